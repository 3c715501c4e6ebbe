"""Operators 11 to 13 against the library or brute force, with nulls, empties, repeats, ties, clashes and long texts."""

import base64
import hashlib
import random
import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import tiktoken

from corpusloom.llm import chunked_bpe, divergence, hard_negatives

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts() -> list:
    rng = random.Random(7)
    bits = ["word", " the", "  ", "\n", " \n", "\t\t", "'re", "'s", "''", "é", "ß", "中文", "՘", " ", " ", "\x1c", "12", "½", "🙂", "<|endoftext|>", "#!", "x" * 40, " " * 30]
    mixed = ["".join(rng.choice(bits) for _ in range(rng.choice([1, 5, 60, 400]))) for _ in range(60)]
    return [None, "", " ", "a", "a" * 5000, " " * 3000 + "x", ("ab " * 700) + "z" * 900 + " end", "é" * 2000, *mixed, mixed[0], mixed[0]]


@pytest.mark.parametrize("chunk,overlap", [(64, 16), (200, 40), (1 << 15, 1 << 10)])
def test_chunked_encoding_equals_the_library(spark, library, chunk, overlap):
    texts = odd_texts()
    docs = spark.createDataFrame([(k, t, "x", k) for k, t in enumerate(texts)], "doc_id long, text string, ids string, row long")
    out = {r.doc_id: list(r.ids) for r in chunked_bpe.encode_documents(spark, docs, RANKS, PATTERN, chunk, overlap).collect()}
    assert out == {k: library.encode_ordinary(t or "") for k, t in enumerate(texts)}


def test_roundtrip_digests(spark, library):
    texts = odd_texts()
    docs = spark.createDataFrame([(None if k == 3 else k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, decoded int")
    rows = {r.doc_id: r for r in chunked_bpe.roundtrip(spark, docs, RANKS, PATTERN, 100, 20).collect()}
    for k, t in enumerate(texts):
        ids, r = library.encode_ordinary(t or ""), rows[None if k == 3 else k]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert chunked_bpe.roundtrip(spark, docs.limit(0), RANKS, PATTERN).count() == 0


def test_a_word_longer_than_the_overlap_is_done_again(spark):
    texts = spark.createDataFrame([(0, "ab " * 50 + "q" * 300 + " tail " * 40), (1, "plain words " * 60)], "row long, text string")
    cuts = chunked_bpe.stitches(chunked_bpe.chunk_boundaries(chunked_bpe.cut_texts(texts, 64, 16), 64, 16, RANKS, PATTERN))
    assert {r.row: r.whole for r in cuts.collect()} == {0: False, 1: True}


def brute_negatives(rows, every=100, most=5):
    import math

    take = []
    for vec_id, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        take.append((vec_id, (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label, [math.floor(256 * x) for x in v]))
    key, out = lambda s: (-s[0], s[1] is None, s[1] or 0), []
    for i, (vec_id, label, v) in enumerate(take):
        if vec_id is None or vec_id % every:
            continue
        scored = [(sum(a * b for a, b in zip(v, w)), other, lab) for j, (other, lab, w) in enumerate(take) if j != i]
        for p in sorted((s for s in scored if s[2] == label), key=key)[:most]:
            near = sorted((s for s in scored if s[2] != label and 80 * p[0] <= 100 * s[0] <= 100 * p[0]), key=key)[:most]
            out += [(vec_id, p[1], k + 1, n[1], p[0], n[0]) for k, n in enumerate(near)]
    return sorted(out, key=str)


def vectors(n: int, dims: int, seed: int):
    rng = random.Random(seed)
    rows = [(k, [rng.gauss(0, 0.3) for _ in range(dims)], rng.randrange(4)) for k in range(n)]
    rows += [(k, rows[100][1][:], 1 + k % 2) for k in range(n, n + 30)]  # one common vector
    rows += [rows[100], rows[200], (None, rows[100][1], 0), (None, rows[0][1], 3)]  # repeated rows and rows without an id
    rows += [(700, None, 1), (800, rows[3][1], None), (900, [0.1, None], 1), (1000, [float("nan")], 1), (1100, [float("inf")], 1), (1200, [], 2), (1300, [0.5], 2), (1400, [0.0] * dims, 3)]
    return rows


@pytest.mark.parametrize("n,dims", [(600, 5), (500, 20)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, n, dims):
    rows = vectors(n, dims, n)
    df = spark.createDataFrame([(*r, 9, "x") for r in rows], "vec_id long, embedding array<double>, label int, row int, score string").repartition(3)
    monkeypatch.setattr(hard_negatives, "BLOCK_BYTES", 1 << 13)  # many blocks
    assert sorted(map(tuple, hard_negatives.mine(spark, df).collect()), key=str) == brute_negatives(rows)


def test_hard_negatives_of_empty_and_opposed_tables(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert hard_negatives.mine(spark, spark.createDataFrame([], schema)).count() == 0
    rows = [(100, [1.0, 0.0], 1), (1, [-1.0, 0.0], 1), (2, [0.0, 1.0], 1), (3, [0.0, -1.0], 2), (4, [-0.5, 0.0], 2)]
    got = hard_negatives.mine(spark, spark.createDataFrame(rows, schema)).collect()
    assert sorted(map(tuple, got)) == brute_negatives(rows) == [(100, 2, 1, 3, 0, 0)]
    with pytest.raises(ValueError):
        hard_negatives.mine(spark, spark.createDataFrame([(100, [1e30], 1)], schema))


def test_partial_index_omits_and_still_finds():
    import numpy as np

    rng = np.random.default_rng(1)
    x, q = np.floor(rng.normal(0, 40, (400, 37))), np.floor(rng.normal(0, 40, (20, 37)))
    for reach in (-1.0, 0.0, 120.0, 200.0):
        index, least = hard_negatives.PartialIndex(x, reach), reach * np.sqrt((q * q).sum(axis=1))
        found = {(a, b): s for a, b, s in zip(*index.search(q, least))}
        assert found == {(a, b): (q @ x.T)[a, b] for a, b in zip(*np.nonzero(q @ x.T >= least[:, None]))}
    assert index.posted[-1] < index.posted[0]


def brute_divergence(docs):
    words, seen, groups = defaultdict(Counter), defaultdict(set), set()
    for k, (text, lang, source) in enumerate(docs):
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or ""):
            w = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in w)
            words[lang, source][w] += 1
            seen[lang, w].add(k)
    kept = {lang: sorted(w for (a, w), d in seen.items() if a == lang and len(d) >= 3) for lang, _ in groups}
    whole = {lang: Counter() for lang in kept}
    for lang, s in groups:
        whole[lang].update({w: n for w, n in words[lang, s].items() if w in kept[lang]})

    def p(count, lang):
        n = sum(count[w] for w in kept[lang])
        return {w: 1 + 10**9 * (count[w] + 1) // (n + len(kept[lang])) for w in kept[lang]}

    out, share, all_ = set(), {g: p(words[g], g[0]) for g in groups}, {lang: p(whole[lang], lang) for lang in kept}
    f = lambda a, b: (a - b) * (a - b) // b
    for lang, s in groups:
        pairs = [(-sum(f(share[lang, s][w], share[lang, o][w]) for w in kept[lang]), o.encode()) for a, o in groups if a == lang and o != s]
        terms = [(-f(share[lang, s][w], all_[lang][w]), w.encode()) for w in kept[lang] if words[lang, s][w] and share[lang, s][w] > all_[lang][w]]
        for part, rows, most in (("pair", pairs, None), ("term", terms, 200)):
            out |= {(lang, s, part, item.decode(), -v, k + 1) for k, (v, item) in enumerate(sorted(rows)[:most])}
    return out


def divergence_docs():
    rng = random.Random(3)
    pool = ["the", "The", "und", "Ünd", "straße", "a", "naïve", "中文字", "x" * 8, "x" * 16, "x" * 64, "x" * 65, "x" * 80, "y" * 70, "abcdefgh", "abcdefghi", "word1word", "it's", "co-op", "🙂ok", *[f"t{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)]]
    docs = [(" ".join(rng.choice(pool) for _ in range(rng.choice([0, 3, 30, 200]))), rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "S2", "ß", None])) for _ in range(150)]
    return [*docs, docs[0], docs[0], (None, "en", "only null"), ("123 456", "zz", "numbers"), (None, "yy", None), ("the " * 3000, "en", "s1")]


@pytest.mark.parametrize("slice_bytes,bucket_rows", [(8 << 20, 100_000), (700, 40)])
def test_divergence_equals_brute_force(spark, monkeypatch, slice_bytes, bucket_rows):
    monkeypatch.setattr(divergence, "SLICE_BYTES", slice_bytes)  # texts longer than a slice, too
    monkeypatch.setattr(divergence, "BUCKET_ROWS", bucket_rows)
    docs = divergence_docs()
    df = spark.createDataFrame([(*d, "clash", 1) for d in docs], "text string, lang string, source string, term string, n int").repartition(4)
    got = divergence.divergence(spark, df).collect()
    assert {tuple(r) for r in got} == brute_divergence(docs) and len(got) == len(set(map(tuple, got)))


def test_divergence_of_an_empty_table_and_merge_join(spark, monkeypatch):
    assert divergence.divergence(spark, spark.createDataFrame([], "text string, lang string, source string")).count() == 0
    monkeypatch.setattr(divergence, "BROADCAST_GROUPS", 0)
    docs = divergence_docs()[:40]
    assert {tuple(r) for r in divergence.divergence(spark, spark.createDataFrame(docs, "text string, lang string, source string")).collect()} == brute_divergence(docs)


def test_shares_are_exact_for_large_counts():
    import numpy as np

    for count, total, terms in ((9 * 10**14, 10**15, 7), (0, 0, 0), (5, 5, 1), (10**12 + 3, 3 * 10**12 + 1, 10**6)):
        assert divergence.shares(np.array([count]), total, terms)[0] == 1 + 10**9 * (count + 1) // max(1, total + terms)


def test_conversations_with_large_ids_are_paired_exactly(spark):
    from corpusloom.llm import preference

    big = 9007199254740995
    turns = spark.createDataFrame([(i, 0, "user", "x") for i in (big, big - 1, -3, -4, 0, None)], "conv_id long, turn long, role string, text string")
    assert {tuple(r) for r in preference.neighbour_pairs(turns).collect()} == {(big >> 1, big - 1, big), (-2, -4, -3), (0, 0, 1)}


def test_ngrams_do_not_depend_on_blocks(monkeypatch):
    import numpy as np

    from corpusloom.llm import langid

    text = "Ein längerer Text, den mehrere Blöcke teilen. " * 8
    whole = np.sort(np.concatenate(list(langid.ngram_buckets(text, 12))))
    monkeypatch.setattr(langid, "BLOCK", 50)
    assert np.array_equal(np.sort(np.concatenate(list(langid.ngram_buckets(text, 12)))), whole)


def test_passages_across_the_blocks_of_a_long_text_go(spark):
    from corpusloom.llm import suffix_dedup

    rng, at = random.Random(9), suffix_dedup.BLOCK
    own = lambda n, k: [f"{k}{rng.randrange(10**9)}" for _ in range(n)]
    passage = own(80, "p")
    head, tail, other = own(at - 30, "h"), own(5000, "t"), own(60, "o")
    docs = spark.createDataFrame([(1, " ".join(head + passage + tail)), (2, " ".join(other + passage))], "doc_id long, text string")
    out = {r.doc_id: r.text.split() for r in suffix_dedup.remove_repeats(spark, docs, suffix_dedup.WORDS.length, suffix_dedup.WORDS).collect()}
    assert out == {1: head + tail, 2: other}


def test_equal_page_ids_keep_their_own_payloads(spark):
    from corpusloom.llm import warc

    a, b = "a" * 1200, "b" * 1200
    pages = spark.createDataFrame([(1, "u", a), (1, "u", b), (2, "v", a)], "page_id long, url string, html string")
    got = {(r.page_id, r.payload_digest, r.record_type, r.refers_to) for r in warc.warc_roundtrip(spark, pages).collect()}
    sha = lambda x: hashlib.sha1(x.encode()).hexdigest()
    assert got == {(1, sha(a), "revisit", 2), (1, sha(b), "response", None), (2, sha(a), "response", None)}
