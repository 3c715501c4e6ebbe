"""Each training-data operator against a brute-force version, with nulls, ties, repeats, empty tables and long texts."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import bpe, decontam, langid, parity_join, preference, quality, records, sharding, suffix_dedup, warc
from corpusloom.llm.graph import connected_components
from corpusloom.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocab=300):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = [words(rng, rng.randrange(3, 200), 4000) for _ in range(40)]
    near = []
    for t in base[:15]:
        w = t.split(" ")
        if len(w) > 20:
            w[len(w) // 2] = "changed"
        near.append(" ".join(w))
    passage = words(rng, 120, 4000)
    texts = [*base, *near, *near[:3], passage, f"a b {passage} c", f"x\n{passage} {passage}", "A " * 30_000, "é日本 𝒳 " * 40, "", None, None, "!!", "one", "one two three", "One two three", "a  b \n\n c\t'll <|endoftext|> it's"]
    return [(k, t, "en" if k % 3 else "de", "s", 0) for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80), (1, 75), (3, 100)])
def test_jaccard_components(spark, docs, rows, empty, width, percent):
    sets = {}
    for k, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[k] = {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
    label = {k: k for k in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                i = len(sets[a] & sets[b])
                if sets[a] and 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i):
                    label[a] = label[b] = min(label[a], label[b])
    got = parity_join.jaccard_components(spark, docs, width, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {k: (len(s), label[k]) for k, s in sets.items()}
    assert parity_join.jaccard_components(spark, empty, width, percent).count() == 0
    assert {r.doc_id for r in parity_join.drop_near_copies(spark, docs, width, percent).collect()} == {k for k in sets if label[k] == k}


def test_one_row_of_each_group_stays(spark):
    import corpus_pipeline

    rng = random.Random(8)
    twice, null, mixed, other, last = (words(rng, 150, 4000) for _ in range(5))
    rows = [(7, other), (5, twice), (5, twice), (None, null), (None, null), (9, mixed), (2, mixed), (2, other), (None, last), (8, last), (4, ""), (4, "")]
    d = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], SCHEMA).repartition(3)
    key = lambda r: (str(r[0]), r[1])
    want = sorted([(5, twice), (None, null), (2, mixed), (2, other), (8, last), (4, ""), (4, "")], key=key)
    kept = corpus_pipeline.near_copies(spark, d, "")
    assert kept.columns == d.columns and sorted(((r.doc_id, r.text) for r in kept.collect()), key=key) == want
    assert sorted(((r.doc_id, r.text) for r in corpus_pipeline.repeated_passages(spark, kept, "").collect()), key=key) == want


def test_thresholds_beyond_the_bands_are_refused(spark, docs):
    for width, percent in ((0, 80), (5, 74), (5, 101)):
        with pytest.raises(ValueError):
            parity_join.jaccard_components(spark, docs, width, percent)


@pytest.mark.parametrize("percent", [75, 80, 85, 93, 100])
def test_sizes_of_linked_sets_share_a_band(percent):
    firsts, blocks, slack = parity_join.bands(percent)
    for small in [*range(1, 3000), *range(3000, 10**6, 9973)]:
        large = 100 * small // percent  # the largest set that the smaller can link with
        a, b = (int(np.searchsorted(firsts, n, side="right")) - 1 for n in (small, large))
        assert b == a or b == a + 1 and small * 100 >= percent * firsts[b]
        t = small + large
        assert t - 2 * -(-percent * t // (100 + percent)) < blocks[b] - slack[b]


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80)])
def test_large_groups_lose_no_link(spark, width, percent):
    rng = random.Random(3)
    chain, w = [], [f"v{k}" for k in range(80)]
    for _ in range(60):  # neighbours are linked, distant ones are not
        chain.append(" ".join(w))
        w[rng.randrange(80)] = f"n{rng.randrange(10**6)}"
    copies = [" ".join([f"c{k}" for k in range(100)] + [f"tail{j}"]) for j in range(60)]
    d = spark.createDataFrame(list(enumerate([*chain, *copies])), "doc_id long, text string")
    sets = [parity_join.shingle_set(t, width) for t in [*chain, *copies]]
    label = list(range(len(sets)))
    for _ in range(60):
        for a in range(len(sets)):
            for b in range(a):
                i = len(np.intersect1d(sets[a], sets[b]))
                if 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i):
                    label[a] = label[b] = min(label[a], label[b])
    assert {r.doc_id: r.component_id for r in parity_join.jaccard_components(spark, d, width, percent).collect()} == dict(enumerate(label))


def test_rows_without_id_still_link(spark):
    base = [f"w{k}" for k in range(100)]
    new = [f"x{k}" for k in range(60)]
    rows = [(5, " ".join(base[:-6] + new[:6])), (None, " ".join(base)), (3, " ".join(new[:6] + base[6:])), (None, "alone in the world today"), (9, "A B c d"), (4, "a b C D"), (4, " ".join(base[:40] + new))]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("x")).withColumn("t", F.lit(1)).repartition(3)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in parity_join.jaccard_components(spark, d, 4, 85).collect()), key=str)
    assert got == sorted([(5, 97, 3), (None, 97, 3), (3, 97, 3), (None, 2, None), (9, 1, 4), (4, 1, 4), (4, 97, 4)], key=str)


def test_sketch_bound_holds():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a = np.unique(rng.integers(0, 2**63, 60).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.integers(0, 8) :], rng.integers(0, 2**63, 3).astype(np.uint64)]))
        assert int(np.bitwise_count(parity_join.folded(a) ^ parity_join.folded(b)).sum()) <= len(np.setxor1d(a, b))
        for x, y in ((a, b), (a, a[:20]), (b, a[:0]), (a, a[:1])):
            assert parity_join.hamming(parity_join.wide_sketch(x), parity_join.wide_sketch(y)) <= len(np.setxor1d(x, y))
    far = [np.unique(rng.integers(0, 2**63, 5000).astype(np.uint64)) for _ in range(2)]
    assert parity_join.hamming(*map(parity_join.wide_sketch, far)) > 3000


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(50)] + [(100, 200), (7, 7)], "a long, b long")
    got = {r.id: r.component for r in connected_components(spark, links).collect()}
    assert got == {k: 0 for k in range(51)} | {100: 100, 200: 100}


@pytest.mark.parametrize("crowded", [2000, 1])
def test_repeated_passages(spark, docs, rows, empty, monkeypatch, crowded):
    monkeypatch.setattr(suffix_dedup, "CROWDED", crowded)  # 1: every group is split
    data = {k: (t or "").encode() for k, t, *_ in rows}
    seen = collections.Counter(d[i : i + 400] for d in data.values() for i in range(len(d) - 399))
    got = {r.doc_id: r for r in suffix_dedup.repeat_report(spark, docs).collect()}
    assert len(got) == len(data)
    for k, d in data.items():
        mark = np.zeros(len(d) + 1, int)
        for i in range(len(d) - 399):
            if seen[d[i : i + 400]] > 1:
                mark[i] += 1
                mark[i + 400] -= 1
        gone = np.cumsum(mark)[: len(d)] > 0
        kept = bytes(np.frombuffer(d, np.uint8)[~gone])
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        assert (got[k].n_bytes, got[k].n_removed, got[k].n_spans, got[k].kept_sha256) == (len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    dense = re.compile("[\u3000-\u9fff\U00020000-\U0010ffff]|[^\x20\x09-\x0d\u3000-\u9fff\U00020000-\U0010ffff]+")
    cut = {k: dense.findall(t or "") for k, t, *_ in rows}
    runs = collections.Counter(tuple(w[i : i + 51]) for w in cut.values() for i in range(len(w) - 50))
    for k, w in cut.items():
        gone = {j for i in range(len(w) - 50) if runs[tuple(w[i : i + 51])] > 1 for j in range(i, i + 51)}
        assert got[k].n_passage_words == len(gone)
    assert suffix_dedup.repeat_report(spark, empty).count() == 0
    assert set(suffix_dedup.remove_repeats(spark, docs.withColumn("key", docs.doc_id)).columns) == {*docs.columns, "key"}


def test_passages_of_more_than_fifty_words(spark, rows):
    import corpus_pipeline

    rng = random.Random(9)
    shared, short, scattered = (" ".join(words(rng, n, 4000).split()) for n in (55, 50, 60))
    kana = "".join(chr(0x3042 + rng.randrange(80)) for _ in range(60))
    a, b = (words(rng, 90, 10**6) for _ in "ab")
    new = [f"{a}\n{shared} {b}", f"{b[:200]} x {shared}\t{a[:200]}", f"q {short} r", f"s {short} t", scattered + " u", "v\n" + scattered.replace(" ", "\n  "), f"abc{kana} d", f"é {kana}zz"]
    d = spark.createDataFrame([*rows, *((100 + k, t, "en", "s", len(t)) for k, t in enumerate(new))], SCHEMA)
    dense = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3000-\u9fff\U00020000-\U0010ffff]|[^\x20\x09-\x0d\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3000-\u9fff\U00020000-\U0010ffff]+")
    cut = {r.doc_id: list(dense.finditer(r.text or "")) for r in d.collect()}
    runs = collections.Counter(tuple(m[0] for m in w[i : i + 51]) for w in cut.values() for i in range(len(w) - 50))
    want = {}
    for r in d.collect():
        w, text, gone = cut[r.doc_id], r.text, set()
        for i in range(len(w) - 50):
            if runs[tuple(m[0] for m in w[i : i + 51])] > 1:
                gone.update(range(i, i + 51))
        for i in sorted(gone, reverse=True):
            if i + 1 not in gone:
                end = w[i].end()
            if i - 1 not in gone:
                text = text[: w[i].start()] + text[end:]
        want[r.doc_id] = text
    assert want[100] == f"{a}\n {b}" and want[102] == new[2] and want[104] == " u" and want[106] == "abc d"
    got = corpus_pipeline.repeated_passages(spark, d, "").collect()
    assert {r.doc_id: r.text for r in got} == want
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got)


def test_prefix_intervals_are_the_tree():
    assert sorted(suffix_dedup.prefix_intervals(np.array([3, 5, 0, 2]), 5)) == [(2, 3, 5), (3, 0, 3), (5, 1, 3)]


def test_encoding_equals_the_library(spark, docs, rows, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary())
    ids = {k: tok.encode(t or "", add_special_tokens=False).ids for k, t, *_ in rows}
    pack = lambda x: np.array(x, "<u4").tobytes()
    for size in (5, 50_000):
        got = {r.doc_id: r for r in bpe.bpe_roundtrip(spark, docs, vocabulary(), size).collect()}
        for k, i in ids.items():
            assert (got[k].n_tokens, got[k].ids_sha256, got[k].decoded_sha256) == (len(i), hashlib.sha256(pack(i)).hexdigest(), hashlib.sha256(tok.decode(i, skip_special_tokens=False).encode()).hexdigest())
    at = 0
    got = {r.doc_id: r for r in records.binary_output(spark, docs, vocabulary()).collect()}
    for k in sorted(ids):
        i = [*ids[k], 0]
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (at, len(i), zlib.crc32(pack(i)))
        at += len(i)
    assert bpe.bpe_roundtrip(spark, empty, vocabulary()).count() == 0 and records.binary_output(spark, empty, vocabulary()).count() == 0


def test_transducer(tmp_path):
    table = {b"tap": [1], b"taps": [2, 3], b"top": [4], b"tops": [5], b"s": [6], bytes([0, 255]): [7]}
    bpe.write_lexicon(bpe.compile_lexicon(table), str(tmp_path / "x"))
    lex = bpe.Lexicon(str(tmp_path / "x"))
    assert [np.frombuffer(x, "<u4").tolist() for x in lex.lookup_many([*table])] == [*table.values()]
    assert lex.lookup_many([b"", b"ta", b"top", b"tapsx", b"z"]) == [None, None, np.array([4], "<u4").tobytes(), None, None]
    assert len(lex.final) < 8  # suffixes are shared
    v = bpe.Vocabulary(vocabulary())
    long = "".join(random.Random(1).choice("abcde") for _ in range(500)).encode()
    from tokenizers import Tokenizer

    want = Tokenizer.from_file(vocabulary()).encode(long.decode(), add_special_tokens=False).ids
    assert v.merge(long) == want
    rng = random.Random(2)
    many = [b"", long, *(bytes(rng.choice(b"aeinst \xc3\xa9") for _ in range(rng.randrange(1, 70))) for _ in range(300))]
    assert [np.frombuffer(x, "<u4").tolist() for x in v.merge_many(many)] == [v.merge(w) for w in many]


def test_encoder_in_small_blocks(monkeypatch):
    from tokenizers import Tokenizer

    tok, v, rng = Tokenizer.from_file(vocabulary()), bpe.Vocabulary(vocabulary()), random.Random(6)
    alphabet = ["a", "bc", "don't", "é", "日", "9", " ", " ", " ", "\n", "\t", "  ", ".", "!?", "'s", "<|endoftext|>", "\u2003", "x" * 40, "_"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(400)] + [None, "", " ", "\n"]
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 16)  # segments and blocks of a few characters, memos that forget all the time
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 20)
    monkeypatch.setattr(bpe, "BLOCK_TOKENS", 7)
    ids = bpe.Encoder(v.merge_many, v.special, v.split).encode_many(texts)
    want = [tok.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == want
    assert bpe.Decoder(v).decode_many(ids) == [tok.decode(i, skip_special_tokens=False) for i in want]


def test_broken_records_are_noticed():
    data = records.frame(b"abc")
    assert records.unframe(data) == (b"abc", len(data))
    with pytest.raises(ValueError):
        records.unframe(data[:-6] + b"x" + data[-5:])


def test_quality(spark, docs, rows, empty):
    def brute(t):
        w, lines, seen, dup = re.findall(r"[^\x20\x09-\x0D]+", t), [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)], set(), 0
        g = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        c = {j for i in range(len(w) - 7) if g[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        for x in lines:
            dup += x in seen
            seen.add(x)
        return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), dup, len(c)

    got = {r.doc_id: r for r in quality.quality_report(spark, docs).collect()}
    for k, t, *_ in rows:
        assert tuple(got[k][1:6]) == brute(t or "")
    assert {r.doc_id for r in quality.filter_documents(spark, docs).collect()} == {k for k, r in got.items() if r.kept}
    assert quality.quality_report(spark, empty).count() == 0


def test_sharding(spark, docs, rows, empty):
    got = sharding.shard_report(spark, docs.union(docs.limit(5))).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert len(got) == len(rows) + 5 and set(by) <= set(range(16))
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and all(sorted(v) == [*range(len(v))] for v in by.values())
    assert sharding.shard_report(spark, empty).count() == 0
    m = sharding.communication_matrix([5, 0, 9], [4, 5, 5], 1)
    assert m.sum(axis=1).tolist() == [5, 0, 9] and m.sum(axis=0).tolist() == [4, 5, 5]
    draws = [sharding.hypergeometric(np.random.default_rng(k), 10**9, 10**9, 1000) for k in range(300)]
    assert abs(np.mean(draws) - 500) < 5 and 10 < np.std(draws) < 22


def test_language_id(spark, empty):
    rng = random.Random(2)
    text = {"en": "the and of with thing", "de": "und der schön über nicht", "fr": "été le où ça vous"}
    rows = [(k, " ".join(rng.choices(text[x].split(), k=12)), x) for k in range(300) for x in [rng.choice(list(text))]] + [(900, None, "en"), (901, "12 !", "de"), (902, "the and", None)]
    got = {r.doc_id: r for r in langid.identify(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[k].lang_pred == x for k, _, x in rows[:300]) and all(0 <= r.score <= 1 for r in got.values())
    assert [got[k].lang_pred for k in (900, 901, 902)] == ["und", "und", "en"]
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in got.items())
    assert langid.identify(spark, empty).count() == 0


def test_decontamination(spark, empty):
    rng = random.Random(4)
    item = words(rng, 40).split()
    shuffled = item[20:] + ["filler"] + item[:20]
    d = spark.createDataFrame([(1, "x y " + " ".join(item) + "!"), (2, " ".join(shuffled).upper()), (3, " ".join(item[:15])), (4, words(rng, 300)), (5, None), (6, ""), (7, "short Item")], "doc_id long, text string")
    b = spark.createDataFrame([(10, " ".join(item)), (11, None), (12, "..."), (13, "short item")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_covered, r.n_tiles) for r in decontam.contaminated_pairs(spark, d, b).collect()}
    assert got == {(1, 10): (40, 1), (2, 10): (40, 2), (7, 13): (2, 1)}
    assert {r.doc_id for r in decontam.drop_contaminated(spark, d, b).collect()} == {3, 4, 5, 6}
    assert decontam.contaminated_pairs(spark, empty, b).count() == 0 and decontam.contaminated_pairs(spark, d, b.limit(0)).count() == 0


def test_tiles_are_greedy():
    a, b = np.array([1, 2, 3, 4, 5, 6, 7, 8]), np.array([5, 6, 7, 8, 9, 1, 2, 3, 4, 5])
    assert decontam.greedy_tiles(a, b, 2) == [(0, 5, 5), (5, 1, 3)]


def brute_force_tiles(item, doc, least):
    free_i, free_d, out = [True] * len(item), [True] * len(doc), []
    for s in range(min(len(item), len(doc)), least - 1, -1):
        for p in range(len(item) - s + 1):
            for q in range(len(doc) - s + 1):
                if all(free_i[p : p + s]) and all(free_d[q : q + s]) and item[p : p + s] == doc[q : q + s]:
                    free_i[p : p + s] = free_d[q : q + s] = [False] * s
                    out.append((p, q, s))
    return out


@pytest.mark.parametrize("run", [17, 19, 20, 30])
def test_long_runs_are_one_tile(spark, run):
    rng = random.Random(run)
    item = list(range(30))
    doc = [rng.randrange(30) for _ in range(300)]
    doc[100 : 100 + run] = item[:run]
    tiles = decontam.greedy_tiles(np.array(item), np.array(doc), 5)
    assert tiles == brute_force_tiles(item, doc, 5) and tiles[0][2] >= run
    text = lambda ids: " ".join(f"w{k}" for k in ids)
    d = spark.createDataFrame([(1, text(doc))], "doc_id long, text string")
    b = spark.createDataFrame([(10, text(item))], "item_id long, text string")
    leaks = sum(t[2] for t in tiles) >= 0.6 * 30
    assert decontam.drop_contaminated(spark, d, b).count() == (0 if leaks else 1)


def test_preferences(spark):
    t = [(0, 0, "user", "q"), (0, 1, "assistant", "good"), (1, 0, "user", "q"), (1, 1, "assistant", "bad"), (1, 2, "user", None), (2, 0, "user", "same"), (3, 0, "user", "same"), (3, 0, "user", "same"), (4, 0, "user", "alone"), (None, 0, "user", "x"), (6, None, "user", "x")]
    turns = spark.createDataFrame(t, "conv_id long, turn long, role string, text string")
    got = {(r.pair_id, r.section): (r.text, r.mask) for r in preference.format_preferences(turns, preference.neighbour_pairs(turns)).collect()}
    assert got == {
        (0, "prompt"): ("<|user|>\nq<|end|>\n", ""), (0, "chosen"): ("<|assistant|>\ngood<|end|>\n", "14:26"),
        (0, "rejected"): ("<|assistant|>\nbad<|end|>\n<|user|>\n<|end|>\n", "14:25"), (1, "prompt"): ("<|user|>\nsame<|end|>\n", ""),
    }


def test_warc(spark):
    big = "é" * 600
    rows = [(1, "u", big), (2, "u", big), (3, None, "small"), (4, "v", "small"), (5, "w", None), (None, "n", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.warc_roundtrip(spark, pages).collect()}
    sha = lambda t: hashlib.sha1(t.encode()).hexdigest()
    assert got == {1: (1200, sha(big), "revisit", 2), 2: (1200, sha(big), "response", None), 3: (5, sha("small"), "response", None), 4: (5, sha("small"), "response", None), 5: (0, sha(""), "response", None), None: (1200, sha(big), "revisit", 2)}
    assert warc.warc_roundtrip(spark, pages.limit(0)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, sf).collect()
    ids = {r.doc_id for r in out}
    assert len(out) == len(ids) > 50 and all(r.lossless for r in out)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    leaked = {r.doc_id for r in decontam.contaminated_pairs(spark, docs, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert not ids & leaked
