"""Operators against brute force, and their handling of nulls, repeats, long texts, empty tables and clashing columns."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import bpe, decontam, langid, parity_join, preference, quality, records, sharding, suffix_dedup, warc
from corpusloom.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ("__row", "__stats", "__lang", "symbols_lo", "shard", "slot", "__sd_key", "__sd_spans", "__hs_row", "t", "id", "a.b")


def words(rng, n, vocab=300):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    texts = [words(rng, rng.randrange(25, 120), 5000) for _ in range(30)]
    shared = words(rng, 70, 5000)
    texts += [texts[0], texts[1] + " more", f"{words(rng, 40, 5000)} {shared}", f"{shared} {words(rng, 40, 5000)}", "é日 " * 3000, "", None, "...", "$ % " * 40]
    out = [(k, t, ("en", "de", None)[k % 3], ("s", None)[k % 2], 0 if t is None else len(t)) for k, t in enumerate(texts)]
    return [*out, out[3], (None, texts[5], None, None, 1), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def clashing(docs):
    out = docs
    for k, c in enumerate(CLASHING):
        out = out.withColumn(c, F.concat(F.lit(f"{k}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    return out


def rest(r, columns):
    return tuple(r[c] for c in columns)


@pytest.mark.parametrize("stage", ["quality", "copies", "passages", "leaks"])
def test_stages_keep_extra_columns_whatever_their_names(spark, docs, clashing, stage):
    items = spark.createDataFrame([(1, "w1 w2"), (2, None), (3, "")], "item_id long, text string")
    run = {
        "quality": lambda d: quality.filter_documents(spark, d), "copies": lambda d: parity_join.drop_near_copies(spark, d),
        "passages": lambda d: suffix_dedup.remove_repeats(spark, d, suffix_dedup.WORDS.length, suffix_dedup.WORDS), "leaks": lambda d: decontam.drop_contaminated(spark, d, items),
    }[stage]
    got, plain = run(clashing), run(docs)
    assert got.columns == clashing.columns and plain.columns == docs.columns
    key = lambda r: repr(rest(r, docs.columns))
    got, plain = sorted(got.collect(), key=key), sorted(plain.collect(), key=key)
    assert list(map(key, got)) == list(map(key, plain)) and len(got) > 20
    assert all(r[c] == f"{k}:{'none' if r.doc_id is None else r.doc_id}" for r in got for k, c in enumerate(CLASHING))
    assert run(clashing.limit(0)).collect() == []


def test_shards_beside_clashing_columns(spark, rows, clashing):
    out = sharding.uniform_shards(spark, clashing, 4)
    assert [c for c in out.columns if c not in ("shard", "slot")] == [c for c in clashing.columns if c not in ("shard", "slot")]
    got = out.collect()
    assert sorted(repr(rest(r, ["doc_id", "text"])) for r in got) == sorted(repr(r[:2]) for r in rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert all(sorted(v) == [*range(len(v))] for v in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    for r in sharding.shard_report(spark, clashing).collect():
        assert r.law == "rows" and r.grown_shard is None
    sizes = collections.Counter((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t, *_ in rows)
    assert collections.Counter((r["size"], r.text_crc32) for r in sharding.shard_report(spark, clashing).collect()) == sizes


def test_every_assignment_to_shards_is_as_likely(spark):
    """Over seeds, each row lands in each shard and slot about equally often."""
    d, seen = spark.range(0, 12, 1, 3), collections.Counter()
    for seed in range(40):
        seen.update((r.id, r.shard) for r in sharding.uniform_shards(spark, d, 3, seed).collect())
    assert max(seen.values()) < 30 and len(seen) == 36


def test_language_scores_equal_counting(spark, rows):
    """Counts, log probabilities and scores of whole texts, one n-gram at a time."""
    labelled = [r for r in rows if r[2] is not None and r[1] is not None and zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 5]
    bits, mask = langid.MOST_BUCKET_BITS, (1 << 64) - 1

    def grams(text):
        u = [ord(c) if ord(c) > 127 or c.isalpha() else 32 for c in f" {text.lower()} "]
        for n in langid.ORDERS:
            for i in range(len(u) - n + 1):
                h = (u[i] + (n << 32)) & mask
                for x in u[i + 1 : i + n]:
                    h = (h * int(langid._MIX) & mask) ^ x
                yield (h * int(langid._MIX) & mask) >> (64 - bits)

    counts, share = collections.defaultdict(collections.Counter), collections.Counter(r[2] for r in labelled)
    for r in labelled:
        counts[r[2]].update(grams(r[1]))
    total = {x: sum(c.values()) + langid.ALPHA * (1 << bits) for x, c in counts.items()}
    got = langid.identify(spark, spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, round(r.score, 4), r.lang_pred, r.held_out) for r in got}
    for k, text, *_ in rows:
        held = zlib.crc32(str("" if k is None else k).encode()) % 5 == 0
        if not text or not any(map(str.isalpha, text)):
            assert (k, 0.0, "und", held) in by
            continue
        g = collections.Counter(grams(text))
        score = {x: math.log(share[x] / sum(share.values())) + sum(n * (math.log(counts[x][b] + langid.ALPHA) - math.log(total[x])) for b, n in g.items()) for x in share}
        best = max(sorted(score), key=score.get)
        p = 1 / sum(math.exp(max(-700, s - score[best])) for s in score.values())
        assert any(r[0] == k and r[2] == best and r[3] == held and abs(r[1] - p) < 0.01 for r in by)


def tiles_by_hand(item, doc, least):
    free_i, free_d, out = [True] * len(item), [True] * len(doc), []
    for s in range(min(len(item), len(doc)), least - 1, -1):
        for p in range(len(item) - s + 1):
            for q in range(len(doc) - s + 1):
                if item[p] == doc[q] and item[p : p + s] == doc[q : q + s] and all(free_i[p : p + s]) and all(free_d[q : q + s]):
                    free_i[p : p + s] = free_d[q : q + s] = [False] * s
                    out.append(s)
    return out


def test_leaks_equal_tiling_by_hand(spark):
    rng = random.Random(12)
    items = [(k, words(rng, rng.choice((3, 8, 30)), 40)) for k in range(8)] + [(8, None), (9, " . "), (10, "w1 w2"), (10, "w1 w2")]
    texts = [words(rng, 60, 40) for _ in range(6)]
    for k, t in items[:8]:
        w = t.split()
        texts.append(" ".join([*w[len(w) // 2 :], "x", *w[: len(w) // 2]]) + words(rng, 20, 40))
        texts.append(f"{words(rng, 700, 30)} {' '.join(w[: len(w) * 2 // 3])}")
    docs = [*enumerate([*texts, "", None, "W1, w2!"]), (0, texts[0]), (None, texts[7])]
    want = collections.Counter()
    split = lambda t: re.findall(r"\w+", (t or "").lower())
    for d, t in docs:
        for i, x in items:
            a, b = split(x), split(t)
            tiles = tiles_by_hand(a, b, min(decontam.MIN_TILE, len(a))) if a and b else []
            if tiles and sum(tiles) >= decontam.COVERAGE * len(a):
                want[d, i, sum(tiles), len(tiles), max(tiles)] += 1
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("h", F.lit(1)).withColumn("item_id", F.lit(2))
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contaminated_pairs(spark, d, b).collect()
    assert collections.Counter((r.doc_id, r.item_id, r.n_covered, r.n_tiles, r.longest) for r in got) == want and want
    clean = decontam.drop_contaminated(spark, d, b)
    assert clean.columns == d.columns and clean.count() == sum(all((k, i) != x[:2] for x in want for i in [x[1]]) for k, _ in docs)


def test_records_in_any_order(spark, rows, docs):
    from corpusloom.llm.common import shared_dir

    folder = shared_dir(spark) + "/records"
    index = records.write_records(spark, docs, vocabulary(), folder, partitions=3)
    whole = {(r.doc_id, r.start): r.ids for r in records.read_records(index, folder).collect()}
    assert len(whole) == len(rows) and [k for k, _ in whole].count(None) == 2 and [k for k, _ in whole].count(3) == 2
    starts = sorted(s for _, s in whole)
    assert starts[0] == 0 and [a + len(next(v for (_, s), v in whole.items() if s == a)) // 4 for a in starts[:-1]] == starts[1:]
    some = index.where("pmod(hash(start), 3) = 0").orderBy(F.desc("start"))
    part = {(r.doc_id, r.start): r.ids for r in records.read_records(some, folder, most=64).collect()}
    assert 0 < len(part) < len(whole) and all(whole[k] == v for k, v in part.items())


def test_selected_archive_records(spark):
    from corpusloom.llm.common import shared_dir

    big, long = "x" * 1200, "".join(random.Random(1).choice("abc<>é") for _ in range(400_000))
    rows = [(1, "u", big), (1, "u", big), (2, "v", long), (3, "w", long), (4, None, ""), (None, "n", None), (5, "a\r\nb", "small")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(0)).withColumn("size", F.lit(0))
    folder = shared_dir(spark) + "/warc"
    index = warc.write_archives(spark, warc.with_types(pages), folder)
    got = warc.read_archives(index, folder).collect()
    assert len(got) == len(rows)
    assert sorted((str(r.page_id), r.record_type, str(r.refers_to)) for r in got) == sorted([("1", "response", "None")] * 2 + [("2", "revisit", "3"), ("3", "response", "None"), ("4", "response", "None"), ("None", "response", "None"), ("5", "response", "None")])
    assert {r.payload.decode() for r in got if r.page_id == 3} == {long} and {r.payload_bytes for r in got if r.page_id == 2} == {len(long.encode())}
    chosen = warc.read_archives(index.where("url IN ('w', 'n')").orderBy(F.desc("offset")), folder).collect()
    assert sorted((str(r.page_id), r.url) for r in chosen) == [("3", "w"), ("None", "n")]


def test_preferences_of_long_conversations(spark):
    t = [(0, k, "user", "same") for k in range(300)] + [(1, k, "user", "same") for k in range(300)] + [(0, 300, "assistant", "good"), (1, 300, "assistant", "bad")]
    turns = spark.createDataFrame(t, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("x")).withColumn("pair_id", F.lit(7))
    got = {(r.section, r.part): (r.n_turns, r.text, r.mask) for r in preference.format_preferences(turns, preference.neighbour_pairs(turns)).collect()}
    assert got["prompt", 0][0] == 256 and got["prompt", 1][0] == 44 and got["chosen", 1][:2] == (1, "<|assistant|>\ngood<|end|>\n") and len(got) == 4
    assert preference.format_preferences(turns.limit(0), preference.neighbour_pairs(turns.limit(0))).count() == 0


def test_ids_of_any_table(spark, docs, clashing):
    name = bpe.build_lexicon(spark, docs, vocabulary(), lexicon_size=50)
    out = bpe.encode_documents(clashing.withColumn("ids", F.lit("old")), vocabulary(), name)
    back = bpe.decode_documents(out, vocabulary())
    assert set(back.columns) == {*clashing.columns, "ids", "decoded"}
    assert all((r.text or "") == r.decoded and r["a.b"] for r in back.collect())
    assert bpe.decode_documents(spark.createDataFrame([(None,)], "ids binary"), vocabulary()).head().decoded is None


def test_pipeline_equals_its_stages_by_hand(spark, docs, rows, tmp_path):
    """All five stages over a small table, each one's decision recomputed on what the one before kept."""
    import corpus_pipeline

    rng = random.Random(13)
    item = words(rng, 40, 9000)
    more = [(200, f"{item} {words(rng, 30, 9000)}", "en", "s", 1), (201, " ".join(item.split()[20:] + item.split()[:20]) + " end", "en", "s", 1)]
    docs.union(spark.createDataFrame(more, SCHEMA)).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = [*rows, *more]
    # 1: here every adaptive group is small and alike, so the base rules decide, and symbols far from the median.
    w = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")

    def passes(t):
        x, g = w(t), collections.Counter(tuple(w(t)[i : i + 8]) for i in range(len(w(t)) - 7))
        again = {j for i in range(len(x) - 7) if g[tuple(x[i : i + 8])] > 1 for j in range(i, i + 8)}
        return len(x) >= 20 and 100 * len(again) <= 30 * len(x)

    kept = [r for r in kept if passes(r[1])]
    # 2: one row of each group of five-word sets that are 0.8 alike.
    sets = [{tuple(w(r[1].lower())[i : i + 5]) for i in range(len(w(r[1])) - 4)} for r in kept]
    label = list(range(len(kept)))
    for _ in kept:
        for a in range(len(kept)):
            for b in range(len(kept)):
                if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    groups = collections.defaultdict(list)
    for k, r in enumerate(kept):
        groups[label[k]].append(r)
    kept = [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]
    # 3: runs of more than fifty words that occur again go, white space around them stays.
    runs = collections.Counter(tuple(w(r[1])[i : i + 51]) for r in kept for i in range(len(w(r[1])) - 50))
    cut = []
    for r in kept:
        x = w(r[1])
        gone = {j for i in range(len(x) - 50) if runs[tuple(x[i : i + 51])] > 1 for j in range(i, i + 51)}
        cut.append((r, [v for k, v in enumerate(x) if k not in gone]))
    # 4: no document that covers the benchmark item, in whatever order.
    cut = [(r, x) for r, x in cut if sum(tiles_by_hand(item.split(), x, 5)) < 0.6 * 40]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(repr(r.doc_id) for r in out) == sorted(repr(r[0]) for r, _ in cut) and len(cut) < len(kept) < len(rows)
    # 5: lossless ids.
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary())
    texts = {r.doc_id: tok.decode(np.frombuffer(r.ids, "<u4").tolist(), skip_special_tokens=False) for r in out}
    assert all(r.lossless and r.n_tokens * 4 == len(r.ids) for r in out) and {k: w(t) for k, t in texts.items()} == {r[0]: x for r, x in cut}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
