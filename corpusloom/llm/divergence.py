"""Operator 13: how the sources of a language differ in their words, counted by sorting token-start pointers.

A task takes the UTF-8 bytes of its Arrow batches as they lie, marks the first byte of every word as a pointer and sorts
the pointers of a slice by multikey quicksort: eight bytes of each word are compared as one number, each partition is
sorted by the next eight, and words of more than 64 bytes are finished by plain comparison. Equal runs are the terms of
the slice; their lengths are occurrences, and their distinct documents the document frequency, by (lang, source). Slices
send one row per group and term, so a hot word or source shrinks before anything is shuffled.

The report compares smoothed shares p = 1 + floor(10^9 (count + 1) / (N + V)) of the terms that a language keeps. Sources
are compared in buckets of terms: a bucket is one bounded matrix of sources by terms, and what leaves it is one number
per pair of sources. All arithmetic is on whole numbers (counts up to 9 * 10^15).

Null texts, languages and sources count as ''. A text without words makes its group occur, nothing more. Repeated rows
are documents of their own. Texts of any length are cut into slices between words; their document still counts once. An
empty table gives an empty report. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import forget, shared_dir, small_batches, written

#: Bytes of text whose pointers are sorted together; bytes of a word that are compared as numbers.
SLICE_BYTES, WIDE = 8 << 20, 64
#: Rows (source and term) of a bucket on average; groups whose totals are broadcast at most.
BUCKET_ROWS, BROADCAST_GROUPS = 100_000, 20_000
SCALE = 1_000_000_000
COUNTS = "lang string, source string, term string, n long, df long"

#: What a byte is in a word: itself, a lower-cased letter, or 0 for what separates words.
_BYTE = np.arange(256, dtype=np.uint8)
_BYTE[:128] = [b if 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 0 for b in range(128)]


def word_pointers(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of every word in bytes that ``_BYTE`` has mapped."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], data != 0, [False]]).view(np.int8)))
    return edge[::2], edge[1::2]


def sort_pointers(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, run): pointers in an order in which equal words lie together, and the number of each one's run of equal words."""
    padded = np.concatenate([data, np.zeros(WIDE + 8, np.uint8)])
    eights = np.lib.stride_tricks.sliding_window_view(padded, 8)
    order, run, done = np.arange(len(start)), np.zeros(len(start), np.int64), []
    runs, mask = 0, np.concatenate([np.zeros(1, np.uint64), np.uint64(2**64 - 1) << np.arange(56, -1, -8).astype(np.uint64)])
    for at in range(0, WIDE, 8):
        if not len(order):
            break
        s, left = start[order] + at, np.minimum(end[order] - start[order] - at, 8)
        key = np.ascontiguousarray(eights[np.minimum(s, len(data))]).view(">u8").ravel().astype(np.uint64) & mask[np.maximum(left, 0)]
        by = np.argsort(key, kind="stable") if at == 0 else np.lexsort((key, run))
        order, key, before, left = order[by], key[by], run[by], end[order[by]] - start[order[by]] - at
        new = np.ones(len(order), bool)
        new[1:] = (key[1:] != key[:-1]) | (before[1:] != before[:-1])
        run = np.cumsum(new) - 1 + runs
        # A word that ends here differs from all longer ones by the zeros behind it.
        over = left < 8
        done.append((order[over], run[over]))
        runs = int(run[-1]) + 1
        order, run = order[~over], run[~over]
    if len(order):
        words = [data[start[i] : end[i]].tobytes() for i in order]
        names = {w: runs + k for k, w in enumerate(dict.fromkeys(words))}
        done.append((order, np.array([names[w] for w in words], np.int64)))
    if not done:
        return order, run
    order, run = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
    by = np.argsort(run, kind="stable")
    return order[by], run[by]


def count_slice(data: np.ndarray, start: np.ndarray, end: np.ndarray, doc: np.ndarray, group: np.ndarray) -> list[tuple[int, bytes, int, int]]:
    """(group, term, occurrences, documents) of the words of a slice; ``doc`` per word, ``group`` per document."""
    order, run = sort_pointers(data, start, end)
    if not len(order):
        return []
    doc = doc[order]
    by = np.lexsort((doc, group[doc], run))
    order, run, doc = order[by], run[by], doc[by]
    g = group[doc]
    new = np.ones(len(order), bool)
    new[1:] = (run[1:] != run[:-1]) | (g[1:] != g[:-1])
    first = np.flatnonzero(new)
    once = np.ones(len(order), np.int64)
    once[1:] = (doc[1:] != doc[:-1]) | new[1:]
    n, df = np.diff(np.append(first, len(order))), np.add.reduceat(once, first)
    raw, at = data.tobytes(), order[first]
    return [(a, raw[s:e], b, c) for a, s, e, b, c in zip(g[first].tolist(), start[at].tolist(), end[at].tolist(), n.tolist(), df.tolist())]


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, df) by slice: occurrences and documents; a group without words gives one row with a null term."""

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        forget()
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]

        def out(rows: list, names: list) -> Iterator:
            for at in range(0, len(rows), 50_000):
                cols = list(zip(*((*names[g], t, n, df) for g, t, n, df in rows[at : at + 50_000])))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], kinds[0]), pa.array(cols[1], kinds[1]), pa.array(cols[2], pa.binary()).cast(kinds[2]), pa.array(cols[3], kinds[3]), pa.array(cols[4], kinds[4])], [x.split(" ")[0] for x in COUNTS.split(", ")])

        def long_text(text: np.ndarray, name: tuple) -> Iterator:
            sums: dict[bytes, int] = {}
            at = 0
            while at < len(text):
                to = min(at + SLICE_BYTES, len(text))
                while to < len(text) and _BYTE[text[to]]:  # up to the end of the word
                    to += 1
                data = _BYTE[text[at:to]]
                start, end = word_pointers(data)
                for _, term, n, _ in count_slice(data, start, end, np.zeros(len(start), np.int64), np.zeros(1, np.int64)):
                    sums[term] = sums.get(term, 0) + n
                at = to
            yield from out([(0, t, n, 1) for t, n in sums.items()] or [(0, None, 0, 0)], [name])

        def slice_(parts: list[np.ndarray], names_of: list[tuple]) -> Iterator:
            names = list(dict.fromkeys(names_of))
            number = {x: k for k, x in enumerate(names)}
            group = np.array([number[x] for x in names_of], np.int64)
            data = _BYTE[np.concatenate([x for p in parts for x in (p, np.zeros(1, np.uint8))])]
            start, end = word_pointers(data)
            doc = np.searchsorted(np.cumsum([len(p) + 1 for p in parts]), start, side="right")
            rows = count_slice(data, start, end, doc, group)
            yield from out([(k, None, 0, 0) for k in range(len(names))] + rows, names)

        parts, names, held = [], [], 0
        for b in batches:
            lang, source = (b.column(k).fill_null("").to_pylist() for k in (0, 1))
            text = b.column(2).fill_null("").cast(pa.large_string())
            ends = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, text.offset * 8)
            body = np.frombuffer(text.buffers()[2] or b"", np.uint8)
            for k, name in enumerate(zip(lang, source)):
                piece = body[ends[k] : ends[k + 1]]
                if len(piece) > SLICE_BYTES:
                    yield from long_text(piece, name)
                    continue
                parts.append(piece)
                names.append(name)
                held += len(piece) + 1
                if held >= SLICE_BYTES:
                    yield from slice_(parts, names)
                    parts, names, held = [], [], 0
        if parts:
            yield from slice_(parts, names)

    return docs.select("lang", "source", "text").mapInArrow(run, COUNTS)


def shares(count: np.ndarray, total: int, terms: int) -> np.ndarray:
    """p of every count, by long division in steps of a thousand."""
    whole, left = np.divmod(count + 1, max(1, total + terms))
    for _ in range(3):
        digit, left = np.divmod(left * 1000, max(1, total + terms))
        whole = whole * 1000 + digit
    return whole + 1


def _near(spark: SparkSession, df: DataFrame, groups: int) -> DataFrame:
    """The totals of groups: broadcast up to a proven number of rows, else joined by sort and merge."""
    return F.broadcast(df) if groups <= BROADCAST_GROUPS else df.hint("merge")


def divergence(spark: SparkSession, docs: DataFrame, least_docs: int = 3, most_terms: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank: ``pair`` rows say how far a source is from every other source of its language,
    ``term`` rows which kept terms it has too often."""
    small_batches(spark)
    c = F.col
    counts = written(spark, term_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df")), shared_dir(spark))
    by_term = Window.partitionBy("lang", "term")
    kept = counts.where("term IS NOT NULL").select("lang", "source", "term", "n", F.sum("n").over(by_term).alias("all_n"), F.sum("df").over(by_term).alias("docs"))
    kept = written(spark, kept.where(c("docs") >= least_docs).drop("docs"), shared_dir(spark))
    langs = kept.groupBy("lang").agg(F.count_distinct("term").alias("terms"), F.sum("n").alias("lang_n"))
    group_n = kept.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    groups = counts.select("lang", "source").distinct().join(group_n.hint("merge"), ["lang", "source"], "left").join(langs.hint("merge"), "lang", "left")
    groups = written(spark, groups.select("lang", "source", *(F.coalesce(x, F.lit(0)).alias(x) for x in ("group_n", "terms", "lang_n"))), shared_dir(spark))
    n_groups = groups.count()
    return _pairs(spark, kept, groups).unionByName(_terms(spark, kept, groups, n_groups, most_terms))


def _terms(spark: SparkSession, kept: DataFrame, groups: DataFrame, n_groups: int, most: int) -> DataFrame:
    c = F.col
    # Decimals: 10^9 times a count may not fit in a long.
    share = lambda n, total: F.expr(f"1 + cast((cast({n} as decimal(20,0)) + 1) * {SCALE} div (cast({total} as decimal(20,0)) + terms) as long)")
    rows = kept.join(_near(spark, groups, n_groups), ["lang", "source"])
    rows = rows.select("lang", "source", c("term").alias("item"), share("n", "group_n").alias("p"), share("all_n", "lang_n").alias("q")).where("p > q")
    w = Window.partitionBy("lang", "source").orderBy(c("value").desc(), "item")
    ranked = rows.select("lang", "source", "item", F.expr("(p - q) * (p - q) div q").alias("value")).withColumn("rank", F.row_number().over(w)).where(c("rank") <= most)
    return ranked.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")


def _pairs(spark: SparkSession, kept: DataFrame, groups: DataFrame) -> DataFrame:
    import math

    c = F.col
    buckets = max(1, math.ceil(kept.count() / BUCKET_ROWS))

    def compare(key: tuple, cells, sources):
        import pandas as pd

        if not len(sources):
            return pd.DataFrame({"lang": [], "source": [], "item": [], "value": []})
        names = sources["source"].tolist()
        at = {x: k for k, x in enumerate(names)}
        terms, _ = pd.factorize(cells["term"])
        width = int(terms.max()) + 1 if len(terms) else 0
        n = np.zeros((len(names), width), np.int64)
        n[cells["source"].map(at).to_numpy(np.int64), terms] = cells["n"].to_numpy(np.int64)
        p = np.stack([shares(row, int(t), int(v)) for row, t, v in zip(n, sources["group_n"], sources["terms"])])
        out = []
        for k, name in enumerate(names):
            value = np.zeros(len(names), np.int64)
            for t in range(0, width, 1 + (1 << 18) // len(names)):
                part = p[:, t : t + 1 + (1 << 18) // len(names)]
                value += ((part[k] - part) ** 2 // part).sum(axis=1)
            out.append(pd.DataFrame({"lang": sources["lang"].to_numpy(), "source": name, "item": names, "value": value}))
        return pd.concat(out)

    bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")
    cells = kept.select("lang", "source", "term", "n", bucket.alias("bucket")).groupBy("lang", "bucket")
    sources = groups.select("lang", "source", "group_n", "terms", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket")).groupBy("lang", "bucket")
    parts = cells.cogroup(sources).applyInPandas(compare, "lang string, source string, item string, value long")
    sums = parts.where("source <> item").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    w = Window.partitionBy("lang", "source").orderBy(c("value").desc(), "item")
    return sums.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(w).alias("rank"))
