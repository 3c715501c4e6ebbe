"""Operator 6: exact repeated passages by common-prefix interval trees over enhanced suffix arrays.

A text is a row of units: its UTF-8 bytes (``BYTES``, the operator) or its words (``WORDS``, the pipeline). Below, lengths and
positions are units. A word is a run of bytes other than \\x20 and \\x09-\\x0D, case kept; characters of scripts that put no
space between words (U+0E00 to U+0EFF, U+1000 to U+109F, U+1780 to U+17FF, U+3000 to U+9FFF, U+20000 and above) are a word
each. Words are compared as 32-bit hashes (xxh3; runs of 51 of them), white space between them is not. A removed run of words reaches from its
first byte to its last; white space around it stays.

Every unit covered by a run of ``length`` units that also starts somewhere else (in any document, the same one
included) is found and removed. Matches never cross documents.

1. Anchors. In each window of ``length`` units the position with the smallest hash of its next ``anchor`` units is an
   anchor. Equal windows have their anchor at the same place, so all copies of a repeated window meet in the group of one
   anchor hash, and only suffixes that start at anchors with a repeated hash need sorting (a sparse suffix array).
2. Contexts. Such an anchor takes its suffix (up to ``length`` units) and those before it (up to ``length - anchor``).
   Equal contexts are counted once before any group is built, so exact copies and hot passages cost one entry.
   Contexts of a crowded anchor are not one group: a repeat of ``length`` units with r units from the anchor on has
   ``length - r`` before it, so for each of SPLITS ranges of r contexts are grouped by the units that they must share
   (all but ``(length - anchor) / SPLITS`` of them), and what their groups find is united. A line that very many different
   texts hold then falls apart into small groups; only contexts that share nearly a whole repeat still meet in one task.
3. Suffix arrays. In each group suffixes are sorted, the array of common-prefix lengths is scanned with a stack, and each
   interval of the tree (a right-maximal repeat of depth r) is tested for left extension: its members are sorted by
   what precedes them, and each is extended as far as it agrees with another member. If the extension and r
   reach ``length``, that occurrence of the maximal repeat is reported; every member reports, not only neighbours.
4. Spans of all occurrences are merged per document.

Null texts count as empty; texts shorter than ``length`` keep everything. Repeated rows are copies of each other. doc_id
may be null or occur twice: rows are told apart by (doc_id, text). Removal may split a character; kept bytes are then
decoded with U+FFFD dropped where a table of texts is wanted. Extra columns pass through ``remove_repeats``, whatever
their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, forget, shared_dir, small_batches, splitmix, written

LENGTH, ANCHOR, BLOCK = 400, 64, 1 << 16
#: Anchors that occur more often are crowded; the number of groups that contexts of such an anchor are split into.
CROWDED, SPLITS = 2000, 8
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Units(NamedTuple):
    """What repeats are counted in: least length and anchor (a power of two) in units, bytes a unit takes once encoded."""

    length: int
    anchor: int
    width: int


BYTES, WORDS = Units(LENGTH, ANCHOR, 1), Units(51, 8, 4)


def _byte_hashes() -> np.ndarray:
    return splitmix(np.arange(256, dtype=np.uint64))


#: Where a character of a script without spaces may begin.
_DENSE = re.compile(rb"[\xe3-\xe9\xf1-\xff]|\xe0[\xb8-\xbb]|\xe1[\x80-\x82\x9e\x9f]|\xf0[\xa0-\xff]")


def word_places(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the words of a text in UTF-8."""
    b = np.frombuffer(data, np.uint8)
    inside = ~((b == 32) | ((b >= 9) & (b <= 13)))
    edge = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not data.isascii():
        second = np.append(b[1:], 0)
        three = ((b >= 0xE3) & (b <= 0xE9)) | ((b == 0xE0) & (second >= 0xB8) & (second <= 0xBB)) | ((b == 0xE1) & (((second >= 0x80) & (second <= 0x81)) | (second == 0x82) | (second == 0x9E) | (second == 0x9F)))
        four = (b >= 0xF1) | ((b == 0xF0) & (second >= 0xA0))
        at = np.concatenate([np.flatnonzero(three), np.flatnonzero(four)])
        after = np.concatenate([np.flatnonzero(three) + 3, np.flatnonzero(four) + 4])
        if len(at):
            cuts = np.concatenate([at, after])
            starts = np.unique(np.concatenate([starts, cuts[(cuts < len(b)) & inside[np.minimum(cuts, len(b) - 1)]]]))
            cuts = cuts[(cuts > 0) & inside[np.minimum(cuts, len(b)) - 1]]
            ends = np.unique(np.concatenate([ends, cuts]))
    return starts, ends


def encoded(text: str | None, units: Units = BYTES) -> bytes:
    """A text as its units, ``width`` bytes each."""
    data = (text or "").encode("utf-8", "surrogatepass")
    if units.width == 1:
        return data
    from xxhash import xxh3_64_intdigest

    if _DENSE.search(data):
        words = [data[s:e] for s, e in zip(*(x.tolist() for x in word_places(data)))]
    else:
        words = data.split()  # on bytes: at the same white space
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words)).astype(np.uint32).tobytes()


def anchors(data: bytes, units: Units = BYTES) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the anchors of an encoded text."""
    length, anchor, _ = units
    data = np.frombuffer(data, np.uint8 if units.width == 1 else np.uint32)
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    b, table = data, _byte_hashes()
    width = length - anchor + 1  # hashes in a window
    places, values = [], []
    for at in range(0, len(b) - length + 1, BLOCK):
        h = b[at : at + BLOCK + length - 1]
        h = table[h] if units.width == 1 else splitmix(h.astype(np.uint64))
        with np.errstate(over="ignore"):
            power, n = _BASE, 1
            while n < anchor:
                h = h[:-n] * power + h[n:]
                power, n = power * power, 2 * n
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
        key = (h & np.uint64(0xFFFFFFFFFFFC0000)) | np.arange(len(h), dtype=np.uint64)
        low, n = key, 1
        while 2 * n <= width:
            low, n = np.minimum(low[:-n], low[n:]), 2 * n
        low = np.minimum(low[: len(key) - width + 1], low[width - n : width - n + len(key) - width + 1])
        first = (low & np.uint64(0x3FFFF)).astype(np.int64)
        first = first[np.concatenate([[True], first[1:] != first[:-1]])]
        places.append(first + at)
        values.append(h[first].view(np.int64))
    p, v = np.concatenate(places), np.concatenate(values)
    keep = np.concatenate([[True], p[1:] != p[:-1]])
    return p[keep], v[keep]


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n - 1
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[:mid] == b[:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def _neighbours(texts: list[bytes], width: int = 1) -> np.ndarray:
    """Bytes of the whole units that neighbours have in common."""
    return np.array([_common(a, b) for a, b in zip(texts, texts[1:])], np.int64) // width * width


def prefix_intervals(lcp: np.ndarray, n: int) -> Iterator[tuple[int, int, int]]:
    """(depth, first, last + 1) of the intervals of the common-prefix tree: one scan with a stack."""
    stack = [(0, 0)]  # (depth, first)
    for i in range(1, n + 1):
        depth, first = int(lcp[i - 1]) if i < n else 0, i - 1
        while stack and stack[-1][0] > depth:
            d, first = stack.pop()
            yield d, first, i
        if stack and stack[-1][0] < depth:
            stack.append((depth, first))


def maximal_repeats(contexts: list[tuple[bytes, bytes, int]], length: int = LENGTH, width: int = 1) -> list[list[tuple[int, int]]]:
    """For each context (left, right, count) the maximal repeats of ``length`` bytes and more through its anchor, each as
    (bytes before, bytes after the anchor's start), in whole units of ``width`` bytes."""
    n = len(contexts)
    out: list[list[tuple[int, int]]] = [[] for _ in contexts]
    for k, (left, right, count) in enumerate(contexts):
        if count > 1 and len(left) + len(right) >= length:
            out[k].append((len(left), len(right)))
    if n == 1:
        return out
    order = sorted(range(n), key=lambda k: contexts[k][1])  # the suffix array
    lcp = _neighbours([contexts[k][1] for k in order], width)
    back = [c[0][::-1] for c in contexts]
    for depth, lo, hi in prefix_intervals(lcp, n):
        if depth + max(len(contexts[k][0]) for k in order[lo:hi]) < length:
            continue
        members = sorted(order[lo:hi], key=back.__getitem__)
        ext = _neighbours([back[k] for k in members], width)
        for at, k in enumerate(members):
            reach = max(ext[at - 1] if at else 0, ext[at] if at < len(ext) else 0)
            if reach + depth >= length:
                out[k].append((int(reach), depth))
    return out


def _row_key(docs: DataFrame) -> DataFrame:
    return docs.withColumn("__sd_key", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce("text", F.lit(""))))


def repeated_spans(spark: SparkSession, docs: DataFrame, units: Units = BYTES) -> DataFrame:
    """(key, spans): sorted, disjoint spans of units [start, end) to remove, none touching the next, as a flat array start, end,
    ..., for the rows that have any.

    ``docs``: key, text (equal keys only for equal rows).
    """
    small_batches(spark)
    folder, width = shared_dir(spark), units.width

    def find(batches: Iterable) -> Iterator:
        import pyarrow as pa

        forget()
        for b in batches:
            keys, places, values = [], [], []
            for key, t in zip(b.column(0).to_pylist(), b.column(1)):
                p, v = anchors(encoded(t.as_py(), units), units)
                keys.append(np.full(len(p), key, np.int64))
                places.append(p)
                values.append(v)
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, places, values)], ["key", "pos", "h"])

    found = written(spark, docs.mapInArrow(find, "key long, pos long, h long"), f"{folder}/anchors")
    # Written first: so both sides of the join are dealt by it alone, and Spark can split a hash with very many anchors.
    again = found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h", (F.col("n") > CROWDED).alias("crowded"))
    again = written(spark, again, f"{folder}/again")
    wanted = found.join(again.hint("merge"), "h").groupBy("key").agg(F.array_sort(F.collect_set(F.struct("pos", "crowded"))).alias("at"))  # bounded by a text
    wanted = wanted.select("key", F.col("at.pos").alias("pos"), F.col("at.crowded").alias("crowded"))
    texts = written(spark, docs.join(wanted.hint("merge"), "key"), f"{folder}/texts")

    for name in ("anchors", "again"):
        drop(spark, f"{folder}/{name}")

    def cut(batches: Iterable) -> Iterator:
        import pyarrow as pa

        rows: list = []

        def flush():
            cols = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()))]
            return pa.RecordBatch.from_arrays(cols, ["key", "pos", "crowded", "before", "after"])

        for b in batches:
            for key, t, pos, crowded in zip(b.column(0).to_pylist(), b.column(1), b.column(2), b.column(3)):
                data = encoded(t.as_py(), units)
                for p, full in zip(pos.as_py(), crowded.as_py()):
                    at = p * width
                    rows.append((key, p, full, data[max(0, p - units.length + units.anchor) * width : at], data[at : at + units.length * width]))
                    if len(rows) >= 8192:
                        yield flush()
                        rows.clear()
        if rows:
            yield flush()

    # Groups are formed by the anchor's own bytes, so that equal hashes of different anchors cannot meet.
    ctx = texts.select("key", "text", "pos", "crowded").mapInArrow(cut, "key long, pos long, crowded boolean, before binary, after binary")
    ctx = ctx.withColumn("h", F.xxhash64(F.substring("after", 1, units.anchor * width))).withColumn("c", F.xxhash64(F.lit(1), "before", F.lit(2), "after"))
    occurrences = ctx.select("key", "pos", "h", "c")
    distinct = ctx.groupBy("h", "c", "crowded", "before", "after").agg(F.count("*").alias("n"))
    # Groups: the anchor, or for a crowded one the units that a repeat with r units from the anchor on must share.
    step = -(-(units.length + 1 - units.anchor) // SPLITS)
    parts = []
    for r in range(units.anchor, units.length + 1, step):
        left = max(0, units.length + 1 - r - step) * width
        enough = (F.octet_length("before") >= left) & (F.octet_length("after") >= r * width)
        shared = F.xxhash64("h", F.lit(r), F.substring("before", -left, left) if left else F.lit(b""), F.substring("after", 1, r * width))
        parts.append(F.when(enough, shared))
    group = F.when(F.col("crowded"), F.filter(F.array(*parts), lambda g: g.isNotNull())).otherwise(F.array("h"))
    distinct = distinct.withColumn("g", F.explode(group))

    def solve(batches: Iterable) -> Iterator:
        import pyarrow as pa

        held, group, out = None, [], []

        def close():
            got = maximal_repeats([g[1:] for g in group], units.length * width, width)
            # All repeats of an occurrence hold its anchor, so what they cover together is one span.
            out.extend((*g[0], max(a for a, _ in s) // width, max(b for _, b in s) // width) for g, s in zip(group, got) if s)

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["h", "c", "l", "r"])

        for b in batches:
            for g, h, c, left, right, n in zip(*(x.to_pylist() for x in b.columns)):
                if g != held and group:
                    close()
                    group.clear()
                    if len(out) >= 4096:
                        yield batch()
                        out.clear()
                held = g
                group.append(((h, c), left, right, n))
        if group:
            close()
        if out:
            yield batch()

    sorted_groups = distinct.repartition("g").sortWithinPartitions("g", "c").select("g", "h", "c", "before", "after", "n")
    solved = sorted_groups.mapInArrow(solve, "h long, c long, l long, r long").groupBy("h", "c").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    repeats = written(spark, solved, f"{folder}/repeats")
    spans = occurrences.join(repeats.hint("merge"), ["h", "c"]).select("key", (F.col("pos") - F.col("l")).alias("s"), (F.col("pos") + F.col("r")).alias("e"))
    merged = spans.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("s", "e"))).alias("xs"))  # bounded by a text
    out = written(spark, merged.select("key", merge_spans(F.col("xs.s"), F.col("xs.e")).alias("spans")), f"{folder}/spans")
    for name in ("texts", "repeats"):
        drop(spark, f"{folder}/{name}")
    return out


def merge_spans(starts: Column, ends: Column) -> Column:
    """Spans sorted by start, merged where they touch or overlap, as a flat array start, end, start, end, ..."""

    def merge(all_starts, all_ends):
        import pandas as pd

        def one(s, e):
            reach = np.maximum.accumulate(e)
            new = np.concatenate([[True], s[1:] > reach[:-1]])
            return np.stack([s[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(s) - 1)]], 1).ravel()

        return pd.Series([one(np.asarray(s), np.asarray(e)) for s, e in zip(all_starts, all_ends)], dtype=object)

    return F.pandas_udf(merge, "array<long>")(starts, ends)


def kept_bytes(text: str | None, spans, units: Units = BYTES) -> bytes:
    """A text without its spans of units."""
    data, out, at = (text or "").encode("utf-8", "surrogatepass"), [], 0
    if spans is not None and units.width > 1:
        starts, ends = word_places(data)
        spans = [x for s, e in zip(spans[::2], spans[1::2]) for x in (int(starts[s]), int(ends[e - 1]))]
    for s, e in zip(spans[::2], spans[1::2]) if spans is not None else ():
        out.append(data[at:s])
        at = e
    return b"".join([*out, data[at:]])


def _kept_column(text: str, spans: str) -> Column:
    def kept(texts, all_spans):
        import pandas as pd

        return pd.Series([kept_bytes(t, s) for t, s in zip(texts, all_spans)], dtype=object)

    return F.pandas_udf(kept, "binary")(F.col(text), F.col(spans))


def repeat_report(spark: SparkSession, docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and n_passage_words of every document.

    The first columns follow ``length`` bytes. n_passage_words counts the words in runs of more than fifty words that occur
    again anywhere: such a run need not reach ``length`` bytes, so it may lie in a document that loses none.
    """
    keyed = _row_key(docs.select("doc_id", "text"))
    texts = keyed.select(F.col("__sd_key").alias("key"), "text")
    covered = F.expr("aggregate(transform(sequence(0, size(spans) div 2 - 1), i -> spans[2 * i + 1] - spans[2 * i]), 0L, (a, x) -> a + x)")
    spans = repeated_spans(spark, texts, BYTES._replace(length=length))
    passages = repeated_spans(spark, texts, WORDS).select(F.col("key").alias("__sd_key"), covered.alias("n_passage_words"))
    cut = texts.join(spans.hint("merge"), "key").dropDuplicates(["key"]).select("key", _kept_column("text", "spans").alias("kept"), (F.size("spans") / 2).cast("long").alias("n_spans"))
    cut = cut.select(F.col("key").alias("__sd_key"), F.octet_length("kept").alias("n_kept"), "n_spans", F.sha2("kept", 256).alias("sha"))
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    narrow = keyed.select("doc_id", "__sd_key", F.octet_length(data).cast("long").alias("n_bytes"), F.sha2(data, 256).alias("whole"))
    out = narrow.join(cut.hint("merge"), "__sd_key", "left").join(passages.hint("merge"), "__sd_key", "left")
    return out.select(
        "doc_id", "n_bytes", F.coalesce(F.col("n_bytes") - F.col("n_kept"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("sha", "whole").alias("kept_sha256"), F.coalesce("n_passage_words", F.lit(0)).cast("long").alias("n_passage_words"),
    )


def remove_repeats(spark: SparkSession, docs: DataFrame, length: int = LENGTH, units: Units = BYTES) -> DataFrame:
    """``docs`` without their repeated passages. The first holder's copy goes too, as the operator's contract says."""
    units = units._replace(length=length)
    # The row travels as one column, so none of its names can meet those used here.
    keyed = _row_key(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("__row"), "doc_id", "text"))
    spans = repeated_spans(spark, keyed.select(F.col("__sd_key").alias("key"), "text"), units)
    joined = keyed.join(spans.select(F.col("key").alias("__sd_key"), F.col("spans").alias("__sd_spans")).hint("merge"), "__sd_key", "left")

    def kept(texts, all_spans):
        import pandas as pd

        return pd.Series([t if s is None else kept_bytes(t, s, units).decode("utf-8", "ignore") for t, s in zip(texts, all_spans)], dtype=object)

    text = F.pandas_udf(kept, "string")(F.col("text"), F.col("__sd_spans"))
    return joined.select(*(text.alias("text") if c == "text" else F.col(f"__row.`{c}`").alias(c) for c in docs.columns))
