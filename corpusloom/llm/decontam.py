"""Operator 2: benchmark decontamination by greedy string tiling.

Texts become tokens (lower case, letters and digits; anything else separates). Benchmark items that share a seed of
``min_tile`` tokens with a document are its candidates. For each candidate the longest common run of tokens still free on
both sides is found by Karp-Rabin hashing (binary search on its length), all non-overlapping runs of that length are
marked, and so on down to ``min_tile``. The share of the item's tokens that tiles cover decides, wherever the tiles lie,
so a passage whose sentences were put in another order is caught as well.

Benchmark items are the query set: they are packed into blocks of at most ``BLOCK_BYTES`` of text, each block is
broadcast, and every document is tested against each block; no document is shuffled. Items with fewer tokens than
``min_tile`` must occur whole. Null, empty and token-free texts or items match nothing. Repeated rows give repeated
results; items with equal text each report. Documents are read whole. Extra columns pass through ``drop_contaminated``.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, small_batches, splitmix

MIN_TILE, COVERAGE = 5, 0.6
BLOCK_BYTES = 16 << 20
HIT = "array<struct<item_id: long, n_item_tokens: long, n_covered: long, n_tiles: long, longest: long, tiles: array<struct<item_from: int, doc_from: int, n: int>>>>"
_OTHER = re.compile(r"[^\w\x00-\x7f]")
_TABLE = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def tokens(text: str | None) -> list[bytes]:
    """Lower-case tokens of a whole text as UTF-8."""
    if not text:
        return []
    text = text.lower()
    if not text.isascii():
        text = _OTHER.sub(" ", text)
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


def window_hashes(ids: np.ndarray, s: int, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, Karp-Rabin hashes) of the windows of s tokens that are wholly free. A hash is the sum of v[k] * B^(k + 1) over
    the window's own tokens, in both forms, so windows of different sequences compare."""
    n = len(ids) - s + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    taken = np.concatenate([[0], np.cumsum(~free)])
    starts = np.flatnonzero(taken[s:] == taken[:-s])
    h = np.zeros(len(starts), np.uint64)
    v = splitmix(ids.astype(np.uint64))
    with np.errstate(over="ignore"):
        if s <= 16 or len(starts) < 64:
            for k in reversed(range(s)):
                h = (h + v[starts + k]) * np.uint64(_BASE)
        else:
            power = np.cumprod(np.full(len(ids), _BASE, np.uint64))
            back = np.cumprod(np.full(len(ids), _INVERSE, np.uint64)) * np.uint64(_BASE)  # B^-p takes the place out again
            before = np.concatenate([np.zeros(1, np.uint64), np.cumsum(v * power)])
            h = (before[starts + s] - before[starts]) * back[starts]
    return starts, h


def greedy_tiles(item: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(item position, document position, length) of the tiles, longest first. Negative tokens match nothing."""
    free_i, free_d, out = item >= 0, doc >= 0, []
    hi = min(len(item), len(doc))

    def common(s: int) -> bool:
        a, b = window_hashes(item, s, free_i)[1], window_hashes(doc, s, free_d)[1]
        return len(a) > 0 and len(b) > 0 and bool(np.isin(b, a).any())

    while hi >= least and common(least):
        lo = least
        while lo < hi:  # if a run of s tokens is common, so is one of s - 1
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if common(mid) else (lo, mid - 1)
        s = lo
        at_i, h_i = window_hashes(item, s, free_i)
        at_d, h_d = window_hashes(doc, s, free_d)
        marked = False
        for p, h in zip(at_i, h_i):
            if not free_i[p : p + s].all():
                continue
            for q in at_d[h_d == h]:
                if free_d[q : q + s].all() and np.array_equal(item[p : p + s], doc[q : q + s]):
                    free_i[p : p + s] = free_d[q : q + s] = False
                    out.append((int(p), int(q), s))
                    marked = True
                    break
        hi = s if marked else s - 1
    return out


def block_model(items: list[tuple[int, str]], least: int) -> dict:
    """Vocabulary, item tokens and seeds (by seed length) of one block of the benchmark."""
    vocabulary: dict[bytes, int] = {}
    ids, seqs = [], []
    for item_id, text in items:
        words = tokens(text)
        if words:
            ids.append(item_id)
            seqs.append(np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words], np.int64))
    seeds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for s in {min(least, len(q)) for q in seqs}:
        hashes, owners = [], []
        for k, q in enumerate(seqs):
            if min(least, len(q)) == s:
                h = np.unique(window_hashes(q, s, np.ones(len(q), bool))[1])
                hashes.append(h)
                owners.append(np.full(len(h), k, np.int64))
        h, o = np.concatenate(hashes), np.concatenate(owners)
        order = np.argsort(h, kind="stable")
        seeds[s] = h[order], o[order]
    return {"vocabulary": vocabulary, "ids": ids, "seqs": seqs, "seeds": seeds}


def tile_text(model: dict, text: str | None, least: int, coverage: float) -> list[tuple]:
    """HIT rows of the items that a text covers."""
    words = tokens(text)
    doc = np.fromiter(map(model["vocabulary"].get, words, repeat(-1)), np.int64, len(words))
    found: set[int] = set()
    for s, (hashes, owners) in model["seeds"].items():
        h = window_hashes(doc, s, doc >= 0)[1]
        if len(h):
            h = np.unique(h)
            lo, hi = np.searchsorted(hashes, h), np.searchsorted(hashes, h, side="right")
            for a, b in zip(lo[hi > lo], hi[hi > lo]):
                found.update(owners[a:b].tolist())
    out = []
    for k in sorted(found):
        item = model["seqs"][k]
        tiles = greedy_tiles(item, doc, min(least, len(item)))
        n = sum(t[2] for t in tiles)
        if n and n >= coverage * len(item):
            out.append((model["ids"][k], len(item), n, len(tiles), max(t[2] for t in tiles), tiles))
    return out


def hits_column(spark: SparkSession, benchmark: DataFrame, text: Column, least: int = MIN_TILE, coverage: float = COVERAGE) -> Column:
    """Array of HIT: the benchmark items that each text covers. One broadcast per block of the benchmark."""
    small_batches(spark)
    items = benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    n_blocks = -(-total // BLOCK_BYTES) or 1
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)))
    columns = []
    for k in range(n_blocks):
        rows = dealt.where(F.col("block") == k).orderBy("item_id", "text").collect()  # one block
        held = spark.sparkContext.broadcast(block_model([(r.item_id, r.text) for r in rows], least))

        def hits(texts, held=held):
            import pandas as pd

            forget()
            model = held.value
            return pd.Series([tile_text(model, t, least, coverage) for t in texts], dtype=object)

        columns.append(F.pandas_udf(hits, HIT)(text))
    return columns[0] if len(columns) == 1 else F.concat(*columns)


def contaminated_pairs(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, least: int = MIN_TILE, coverage: float = COVERAGE) -> DataFrame:
    """One row per document and benchmark item that it covers."""
    hits = docs.select("doc_id", F.explode(hits_column(spark, benchmark, F.col("text"), least, coverage)).alias("h"))
    return hits.select("doc_id", "h.item_id", "h.n_item_tokens", "h.n_covered", "h.n_tiles", "h.longest", (F.col("h.n_covered") / F.col("h.n_item_tokens")).alias("coverage"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that cover no benchmark item, with their columns."""
    return docs.where(F.size(hits_column(spark, benchmark, F.col("text"))) == 0)
