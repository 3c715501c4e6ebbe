"""Operator 12: hard negatives by threshold joins over a partial inverted index.

Vectors become whole numbers and are written once, in blocks of bounded size. A search is a threshold join: every task
indexes the block of rows that it reads and streams the anchors past it from the shared folder, so neither side is ever
held whole. The index of a block has posting lists by group of dimensions, the heaviest dimensions of the whole table
first; a row leaves the lists at the first group from which the norm of its rest (suffix) can no longer reach the
threshold. Scores are accumulated list by list, pairs whose partial score plus the product of the remaining norms stays
below the anchor's threshold are pruned, and the few that are left are computed in full. Of what reaches the threshold a
task hands on, for each anchor, only the first rows that can be in the answer. Anchors whose windows are not full come
back with a lower threshold, until they are full or nothing lies below: the result never depends on the thresholds.

A row takes part if it has a label and a vector without null or non-finite components. Shorter vectors count as filled
with zeros, empty ones score 0 everywhere. A row without vec_id takes part as a positive or negative and comes last
among equal scores. Repeated rows are rows of their own: a repeat of an anchor is another anchor, and its positive.
Extra columns are ignored, an empty table gives an empty result. Scores are exact; vectors so large that a score could
leave the 53 bits of a double's whole numbers are refused with a ValueError.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import forget, open_fs, shared_dir, small_batches, written

#: Thresholds of the rounds that look for positives, as parts of the largest possible score of an anchor; the last one
#: lets every row in. Those of negatives are parts of the positive's score, the last one the window's end.
POSITIVE_ROUNDS, NEGATIVE_ROUNDS = (0.7, 0.4, 0.25, 0.1, -1.0), (0.95, 0.8)
#: Dimensions of a posting list; bytes of a block of rows and of the scores being accumulated; share of pairs below
#: which they are computed one by one.
LIST_DIMS, BLOCK_BYTES, FEW = 8, 16 << 20, 1 / 16
FOUND = "anchor long, slot int, other long, score long"


def prepare(spark: SparkSession, embeddings: DataFrame) -> DataFrame:
    """row, vec_id, label, v (whole numbers) of the rows that take part, written; labels as the mining defines them."""
    c = F.col
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    moved = F.when(c("vec_id") % 7 == 0, (c("label") + 1) % 10).otherwise(c("label"))
    rows = embeddings.select("vec_id", "label", "embedding").where(c("label").isNotNull() & c("embedding").isNotNull() & fine)
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256))
    return written(spark, rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", moved.cast("long").alias("label"), v.alias("v")), shared_dir(spark))


def _matrix(column, width: int) -> np.ndarray:
    """Rows of an Arrow list column as doubles, filled up with zeros."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width))
    out[np.repeat(np.arange(len(ends)), ends), np.arange(len(flat)) - np.repeat(np.cumsum(ends) - ends, ends)] = flat
    return out


def statistics(rows: DataFrame) -> tuple[np.ndarray, float]:
    """(dimensions by falling sum of squares over all rows, largest norm)."""

    def weigh(batches: Iterable) -> Iterator:
        import pyarrow as pa

        sums, most = np.zeros(0), 0.0
        for b in batches:
            if b.num_rows:
                m = _matrix(b.column(0), max(1, int(np.max(b.column(0).value_lengths().to_numpy(zero_copy_only=False)))))
                sums = np.pad(sums, (0, max(0, m.shape[1] - len(sums))))
                sums[: m.shape[1]] += (m * m).sum(axis=0)
                most = max(most, float(np.sqrt((m * m).sum(axis=1).max())))
        yield pa.RecordBatch.from_arrays([pa.array([*range(len(sums)), -1], pa.int32()), pa.array([*sums, most], pa.float64())], ["dim", "x"])

    found = rows.select("v").mapInArrow(weigh, "dim int, x double").groupBy("dim").agg(F.sum("x").alias("total"), F.max("x").alias("most")).collect()  # one row per dimension
    sums = {r.dim: r.total for r in found if r.dim >= 0}
    return np.array(sorted(sums, key=lambda d: (-sums[d], d)), np.int64), next((r.most for r in found if r.dim < 0), 0.0)


class PartialIndex:
    """Posting lists of a block of rows, complete for scores of at least ``reach`` times an anchor's norm."""

    def __init__(self, x: np.ndarray, reach: float):
        lists = max(1, -(-x.shape[1] // LIST_DIMS))
        x = np.pad(x, ((0, 0), (0, lists * LIST_DIMS - x.shape[1])))
        squares = (x * x).reshape(len(x), lists, LIST_DIMS).sum(axis=2)
        rest = np.sqrt(np.hstack([squares[:, ::-1].cumsum(axis=1)[:, ::-1], np.zeros((len(x), 1))]))
        # The lists that a row is in: as long as the norm of what follows can reach the threshold alone.
        kept = (rest[:, :lists] >= reach * (1 - 1e-9) - 1e-6).sum(axis=1)
        self.order = np.argsort(-kept, kind="stable")
        self.kept, self.x, self.rest = kept[self.order], x[self.order], rest[self.order]
        self.posted = [int((self.kept > k).sum()) for k in range(lists)]

    def search(self, q: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, row, score) of all pairs with a score of at least the anchor's ``least``."""
        lists, n = len(self.posted), self.posted[0]
        q = np.pad(q, ((0, 0), (0, lists * LIST_DIMS - q.shape[1])))
        squares = (q * q).reshape(len(q), lists, LIST_DIMS).sum(axis=2)
        left = np.sqrt(np.hstack([squares[:, ::-1].cumsum(axis=1)[:, ::-1], np.zeros((len(q), 1))]))
        score = np.zeros((len(q), n))
        for k in range(lists):
            m, dims = self.posted[k], slice(k * LIST_DIMS, (k + 1) * LIST_DIMS)
            score[:, :m] += q[:, dims] @ self.x[:m, dims].T
            if k + 1 == lists or k % 2:
                at = np.minimum(self.kept[:n], k + 1)
                bound = left[:, at] * self.rest[np.arange(n), at]
                bound += score
                alive = bound + 1e-9 * np.abs(bound) + 1e-6 >= least[:, None]
                if k + 1 == lists or np.count_nonzero(alive) < FEW * alive.size:
                    break
        qi, xi = np.nonzero(alive)
        full, parts = score[qi, xi], max(1, (4 << 20) // max(1, q.shape[1]))
        open_ = np.flatnonzero((self.kept[xi] < lists) | (k + 1 < lists))  # all lists together are the whole score
        for at in range(0, len(open_), parts):
            part = open_[at : at + parts]
            full[part] = np.einsum("ij,ij->i", q[qi[part]], self.x[xi[part]])
        reached = full >= least[qi]
        return qi[reached], self.order[xi[reached]], full[reached]


def _first(scores: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Positions of the first rows by falling score, then rising id."""
    if len(scores) > 4 * most:
        cut = np.partition(scores, len(scores) - most)[len(scores) - most]
        near = np.flatnonzero(scores >= cut)
        return near[np.lexsort((ids[near], -scores[near]))[:most]]
    return np.lexsort((ids, -scores))[:most]


def threshold_join(spark: SparkSession, rows: DataFrame, anchors: str, width: int, order: np.ndarray, reach: float, most: int, same_label: bool) -> DataFrame:
    """(anchor, slot, other, score): from each block of rows the first ``most`` for each anchor's slot.

    ``anchors``: folder of a written table row, label, v, least (smallest score of interest), tops (largest score of each slot).
    """
    last = np.iinfo(np.int64).max

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa
        import pyarrow.dataset as ds

        forget()
        fs, path = open_fs(anchors)
        block_rows = max(1, BLOCK_BYTES // (8 * max(1, width)))

        def block(parts: list) -> Iterator:
            t = pa.Table.from_batches(parts)
            no, label = t["row"].to_numpy(), t["label"].to_numpy()
            ids = t["vec_id"].fill_null(last).to_numpy()
            index = PartialIndex(_matrix(t["v"].combine_chunks(), width)[:, order], reach)
            at_once = max(1, BLOCK_BYTES // (8 * max(1, t.num_rows)))
            for b in ds.dataset(path, filesystem=fs, format="parquet").to_batches(batch_size=at_once):
                if not b.num_rows:
                    continue
                b = {n: b.column(n) for n in ("row", "label", "v", "least", "tops")}
                anchor, own, tops = b["row"].to_numpy(), b["label"].to_numpy(), b["tops"].to_pylist()
                qi, xi, score = index.search(_matrix(b["v"], width)[:, order], b["least"].to_numpy().astype(float))
                wanted = (label[xi] == own[qi]) & (no[xi] != anchor[qi]) if same_label else label[xi] != own[qi]
                qi, xi, score = qi[wanted], xi[wanted], score[wanted].astype(np.int64)
                out: list[tuple] = []
                for k, part in zip(np.unique(qi), np.split(np.arange(len(qi)), np.flatnonzero(np.diff(qi)) + 1)) if len(qi) else ():
                    s, x = score[part], xi[part]
                    for slot, top in enumerate(tops[k]):
                        inside = np.arange(len(s)) if top is None else np.flatnonzero(s <= top)
                        out += ((int(anchor[k]), slot, int(ids[x[j]]), int(s[j])) for j in inside[_first(s[inside], ids[x[inside]], most)])
                if out:
                    cols = list(zip(*out))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array([None if i == last else i for i in cols[2]], pa.int64()), pa.array(cols[3], pa.int64())], ["anchor", "slot", "other", "score"]
                    )

        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= block_rows:
                yield from block(held)
                held, n = [], 0
        if n:
            yield from block(held)

    return rows.select("row", "vec_id", "label", "v").mapInArrow(run, FOUND)


def _rounds(spark: SparkSession, rows: DataFrame, wanted: DataFrame, width: int, order: np.ndarray, most_norm: float, parts: tuple[float, ...], most: int, same_label: bool) -> DataFrame:
    """(anchor, slot, rank, other, score): the first ``most`` rows of every slot, thresholds lowered until the slots are full.

    ``wanted``: row, label, v, scale (score that the parts are of), tops, lowest (no score below counts; null: all do).
    """
    c, done = F.col, []
    w = Window.partitionBy("anchor", "slot").orderBy(c("score").desc(), c("other").asc_nulls_last())
    for k, part in enumerate(parts):
        last = k + 1 == len(parts)
        least = F.greatest(F.ceil(c("scale") * part) - (2 if last else 0), c("lowest"))
        norm = F.greatest(F.lit(1e-9), F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)))
        path = shared_dir(spark)
        anchors = written(spark, wanted.select("row", "label", "v", "scale", "tops", "lowest", least.cast("long").alias("least"), (least / norm).alias("reach")), path)
        reach = anchors.agg(F.min("reach")).head()[0]
        if reach is None:  # no anchor is left
            break
        near = threshold_join(spark, rows, path, width, order, reach, most, same_label)
        found = written(spark, near.withColumn("rank", F.row_number().over(w)).where(c("rank") <= most), shared_dir(spark))
        if last:
            done.append(found)
            break
        count = found.groupBy("anchor").agg(F.count("*").alias("n"))
        full = anchors.join(count.hint("merge"), anchors["row"] == count["anchor"]).where(c("n") >= F.size("tops") * most).select("row")
        done.append(found.join(full.select(c("row").alias("anchor")).hint("merge"), "anchor", "left_semi"))
        wanted = anchors.join(full.hint("merge"), "row", "left_anti")
    out = done[0] if done else spark.createDataFrame([], FOUND + ", rank int")
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def mine(spark: SparkSession, embeddings: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor (vec_id divisible by ``every``)
    and each of its first ``positives`` rows of the same label, the first ``negatives`` rows of other labels that score
    between 80 % of the positive's score and all of it."""
    small_batches(spark)
    c = F.col
    rows = prepare(spark, embeddings)
    order, norm = statistics(rows)
    if norm * norm >= 2.0**53:
        raise ValueError("vectors are so large that scores are not exact")
    chosen = rows.where(c("vec_id") % every == 0)
    width, own = len(order), F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    wanted = chosen.select("row", "label", "v", (own * float(norm)).alias("scale"), F.array(F.lit(None).cast("long")).alias("tops"), F.lit(None).cast("long").alias("lowest"))
    best = written(spark, _rounds(spark, rows, wanted, width, order, norm, POSITIVE_ROUNDS, positives, True).select(c("anchor").alias("row"), c("rank").alias("k"), c("other").alias("positive_id"), c("score").alias("positive_score")), shared_dir(spark))
    # Only positives of at least 0 leave a window: 80 % of a negative score is more than all of it.
    slots = best.where("positive_score >= 0").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("k", "positive_id", "positive_score"))).alias("p"))  # a few per anchor
    low = F.array_min(F.transform("p", lambda x: x["positive_score"]))
    asked = written(spark, chosen.join(slots.hint("merge"), "row").select("row", "vec_id", "label", "v", low.cast("double").alias("scale"), "p", F.floor(low * 0.8).cast("long").alias("lowest")), shared_dir(spark))
    wanted = asked.select("row", "label", "v", "scale", F.transform("p", lambda x: x["positive_score"]).alias("tops"), "lowest")
    found = _rounds(spark, rows, wanted, width, order, norm, NEGATIVE_ROUNDS, negatives, False)
    out = found.join(asked.select(c("row").alias("anchor"), c("vec_id").alias("anchor_id"), "p").hint("merge"), "anchor").withColumn("x", F.element_at("p", c("slot") + 1))
    inside = (c("x.positive_score") * 80 <= c("score") * 100) & (c("score") <= c("x.positive_score"))
    return out.where(inside).select("anchor_id", c("x.positive_id").alias("positive_id"), c("rank").cast("int").alias("rank"), c("other").alias("negative_id"), c("x.positive_score").alias("positive_score"), c("score").alias("negative_score"))
