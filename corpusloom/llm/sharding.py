"""Operator 9: a uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Rows are numbered inside bounded logical partitions, once, in a written table, so that a lost executor cannot change a
number. How many rows each partition sends to each shard is drawn exactly: row by row of the matrix, a multivariate
hypergeometric draw from the room that the shards have left. A partition permutes its rows and cuts them by its row of
the matrix; rows are exchanged; each shard permutes what it got. Every assignment of rows to shards of these sizes is
equally likely, and sizes differ by one at most (the law ``rows``).

The second permutation is dealt over buckets of the row's random number, so no task ever holds a whole shard. Null
texts have size 1 and checksum 0. Repeated rows and equal or null ids are separate rows. Only counts (logical partitions
x shards, both bounded) come to the driver. Columns of the input pass through, but for shard, slot, __hs_shard
and __hs_slot, whose names are taken.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, written

LOGICAL, BUCKETS_PER_SHARD = 1024, 64


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Of ``n`` drawn without replacement from good + bad, how many are good. Exact inversion beyond numpy's limit."""
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, n)) if n and good else 0
    lo, hi = max(0, n - bad), min(n, good)
    mean = n * good / (good + bad)
    reach = 40 + 14 * int(np.sqrt(max(1.0, mean * (1 - good / (good + bad)))))
    k = np.arange(max(lo, int(mean) - reach), min(hi, int(mean) + reach) + 1, dtype=np.float64)
    steps = np.log(good - k[:-1]) + np.log(n - k[:-1]) - np.log(k[:-1] + 1) - np.log(bad - n + k[:-1] + 1)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    p = np.cumsum(np.exp(logs - logs.max()))
    return int(k[np.searchsorted(p, rng.random() * p[-1], side="right").clip(0, len(k) - 1)])


def communication_matrix(counts: list[int], sizes: list[int], seed: int) -> np.ndarray:
    """[partition, shard] numbers of rows with the given row and column sums."""
    rng, room = np.random.default_rng(seed), [int(x) for x in sizes]
    out = np.zeros((len(counts), len(sizes)), np.int64)
    for i, n in enumerate(counts):
        left, total = int(n), sum(room)
        for j in range(len(room)):
            total -= room[j]
            out[i, j] = hypergeometric(rng, room[j], total, left) if total else left
            left -= int(out[i, j])
        room = [r - int(x) for r, x in zip(room, out[i])]
    return out


def uniform_shards(spark: SparkSession, df: DataFrame, n_shards: int = 16, seed: int = 42) -> DataFrame:
    """``df`` and columns shard (0..n_shards-1) and slot (gapless from 0 in each shard); columns of these names are replaced."""
    # The row travels as one column, so none of its names can meet those used here.
    at = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("__hs_in_row"), F.monotonically_increasing_id().alias("__hs_row"), F.spark_partition_id().alias("__hs_task"))
    rows = written(spark, at, f"{shared_dir(spark)}/numbered")
    rows = rows.withColumn("__hs_part", F.pmod("__hs_task", F.lit(LOGICAL)))
    got = {r[0]: r[1] for r in rows.groupBy("__hs_part").count().collect()}  # at most LOGICAL rows
    parts = sorted(got)
    total = sum(got.values())
    sizes = [total // n_shards + (k < total % n_shards) for k in range(n_shards)]
    matrix = communication_matrix([got[p] for p in parts], sizes, seed)
    ends = spark.createDataFrame([(p, [int(x) for x in np.cumsum(matrix[k])]) for k, p in enumerate(parts)], "__hs_part int, __hs_ends array<long>")

    # Permute locally: a random number per row, ranked inside its partition. Ranks are taken in two steps (bucket of the
    # random number, then rank inside the bucket), so that a partition is never sorted in one task.
    rows = rows.withColumn("__hs_a", F.xxhash64(F.lit(seed), "__hs_row")).withColumn("__hs_b", F.xxhash64(F.lit(seed + 1), "__hs_row"))
    cut = lambda c: F.shiftrightunsigned(c, 58).cast("int")  # noqa: E731  # 64 buckets in the order of the random number
    rows = rows.withColumn("__hs_ka", cut("__hs_a"))
    ranked = ranked_in_buckets(rows, "__hs_part", "__hs_ka", "__hs_a", "__hs_rank")
    rank = F.col("__hs_rank")
    sent = ranked.join(F.broadcast(ends), "__hs_part").withColumn("shard", F.size(F.filter("__hs_ends", lambda e: e <= rank)))
    sent = sent.drop("__hs_ends").withColumn("__hs_kb", cut("__hs_b"))
    out = ranked_in_buckets(sent, "shard", "__hs_kb", "__hs_b", "slot")
    kept = out.select("__hs_in_row.*", F.col("shard").alias("__hs_shard"), F.col("slot").alias("__hs_slot"))
    names = [c for c in df.columns if c.lower() not in ("shard", "slot", "__hs_shard", "__hs_slot")]
    return kept.select(*(F.col(f"`{c}`") for c in names), F.col("__hs_shard").alias("shard"), F.col("__hs_slot").alias("slot"))


def ranked_in_buckets(df: DataFrame, group: str, bucket: str, key: str, out: str) -> DataFrame:
    """``df`` and its gapless rank (from 0) by ``key`` in each group; buckets (64 a group) follow the order of the key."""
    before = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    base = df.groupBy(group, bucket).agg(F.count("*").alias("__hs_n"))  # bounded: groups x 64
    base = base.select(group, bucket, F.coalesce(F.sum("__hs_n").over(before), F.lit(0)).alias("__hs_base"))
    inside = F.row_number().over(Window.partitionBy(group, bucket).orderBy(F.expr(f"shiftrightunsigned({key}, 1)"), key, "__hs_row"))
    return df.withColumn("__hs_in", inside).join(F.broadcast(base), [group, bucket]).withColumn(out, F.col("__hs_base") + F.col("__hs_in") - 1).drop("__hs_base", "__hs_in")


def shard_report(spark: SparkSession, docs: DataFrame, n_shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = uniform_shards(spark, rows, n_shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int"), F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))
