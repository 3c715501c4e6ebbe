"""Ranks, counters and neighbours in the order of a group that may be larger than a task: scans in two levels.

A group is cut into blocks of consecutive rows. Each block is scanned alone, its totals are scanned block by block (a few
rows per group), and what a block begins with is added to its rows. No window holds a whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import big, written

#: Rows of a block once rows have a rank.
BLOCK = 1 << 16


def ranked(df: DataFrame, group: str, order: str, name: str = "pos") -> DataFrame:
    """df with ``name``: the rank (from 1) of each row in its group. Rows are dealt by ranges of (group, order), which may cut a group."""
    stored = written(df.sparkSession, df.repartitionByRange(group, order).withColumn("__block", F.spark_partition_id()))
    sums = stored.groupBy(group, "__block").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(group).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    local = F.row_number().over(Window.partitionBy(group, "__block").orderBy(order))
    # The join deals the rows by (group, block), as the window wants them.
    return stored.join(big(sums.select(group, "__block", before.alias("__before"))), [group, "__block"]).withColumn(name, (F.col("__before") + local).cast("int")).drop("__block", "__before")


def block_of(pos: str) -> Column:
    return F.floor(F.col(pos) / BLOCK).cast("int")


def restarting_counts(rows: DataFrame, group: str, pos: str, depth: str, kind: str, restarts: Column, counted: Column) -> DataFrame:
    """rows with ``n``: which row of its kind and depth this is since the last restarting row above its depth; null where ``counted``
    does not hold. ``pos`` ranks the rows of a group."""
    spark = rows.sparkSession
    e = written(spark, rows.withColumns({"__block": block_of(pos), "__restarts": restarts, "__counted": counted}))
    deepest = e.where("__counted").agg(F.max(depth)).head()[0] or 0  # of a stored table: one number, a window function for each depth
    last = lambda k: F.max(F.when(F.col("__restarts") & (F.col(depth) < k), F.col(pos)))
    w = Window.partitionBy(group, "__block").orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    e = e.withColumn("__reset", F.get(F.array(*[last(k).over(w) for k in range(deepest + 1)]), F.col(depth)))
    e = e.withColumn("__n", F.row_number().over(Window.partitionBy(group, "__block", kind, depth, "__reset").orderBy(pos)))
    # What each block leaves behind: its last restart above every depth, and how many rows of a kind follow that restart.
    ends = e.groupBy(group, "__block").agg(F.array(*[last(k) for k in range(deepest + 1)]).alias("__ends"))
    own = e.where("__counted").select(group, "__block", kind, depth, pos).join(big(ends), [group, "__block"])
    own = own.groupBy(group, "__block", kind, depth).agg(F.count_if(F.coalesce(F.col(pos) > F.get("__ends", F.col(depth)), F.lit(True))).alias("__left"))
    own = written(spark, own)  # a few rows per block
    every = ends.join(big(own.select(group, kind, depth).distinct()), group).join(big(own), [group, "__block", kind, depth], "left")
    by_kind = Window.partitionBy(group, kind, depth).orderBy("__block")
    every = every.withColumn("__seg", F.count(F.get("__ends", F.col(depth))).over(by_kind))
    total = F.sum(F.coalesce("__left", F.lit(0))).over(Window.partitionBy(group, kind, depth, "__seg").orderBy("__block"))
    every = every.withColumn("__total", total).withColumn("__carry", F.lag("__total").over(by_kind))
    carry = every.where("__carry > 0").select(group, "__block", kind, depth, "__carry")
    out = e.join(big(carry), [group, "__block", kind, depth], "left")
    n = F.col("__n") + F.when(F.col("__reset").isNull(), F.coalesce("__carry", F.lit(0))).otherwise(0)
    return out.withColumn("n", F.when(F.col("__counted"), n).cast("int")).select(*rows.columns, "n")


def neighbours(rows: DataFrame, group: str, pos: str, value: str) -> DataFrame:
    """rows with ``prev`` and ``next``: the value of the rows before and after in the group's order."""
    e = written(rows.sparkSession, rows.withColumn("__block", block_of(pos)))
    w = Window.partitionBy(group).orderBy("__block")
    edges = e.groupBy(group, "__block").agg(F.min_by(value, pos).alias("__first"), F.max_by(value, pos).alias("__last"))
    edges = edges.select(group, "__block", F.lag("__last").over(w).alias("__prev"), F.lead("__first").over(w).alias("__next"))
    inside = Window.partitionBy(group, "__block").orderBy(pos)
    e = e.join(big(edges), [group, "__block"]).withColumns({"prev": F.lag(value).over(inside), "next": F.lead(value).over(inside)})
    return e.withColumns({"prev": F.coalesce("prev", "__prev"), "next": F.coalesce("next", "__next")}).select(*rows.columns, "prev", "next")
