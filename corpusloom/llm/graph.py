"""Connected components of a table of links, by contraction in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, written


def connected_components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable, for every id that occurs in ``links`` (a, b).

    Each round hooks every id to its smallest neighbour, jumps over two hooks and contracts the links to the new ids;
    links that fall together vanish. Rounds grow with the logarithm of the longest chain. Every round is written to the
    shared folder, so a lost executor costs one round at most.
    """
    folder = shared_dir(spark)
    links = links.select("a", "b").where("a <> b")
    both = written(spark, links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{folder}/0")
    found, k = None, 0
    while not both.isEmpty():
        k += 1
        hook = written(spark, both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("p")), f"{folder}/hook{k}")
        up = hook.select(F.col("a").alias("p"), F.col("p").alias("pp"))
        jump = hook.join(up.hint("merge"), "p").select("a", F.col("pp").alias("p"))
        up = jump.select(F.col("a").alias("p"), F.col("p").alias("pp"))
        hook = written(spark, jump.join(up.hint("merge"), "p").select("a", F.col("pp").alias("p")), f"{folder}/jump{k}")
        if found is None:
            found = hook.select(F.col("a").alias("id"), F.col("p").alias("component"))
        else:
            later = hook.select(F.col("a").alias("component"), "p")
            found = found.join(later.hint("merge"), "component", "left").select("id", F.coalesce("p", "component").alias("component"))
        found = written(spark, found, f"{folder}/found{k}")
        other = hook.select(F.col("a").alias("b"), F.col("p").alias("q"))
        both = both.join(hook.hint("merge"), "a").select(F.col("p").alias("a"), "b").join(other.hint("merge"), "b").select("a", F.col("q").alias("b"))
        both = written(spark, both.where("a <> b").distinct(), f"{folder}/{k}")
    return found if found is not None else both.select(F.col("a").alias("id"), F.col("b").alias("component"))
