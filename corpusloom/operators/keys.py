"""Key spaces: which maps a folder sees, what their keys mean, and where they are defined."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.store import big, met
from .maps import key_values


def visible_maps(dirs: DataFrame, maps: DataFrame, nearest_only: bool = False) -> DataFrame:
    """(scope_dir, map_path, distance): maps in a folder and its ancestors. dirs: scope_dir; maps: path."""
    up = dirs.select("scope_dir").distinct().select("scope_dir", F.posexplode(T.ancestors("scope_dir")).alias("distance", "dir"))
    m = maps.select(F.col("path").alias("map_path"), T.dirname("path").alias("dir"))
    out = up.join(big(m), "dir").select("scope_dir", "map_path", "distance")
    if nearest_only:
        out = out.withColumn("__r", F.rank().over(Window.partitionBy("scope_dir").orderBy("distance"))).where("__r = 1").drop("__r")
    return out


def owning_map(dirs: DataFrame, maps: DataFrame) -> DataFrame:
    """(scope_dir, map_path, candidates): the nearest map, first by name, and all at that distance."""
    near = visible_maps(dirs, maps, nearest_only=True)
    return near.groupBy("scope_dir").agg(F.min("map_path").alias("map_path"), F.array_sort(F.collect_list("map_path")).alias("candidates"))


def key_definitions(expanded: DataFrame, nodes: DataFrame, split_keys: bool = False) -> DataFrame:
    """(root_map, key, value, order_key) of expanded maps.

    The value is the first filled of keyword, linktext, navtitle, shortdesc in the element's own topicmeta, each directly and
    then in its keywords; else the key itself. Only keydefs and topicrefs define keys.
    """
    defs = expanded.where(F.col("base").isin("map/keydef", "map/topicref") & (F.coalesce(F.col("attrs")["keys"], F.lit("")) != ""))
    key = F.explode(F.split(T.js_trim(F.col("attrs")["keys"]), r"\s+")) if split_keys else F.col("attrs")["keys"]
    d = defs.withColumn("key", key).join(big(key_values(nodes).withColumnRenamed("doc", "src_map")), ["src_map", "pre"], "left")
    return d.select("root_map", "key", F.coalesce("value", "key").alias("value"), "order_key")


def key_space(visible: DataFrame, definitions: DataFrame) -> DataFrame:
    """keys(scope_dir, key, value, map_path, distance): the nearest map wins, then its name, then document order."""
    j = visible.join(big(definitions.withColumnRenamed("root_map", "map_path")), "map_path")
    best = j.groupBy("scope_dir", "key").agg(F.min_by(F.struct("value", "map_path", "distance"), F.struct("distance", "map_path", "order_key")).alias("b"))
    return best.select("scope_dir", "key", "b.*")


def resolve_keyrefs(uses: DataFrame, keys: DataFrame) -> DataFrame:
    """uses(scope_dir, key, tag, own) with the text that is shown: own content, else the key's value, else for a ph a
    placeholder and for an abbreviated form the key's name."""
    # Uses are many times the keys: if these are small, no use is shuffled.
    j = uses.join(met(uses.sparkSession, keys.select("scope_dir", "key", F.col("value").alias("__v"))), ["scope_dir", "key"], "left")
    bare = F.when(F.col("tag") == "ph", F.concat(F.lit("["), F.col("key"), F.lit("]"))).when(F.col("tag") == "abbreviated-form", F.col("key")).otherwise(F.coalesce("own", F.lit("")))
    shown = F.when(~T.is_blank("own"), F.col("own")).when(F.col("__v").isNotNull(), F.col("__v")).otherwise(bare)
    return j.withColumn("shown", shown).withColumn("resolved", F.col("__v").isNotNull()).drop("__v")
