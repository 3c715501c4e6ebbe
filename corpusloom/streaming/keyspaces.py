"""Key spaces that are kept up to date: stored by folder with the stamps of the files that they come from.

After a change only the folders whose files changed are made anew: those that recorded a file which was touched, removed or
has now appeared, and those that see a map which they did not see. What they need is read again, nothing else, and only
the partitions that hold these folders are written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import keys as K
from ..operators import maps as M
from ..operators import refs as R
from ..sources.shred import stored_nodes
from ..sources.store import big, written

KEYS = "scope_dir string, key string, value string, map_path string, distance int"
STAMPS = "scope_dir string, path string, mtime timestamp"
LINKS = "doc string, target string, mtime timestamp"


class KeySpaces:
    """Stored key spaces below ``folder``: tables keys, stamps and links, each in ``parts`` partitions.

    keys (KEYS) are those of ``keys.key_space``; stamps (STAMPS) name every map that a folder's keys come from, also those
    that are referred to and not there (mtime null); links (LINKS) lead from a map to the maps that it refers to, with the
    map's mtime when they were read (a row without target marks a map that refers to none).
    """

    def __init__(self, spark: SparkSession, folder: str, parts: int = 64):
        self.spark, self.folder, self.parts = spark, folder, parts

    def read(self, name: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        columns = [c.split(" ")[0] for c in schema.split(", ")]
        return self.spark.read.schema(f"{schema}, part int").parquet(f"{self.folder}/{name}").select(*columns)

    @property
    def keys(self) -> DataFrame:
        return self.read("keys", KEYS)

    @property
    def stamps(self) -> DataFrame:
        return self.read("stamps", STAMPS)

    def _part(self, column: str):
        return F.pmod(F.xxhash64(column), F.lit(self.parts)).cast("int")

    def _replace(self, name: str, schema: str, by: str, gone: DataFrame, new: DataFrame) -> None:
        """In table ``name`` the rows of ``gone`` (by) give way to ``new``; only the partitions that hold them are written."""
        kept = self.read(name, schema).withColumn("part", self._part(by))
        touched = gone.select(self._part(by).alias("part")).distinct()
        stay = kept.join(big(touched), "part", "left_semi").join(big(gone.select(by).distinct()), by, "left_anti")
        rows = written(self.spark, stay.select(*new.columns, "part").unionByName(new.withColumn("part", self._part(by))))
        # A partition whose rows are all gone is not overwritten by any row: it is emptied by hand.
        empty = touched.join(big(rows.select("part").distinct()), "part", "left_anti")
        rows.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{self.folder}/{name}")
        for (part,) in empty.collect():  # numbers of partitions: at most ``parts``
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/part={part}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _links(self, maps: DataFrame) -> DataFrame:
        """The links of all maps; only those of maps that were touched are read anew."""
        old = self.read("links", LINKS)
        now = maps.select(F.col("path").alias("doc"), F.col("mtime").alias("now"))
        state = written(self.spark, old.groupBy("doc").agg(F.max("mtime").alias("mtime")).join(big(now), "doc", "full_outer").where("NOT (mtime <=> now)"))
        if not state.isEmpty():
            fresh = maps.join(big(state.where("now IS NOT NULL").select(F.col("doc").alias("path"))), "path", "left_semi")
            refs = R.collect_refs(fresh).where("attr = 'href'").where(~T.is_external("value", "scope"))
            named = F.lower(T.path_part("value")).endswith(".ditamap") | F.coalesce(F.col("format") == "ditamap", F.lit(False))
            found = refs.where(named).select("doc", T.resolve(T.dirname("doc"), "value").alias("target")).where("target IS NOT NULL").distinct()
            new = fresh.select(F.col("path").alias("doc"), "mtime").join(big(found), "doc", "left").select("doc", "target", "mtime")
            self._replace("links", LINKS, "doc", state.select("doc"), new)
        return self.read("links", LINKS).where("target IS NOT NULL").select("doc", "target").distinct()

    def refresh(self, maps: DataFrame, dirs: DataFrame) -> DataFrame:
        """Bring the store to the state of maps(path, content, mtime) and folders (dirs: scope_dir); (scope_dir) that were made anew."""
        spark, stamps = self.spark, self.stamps
        now = maps.select("path", F.col("mtime").alias("now"))
        dirs = dirs.select("scope_dir").distinct()
        seen = K.visible_maps(dirs, maps)
        stale = stamps.join(big(now), "path", "left").where("NOT (mtime <=> now)").select("scope_dir")
        fresh = seen.join(big(stamps.select("scope_dir", F.col("path").alias("map_path"))), ["scope_dir", "map_path"], "left_anti").select("scope_dir")
        closed = stamps.select("scope_dir").join(big(dirs), "scope_dir", "left_anti")
        affected = written(spark, stale.unionByName(fresh).unionByName(closed).distinct())
        if affected.isEmpty():
            return affected
        links = written(spark, self._links(maps))
        seen = written(spark, seen.join(big(affected), "scope_dir", "left_semi"))
        # Every map that one of these folders' maps leads to, round by round.
        last = written(spark, seen.select(F.col("map_path").alias("root"), F.col("map_path").alias("path")).distinct())
        reach = last
        while not last.isEmpty():
            new = last.join(big(links.select(F.col("doc").alias("path"), "target")), "path").select("root", F.col("target").alias("path")).distinct()
            last = written(spark, new.join(big(reach), ["root", "path"], "left_anti"))
            reach = reach.unionByName(last)
        needed = maps.join(big(reach.select("path").distinct()), "path", "left_semi")
        nodes = stored_nodes(spark, needed)
        roots = seen.select(F.col("map_path").alias("path")).distinct()
        keys = K.key_space(seen, K.key_definitions(M.expand_maps(nodes, roots), nodes)).select(*[c.split(" ")[0] for c in KEYS.split(", ")])
        involved = seen.join(big(reach.withColumnRenamed("root", "map_path")), "map_path").select("scope_dir", "path").distinct()
        self._replace("keys", KEYS, "scope_dir", affected, keys)
        # Stamps last: a run that breaks off before leaves the folders stale, and the next one makes them again.
        self._replace("stamps", STAMPS, "scope_dir", affected, involved.join(big(now), "path", "left").select("scope_dir", "path", F.col("now").alias("mtime")))
        return affected


def kept_key_spaces(changes: DataFrame, spaces: KeySpaces, corpus: Callable[[], tuple[DataFrame, DataFrame]], checkpoint: str):
    """A streaming query: when maps are saved, the key spaces that come from them are made anew. ``corpus`` gives the state of
    (maps, dirs) at the time of the batch."""

    def renew(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            spaces.refresh(*corpus())

    saved = changes.where((F.col("op") == "save") & F.lower("path").endswith(".ditamap")).select("path", "ts")
    return saved.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(renew).start()
