"""Tables written to the shared folder between steps, dealt by a key where many steps join on it, and join strategies."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a written table that may be broadcast.
SMALL = 8 << 20
#: Folders and tables of the scopes that are open, innermost last.
_SCOPES: list[tuple[list[str], list[str]]] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``. On a cluster the session must name one; a local session gets its own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/corpusloom-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1][0].append(path)
    return path


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _path(spark, path)
    fs.delete(p, True)


def bytes_of(spark: SparkSession, path: str) -> int:
    fs, p = _path(spark, path)
    return fs.getContentSummary(p).getLength()


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Tables that operators write inside are deleted at the end: use and save results before. Scopes may be nested."""
    _SCOPES.append(([], []))
    try:
        yield
    finally:
        folders, tables = _SCOPES.pop()
        for name in tables:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        for path in folders:
            delete(spark, path)


def written(spark: SparkSession, df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` written as Parquet and reread: made once, however often it is used, and its size is known."""
    path = path or shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(spark: SparkSession, df: DataFrame, key: str = "doc", buckets: int | None = None, placed: bool = False) -> DataFrame:
    """``df`` written in buckets by ``key``: joins, groups and windows on the key, alone or with more columns, need no exchange.

    One shuffle deals the rows, one file a bucket. Buckets are as many as the session's shuffle partitions, so what is
    shuffled by the key meets them without another one. ``placed``: the rows' partitions are already those of the deal.
    """
    n, name = buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), f"corpusloom_{uuid.uuid4().hex}"
    rows = df if placed else df.repartition(n, key)
    # A task holds one bucket (a few if partitions were put together), so its rows need no sort before they are written.
    writers = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(writers, "0")
    spark.conf.set(writers, "16")
    try:
        rows.write.format("parquet").bucketBy(n, key).option("path", shared_dir(spark)).saveAsTable(name)
    finally:
        spark.conf.set(writers, before)
    if _SCOPES:
        _SCOPES[-1][1].append(name)
    # A join on (key, more) may use the deal by key alone.
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return spark.table(name)


def big(df: DataFrame) -> DataFrame:
    """Join this side by sort and merge: sizes of exploded or Python-made tables are guesses, so none is broadcast."""
    return df.hint("merge")


def met(spark: SparkSession, df: DataFrame, most: int = SMALL) -> DataFrame:
    """Join this side by broadcast if it is small, which is proven by writing it, else by sort and merge."""
    path = shared_dir(spark)
    out = written(spark, df, path)
    return F.broadcast(out) if bytes_of(spark, path) <= most else big(out)


class Layers:
    """A table that grows by small written pieces: eight of one size are merged into one, so reading it all stays a union of a few."""

    WIDTH = 8

    def __init__(self, spark: SparkSession):
        self.spark, self.levels = spark, [[]]

    def add(self, piece: DataFrame) -> None:
        self.levels[0].append(piece)
        for k, level in enumerate(self.levels):
            if len(level) < self.WIDTH:
                break
            if k + 1 == len(self.levels):
                self.levels.append([])
            self.levels[k + 1].append(written(self.spark, self._union(level)))
            level.clear()

    @staticmethod
    def _union(pieces: list[DataFrame]) -> DataFrame:
        out = pieces[0]
        for p in pieces[1:]:
            out = out.unionByName(p)
        return out

    def all(self) -> DataFrame:
        return self._union([p for level in self.levels for p in level])
