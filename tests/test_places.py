"""Files by their place below a root folder, however the folder is named."""

from pyspark.sql import functions as F

from corpusloom.sources.shred import relative_path


def test_relative_path_of_roots_with_and_without_scheme(spark):
    rows = [("file:/r/a/b.html",), ("file:///r/a/b.html",), ("hdfs://nn:8020/r/a/b.html",), ("/r/a/b.html",), ("file:/else/b.html",)]
    d = spark.createDataFrame(rows, "path string")
    got = lambda root, col="path": [r[0] for r in d.select(relative_path(col, root)).collect()]
    assert got("/r") == got("/r/", F.col("path")) == ["a/b.html"] * 4 + ["file:/else/b.html"]
    assert got("file:///r") == got("file:/r/") == ["a/b.html", "a/b.html", *(r[0] for r in rows[2:])]
    assert got("hdfs://nn:8020/r")[2:] == ["a/b.html", "/r/a/b.html", "file:/else/b.html"]


def test_replaced_places_with_long_keys(spark, tmp_path):
    import duckdb

    from corpusloom.plans.catalog import ORACLE_SQL, QUERIES

    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet").withColumn("p_partkey", F.col("p_partkey") + 1_000_000)
    part.write.parquet(f"file://{tmp_path}/part.parquet")
    want = duckdb.connect().execute(ORACLE_SQL["replaced_places"].replace("FROM part", f"FROM '{tmp_path}/part.parquet/*.parquet' AS part")).fetchall()
    got = [tuple(r) for r in QUERIES["replaced_places"](spark, f"file://{tmp_path}").collect()]
    assert sorted(got) == sorted(want) and len(got) > 0
