"""References that lead to one place are counted and led there once; texts are scanned once for all that definitions need."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import refs as R
from corpusloom.sources.store import written

DOCS = [
    *((f"t/a{i}.dita", f'<topic id="a">\n<p id="e"/>\n <xref href="b.dita#b/e"/><xref href="#a/e"/><xref href="#a/gone"/><xref href="../none.dita"/><xref scope="external" href="b.dita"/><ph keyref="k/x"/><ph conref="b.dita"/><xref href=""/></topic>') for i in range(3)),
    ("t/b.dita", '<topic>\n<topic id="b">\n  <p id = "e"/><xref href="./../t/a0.dita#a"/></topic></topic>'), ("/r.dita", '<a href="s.dita"/><ph keyref="k"/>'), ("/s.dita", "\n"), ("top.dita", '<a href="t/b.dita#b"/><b href="t/b.dita"/>'), ("t/null.dita", None),
]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(DOCS, "path string, content string")


def _keys(spark):
    return spark.createDataFrame([("t", "k", "t/b.dita", 9)], "scope_dir string, key string, map_path string, off int")


def test_names_in_folders(spark):
    dirs = ["", "/", "a", "/a", "a/", "a//b", "hdfs://nn/c", "hdfs://nn"]
    assert [r.d for r in spark.createDataFrame([(d,) for d in dirs], "x string").select(T.dirname(T.file_in("x")).alias("d")).collect()] == dirs


def test_alike_references_lead_where_each_of_them_does(spark, docs):
    places = R.scan_places(docs)
    refs, every = R.alike(R.references(places)), R.collect_refs(docs)
    assert R.references(places).count() == every.count() == refs.agg(F.sum("n")).head()[0]
    # Of the 24 references of t/a0 to t/a2, those into a file are three of a kind, those into the document itself are not.
    assert sorted(r.n for r in refs.collect()) == [1] * 14 + [3] * 5
    each = Counter((r.attr, r.value, r.target, r.target_line, r.target_col) for r in R.definitions(every, docs, _keys(spark)).collect())
    once = Counter()
    for r in R.definitions(refs, docs, _keys(spark), written(spark, places)).collect():
        once[r.attr, r.value, r.target, r.target_line, r.target_col] += r.n
    assert once == each and each["href", "b.dita#b/e", "t/b.dita", 2, 5] == 3 and each["keyref", "k/x", "t/b.dita", 1, 1] == 3 and each["href", "#a/e", "t/a1.dita", 1, 3] == 1


def test_texts_are_scanned_once_for_definitions(spark, docs, monkeypatch):
    scans, scan = [], R._scan
    monkeypatch.setattr(R, "_scan", lambda *a, **k: scans.append(a[2]) or scan(*a, **k))
    R.definitions(spark.createDataFrame([("t/a0.dita", "href", "b.dita#b/e", None)], "doc string, attr string, value string, scope string"), docs, _keys(spark)).collect()
    assert len(scans) == 1
