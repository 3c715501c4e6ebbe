"""Reports on references read each text once."""

import pytest

from corpusloom.operators import refs as R
from corpusloom.sources.store import written

DOCS = [
    ("t/a.dita", '<topic id="a"><p id="e"/><xref href="b.dita#b/e"/><xref href="#a/gone"/><xref href="../none.dita"/><xref scope="external" href="x.dita"/><ph keyref="k/x"/><ph conref="b.dita#zz"/><xref href=""/></topic>'),
    ("t/b.dita", '<topic id="b"><p id = "e"/><xref href="./../t/a.dita#a"/><ph keyref="undefined"/></topic>'),
    ("t/empty.dita", ""), ("t/null.dita", None), ("t/c.dita", '<xref href="empty.dita"/><xref href="null.dita#x"/>'),
]


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(DOCS, "path string, content string")


def test_scan_holds_references_ids_and_paths(docs):
    scanned, names = R.scan_texts(docs), R.collect_refs(docs).columns
    assert _rows(R.references(scanned).select(*names)) == _rows(R.collect_refs(docs)) != []
    assert _rows(scanned.where("attr = 'id'").select("doc", "value", "value_start")) == _rows(R.id_positions(docs)) != []
    assert _rows(scanned.where("attr IS NULL").select("doc")) == _rows(docs.select("path"))


def test_targets_from_the_scan(spark, docs):
    scanned, refs = written(spark, R.scan_texts(docs)), R.collect_refs(docs)
    cols = R.with_targets(refs).columns
    assert _rows(R.with_targets(R.references(scanned)).select(*cols)) == _rows(R.with_targets(refs)) != []
    got, want = R.missing_ids(R.references(scanned), docs, scanned), R.missing_ids(refs, docs)
    assert _rows(got.select(*want.columns)) == _rows(want) != []


def test_diagnostics_make_each_text_once(spark, docs):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    keys = spark.createDataFrame([("t", "k")], "scope_dir string, key string")
    found = R.diagnostics(docs.mapInArrow(count, docs.schema), keys).select("doc", "code", "value")
    assert _rows(found) == sorted([
        ("t/a.dita", "missing-id", "#a/gone"), ("t/a.dita", "missing-file", "../none.dita"), ("t/a.dita", "missing-id", "b.dita#zz"),
        ("t/b.dita", "undefined-key", "undefined"), ("t/c.dita", "missing-id", "null.dita#x"),
    ], key=str)
    assert made.value == len(DOCS)
