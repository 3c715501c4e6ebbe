"""Nodes that carry the texts of their elements, bare nodes, and paths that are resolved once."""

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import documents as D
from corpusloom.sources import shred as X

DOCS = [
    ("a/x.dita", '<topic id="a"><title>Top <b>bold <title>in</title></b>end</title><body><section id="s"><title>one</title></section><section id="s"><title>two</title><title>three</title></section>'
     '<p id="p">no title</p><p><xref href="../b/y.dita#b"/><xref href="#a/s"/><xref href="../b/./y.dita"/><xref href="#a/p"> </xref><xref href="http://h/x"/><xref/><xref href="../b/y.dita#gone">own</xref></p></body></topic>'),
    ("b/y.dita", '<concept id="b"><title/><conbody><example id="e"><title>Ex &amp; <xref href="#b">inner</xref></title></example></conbody></concept>'),
    ("b/broken.dita", "<topic><title>never closed</topic>"),
]
OWN = ("topic/title", "topic/xref")


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(DOCS, "path string, content string")


def test_carried_texts_equal_those_put_together(docs):
    plain, carried = X.shred(docs), X.shred(docs, own=OWN)
    assert _rows(D.element_text(carried, OWN)) == _rows(D.element_text(plain, OWN)) != []
    assert _rows(carried.drop("own").select("doc", "pre", "post", "ord", "path", "text", "error")) == _rows(plain.select("doc", "pre", "post", "ord", "path", "text", "error"))


@pytest.mark.parametrize("bare", [False, True])
def test_titles_and_links_from_carried_texts(spark, docs, bare):
    plain = X.shred(docs)
    carried = X.stored_nodes(spark, docs, columns=D.LINKS, own=OWN, bare=bare)
    for of in (D.titles, D.title_map, D.root_titles, D.xref_titles):
        assert _rows(of(carried)) == _rows(of(plain)) != []


def test_bare_nodes_are_few_and_hold_errors(docs):
    bare = X.shred(docs, own=OWN, bare=True)
    assert bare.where("type = 'text'").count() == 0
    assert bare.where("error IS NOT NULL").count() == 1
    assert bare.where("tag = 'body' OR tag = 'conbody'").count() == 0


def test_large_documents_carry_texts_piece_by_piece():
    xml = "<topic><title>" + "ab<b>c</b>" * 500 + "</title><p id='x'/></topic>"
    small = [r for rows in X._nodes(xml, X.tag_types(), own=("topic/title",), bare=True) for r in rows]
    pieces = [r for rows in X._nodes(xml, X.tag_types(), own=("topic/title",), bare=True, large=100, piece=64) for r in rows]
    assert sorted(r[18] or "" for r in small) == sorted(r[18] or "" for r in pieces) == ["", "", "abc" * 500]


def test_suppression_drops_carried_texts(docs):
    assert "own" not in D.suppress(X.shred(docs, own=OWN)).columns
    with pytest.raises(ValueError):
        D.suppress(X.shred(docs, columns=("pre", "base", "path"), own=OWN, bare=True))


def test_simple_cells_from_carried_texts(spark):
    docs = spark.createDataFrame([("s.dita", "<reference><refbody><simpletable><sthead><stentry>h<b>!</b></stentry></sthead><strow><stentry/><stentry>v</stentry></strow></simpletable></refbody></reference>")], "path string, content string")
    assert _rows(D.simple_cells(X.shred(docs, columns=D.SIMPLE, own=("topic/stentry",), bare=True))) == _rows(D.simple_cells(X.shred(docs))) != []


def test_link_kinds_are_told_without_resolving_paths(spark, docs):
    nodes = X.shred(docs)
    links = nodes.where("base = 'topic/xref'").select("doc", "pre", F.col("attrs")["href"].alias("href"))
    plan = D.with_link_titles(links, nodes)._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.split("\n") if "Filter" in line]
    assert filters and not any("url_decode" in line.lower() for line in filters)


def test_paths_are_made_once(spark):
    plan = spark.range(1).select(T.resolve(F.col("id").cast("string"), F.concat("id", F.lit("x"))))._jdf.queryExecution().analyzed().toString().lower()
    assert plan.count("url_decode") <= 2  # one call is written with both of its names


def test_settled_and_left_folders(spark):
    cases = [("a/../b", "b"), ("a/b/../../c", "c"), ("../a/../b", "../b"), ("a//b/./c", "a/b/c"), ("c:/../x", "c:/x"), ("/a/../../b", "/b"), ("hdfs://nn/../b", "hdfs://nn/b"), ("a/.../b", "a/.../b"), ("", ""), ("a/..", "")]
    df = spark.createDataFrame(cases, "p string, want string").select("p", "want", T.normalise("p").alias("got"))
    assert [r for r in df.collect() if r.got != r.want] == []
