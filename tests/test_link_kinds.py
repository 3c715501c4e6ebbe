"""Titles are looked for only among the kinds of links that a set of pages has."""

from corpusloom.operators import documents as D
from corpusloom.sources import shred as X


def test_pages_look_for_titles_of_their_own_links(spark, monkeypatch):
    asked = []
    plain = D.with_link_titles
    monkeypatch.setattr(D, "with_link_titles", lambda links, nodes, *kinds: asked.append(set(*kinds)) or plain(links, nodes, *kinds))
    docs = [("a.dita", '<topic id="t"><title>T</title><body><p><xref href="#t"/><xref href="#no"/><xref href="http://x/y"/></p></body></topic>')]
    pages = D.topic_html(X.stored_nodes(spark, spark.createDataFrame(docs, "path string, content string")))
    html = pages.collect()[0].html
    assert asked == [{"here", "none"}]
    assert '<a href="#t" class="xref">T</a><a href="#no" class="xref">#no</a>' in html and "http://x/y</span>" in html


def test_kinds_of_links(spark):
    hrefs = {"#a": "here", "b.dita#c": "id", "b.dita": "root", "B.XML": "root", "b.png": "none", "http://x/y.dita": "none", "": "none", None: "none"}
    rows = spark.createDataFrame([(h,) for h in hrefs], "href string").select("href", D.link_kind().alias("kind")).collect()
    assert {r.href: r.kind for r in rows} == hrefs


def test_base_types_that_occur(spark):
    rows = spark.createDataFrame([("topic/fig",), ("topic/p",), (None,)], "base string")
    assert D._bases_of(rows, ("topic/fig", "topic/note")) == {"topic/fig"}
    assert D._bases_of(rows.where("base IS NULL"), ("topic/fig", "topic/note")) == set()
