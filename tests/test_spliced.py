"""Spliced content: what a followed reference replaces goes whole, and only documents that are named are looked into."""

from corpusloom.operators import documents as D
from corpusloom.sources import shred as X

LIB = '<topic id="l"><title>L</title><body><p id="q">shared<ph conref="lib.dita#l/w">no</ph></p><ph id="w">word</ph></body></topic>'
DOC = (
    '<topic id="t"><title>T</title><body><p conref="lib.dita#l/q">a<ph conref="lib.dita#l/w">b</ph><b>c</b></p><p>after</p>'
    '<p conref="lib.dita#l/gone">kept <ph conref="lib.dita#l/w">d</ph></p><ul conref="lib.dita#l/q"><li><ph conref="lib.dita#l/w">e</ph></li></ul></body></topic>'
)
SHARED = '<p>shared<span class="ph">word</span></p>'


def _nodes(spark):
    return X.stored_nodes(spark, spark.createDataFrame([("a.dita", DOC), ("lib.dita", LIB)], "path string, content string"))


def test_references_in_replaced_content_are_not_followed(spark):
    html = {r.doc: r.html for r in D.topic_html(_nodes(spark)).collect()}
    assert f'{SHARED}<p>after</p><p>kept <span class="ph">word</span></p>{SHARED}</main>' in html["a.dita"]
    assert f'{SHARED}<span class="ph">word</span></main>' in html["lib.dita"]


def test_only_named_documents_are_taken_apart(spark, monkeypatch):
    asked = []
    plain = D._prefixes
    monkeypatch.setattr(D, "_prefixes", lambda key="key": asked.append(key) or plain(key))
    view = D.splice_conrefs(_nodes(spark))
    assert set(asked) == {"ord"}  # nodes of documents that are drawn are never joined with all their ancestors
    assert view.where("doc = 'a.dita' AND text = 'word'").count() == 3
    assert not view.where("text IN ('a', 'b', 'c', 'd', 'e', 'no')").count()
    assert view.count() == view.select("doc", "key").distinct().count()
