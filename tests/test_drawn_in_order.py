"""HTML in one pass over a document: rows after and before an element say what it holds and what is hidden."""

import pytest

from corpusloom.operators import documents as D
from corpusloom.sources import shred as X

DOC = """<topic xml:lang="zh"><title>T</title><body><p> <prolog><p>no</p></prolog> <ph keyref="k"> </ph><ph keyref="gone"> <indexterm>x</indexterm> </ph><ph keyref="k">own</ph></p>
<xref href=""><b>cut <xref href="#s"/></b></xref><boolean value="yes">cut<b/></boolean><b>kept</b><note>N</note><xref href="#s"/><xref href="o.dita"/><xref href="#none"> </xref>
<fig><title>A</title><fig><title>B</title><p>in</p></fig><title>C<b>c</b></title></fig><section id="s"><title>S &amp; '</title></section>
<table><tgroup><colspec colname="a" colnum="1"/><colspec colname="b" colnum="3"/><tbody><row><entry namest="a" nameend="b">1<table><tgroup><colspec colname="a" colnum="7"/><tbody><row><entry namest="a" nameend="b"/></row></tbody></tgroup></table></entry></row></tbody></tgroup></table></body></topic>""".replace("\n", "")
WANTED = """<article class="topic"><h1>T</h1><main class="body"><p>  <span class="ph">v\0l\0n&lt;</span><span class="ph unresolved-keyref" title="Unresolved key: gone">[gone]</span><span class="ph">own</span></p>
<span class="boolean" data-value="yes">yes</span><strong>kept</strong><div class="note note--note"><span class="note__label">注:</span> N</div><a href="#s" class="xref">S &amp; &#39;</a><span class="xref-external">→ O</span><a href="#none" class="xref"> </a>
<figure><figure><p>in</p><figcaption>B</figcaption></figure><figcaption>A</figcaption></figure><section id="s"><h2>S &amp; '</h2></section>
<table class="cals-table"><colgroup><col><col></colgroup><tbody><tr><td colspan="3">1<table class="cals-table"><colgroup><col></colgroup><tbody><tr><td colspan="3"></td></tr></tbody></table></td></tr></tbody></table></main></article>""".replace("\n", "")


@pytest.fixture
def nodes(spark):
    return X.stored_nodes(spark, spark.createDataFrame([("d.dita", DOC), ("o.dita", "<topic><title>O</title></topic>")], "path string, content string"), columns=D.DRAWN)


def test_what_is_seen_from_neighbours(spark, nodes):
    keys = spark.createDataFrame([("", "k", "v\0l\0n<")], "scope_dir string, key string, value string")
    assert {r.doc: r.html for r in D.topic_html(nodes, keys).collect()} == {"d.dita": WANTED, "o.dita": '<article class="topic"><h1>O</h1></article>'}


def test_pages_are_put_together_without_lambdas(nodes, monkeypatch):
    """Nodes meet their neighbours in windows of one order, and events are sorted by generated code."""
    plans, keep = [], D.written
    monkeypatch.setattr(D, "written", lambda s, df, path=None: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or keep(s, df, path))
    D.topic_html(nodes)
    page = next(p for p in plans if "Window" in p)
    assert page.count("Window [") >= 2 and "arrays_overlap" not in page and "transform(sort_array" not in page and "sort_array(flatten(" in page
