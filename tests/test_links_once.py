"""Pages look a link up once for each folder, and only the rules of base types that occur are asked."""

from corpusloom.operators import documents as D
from corpusloom.sources import shred as X

DOCS = [
    *((f"a/d{i}.dita", f'<topic id="t"><title>T{i}</title><p><xref href="x.dita#x"/><xref href="#t"/><xref href="gone.dita"/><xref href="h &amp; i"/></p></topic>') for i in range(4)),
    ("b/e.dita", '<topic><xref href="x.dita#x"/><xref>own</xref><xref href="#t"> </xref></topic>'), ("a/x.dita", '<topic id="x"><title>In a</title></topic>'), ("b/x.dita", '<topic id="x"><title>In b</title></topic>'),
]


def test_links_are_looked_up_once_for_a_folder(spark, monkeypatch):
    asked, look = [], D.with_link_titles
    monkeypatch.setattr(D, "with_link_titles", lambda links, *more: asked.append(sorted((r.doc[:2], r.href) for r in links.collect())) or look(links, *more))
    nodes = X.stored_nodes(spark, spark.createDataFrame(DOCS, "path string, content string"), columns=D.PAGES, own=("topic/title",))
    html = {r.doc: r.html for r in D.topic_html(nodes).collect()}
    outside = [("a/", "gone.dita"), ("a/", "h & i"), ("a/", "x.dita#x")]
    assert asked == [sorted([*outside, ("b/", "x.dita#x"), *[("a/", "#t")] * 4])]
    away = '<span class="xref-external">→ {}</span>'.format
    for i in range(4):
        assert html[f"a/d{i}.dita"] == f'<article id="t" class="topic"><h1>T{i}</h1><p>{away("In a")}<a href="#t" class="xref">T{i}</a>{away("gone.dita")}{away("h &amp; i")}</p></article>'
    assert html["b/e.dita"] == f'<article class="topic">{away("In b")}<a href="#t" class="xref"> </a></article>'
    assert html["b/x.dita"] == '<article id="x" class="topic"><h1>In b</h1></article>'


def test_rules_that_nothing_needs_are_left_out(spark, monkeypatch):
    plans, keep = [], D.written
    monkeypatch.setattr(D, "written", lambda s, df, path=None: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or keep(s, df, path))
    nodes = X.stored_nodes(spark, spark.createDataFrame(DOCS, "path string, content string"), columns=D.PAGES, own=("topic/title",))
    D.topic_html(nodes)
    page = next(p for p in plans if "Window" in p)
    assert "topic/xref" in page and not [n for n in ("note", "image", "codeblock", "glossterm", "prolog", "tgroup") if f"topic/{n}" in page]
