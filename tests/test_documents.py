"""Small documents with known results."""

import time

import pandas as pd
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import documents as D
from corpusloom.operators import keys as K
from corpusloom.operators import map_html as H
from corpusloom.operators import maps as M
from corpusloom.operators import refs as R
from corpusloom.operators import site as S
from corpusloom.sources import shred as X
from corpusloom.streaming import changes as C


def one(spark, c):
    return spark.range(1).select(c).head()[0]


def docs(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, content string")


def test_functions(spark):
    lit = F.lit
    assert one(spark, T.escape_attr(lit("a&b<\"'>"))) == "a&amp;b&lt;&quot;&#39;&gt;"
    assert one(spark, T.resolve(lit("a/b"), lit("../c%20d.dita#x"))) == "a/c d.dita"
    assert one(spark, T.decode_href(lit("50%"))) == "50%"
    assert one(spark, T.relative(lit("a/b/c.x"), lit("a/d"))) == "../b/c.x"
    assert one(spark, T.relative(lit("c.x"), lit(""))) == "c.x"
    assert [one(spark, T.is_external(lit(v), lit(s))) for v, s in (("", None), ("http://x", None), ("a.dita", "external"), ("/x", None), ("a.dita", None), ("#a", None))] == [True, True, True, True, False, False]
    assert [one(spark, T.roman(lit(n))) for n in (1, 4, 1994)] == ["I", "IV", "MCMXCIV"]
    assert [one(spark, T.letters(lit(n))) for n in (1, 26, 27, 702, 703, 18278, 18279)] == ["A", "Z", "AA", "ZZ", "AAA", "ZZZ", "AAAA"]
    assert one(spark, T.json_in_page(lit("a</SCRIPT>"))) == r"a<\/script>" and one(spark, T.capitalised(lit("toc"))) == "Toc" and one(spark, T.safe_attr("a", lit(None).cast("string"))) == ""
    assert [one(spark, T.column_of(lit("ab\ncd"), lit(n))) for n in (1, 3, 4)] == [1, 0, 1]
    assert one(spark, T.js_trim(lit("  x "))) == "x"
    assert [one(spark, T.log_level(lit(x))) for x in ("[Error] [WARN]", "a [warn]", "x")] == ["error", "warn", "info"]


def test_shred_and_errors(spark):
    d = docs(spark, ("a", "<t id='1'>x<![CDATA[<y>]]><b/>z</t>"), ("bad", "<t>"), ("none", None), ("", ""))
    rows = X.shred(d).orderBy("doc", "pre").collect()
    ok = [r for r in rows if r.doc == "a"]
    assert [(r.type, r.tag, r.text) for r in ok] == [("element", "t", None), ("text", None, "x<y>"), ("element", "b", None), ("text", None, "z")]
    assert all(r.error for r in rows if r.doc != "a") and len(rows) == 7
    assert one(spark, X.clean_entities(F.lit('<!DOCTYPE t [<!ENTITY a "$&x">]><t>&a;&nope;&amp;</t>'))) == "<t>$&x&amp;</t>"


def test_known_entities_stay(spark):
    assert len(X.ENTITIES) == 41
    assert one(spark, X.clean_entities(F.lit("&ldquo;a&rdquo; &frac12;&nbsp;&Prime;&prime;&rarr;&nope;"))) == "“a” ½\u00a0″′→"


def test_references(spark):
    d = docs(spark, ("t/a.dita", '<p><xref href="b.dita#t/e" scope="local"/>é<ph conref="#s"/><x href="http://z"/>'), ("t/b.dita", '<topic id="t"><p id="e"/>'))
    text = d.where("path = 't/a.dita'").head().content
    refs = R.collect_refs(d).collect()
    assert [(r.tag, r.attr, r.value, r.value_start) for r in refs] == [(t, a, v, text.index(v)) for t, a, v in (("xref", "href", "b.dita#t/e"), ("ph", "conref", "#s"), ("x", "href", "http://z"))]
    assert [r.value for r in R.missing_ids(R.collect_refs(d), d).collect()] == ["#s"]


def test_tags_are_found_as_they_are_written(spark):
    text = """<a href="x" disabled><b data-href="q" href='no' href="r"><c id = "i" title='a>"b' href= "s"/><d q="href=" href="t" """
    refs = R.collect_refs(docs(spark, ("p", text))).collect()
    assert [(r.value, r.value_start) for r in refs] == [("x", text.index('"x"') + 1), ("r", text.index('"r"') + 1), ("s", text.index('"s"') + 1)]
    ids = R.id_positions(docs(spark, ("p", 'x-id="a" <p id = "b"/><p id="">'))).collect()
    assert [(r.id, r.off) for r in ids] == [("a", 2), ("b", 12)]
    maps = docs(spark, ("m", '<keydef keys="a b"/><keydef keys = "b c"/>'))
    assert {(r.key, r.off) for r in R.key_positions(maps).collect()} == {("a", 8), ("b", 8), ("c", 28)}


def test_ranges_of_elements(spark):
    text = '<t>\n<p a="/>">é<b/></p>\n</t>'
    rows = {r.tag: (r.line, r.col, r.end_line, r.end_col) for r in X.shred(docs(spark, ("d", text))).where("type = 'element'").collect()}
    assert rows == {"t": (0, 0, 2, 4), "p": (1, 0, 1, 19), "b": (1, 11, 1, 15)}
    points = spark.createDataFrame([("d", 1, 12), ("d", 1, 10), ("d", 2, 2), ("d", 9, 0), ("none", 0, 0)], "doc string, line int, col int")
    got = {(r.line, r.col): (r.tag, r.exact) for r in D.elements_at(points, X.shred(docs(spark, ("d", text)))).collect()}
    assert got == {(1, 12): ("b", True), (1, 10): ("p", True), (2, 2): ("t", True), (9, 0): ("p", False)}


def expanded_by_hand(maps, path):
    """Entries (tag, href, depth) of a map as a recursive reader sees them. maps: path -> list of (tag, href, children)."""

    def walk(items, depth, seen):
        for tag, href, children in items:
            out.append((tag, href, depth))
            kids, known = list(children), seen
            if href.endswith(".ditamap"):
                known = set() if seen is None else seen  # below the outermost reference all share one set
                if href not in known:
                    known.add(href)
                    kids += maps.get(href, [])
            walk(kids, depth + 1, known)

    out: list = []
    walk(maps[path], 0, None)
    return out


def test_expansion_equals_recursion(spark):
    import random

    rng = random.Random(4)
    names = [f"m{k}.ditamap" for k in range(7)]

    def item(level):
        href = rng.choice([*names, "x.dita", "gone.ditamap"])
        return "topicref", href, [item(level + 1) for _ in range(rng.randrange(3 - level) if level < 2 else 0)]

    maps = {n: [item(0) for _ in range(rng.randrange(3))] for n in names}
    draw = lambda items: "".join(f'<{t} href="{h}">{draw(c)}</{t}>' for t, h, c in items)
    d = docs(spark, *((n, f"<map>{draw(x)}</map>") for n, x in maps.items()))
    nodes = X.stored_nodes(spark, d)
    got = {n: [] for n in names}
    for r in M.map_entries(M.expand_maps(nodes), nodes).orderBy("root_map", "pos").collect():
        got[r.root_map].append((r.tag, r.href, r.depth))
    assert got == {n: expanded_by_hand(maps, n) for n in names}


def test_deep_chains_are_not_cut(spark):
    d = docs(spark, *((f"m{k}.ditamap", f'<map><topicref href="m{k + 1}.ditamap"/></map>') for k in range(26)))
    nodes = X.stored_nodes(spark, d)
    e = M.map_entries(M.expand_maps(nodes, d.where("path = 'm0.ditamap'")), nodes)
    assert e.agg(F.max("depth"), F.count("*")).head()[:] == (25, 26)


def test_names_and_keys_of_map_references(spark):
    x = """<map><topicref keys="outer"><topicmeta><navtitle> Nice </navtitle><navtitle>no</navtitle></topicmeta><keydef keys="in"><topicmeta><keywords><keyword>INNER</keyword></keywords></topicmeta></keydef></topicref>
    <topicref href="a/.b.c" navtitle="no"/><topicref/><topichead keys="h"/><topicgroup><topicref href="g.dita"/></topicgroup><reltable><relrow><relcell><topicref href="r.dita"/></relcell></relrow></reltable></map>"""
    nodes = X.stored_nodes(spark, docs(spark, ("m.ditamap", x)))
    expanded = M.expand_maps(nodes)
    e = M.map_entries(expanded, nodes).orderBy("pos").collect()
    assert [(r.display_name, r.depth) for r in e] == [("Nice", 0), ("INNER", 1), (".b", 0), ("(unnamed)", 0), ("h", 0), ("g", 0)]
    assert {(r.key, r.value) for r in K.key_definitions(expanded, nodes).collect()} == {("outer", "Nice"), ("in", "INNER")}
    o = M.map_outline(nodes).orderBy("pos").collect()
    assert [(r.name, r.kind, r.depth) for r in o] == [("Nice", "ref", 0), ("in", "keydef", 1), ("no", "ref", 0), ("(unnamed)", "ref", 0), ("h", "head", 0), ("g.dita", "ref", 0)]


def simulate(rows):
    """The numbering rule, by hand: any division restarts the counters below it."""
    counters, out = {}, []
    for tag, depth in rows:
        if tag in ("chapter", "part", "appendix", "preface", "notices", "draftintro", "dedication", "colophon", "bookabstract", "amendments", "glossaryref"):
            counters = {k: v for k, v in counters.items() if k[1] <= depth}
        if tag in ("chapter", "part", "appendix"):
            counters[tag, depth] = counters.get((tag, depth), 0) + 1
            out.append(counters[tag, depth])
        else:
            out.append(None)
    return out


def test_numbering_follows_the_rule(spark):
    import random

    rng = random.Random(1)
    books = {f"m{k}": [(rng.choice(["chapter", "part", "appendix", "topicref", "preface", "colophon"]), rng.randrange(12)) for _ in range(60)] for k in range(20)}
    rows = [(m, p, t, d) for m, b in books.items() for p, (t, d) in enumerate(b)]
    got = M.number_divisions(spark.createDataFrame(rows, "root_map string, pos int, tag string, depth int")).collect()
    for m, b in books.items():
        assert [r.n for r in sorted((r for r in got if r.root_map == m), key=lambda r: r.pos)] == simulate(b)
    assert {r.role for r in got if r.tag == "colophon"} == {"Colophon"} and {r.role for r in got if r.tag == "topicref"} == {None}


def test_map_tree(spark):
    x = '<bookmap><booktitle><mainbooktitle>M &lt;</mainbooktitle><subtitle>S</subtitle></booktitle><frontmatter><topicgroup><chapter href="a.dita"><topichead/></chapter></topicgroup></frontmatter><keydef keys="k"/><reltable><relheader><relcolspec navtitle="H"/></relheader><relrow><relcell><topicref href="r.dita"/></relcell></relrow></reltable></bookmap>'
    nodes = X.stored_nodes(spark, docs(spark, ("m.ditamap", x)))
    html = H.map_html(M.expand_maps(nodes), nodes).head().html
    lines = """
    <div class="ditamap-container"><div class="book-titlepage"><h1 class="map-title">M &lt;</h1><p class="book-subtitle">S</p></div><ul class="map-tree">
    <li class="map-tree-item map-tree-item--structural"><span class="map-tree-label map-tree-label--structural">Frontmatter</span><ul class="map-tree">
    <li class="map-tree-item map-tree-item--group"><ul class="map-tree">
    <li class="map-tree-item map-tree-item--nav" data-keys="" data-href="a.dita"><a href="#" class="map-tree-link" data-href="a.dita">
    <span class="map-tree-icon map-tree-icon--file">\U0001f4c4</span><span class="map-tree-badge">Chapter 1</span><span class="map-tree-label">a</span></a><ul class="map-tree">
    <li class="map-tree-item map-tree-item--head"><span class="map-tree-label map-tree-label--head">(unnamed)</span></li></ul></li></ul></li></ul></li>
    <li class="map-tree-item map-tree-item--keydef" data-keys="k"><span class="map-tree-icon map-tree-icon--key">\U0001f511</span><span class="map-tree-label map-tree-label--keydef">k</span></li>
    <div class="map-reltable"><h2 class="map-reltable-title">Related Information</h2><table class="map-reltable-table"><tbody><tr class="relheader"><th>H</th></tr><tr class="relrow"><td><span class="relcell-content">
    <ul class="map-tree map-tree--inline"><li class="map-tree-item map-tree-item--nav" data-keys="" data-href="r.dita"><a href="#" class="map-tree-link" data-href="r.dita">
    <span class="map-tree-icon map-tree-icon--file">\U0001f4c4</span><span class="map-tree-label">r</span></a></li></ul></span></td></tr></tbody></table></div></ul></div>"""
    assert html == "".join(x.strip() for x in lines.split("\n"))


def test_search(spark):
    d = spark.createDataFrame([("a", "x A.b a.B aab É"), ("n", None)], "doc string, content string")
    at = lambda *a, **k: [(r.n, r.start, r.end) for r in S.search(d, *a, **k).collect()]
    assert at("a.b") == [(1, 2, 5), (2, 6, 9)] and at("É".lower()) == [(1, 14, 15)] and at("é", case_sensitive=True) == []
    assert at("b*", regex=True, case_sensitive=True) == [(1, 4, 5), (2, 12, 13)]
    assert at("(", regex=True) == at("") == [] and S.pattern_error("(") and S.pattern_error("(", regex=False) is None
    assert at("a", most=2) == [(1, 2, 3), (2, 6, 7)]


def test_transclusion(spark):
    a = '<topic id="a"><body><p conref="b.dita#b/p1">lit</p><ph conref="b.dita#b/path" outputclass="mine">lit</ph><p conref="#a/x">same file</p><p conref="b.dita#b/none">none</p></body></topic>'
    b = '<topic id="b"><body><p id="p1">one <ph conref="b.dita#b/path"/> <b conref="b.dita#b/loop">never</b></p><filepath id="path" conref="c" product="q">/x</filepath><b id="loop">L<i><b conref="b.dita#b/loop">stop</b></i></b></body></topic>'
    nodes = X.stored_nodes(spark, docs(spark, ("a.dita", a), ("b.dita", b)))
    html = {r.doc: r.html for r in D.topic_html(nodes).collect()}
    path = '<span class="filepath">/x</span>'
    assert html["a.dita"] == f'<article id="a" class="topic"><main class="body"><p>one {path} <strong>L<em><strong>stop</strong></em></strong></p>{path}<p>same file</p><p>none</p></main></article>'
    view = D.splice_conrefs(nodes).where("doc = 'a.dita' AND tag = 'filepath' AND size(key) = 2").head()
    assert dict(view.attrs) == {"outputclass": "mine", "product": "q"}


def test_html_of_headings_and_unknown_tags(spark):
    x = "<topic><title>T &amp; U</title><prolog><p>no</p></prolog><body><section><title>S</title><odd>a<b>c</b></odd></section><xref>gone</xref><fig><title>F</title><p>x</p></fig></body></topic>"
    nodes = X.stored_nodes(spark, docs(spark, ("d", x)))
    body = '<main class="body"><section><h{b}>S</h{b}>a<strong>c</strong></section><figure><p>x</p><figcaption>F</figcaption></figure></main></article>'
    levels = spark.createDataFrame([("d", 1), ("d", 6)], "doc string, level int")
    assert {r.level: r.html for r in D.topic_html(nodes, levels=levels).collect()} == {n: f'<article class="topic"><h{n}>T &amp; U</h{n}>' + body.format(b=min(6, n + 1)) for n in (1, 6)}
    assert one(spark, D.standalone_html(F.lit("<"), F.lit("<p/>"))).count("&lt;") == 1


def test_contents_and_classes_of_messy_input(spark):
    pages = spark.createDataFrame([(1, '<h1 id="t">A <b>B</b></h1><section id="x"><h2 class="sectiontitle">C<br>&lt;'), (2, '<section id="x"><h2 class="sectiontitle">only</h2></section>'), (3, None)], "page int, html string")
    assert [(r.page, r.pos, r.id, r.title) for r in S.toc_items(pages).collect()] == [(1, 0, "t", "A B"), (1, 1, "x", "C<")]
    f = docs(spark, ("a.mod", '<!ENTITY % e "topic/ph">\n<!ATTLIST (a|b)\n x CDATA ""\n class CDATA "- %e; d/a ">\n<!ATTLIST a class CDATA "- %e; d/a ">'), ("b.mod", None))
    assert [(r.line, r.tag, r.class_value) for r in S.scan_classes(f).orderBy("ord").collect()] == [(2, "a", "- topic/ph d/a "), (2, "b", "- topic/ph d/a "), (5, "a", "- topic/ph d/a ")]
    bases = spark.createDataFrame([("- topic/topic ",), ("- topic/ph a/b ",), ("+ x a/b ",), (None,)], "c string").select(X.derive_base_type("c").alias("b")).collect()
    assert [r.b for r in bases] == [None, "topic/ph", None, None]


def test_folders(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.dita").write_text("<topic/>")
    (tmp_path / "b.txt").write_text("no")
    got = X.docs_from_dir(spark, str(tmp_path)).collect()
    assert [(r.path.rsplit("/", 1)[-1], r.content) for r in got] == [("a.dita", "<topic/>")]
    files = spark.createDataFrame([("d", x) for x in ("a.dita", ".h/a.dita", "out/a.xml", "1/2/3/4.xml", "1/2/3/4/5.xml", "z.txt", "B.DITAMAP")], "dir string, rel string")
    assert {r.rel for r in X.list_files(files).collect()} == {"a.dita", "1/2/3/4.xml", "B.DITAMAP"}
    assert X.list_files(files, most=1).count() == 1
    D.write_pages(spark.createDataFrame([("m", "a.html", "<p>")], "root_map string, file string, html string"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).head().value == '{"file":"a.html","html":"<p>"}'
    S.write_catalogue(spark.createDataFrame([("b", "topic"), ("a", "topic")], "tag string, bucket string").coalesce(1), str(tmp_path / "cat"))
    assert [r.tag for r in spark.read.json(str(tmp_path / "cat")).collect()] == ["a", "b"]


def run_stream(spark, rows, schema, tmp_path, start):
    """Run a streaming query over ``rows`` until it has read them all."""
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(src)
    q = start(spark.readStream.schema(schema).parquet(src), str(tmp_path / "c"))
    try:
        q.processAllAvailable()
    finally:
        q.stop()


def test_streams_of_changes(spark, tmp_path):
    ts = lambda s: pd.Timestamp(f"2024-01-01 00:00:{s:02d}").to_pydatetime()
    schema = "path string, ts timestamp, op string, content string"
    rows = [("a.ditamap", ts(1), "change", "1"), ("a.ditamap", ts(2), "save", "2"), ("b", ts(1), "open", "x"), ("b", ts(3), "close", None), ("c", ts(59), "change", "late")]
    seen: dict[str, list] = {}
    keep = lambda name: lambda df: seen.setdefault(name, []).extend(r.asDict() for r in df.collect())
    (tmp_path / "1").mkdir(), (tmp_path / "2").mkdir(), (tmp_path / "3").mkdir(), (tmp_path / "4").mkdir()
    run_stream(spark, rows, schema, tmp_path / "1", lambda s, c: C.validated(s, keep("valid"), c))
    assert {(r["path"], r["kind"], r["content"]) for r in seen["valid"]} == {("a.ditamap", "settled", "1"), ("a.ditamap", "now", "2"), ("b", "now", "x"), ("b", "closed", None)}
    run_stream(spark, rows, schema, tmp_path / "2", lambda s, c: C.republished(s, keep("pages"), c))
    assert ("a.ditamap", "1") in {(r["path"], r["content"]) for r in seen["pages"]}
    run_stream(spark, rows, schema, tmp_path / "3", lambda s, c: C.refreshed_maps(s, keep("maps"), c))
    assert [r["path"] for r in seen["maps"]] == ["a.ditamap"]
    run_stream(spark, rows, schema, tmp_path / "4", lambda s, c: C.stream_closed(s).writeStream.outputMode("append").option("checkpointLocation", c).foreachBatch(lambda df, _: keep("closed")(df)).start())
    assert {(r["path"], r["content"], r["closed"]) for r in seen["closed"]} == {("a.ditamap", "2", False), ("b", None, True), ("c", "late", False)}
    lines = spark.createDataFrame([("r", ts(1), "error"), ("r", ts(2), "error"), ("r", ts(3), "info")], "run string, ts timestamp, level string")
    assert {(r.level, r.n) for r in C.level_counts(lines).collect()} == {("error", 2), ("info", 1)}


def test_stream_of_chunks_gives_lines(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("r", 0, "a\nb[ERR"), ("r", 1, "OR]\nc")], "run string, seq long, chunk string").coalesce(1).write.parquet(src)
    stream = C.stream_log_lines(spark.readStream.schema("run string, seq long, chunk string").parquet(src))
    q = stream.writeStream.format("memory").queryName("lines").option("checkpointLocation", str(tmp_path / "c")).start()
    for _ in range(120):  # a query with processing-time timeouts never runs out of batches
        if spark.table("lines").count() >= 2:
            break
        time.sleep(0.5)
    q.stop()
    assert {(r.line, r.level) for r in spark.table("lines").collect()} == {("a", "info"), ("b[ERROR]", "error")}


def test_debounce_batch(spark):
    ts = pd.Timestamp("2024-01-01")
    rows = [("p", (ts + pd.Timedelta(milliseconds=m)).to_pydatetime(), "change", c) for m, c in ((0, "1"), (500, "2"), (1000, "3"), (3000, "4"))]
    got = C.debounced(spark.createDataFrame(rows, "path string, ts timestamp, op string, content string")).orderBy("due").collect()
    assert [(r.content, r.n) for r in got] == [("3", 3), ("4", 1)]
