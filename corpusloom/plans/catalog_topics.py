"""Queries on topics, pages and schemas: rendering, transclusion, tables, references, audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import documents as D
from ..operators import refs as R
from ..operators import site as S
from ..sources import shred as X
from ..sources.store import written
from ..streaming import changes as C
from . import corpus
from .corpus import cat, table
from .registry import query


@query(r"""
WITH p AS (SELECT *, CASE WHEN p_partkey % 3 = 0 THEN '提示' ELSE 'Tip' END AS tip, p_size % 4 AS k, '<span class="ph">' AS ph FROM part)
SELECT 'rich/p' || p_partkey || '.dita' AS doc, md5('<article id="t" class="topic"><h1>' || p_name || '</h1><p class="shortdesc">S</p><main class="body">'
  || '<section id="s"><h2>' || p_brand || '</h2><p>a &amp; <span class="uicontrol">' || p_name || '</span><sup class="fn fn-call-f">n</sup></p></section>'
  || '<div class="note note--tip"><span class="note__label">' || tip || ':</span> N</div><div class="note note--odd"><span class="note__label">odd:</span> O</div>'
  || '<figure id="g"><img src="i.png" alt="" width="5" class="image-break" loading="lazy" data-dita-src="i.png"><figcaption>Fig</figcaption></figure>'
  || '<pre class="codeblock language-sql"><code>x</code><div class="codeblock-lang">sql</div></pre><p><a href="#s" class="xref">' || p_brand || '</a><a href="#nowhere" class="xref">#nowhere</a></p>'
  || CASE WHEN k < 2 THEN ph || 'value ' || k || '</span>' ELSE '<span class="ph unresolved-keyref" title="Unresolved key: k' || k || '">[k' || k || ']</span>' END
  || '<span class="ph unresolved-keyref" title="Unresolved key: gone">[gone]</span>' || ph || 'C</span>'
  || '<table id="tb" class="cals-table"><colgroup><col style="width: 25.00%"><col style="width: 75.00%"></colgroup><thead><tr><th colspan="2">H</th></tr></thead><tbody><tr><td rowspan="2">1</td><td>2</td></tr></tbody></table>'
  || '<table class="simple-table"><thead><th>h</th></thead><tr><td>d</td></tr></table>'
  || '<p>shared <strong>bold</strong><span class="filepath">/etc</span></p><span class="filepath">/etc</span>'
  || '<span class="boolean" data-value="yes">yes</span></main></article>') AS hash FROM p""")
def rich_html(spark, sf_dir):
    """Topics with notes, figures, code, tables, links, keys and nested transclusion, in two languages."""
    nodes = X.stored_nodes(spark, corpus.rich_topics(spark, sf_dir), columns=D.DRAWN, own=("topic/title",))
    keys = spark.createDataFrame([("rich", f"k{k}", f"value {k}") for k in (0, 1)], "scope_dir string, key string, value string")
    return D.topic_html(nodes, keys).where("doc LIKE 'rich/p%'").select("doc", F.md5("html").alias("hash"))


@query("""
SELECT 'parts/p' || p_partkey || '.dita' AS doc, md5('<article title="topic" data-line="0" data-end-line="0" data-start-col="0" data-end-col="' || len || '"' || CASE WHEN i <> '' THEN ' id="p' || p_partkey || '"' ELSE '' END || ' class="topic"><h1 title="title" data-line="0" data-end-line="0" data-start-col="'
  || a || '" data-end-col="' || b || '">' || p_name || '</h1><main title="body" data-line="0" data-end-line="0" data-start-col="' || b || '" data-end-col="' || (len - 8) || '" class="body"><p title="p" data-line="0" data-end-line="0" data-start-col="'
  || (b + 6) || '" data-end-col="' || (len - 15) || '">' || p_brand || '</p></main></article>') AS hash
FROM (SELECT *, 7 + length(i) AS a, 22 + length(i) + length(p_name) AS b, 22 + length(i) + length(p_name) + 6 + 7 + length(p_brand) + 7 + 8 AS len
  FROM (SELECT *, CASE WHEN p_size % 4 = 2 THEN '' ELSE ' id="p' || p_partkey || '"' END AS i FROM part WHERE p_size % 2 = 0))""")
def positioned_html(spark, sf_dir):
    """HTML whose elements carry their tag and source range."""
    nodes = X.stored_nodes(spark, corpus.part_topics(spark, sf_dir))
    return D.topic_html(nodes, positions=True).select("doc", F.md5("html").alias("hash"))


@query("""
SELECT 'spec/p' || p_partkey || '.xml' AS doc, 'x' || p_partkey AS id, p_name AS title FROM part""")
def specialised_titles(spark, sf_dir):
    """Elements that only their class attribute explains: no tag of these documents is known by name."""
    c = F.col
    docs = table(spark, sf_dir, "part").select(cat("spec/p", c("p_partkey"), ".xml").alias("path"), cat('<paper id="x', c("p_partkey"), '" class="- topic/topic p/paper "><headline class="- topic/title p/headline ">', c("p_name"), '</headline><secret class="- topic/prolog p/secret ">no</secret></paper>').alias("content"))
    return D.title_map(D.suppress(X.stored_nodes(spark, docs)))


@query("""
SELECT 'o/p' || p_partkey || '.dita' AS doc, depth, name, detail, kind FROM part CROSS JOIN LATERAL (VALUES
  (0, p_name, 'concept', 'topic'), (1, '(section)', 'section', 'section'), (2, '(example)', 'example', 'section'), (1, 'Post ' || p_size, 'postreq', 'section'), (1, 'inner', 'topic', 'topic')) AS v(depth, name, detail, kind)""")
def nested_outline(spark, sf_dir):
    c = F.col
    docs = table(spark, sf_dir, "part").select(cat("o/p", c("p_partkey"), ".dita").alias("path"), cat("<concept><title>", c("p_name"), "</title><conbody><section><div><example><title> </title></example></div></section><postreq><title>Post ", c("p_size"), '</title></postreq></conbody><topic id="inner"/></concept>').alias("content"))
    return D.topic_outline(X.stored_nodes(spark, docs, columns=D.OUTLINE, own=("topic/title",))).select("doc", "depth", "name", "detail", "kind")


@query("""
SELECT 's/p' || p_partkey || '.dita' AS doc, "row", cell, section, header, txt AS text FROM part CROSS JOIN LATERAL (VALUES
  (1, 1, 'sthead', true, 'Type'), (1, 2, 'sthead', true, 'Value'), (2, 1, 'strow', false, p_type), (2, 2, 'strow', false, CAST(p_size AS VARCHAR))) AS v("row", cell, section, header, txt)""")
def simple_cells(spark, sf_dir):
    c = F.col
    docs = table(spark, sf_dir, "part").select(cat("s/p", c("p_partkey"), ".dita").alias("path"), cat("<reference><refbody><properties><prophead><proptypehd>Type</proptypehd><propvaluehd>Value</propvaluehd></prophead><property><proptype>", c("p_type"), "</proptype><propvalue>", c("p_size"), "</propvalue></property></properties></refbody></reference>").alias("content"))
    return D.simple_cells(X.stored_nodes(spark, docs, columns=D.SIMPLE, own=("topic/stentry",), bare=True)).select("doc", "row", "cell", "section", "header", "text")


@query("""
SELECT 'l/p' || p_partkey || '.dita' AS doc, href, shown FROM part CROSS JOIN LATERAL (VALUES
  ('#a/' || p_partkey, p_name), ('#a/gone', '#a/gone'), ('p' || (p_partkey + 1) || '.dita', coalesce((SELECT 'Top ' || q.p_partkey FROM part q WHERE q.p_partkey = part.p_partkey + 1), 'p' || (p_partkey + 1) || '.dita')), ('#own', 'mine')) AS v(href, shown)""")
def local_links(spark, sf_dir):
    """Links inside a file (the last element with the id counts), to a whole file, and with a text of their own."""
    c = F.col
    k = c("p_partkey")
    docs = table(spark, sf_dir, "part").select(cat("l/p", k, ".dita").alias("path"), cat('<topic id="a"><title>Top ', k, '</title><body><section id="', k, '"><title>first</title></section><section id="', k, '"><title>', c("p_name"), '</title></section><p><xref href="#a/', k, '"/><xref href="#a/gone"/><xref href="p', k + 1, '.dita"/><xref href="#own">mine</xref></p></body></topic>').alias("content"))
    return D.xref_titles(X.stored_nodes(spark, docs, columns=D.LINKS, own=("topic/title", "topic/xref"), bare=True)).select("doc", "href", "shown")


@query("""
SELECT 'm/p' || p_partkey || '.dita' AS doc, value FROM part CROSS JOIN LATERAL (VALUES ('#t/before', true), ('#t/after', false), ('#t/', false), ('#t', false), ('#u', p_size % 2 = 0), ('#/after', true)) AS v(value, missing) WHERE missing""")
def missing_element_id(spark, sf_dir):
    """Element ids count after their topic only; an empty element part names the topic; ids may have spaces around the sign."""
    c = F.col
    docs = table(spark, sf_dir, "part").select(cat("m/p", c("p_partkey"), ".dita").alias("path"), cat('<x id="before"/><topic id="t" hidden><p id = "after"/>', F.when(c("p_size") % 2 == 1, '<p id= "u"/>').otherwise(""), *[f'<xref href="{v}"/>' for v in ("#t/before", "#t/after", "#t/", "#t", "#u", "#/after")], "</topic>").alias("content"))
    return R.missing_ids(R.collect_refs(docs), docs).select("doc", "value")


@query("""
SELECT page_id, regexp_extract(html, 'href="([^"]*)"', 1) AS value, CAST(strpos(html, 'href="') + 5 AS INTEGER) AS value_start FROM pages WHERE contains(html, 'href="')""")
def refs_at_offsets(spark, sf_dir):
    """The reference at the first character of each page's first link."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), F.col("html").alias("content"))
    points = pages.select(F.col("path").alias("doc"), (F.instr("content", 'href="') + 5).alias("off")).where("off > 5")
    hits = R.refs_at(points, R.collect_refs(pages))
    return hits.select(F.col("doc").cast("long").alias("page_id"), "value", "value_start")


@query("""
SELECT CASE p_size % 3 WHEN 0 THEN 'image' WHEN 1 THEN 'note' ELSE 'p' END AS tag, CASE p_size % 3 WHEN 0 THEN 'odd' WHEN 1 THEN 'href' ELSE 'type' END AS attr, count(*) AS n FROM part GROUP BY ALL""")
def unknown_attributes(spark, sf_dir):
    c = F.col
    m = c("p_size") % 3
    x = F.when(m == 0, '<image href="a" scale="1" odd="1"/>').when(m == 1, '<note type="tip" href="a"/>').otherwise('<p id="a" type="b" xml:lang="en"/>')
    docs = table(spark, sf_dir, "part").select(cat("a/p", c("p_partkey"), ".dita").alias("path"), cat("<topic>", x, "</topic>").alias("content"))
    return R.unknown_attributes(X.stored_nodes(spark, docs))


@query("""
SELECT 'i/p' || p_partkey || '.dita' AS doc, CASE WHEN p_size % 2 = 0 THEN 'data:' || CASE WHEN p_size % 4 = 0 THEN 'image/svg+xml' ELSE 'application/octet-stream' END || ';base64,' || base64(encode(repeat(p_name, 5))) ELSE '' END AS uri FROM part""")
def image_uris(spark, sf_dir):
    c = F.col
    p = table(spark, sf_dir, "part")
    ext = F.when(c("p_size") % 4 == 0, ".SVG").otherwise(".tif")
    assets = p.where("p_size % 2 = 0").select(cat("i/img/", c("p_partkey"), ext).alias("path"), F.repeat("p_name", 5).cast("binary").alias("content"))
    refs = p.select(cat("i/p", c("p_partkey"), ".dita").alias("doc"), cat("./img/", c("p_partkey"), ext).alias("href"))
    return S.data_uris(refs, assets).select("doc", "uri")


@query("""
SELECT l_orderkey AS page, CAST(pos AS BIGINT) AS pos, id, title FROM (
  SELECT l_orderkey, row_number() OVER w AS pos, 'l' || l_linenumber || '-' || l_partkey AS id, 'Line ' || l_linenumber || ' & more' AS title FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)
  UNION ALL SELECT DISTINCT l_orderkey, 0, 'top', 'Order ' || l_orderkey FROM lineitem)""")
def page_contents(spark, sf_dir):
    """Contents of pages that are not well-formed, whose titles hold markup, after the page's own heading."""
    c = F.col
    sect = cat('<section class=x id="l', c("l_linenumber"), "-", c("l_partkey"), '"><div><h3 class="title sectiontitle">Line <b>', c("l_linenumber"), "</b> &amp; <i>more</h3></div><p></section>")
    pages = table(spark, sf_dir, "lineitem").groupBy(c("l_orderkey").alias("page")).agg(cat('<h1 id="top">Order <em>', F.first("l_orderkey"), '</em></h1><section><h2 class="sectiontitle">no id</h2></section>', corpus.joined(sect, ["l_linenumber", "l_partkey", "l_suppkey"])).alias("html"))
    return S.toc_items(pages).select("page", c("pos").cast("long").alias("pos"), "id", "title")


@query("""
WITH a AS (SELECT 'base/' || (p_partkey // 20) || '.mod' AS path, p_partkey AS k, 'a' || (p_partkey % 50) AS tag,
  CASE p_partkey % 4 WHEN 0 THEN 'topic/ph' WHEN 1 THEN 'map/topicref' WHEN 3 THEN 'topic/kw' || p_size END AS base FROM part),
f AS (SELECT tag, CASE WHEN base LIKE 'map/%' THEN 'map' ELSE 'topic' END AS side, arg_max(base, path || '/' || lpad(CAST(k AS VARCHAR), 9, '0')) AS base, count(DISTINCT base) AS n FROM a WHERE base IS NOT NULL GROUP BY ALL),
c AS (SELECT DISTINCT 'a' || (p_partkey % 60) AS tag, CASE WHEN p_partkey % 60 % 2 = 0 THEN 'topic' ELSE 'map' END AS side, CASE WHEN p_partkey % 60 % 2 = 0 THEN 'topic/ph' ELSE 'map/topichead' END AS base FROM part WHERE p_partkey % 60 >= 8),
d AS (SELECT coalesce(f.side, c.side) AS side, coalesce(f.tag, c.tag) AS tag, CASE WHEN c.tag IS NULL THEN 'only-new' WHEN f.tag IS NULL THEN 'only-code' WHEN f.base = c.base THEN 'matched' ELSE 'conflict' END AS finding, f.base
  FROM f FULL JOIN c ON f.tag = c.tag AND f.side = c.side),
r AS (SELECT side, finding, tag FROM d UNION ALL SELECT side, 'duplicate', tag FROM f WHERE n > 1
  UNION ALL SELECT side, 'missing-renderer', min(tag) FROM d WHERE finding = 'only-new' AND base NOT IN (SELECT base FROM c) AND base NOT IN ('topic/kw1', 'map/topicref') GROUP BY side, base)
SELECT side, finding, count(*) AS n, min(tag) AS sample FROM r GROUP BY ALL""")
def schema_audit(spark, sf_dir):
    """Declared classes against a catalogue: matches, conflicts, duplicates, and new base types that nothing renders."""
    c = F.col
    k = c("p_partkey")
    p = table(spark, sf_dir, "part")
    cls = F.when(k % 4 == 0, F.lit("- topic/ph x/a ")).when(k % 4 == 1, F.lit("+ map/topicref y/b ")).when(k % 4 == 2, F.lit("- topic/topic ")).otherwise(cat("- topic/kw", c("p_size"), " z/c "))
    one = cat("<!ATTLIST a", k % 50, ' %x; class CDATA "', cls, '">\n')
    files = p.groupBy(F.expr("p_partkey div 20").alias("n")).agg(corpus.joined(one, ["p_partkey"]).alias("x")).select(cat("base/", c("n"), ".mod").alias("path"), c("x").alias("content"))
    t = k % 60
    code = p.where(t >= 8).select(cat("a", t).alias("tag"), F.when(t % 2 == 0, "topic").otherwise("map").alias("bucket"), F.when(t % 2 == 0, "topic/ph").otherwise("map/topichead").alias("base_type")).distinct()
    rendered = spark.createDataFrame([("topic/kw1",), ("map/topicref",)], "base_type string")
    return S.schema_audit(S.schema_files(files), code, rendered)


@query("""
WITH a AS (SELECT p_brand AS tag, min(p_type) AS t FROM part WHERE p_partkey % 3 <> 0 GROUP BY 1), b AS (SELECT p_brand AS tag, min(p_type) AS t FROM part WHERE p_partkey % 3 <> 1 GROUP BY 1),
d AS (SELECT coalesce(a.tag, b.tag) AS tag, CASE WHEN a.tag IS NULL THEN 'only-new' WHEN b.tag IS NULL THEN 'only-code' WHEN a.t = b.t THEN 'matched' ELSE 'conflict' END AS status, concat_ws(' vs ', a.t, b.t) AS told FROM a FULL JOIN b ON a.tag = b.tag)
SELECT status AS section, '' AS ord, '## parts: ' || status || ' (' || count(*) || ')' AS line FROM d GROUP BY status UNION ALL SELECT status, tag, '- `' || tag || '`: ' || told FROM d""")
def diff_report(spark, sf_dir):
    tags = lambda k: table(spark, sf_dir, "part").where(f"p_partkey % 3 <> {k}").groupBy(F.col("p_brand").alias("tag")).agg(F.min("p_type").alias("base_type"))
    return S.diff_report(S.catalogue_diff(tags(0), tags(1)), "parts")


@query("""
SELECT 'd' || c_nationkey || '/e' AS scope, CASE WHEN c_nationkey % 3 = 0 THEN 'd' || c_nationkey || '/e/custom.css' WHEN c_nationkey % 3 = 1 THEN 'd' || c_nationkey || '/a.css' ELSE 'root.css' END AS path FROM customer GROUP BY c_nationkey""")
def default_styles(spark, sf_dir):
    """The style of each folder: its own custom one, else the nearest, else the root's."""
    c = F.col
    cu = table(spark, sf_dir, "customer")
    docs = cu.select(cat("d", c("c_nationkey"), "/e/c", c("c_custkey"), ".dita").alias("path"))
    nations = cu.select("c_nationkey").distinct()
    own = nations.where("c_nationkey % 3 = 0").select(F.explode(F.array(cat("d", c("c_nationkey"), "/e/custom.css"), cat("d", c("c_nationkey"), "/custom.css"))).alias("path"))
    mid = nations.where("c_nationkey % 3 = 1").select(cat("d", c("c_nationkey"), "/a.css").alias("path"))
    styles = own.unionByName(mid).unionByName(nations.limit(1).select(F.lit("root.css").alias("path")))
    return S.default_style(S.layered_lookup(S.style_candidates(docs, styles)))


@query("""
SELECT user_id AS path, arg_max(event_type, (ts, event_type = 'error')) <> 'error' AS open FROM (SELECT DISTINCT user_id, ts, event_type FROM events) GROUP BY user_id""")
def open_documents(spark, sf_dir):
    """Errors stand for closes: what is open at the end."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), "ts", F.when(F.col("event_type") == "error", "close").otherwise(F.lit("change")).alias("op"), F.col("event_id").cast("string").alias("content"))
    return C.open_documents(e).select("path", "open")


@query(r"""
SELECT event_id, 'x' || replace('</script>', '/', '\/') || props AS safe, upper(left(event_type, 1)) || substr(event_type, 2) AS label FROM events""")
def page_payloads(spark, sf_dir):
    """Payloads embedded in a page, and labels with a capital."""
    return table(spark, sf_dir, "events").select("event_id", T.json_in_page(F.concat(F.lit("x</script>"), "props")).alias("safe"), T.capitalised("event_type").alias("label"))


@query("""
SELECT lower(substr(l_returnflag, 1, 1)) AS lang, count(*) AS n FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1 UNION ALL SELECT 'code', count(*) FROM lineitem WHERE l_returnflag = 'N'""")
def source_languages(spark, sf_dir):
    c = F.col
    code = cat("<codeblock", F.when(c("l_returnflag") == "N", F.lit("")).otherwise(cat(' outputclass="language-', F.lower("l_returnflag"), '"')), ">x</codeblock>")
    docs = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(corpus.joined(code, ["l_linenumber", "l_partkey", "l_suppkey"]).alias("x")).select(cat("c/o", c("l_orderkey"), ".dita").alias("path"), cat("<topic>", c("x"), "</topic>").alias("content"))
    return S.source_languages(X.shred(docs, columns=("base", "attrs")))
