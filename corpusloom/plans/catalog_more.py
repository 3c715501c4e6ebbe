"""Queries on what reaches beyond one document or batch: entities, folders, rebased links, streams, stored key spaces, files, SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import documents as D
from ..operators import keys as K
from ..operators import map_html as H
from ..operators import maps as M
from ..operators import refs as R
from ..operators import site as S
from ..sources import logs, pages, udtf
from ..sources import shred as X
from ..sources.store import shared_dir, written
from ..streaming import changes as C
from ..streaming import lifecycle as L
from ..streaming.keyspaces import KeySpaces
from . import corpus
from .corpus import cat, table
from .registry import query


@query("""
SELECT 'e/p' || p_partkey || '.dita' AS doc, 'N=' || p_name || ' © & gone ' || chr(160) || CASE WHEN p_size % 2 = 0 THEN p_brand ELSE '' END AS text, 1 AS line, 154 AS col FROM part""")
def entity_documents(spark, sf_dir):
    """Documents with declared, known and unknown entities, behind a DOCTYPE with and without declarations: what their paragraph says,
    and where in the source the element after the entities begins."""
    c = F.col
    head = F.when(c("p_size") % 2 == 0, cat('<!DOCTYPE topic PUBLIC "x" "topic.dtd" [<!ENTITY n "', c("p_name"), '"><!ENTITY b.x "', c("p_brand"), '">]>')).otherwise(F.lit('<!DOCTYPE topic PUBLIC "x" "topic.dtd">'))
    name = F.when(c("p_size") % 2 == 0, F.lit("&n;")).otherwise(c("p_name"))
    line = cat("<topic><p>N=", name, " &copy; &amp; gone&nope; &nbsp;", F.when(c("p_size") % 2 == 0, F.lit("&b.x;")).otherwise(F.lit("")))
    docs = table(spark, sf_dir, "part").select(cat("e/p", c("p_partkey"), ".dita").alias("path"), cat(head, "\n", F.rpad(line, 150, " "), "</p><ph/></topic>").alias("content"))
    nodes = X.stored_nodes(spark, docs)
    text = nodes.where("tag = 'p'").select("doc", "pre").join(D.element_text(nodes, ("topic/p",)), ["doc", "pre"]).select("doc", F.regexp_replace("own", " +$", "").alias("text"))
    place = nodes.where("tag = 'ph'").select("doc", "line", "col")
    return text.hint("merge").join(place, "doc").select("doc", "text", "line", "col")


_LANDS = """
WITH e AS (
  SELECT n_regionkey AS r, n_nationkey AS n, -1 AS c, 'lands/n' || n_nationkey || '/m.ditamap' AS href, 'lands/n' || n_nationkey || '/m.ditamap' AS file FROM nation
  UNION ALL SELECT n_regionkey, n_nationkey, c_custkey, 'lands/n' || n_nationkey || '/t%20x/c' || c_custkey || '.dita#c/d', 'lands/n' || n_nationkey || '/t x/c' || c_custkey || '.dita' FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey % 3 <> 0
  UNION ALL SELECT n_regionkey, n_nationkey, c_custkey, 'up/c' || c_custkey || '.dita', 'up/c' || c_custkey || '.dita' FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey % 3 = 0),
p AS (SELECT *, 'atlas/r' || r || '.ditamap' AS root_map, CAST(row_number() OVER (PARTITION BY r ORDER BY n, c) AS BIGINT) AS pos FROM e)
"""


def _lands(spark, sf_dir):
    """atlas/r<k>.ditamap refers to atlas/lands/n<k>/m.ditamap, whose topics lie in folders beside it and further up."""
    n, cu, c = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer"), F.col
    roots = n.groupBy("n_regionkey").agg(corpus.joined(cat('<chapter href="lands/n', c("n_nationkey"), '/m.ditamap"/>'), ["n_nationkey"]).alias("x"))
    href = F.when(c("c_custkey") % 3 == 0, cat("../../up/c", c("c_custkey"), ".dita")).otherwise(cat("./t%20x/c", c("c_custkey"), ".dita#c/d"))
    inner = cu.groupBy("c_nationkey").agg(corpus.joined(cat('<topicref href="', href, '"/>'), ["c_custkey"]).alias("x"))
    maps = roots.select(cat("atlas/r", c("n_regionkey"), ".ditamap").alias("path"), cat("<bookmap>", c("x"), "</bookmap>").alias("content"))
    maps = maps.unionByName(inner.select(cat("atlas/lands/n", c("c_nationkey"), "/m.ditamap").alias("path"), cat("<map>", c("x"), "</map>").alias("content")))
    nodes = X.stored_nodes(spark, maps)
    return nodes, M.expand_maps(nodes, maps.where("path LIKE 'atlas/r%'")), maps


@query(_LANDS + "SELECT root_map, pos, href, 'atlas/' || file AS file FROM p")
def rebased_entries(spark, sf_dir):
    """Entries of books whose sub-maps lie in folders of their own: links lead from the book's folder."""
    nodes, expanded, _ = _lands(spark, sf_dir)
    return M.first_occurrences(M.map_entries(expanded, nodes)).select("root_map", F.col("pos").cast("long").alias("pos"), "href", "file")


@query(_LANDS + """SELECT root_map, href, CAST(2 AS BIGINT) AS n FROM p""")
def rebased_tree_links(spark, sf_dir):
    """What the outline of such a book links to: each link names its file twice."""
    nodes, expanded, _ = _lands(spark, sf_dir)
    html = H.map_html(expanded, nodes)
    return html.select("root_map", F.explode(F.regexp_extract_all("html", F.lit('data-href="([^"]*)"'), F.lit(1))).alias("href")).groupBy("root_map", "href").agg(F.count("*").alias("n"))


@query(_LANDS + """SELECT root_map, pos, CASE WHEN c < 0 OR c % 2 = 1 THEN NULL ELSE 'atlas/' || file END AS opens, CASE WHEN c < 0 THEN NULL ELSE href END AS description
FROM p""")
def rebased_explorer(spark, sf_dir):
    """Explorer rows of such a book: the link from the book's folder, and the file that opens, if it is there."""
    nodes, expanded, _ = _lands(spark, sf_dir)
    c = F.col
    there = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.when(c("c_custkey") % 3 == 0, cat("atlas/up/c", c("c_custkey"), ".dita")).otherwise(cat("atlas/lands/n", c("c_nationkey"), "/t x/c", c("c_custkey"), ".dita")).alias("path"))
    rows = M.explorer_rows(expanded, nodes, there)
    from ..operators.scan import ranked

    return ranked(rows, "root_map", "order_key").select("root_map", F.col("pos").cast("long").alias("pos"), "opens", F.when(~c("description").startswith("Chapter"), c("description")).alias("description"))


@query("""
SELECT 'atlas/lands/n' || c_nationkey || '/m.ditamap' AS root_map, 'c' || c_custkey || '.html' AS file, 'c' || c_custkey AS title FROM customer WHERE c_custkey % 3 = 0""")
def nav_manifest_own(spark, sf_dir):
    """The manifests of all maps, not expanded: a book of maps alone has none, and a link with a fragment is no page."""
    nodes, _, _ = _lands(spark, sf_dir)
    return M.nav_manifest(M.map_entries(M.own_elements(nodes), nodes)).select("root_map", "file", "title")


@query("""
SELECT 'hdfs://nn:8020/c/' || p_partkey || '/t' AS scope_dir, CASE v WHEN 0 THEN 'hdfs://nn:8020/c/' || p_partkey || '/m.ditamap' ELSE 'hdfs://nn:8020/top.ditamap' END AS map_path, CAST(v * 2 + 1 AS INTEGER) AS distance,
  CASE WHEN p_size % 2 = 0 THEN 0 ELSE 1 END AS missing FROM part CROSS JOIN (VALUES (0), (1)) AS x(v)""")
def rooted_paths(spark, sf_dir):
    """Documents named by whole URIs: the maps that their folders see, and links to files that are not there."""
    c = F.col
    p = table(spark, sf_dir, "part")
    base = cat("hdfs://nn:8020/c/", c("p_partkey"))
    dirs = p.select(cat(base, "/t").alias("scope_dir"))
    maps = p.select(cat(base, "/m.ditamap").alias("path")).unionByName(spark.createDataFrame([("hdfs://nn:8020/top.ditamap",)], "path string"))
    topics = p.select(cat(base, "/t/a.dita").alias("path"), F.lit('<topic><xref href="../b.dita"/></topic>').alias("content"))
    there = topics.select("path").unionByName(p.where("p_size % 2 = 0").select(cat(base, "/b.dita").alias("path")))
    missing = R.missing_files(R.collect_refs(topics), there).groupBy(T.dirname("doc").alias("scope_dir")).agg(F.count("*").cast("int").alias("missing"))
    return K.visible_maps(dirs, maps).join(missing.hint("merge"), "scope_dir", "left").select("scope_dir", "map_path", "distance", F.coalesce("missing", F.lit(0)).alias("missing"))


@query("""
WITH f AS (SELECT 'a/n' || c_nationkey || CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN '/x' WHEN 2 THEN '/x/y' WHEN 3 THEN '/.git' ELSE '/1/2/3/4' END AS d, 'c' || c_custkey || CASE WHEN c_custkey % 2 = 0 THEN '.dita' ELSE '.XML' END AS f, c_nationkey AS n FROM customer),
r AS (SELECT 'a/n' || n AS dir, substr(d || '/' || f, length('a/n' || n) + 2) AS rel FROM f WHERE d NOT LIKE '%/.git' AND d NOT LIKE '%/1/2/3/4')
SELECT dir, rel FROM (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY rel) AS k FROM r) WHERE k <= 20""")
def referenceable_files(spark, sf_dir):
    """What each folder may refer to: three levels deep, no hidden folders, the first twenty by name."""
    c = F.col
    k = c("c_custkey")
    sub = F.when(k % 5 == 0, F.lit("")).when(k % 5 == 1, F.lit("/x")).when(k % 5 == 2, F.lit("/x/y")).when(k % 5 == 3, F.lit("/.git")).otherwise(F.lit("/1/2/3/4"))
    cu = table(spark, sf_dir, "customer")
    paths = cu.select(cat("a/n", c("c_nationkey"), sub, "/c", k, F.when(k % 2 == 0, F.lit(".dita")).otherwise(F.lit(".XML"))).alias("path"))
    return X.referenceable_files(paths, cu.select(cat("a/n", c("c_nationkey")).alias("dir")), most=20)


@query("""
SELECT 's' || c_nationkey || '/d' AS scope_dir, 's' || c_nationkey || '/m' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') || '.ditamap' AS map_path, CAST(k AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM customer) WHERE k <= 50""")
def key_search_cap(spark, sf_dir):
    """Of the maps that a folder searches for keys the first fifty."""
    c = F.col
    cu = table(spark, sf_dir, "customer")
    maps = cu.select(cat("s", c("c_nationkey"), "/m", F.lpad(c("c_custkey").cast("string"), 9, "0"), ".ditamap").alias("path"), F.lit("<map/>").alias("content"))
    dirs = cu.select(cat("s", c("c_nationkey"), "/d").alias("scope_dir"))
    return R.key_search_order(K.visible_maps(dirs, maps), maps)


# ------------------------------------------------------------------ numbering of one large map


@query("""
WITH e AS (SELECT CAST(row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS BIGINT) AS pos,
  CASE WHEN l_linenumber = 1 AND l_orderkey % 97 = 0 THEN 0 WHEN l_linenumber = 1 THEN 1 ELSE 2 END AS depth, CASE WHEN l_linenumber = 1 AND l_orderkey % 97 = 0 THEN 'part' ELSE 'chapter' END AS tag FROM lineitem),
r AS (SELECT *, max(CASE WHEN depth < 1 THEN pos END) OVER w AS r1, max(CASE WHEN depth < 2 THEN pos END) OVER w AS r2 FROM e WINDOW w AS (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT pos, depth, tag, CAST(row_number() OVER (PARTITION BY depth, tag, CASE depth WHEN 0 THEN -1 WHEN 1 THEN coalesce(r1, -1) ELSE coalesce(r2, -1) END ORDER BY pos) AS INTEGER) AS n FROM r""")
def one_large_map(spark, sf_dir):
    """Every line item as a division of one book: ranks and numbers without a window over the whole book."""
    from ..operators.scan import ranked

    c = F.col
    first = c("l_linenumber") == 1
    part = first & (c("l_orderkey") % 97 == 0)
    key = F.array(*[c(n).cast("long") for n in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
    e = table(spark, sf_dir, "lineitem").select(F.lit("m").alias("root_map"), key.alias("order_key"), F.when(part, 0).when(first, 1).otherwise(2).alias("depth"), F.when(part, "part").otherwise("chapter").alias("tag"))
    return M.number_divisions(ranked(e, "root_map", "order_key")).select(c("pos").cast("long").alias("pos"), "depth", "tag", "n")


@query("""
SELECT page_id, lag(page_id) OVER (ORDER BY url, page_id) AS prev, lead(page_id) OVER (ORDER BY url, page_id) AS next FROM pages""")
def page_neighbours(spark, sf_dir):
    """All pages as one manifest: the page before and after each."""
    from ..operators.scan import neighbours, ranked

    p = table(spark, sf_dir, "pages").select(F.lit(1).alias("site"), F.struct("url", "page_id").alias("o"), "page_id")
    return neighbours(ranked(p, "site", "o"), "site", "pos", "page_id").select("page_id", "prev", "next")


# ------------------------------------------------------------------ rendering


@query("""
SELECT 'v/p' || p_partkey || '.dita' AS doc, '<article class="topic">' || '<p>' || '<abbr class="abbreviated-form">' || p_name || '</abbr>' || '<abbr class="abbreviated-form" title="k">V</abbr>'
  || '<abbr class="abbreviated-form">V</abbr>' || '<abbr class="abbreviated-form" title="gone">gone</abbr>' || 'V' || '<a href="gone" class="link"></a>' || '<a href="x.dita" class="link">V</a>' || '</p>'
  || '<figure><p>in</p><figcaption>' || p_brand || '</figcaption></figure></article>' AS html FROM part""")
def rendering_rules(spark, sf_dir):
    """Short forms and links with and without keys and content, and a figure with two titles."""
    c = F.col
    p = ['<abbreviated-form>', c("p_name"), '</abbreviated-form><abbreviated-form keyref="k">own</abbreviated-form><abbreviated-form keyref="k"/><abbreviated-form keyref="gone"/><link keyref="k"/><link keyref="gone"/><link href="x.dita" keyref="k"/>']
    docs = table(spark, sf_dir, "part").select(cat("v/p", c("p_partkey"), ".dita").alias("path"), cat("<topic><p>", *p, "</p><fig><title>", c("p_brand"), "</title><p>in</p><title>second</title></fig></topic>").alias("content"))
    keys = spark.createDataFrame([("v", "k", "V")], "scope_dir string, key string, value string")
    return D.topic_html(X.stored_nodes(spark, docs), keys).select("doc", "html")


@query("""
SELECT 'w/p' || p_partkey || '.dita' AS doc, '<article title="topic" data-line="0" data-end-line="1" data-start-col="0" data-end-col="100" class="topic">' || chr(10) || '<figure title="fig" data-line="1" data-end-line="1" data-start-col="0" data-end-col="33"><figcaption>F</figcaption></figure>'
  || '<span title="filepath" data-line="1" data-end-line="1" data-start-col="' || (3 + length(p_name)) || '" data-end-col="' || (3 + length(p_name) + 30) || '" class="filepath">/x</span></article>' AS html FROM part""")
def replaced_places(spark, sf_dir):
    """Captions carry no place of their own, and an element that another one replaces has the place of that one. The second line is
    padded to one length, with room for keys of any number of digits."""
    c = F.col
    part = table(spark, sf_dir, "part")
    users = part.select(cat("w/p", c("p_partkey"), ".dita").alias("path"), F.rpad(cat('<topic>\n<fig><title>F</title></fig      ><ph conref="l', c("p_partkey"), '.dita#l/f"></ph>'), 100, " ").alias("x")).select("path", F.concat("x", F.lit("</topic>")).alias("content"))
    lib = part.select(cat("w/l", c("p_partkey"), ".dita").alias("path"), cat('<topic id="l"><p/>\n', "<i>", F.regexp_replace("p_name", ".", "y"), '<filepath id="f">/x</filepath></i></topic>').alias("content"))
    nodes = X.stored_nodes(spark, users.unionByName(lib))
    html = D.topic_html(nodes, positions=True).where("doc LIKE 'w/p%'")
    return html.select("doc", F.regexp_replace("html", " +</article>", "</article>").alias("html"))


@query("""
SELECT 'x/p' || p_partkey || '.dita' AS doc, '<article class="topic"><img src="' || CASE WHEN p_size % 2 = 0 THEN 'data:image/png;base64,' || base64(encode(p_name)) ELSE '' END
  || '" alt="" loading="lazy" data-dita-src="img/' || p_partkey || '.png"></article>' AS html FROM part""")
def inlined_images(spark, sf_dir):
    """Pages that hold their images."""
    c = F.col
    p = table(spark, sf_dir, "part")
    docs = p.select(cat("x/p", c("p_partkey"), ".dita").alias("path"), cat('<topic><image href="img/', c("p_partkey"), '.png"/></topic>').alias("content"))
    images = p.where("p_size % 2 = 0").select(cat("x/img/", c("p_partkey"), ".png").alias("path"), c("p_name").cast("binary").alias("content"))
    return D.topic_html(X.stored_nodes(spark, docs), images=images).select("doc", "html")


# ------------------------------------------------------------------ places


@query("""
SELECT 'j/p' || p_partkey || '.dita' AS doc, value, target, CAST(l AS BIGINT) AS target_line, CAST(c AS BIGINT) AS target_col FROM part CROSS JOIN LATERAL (VALUES
  ('#t', 'j/p' || p_partkey || '.dita', p_size + 1, 7), ('#t/e', 'j/p' || p_partkey || '.dita', p_size + 2, 3 + length(p_name)), ('#gone', 'j/p' || p_partkey || '.dita', 0, 0), ('k', 'j/m.ditamap', 1, 8)) AS v(value, target, l, c)""")
def definition_lines(spark, sf_dir):
    """Where references lead in texts of many lines."""
    c = F.col
    part = table(spark, sf_dir, "part")
    text = cat('<!-- x', F.repeat(F.lit("\n"), c("p_size")), '-->\n<topic id="t">\n', c("p_name"), '<p id="e"/><xref href="#t"/><xref href="#t/e"/><xref href="#gone"/><ph keyref="k"/></topic>')
    docs = part.select(cat("j/p", c("p_partkey"), ".dita").alias("path"), text.alias("content"))
    maps = spark.createDataFrame([("j/m.ditamap", '<map>\n<keydef keys="k"/></map>')], "path string, content string")
    dirs = spark.createDataFrame([("j",)], "scope_dir string")
    where = R.key_locations(R.key_search_order(K.visible_maps(dirs, maps), maps), maps)
    d = R.definitions(written(spark, R.collect_refs(docs)), docs.unionByName(maps), where)
    return d.select("doc", "value", "target", F.col("target_line").cast("long").alias("target_line"), F.col("target_col").cast("long").alias("target_col"))


@query("""
SELECT 'r/p' || p_partkey || '.dita' AS doc, CAST(k AS INTEGER) AS k, 'a' || p_size AS value FROM part CROSS JOIN (VALUES (1), (2)) AS v(k)""")
def refs_at_equal_offsets(spark, sf_dir):
    """Two equal points in each document give two rows."""
    c = F.col
    docs = table(spark, sf_dir, "part").select(cat("r/p", c("p_partkey"), ".dita").alias("path"), cat('<xref href="a', c("p_size"), '"/>').alias("content"))
    points = docs.select(c("path").alias("doc"), F.lit(12).alias("off"))
    hits = R.refs_at(points.unionByName(points), R.collect_refs(docs))
    from pyspark.sql import Window

    return hits.select("doc", F.row_number().over(Window.partitionBy("doc").orderBy("value")).alias("k"), "value")


@query("SELECT l_orderkey AS page, 2 * count(*) AS hits, 2 * count(*) AS total, CAST(0 AS BIGINT) AS first_at FROM lineitem GROUP BY l_orderkey")
def search_shown_text(spark, sf_dir):
    """A word in the shown text of pages that also hold it in scripts, styles, comments, tools, attributes and across tags."""
    c = F.col
    one = cat('<p title="line">line<b>line', c("l_linenumber"), "</b><!-- line --><script>var line</script>li<i>ne<br></p>")
    html = table(spark, sf_dir, "lineitem").groupBy(c("l_orderkey").alias("doc")).agg(cat('<html><head><title>line</title><style>line{}</style></head><body><div id="__toolbar"><p>line</div>', F.regexp_replace(corpus.joined(one, ["l_linenumber", "l_partkey", "l_suppkey"]), "line<b>line", "line &amp; <b>Line</i>"), "<mark>line</mark> </body>").alias("html"))
    hits = S.search_pages(html, "line")
    return hits.groupBy(c("doc").alias("page")).agg(F.count("*").alias("hits"), F.max("total").cast("long").alias("total"), F.min(F.when(c("start") >= 0, 0)).cast("long").alias("first_at"))


# ------------------------------------------------------------------ SQL, files, stored tables


@query("""
SELECT 'u/p' || p_partkey || '.dita' AS path, tag, base, CAST(depth AS INTEGER) AS depth, text FROM part CROSS JOIN LATERAL (VALUES
  ('topic', 'topic/topic', 0, NULL), ('title', 'topic/title', 1, NULL), (NULL, NULL, 2, p_name || ' ©')) AS v(tag, base, depth, text)""")
def dita_nodes_sql(spark, sf_dir):
    """The nodes of documents in SQL."""
    c = F.col
    udtf.register(spark)
    docs = table(spark, sf_dir, "part").select(cat("u/p", c("p_partkey"), ".dita").alias("path"), cat("<topic><title>", c("p_name"), " &copy;</title></topic>").alias("content"))
    return spark.sql("SELECT d.path, n.tag, n.base, n.depth, n.text FROM {docs} AS d, LATERAL dita_nodes(d.content, 'topic') AS n", docs=docs)


@query("""
SELECT 'n' || n_nationkey || '/index.html' AS file, '<!DOCTYPE html>' || chr(10) || '<html><head><meta charset="utf-8"><title>' || n_name || ' &amp; é</title><style>p{}</style></head><body><p>' || n_name || '</p></body></html>' AS html FROM nation""")
def page_files(spark, sf_dir):
    """Pages written as files and read back."""
    folder, c = shared_dir(spark), F.col
    html = D.standalone_html(cat(c("n_name"), " & é"), cat("<p>", c("n_name"), "</p>"), "p{}")
    pages.write_pages(table(spark, sf_dir, "nation").select(cat("n", c("n_nationkey"), "/index.html").alias("file"), html.alias("html")), folder)
    back = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return back.select(X.relative_path("path", folder).alias("file"), c("content").cast("string").alias("html"))


@query("""
WITH p AS (SELECT c_nationkey AS n, c_custkey AS c, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS pos FROM customer),
g AS (SELECT n, pos // 10 AS page, string_agg('<p>' || c || '</p>', chr(10) ORDER BY pos) AS body FROM p GROUP BY ALL), m AS (SELECT n, max(page) AS last FROM g GROUP BY n)
SELECT 'b/n' || g.n || '/part-' || lpad(CAST(page AS VARCHAR), 6, '0') || '.html' AS file, md5('<!DOCTYPE html>' || chr(10) || '<html><head><meta charset="utf-8"><title>b/n' || g.n || '.ditamap</title><style></style></head><body><div class="ditamap-book">' || body || '</div>'
  || CASE WHEN page > 0 THEN '<a rel="prev" href="part-' || lpad(CAST(page - 1 AS VARCHAR), 6, '0') || '.html">prev</a>' ELSE '' END
  || CASE WHEN page < last THEN '<a rel="next" href="part-' || lpad(CAST(page + 1 AS VARCHAR), 6, '0') || '.html">next</a>' ELSE '' END || '</body></html>') AS hash FROM g JOIN m ON m.n = g.n""")
def book_parts_files(spark, sf_dir):
    """Books written as ordered parts of ten entries, and read back."""
    from ..operators.scan import ranked

    folder, c = shared_dir(spark), F.col
    parts = ranked(table(spark, sf_dir, "customer").select(cat("b/n", c("c_nationkey"), ".ditamap").alias("root_map"), "c_custkey", cat("<p>", c("c_custkey"), "</p>").alias("html")), "root_map", "c_custkey")
    pages.write_pages(pages.book_files(parts, c("root_map"), rows=10), folder)
    back = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return back.select(X.relative_path("path", folder).alias("file"), F.md5("content").alias("hash"))


@query("""
SELECT 'q/n' || n_nationkey AS scope_dir, 's' || s_suppkey AS key, CASE WHEN n_nationkey % 4 = 1 THEN 'new ' ELSE '' END || s_name AS value, CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE 0 END AS distance
FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE n_nationkey <> 7 UNION ALL SELECT 'q/n' || n_nationkey, 'top', CASE WHEN n_nationkey = 7 THEN 'late' ELSE 'late' END, 1 FROM nation""")
def key_space_refresh(spark, sf_dir):
    """Stored key spaces after every fourth nation's map was saved, the seventh's removed, and one at the top added."""
    c, folder = F.col, shared_dir(spark)
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    dirs = n.select(cat("q/n", c("n_nationkey")).alias("scope_dir"))

    def maps(new: bool):
        k = c("n_nationkey")
        value = cat(F.when(F.lit(new) & (k % 4 == 1), F.lit("new ")).otherwise(F.lit("")), c("s_name"))
        define = cat('<keydef keys="s', c("s_suppkey"), '"><topicmeta><keywords><keyword>', value, "</keyword></keywords></topicmeta></keydef>")
        x = s.join(n.hint("merge"), c("s_nationkey") == k).groupBy("n_nationkey").agg(corpus.joined(define, ["s_suppkey"]).alias("x"))
        x = x.where("n_nationkey <> 7") if new else x
        at = F.timestamp_seconds(F.when(F.lit(new) & (k % 4 == 1), 2000).otherwise(1000))
        # Maps of even nations lie elsewhere and are referred to from the folder above.
        own = x.select(F.when(k % 2 == 0, cat("lib/m", k, ".ditamap")).otherwise(cat("q/n", k, "/m.ditamap")).alias("path"), cat("<map>", c("x"), "</map>").alias("content"), at.alias("mtime"))
        late = spark.createDataFrame([("q/top.ditamap", '<map><keydef keys="top"><topicmeta><keywords><keyword>late</keyword></keywords></topicmeta></keydef></map>')], "path string, content string").withColumn("mtime", F.timestamp_seconds(F.lit(2000)))
        return own.unionByName(late) if new else own

    hubs = n.where("n_nationkey % 2 = 0").select(cat("q/h", c("n_nationkey"), ".ditamap").alias("path"), cat('<map><mapref href="../lib/m', c("n_nationkey"), '.ditamap"/></map>').alias("content"), F.timestamp_seconds(F.lit(1000)).alias("mtime"))
    spaces = KeySpaces(spark, folder, parts=8)
    spaces.refresh(written(spark, maps(False).unionByName(hubs)), dirs)
    spaces.refresh(written(spark, maps(True).unionByName(hubs)), dirs)
    # Every folder sees all hubs; only the keys of its own nation are compared.
    own = spaces.keys.join(s.select(cat("q/n", c("s_nationkey")).alias("scope_dir"), cat("s", c("s_suppkey")).alias("key")).hint("merge"), ["scope_dir", "key"], "left_semi")
    return own.unionByName(spaces.keys.where("key = 'top'")).select("scope_dir", "key", "value", "distance")


# ------------------------------------------------------------------ streams


def _events(spark, sf_dir, stream=False):
    """Events as changes of documents: errors close, purchases save, sign-ups open, all others change."""
    reader = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet") if stream else spark.read
    e = reader.parquet(sf_dir if stream else f"{sf_dir}/events.parquet")
    kind = F.col("event_type")
    op = F.when(kind == "error", "close").when(kind == "purchase", "save").when(kind == "signup", "open").otherwise("change")
    return e.select(F.col("user_id").cast("string").alias("path"), F.col("ts").cast("timestamp").alias("ts"), op.alias("op"), F.col("event_id").cast("string").alias("content"))


_SIGNALS = """
WITH e AS (SELECT CAST(user_id AS VARCHAR) AS path, epoch_us(ts) // 1000 AS ms, CAST(event_id AS VARCHAR) AS content, CASE event_type WHEN 'error' THEN 'close' WHEN 'purchase' THEN 'save' WHEN 'signup' THEN 'open' ELSE 'change' END AS op FROM events),
x AS (SELECT *, min(CASE WHEN op IN ('change', 'close') THEN ms END) OVER (PARTITION BY path ORDER BY ms, op = 'close' ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later, max(ms) OVER (PARTITION BY path) AS last, max(ms) OVER () AS top FROM e),
s AS (SELECT path, CASE WHEN op = 'change' THEN ms + 3600000 ELSE ms END AS at_ms, CASE op WHEN 'change' THEN 'settled' WHEN 'close' THEN 'closed' ELSE 'now' END AS kind, CASE WHEN op <> 'close' THEN content END AS content,
  op <> 'change' OR ms + 3600000 <= top - 10000 OR ms + 3600000 <= last AS out FROM x WHERE op <> 'change' OR later IS NULL OR later >= ms + 3600000)
"""


@query(_SIGNALS + "SELECT path, at_ms, kind, content FROM s")
def settled_signals(spark, sf_dir):
    """What a watcher of documents with a delay of an hour signals, in one batch over all events."""
    return L.settled_signals(_events(spark, sf_dir), 3_600_000)


@query(_SIGNALS + "SELECT path, at_ms, kind, content FROM s WHERE out")
def document_signals(spark, sf_dir):
    """The same from the stateful stream, which stops when all events are read: what still waits then does not come out."""
    folder = shared_dir(spark)
    q = L.watched(_events(spark, sf_dir, stream=True), lambda df: df.write.mode("append").parquet(f"{folder}/out"), f"{folder}/state", 3_600_000, available_now=True)
    q.awaitTermination()
    return spark.read.schema(L.SIGNALS).parquet(f"{folder}/out")


@query("""
SELECT event_type AS run, CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS level, count(*) AS n FROM events GROUP BY ALL""")
def log_files(spark, sf_dir):
    """Events written as log files, read by the stream of chunks, and put together into lines again."""
    folder, c = shared_dir(spark), F.col
    e = table(spark, sf_dir, "events")
    line = cat(F.when(c("event_type") == "error", F.lit("[ERROR] é ")).otherwise(F.lit("é ")), c("event_id"))
    e.select("event_type", line.alias("value")).repartition(4).write.partitionBy("event_type").text(f"{folder}/logs")
    logs.register(spark)
    chunks = spark.readStream.format("log_chunks").option("path", f"{folder}/logs").option("suffix", ".txt").option("chunkBytes", 1000).load()
    q = chunks.writeStream.format("parquet").option("path", f"{folder}/chunks").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    lines = C.log_lines(spark.read.parquet(f"{folder}/chunks"))
    return lines.groupBy(F.regexp_extract("run", "event_type=([a-z]+)", 1).alias("run"), "level").agg(F.count("*").alias("n"))


@query("""
SELECT CAST(user_id AS VARCHAR) AS run, epoch_ms(time_bucket(INTERVAL 1 DAY, ts)) AS start_ms, CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS level, count(*) AS n FROM events GROUP BY ALL""")
def log_level_windows(spark, sf_dir):
    """Levels of each run by day."""
    lines = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("run"), F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type") == "error", "error").otherwise("info").alias("level"))
    return C.level_counts(lines, "1 day").select("run", F.unix_millis("start").alias("start_ms"), "level", "n")


@query("""
WITH s AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WHERE event_type IN ('click', 'view', 'purchase') WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM s)
SELECT CAST(user_id AS VARCHAR) AS path, arg_max(CAST(event_id AS VARCHAR), ts) AS content, count(*) AS n FROM g GROUP BY user_id, k""")
def republished_pages(spark, sf_dir):
    """Bursts of changes and saves after which a page is drawn anew: from the stream, all events of which are known to have ended."""
    folder, c = shared_dir(spark), F.col
    changes = _events(spark, sf_dir, stream=True)
    # A last change of nobody, long after all others, moves the watermark past every burst.
    table(spark, sf_dir, "events").agg(F.max("ts").alias("ts")).select((c("ts").cast("timestamp") + F.expr("INTERVAL 1 DAY")).alias("ts")).write.parquet(f"{folder}/end")
    end = spark.readStream.schema("ts timestamp").parquet(f"{folder}/end").select(F.lit("nobody").alias("path"), "ts", F.lit("save").alias("op"), F.lit("").alias("content"))
    q = C.republished(changes.unionByName(end), lambda df: df.write.mode("append").parquet(f"{folder}/out"), f"{folder}/state", "30 minutes", available_now=True)
    q.awaitTermination()
    return spark.read.parquet(f"{folder}/out").where("path <> 'nobody'").select("path", "content", "n")
