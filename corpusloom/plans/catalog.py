"""All registered queries of the document operators, and their DuckDB SQL over the same tables.

Queries either read the HTML, text and event tables or first build documents from the star schema (``plans.corpus``),
take them apart with the operators, and must agree with SQL on the base tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import documents as D
from ..operators import keys as K
from ..operators import map_html as H
from ..operators import maps as M
from ..operators import refs as R
from ..operators import site as S
from ..sources import shred as X
from ..sources.store import big, written
from ..streaming import changes as C
from . import corpus
from .corpus import cat, table
from .registry import ORACLE_SQL, QUERIES, query  # noqa: F401

FLAGSHIP = "diagnostics_by_code"

def _pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), F.col("html").alias("content"), "page_id", "html")


# ------------------------------------------------------------------ pages and text


@query("SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS value FROM pages")
def page_links(spark, sf_dir):
    return R.collect_refs(_pages(spark, sf_dir)).where("attr = 'href'").select(F.col("doc").cast("long").alias("page_id"), "value")


@query("""
WITH l AS (SELECT unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS v FROM pages)
SELECT v = '' OR regexp_matches(v, '^([A-Za-z][A-Za-z0-9+.-]*:|/)') AS external, regexp_extract(v, '^[a-z]+://([^/]*)', 1) AS host, count(*) AS n
FROM l GROUP BY 1, 2""")
def page_link_hosts(spark, sf_dir):
    refs = R.collect_refs(_pages(spark, sf_dir)).where("attr = 'href'")
    return refs.groupBy(T.is_external("value", "scope").alias("external"), F.regexp_extract("value", "^[a-z]+://([^/]*)", 1).alias("host")).agg(F.count("*").alias("n"))


@query("""
SELECT page_id, value, strpos(html, 'href="' || value || '"') + 5 AS first_start FROM (
  SELECT page_id, html, unnest(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1))) AS value FROM pages)""")
def ref_offsets(spark, sf_dir):
    refs = R.collect_refs(_pages(spark, sf_dir)).where("attr = 'href'")
    return refs.groupBy(F.col("doc").cast("long").alias("page_id"), "value").agg(F.min("value_start").cast("long").alias("first_start"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def page_titles(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query("""
WITH a AS (SELECT page_id, html, '../' || '../' AS up FROM pages),
b AS (SELECT page_id, up, CASE WHEN contains(html, '</head>') THEN left(html, strpos(html, '</head>') - 1) || '<link rel="stylesheet" data-site-assets href="' || up || 'site.css">' || substr(html, strpos(html, '</head>')) ELSE html END AS h FROM a)
SELECT page_id, md5(CASE WHEN contains(h, '</body>') THEN left(h, strpos(h, '</body>') - 1) || '<script data-site-assets src="' || up || 'site.js"></script>' || substr(h, strpos(h, '</body>')) ELSE h END) AS hash FROM b""")
def page_inject(spark, sf_dir):
    once = table(spark, sf_dir, "pages").select("page_id", S.inject_assets("html", 2).alias("html"))
    return once.select("page_id", F.md5(S.inject_assets("html", 2)).alias("hash"))


@query("""
SELECT page, CAST(pos AS BIGINT) AS pos, id, title FROM (
  SELECT l_orderkey AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS pos,
         'l' || l_linenumber || '-' || l_partkey AS id, 'Line ' || l_linenumber AS title, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) WHERE n >= 2""")
def html_toc_items(spark, sf_dir):
    return S.toc_items(corpus.html_pages(spark, sf_dir)).select("page", F.col("pos").cast("long").alias("pos"), "id", "title")


@query("SELECT CASE WHEN l_returnflag = 'N' THEN 'code' ELSE lower(l_returnflag) END AS lang, count(*) AS n FROM lineitem GROUP BY 1")
def html_code_langs(spark, sf_dir):
    return S.code_languages(corpus.html_pages(spark, sf_dir))


@query("SELECT l_orderkey AS page, 'l' || l_linenumber || '-' || l_partkey AS id FROM lineitem")
def html_ids(spark, sf_dir):
    pages = corpus.html_pages(spark, sf_dir).select(F.col("page").cast("string").alias("path"), F.col("html").alias("content"))
    return R.collect_ids(pages).select(F.col("doc").cast("long").alias("page"), "id")


@query("""
SELECT doc_id, CAST(least(len(regexp_extract_all(lower(text), 'tion')), 1000) AS BIGINT) AS n, CAST(strpos(lower(text), 'tion') - 1 AS BIGINT) AS first_at
FROM documents WHERE contains(lower(text), 'tion')""")
def search_hits(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.col("text").alias("content"))
    return S.search(docs, "TION").groupBy(F.col("doc").alias("doc_id")).agg(F.max("total").cast("long").alias("n"), F.min("start").cast("long").alias("first_at"))


@query("""
WITH h AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]+ [a-z]{2} ')) AS m FROM documents)
SELECT doc_id, count(*) AS n, CAST(sum(length(m)) AS BIGINT) AS chars FROM h GROUP BY doc_id""")
def search_regex(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.col("text").alias("content"))
    hits = S.search(docs, "[A-Z][a-z]+ [a-z]{2} ", regex=True, case_sensitive=True, most=1 << 30)
    return hits.groupBy(F.col("doc").alias("doc_id")).agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("chars"))


# ------------------------------------------------------------------ shredding and documents


@query("""
SELECT 'topic' AS tag, count(DISTINCT l_orderkey) AS n FROM lineitem UNION ALL SELECT 'title', count(DISTINCT l_orderkey) FROM lineitem
UNION ALL SELECT 'prolog', count(DISTINCT l_orderkey) FROM lineitem UNION ALL SELECT 'author', count(DISTINCT l_orderkey) FROM lineitem
UNION ALL SELECT 'body', count(DISTINCT l_orderkey) FROM lineitem UNION ALL SELECT 'p', count(*) FROM lineitem
UNION ALL SELECT 'xref', count(*) FROM lineitem UNION ALL SELECT 'keyword', count(*) FROM lineitem""")
def element_counts(spark, sf_dir):
    return X.shred(corpus.order_topics(spark, sf_dir), columns=("type", "tag")).where("type = 'element'").groupBy("tag").agg(F.count("*").alias("n"))


@query("""
SELECT p_partkey, 'A' || p_name || ' © ' || p_brand || ' &amp; ' AS clean FROM part""")
def entity_clean(spark, sf_dir):
    c = F.col
    p = table(spark, sf_dir, "part")
    xml = cat('<!DOCTYPE topic [<!ENTITY n "', c("p_name"), '"><!ENTITY b.x "', c("p_brand"), '">]>A&n; &copy; &b.x;&unknown; &amp; ')
    return p.select("p_partkey", X.clean_entities(xml).alias("clean"))


#: Every entity that documents may use without declaring it, by name.
_ENTITY_NAMES = (
    "nbsp copy reg trade deg plusmn micro middot laquo raquo sect para times divide frac12 frac14 frac34 sup1 sup2 sup3 cent pound yen euro "
    "ndash mdash lsquo rsquo ldquo rdquo hellip bull dagger Dagger prime Prime larr uarr rarr darr harr"
).split()


@query("""
SELECT p_partkey, p_name || array_to_string(list_transform([
  160, 169, 174, 8482, 176, 177, 181, 183, 171, 187, 167, 182, 215, 247, 189, 188, 190, 185, 178, 179, 162, 163, 165, 8364,
  8211, 8212, 8216, 8217, 8220, 8221, 8230, 8226, 8224, 8225, 8242, 8243, 8592, 8593, 8594, 8595, 8596], lambda x: chr(CAST(x AS INTEGER))), '|') AS clean FROM part""")
def entity_names(spark, sf_dir):
    every = "|".join(f"&{n};" for n in _ENTITY_NAMES)
    return table(spark, sf_dir, "part").select("p_partkey", X.clean_entities(cat(F.col("p_name"), "&unknown;", every)).alias("clean"))


@query("SELECT 'topics/o' || l_orderkey || '.dita' AS doc, 'o' || l_orderkey AS id, 'Order ' || l_orderkey AS title FROM lineitem GROUP BY l_orderkey")
def topic_titles(spark, sf_dir):
    return D.title_map(X.stored_nodes(spark, corpus.order_topics(spark, sf_dir), columns=D.LINKS, own=("topic/title",), bare=True))


@query("""
SELECT 'parts/p' || p_partkey || '.dita' AS doc, 0 AS depth, p_name AS name, 'topic' AS kind FROM part WHERE p_size % 2 = 0""")
def topic_outline(spark, sf_dir):
    return D.topic_outline(X.stored_nodes(spark, corpus.part_topics(spark, sf_dir), columns=D.OUTLINE)).select("doc", "depth", "name", "kind")


@query("""
SELECT 'topics/o' || l_orderkey || '.dita' AS doc, 'Order ' || l_orderkey AS own FROM lineitem GROUP BY l_orderkey""")
def suppressed_text(spark, sf_dir):
    nodes = D.suppress(X.stored_nodes(spark, corpus.order_topics(spark, sf_dir), columns=D.TITLES))
    text = D.element_text(nodes)
    root = nodes.where("depth = 0").select("doc", "pre").join(big(text), ["doc", "pre"])
    return root.select("doc", T.js_trim("own").alias("own"))


@query("""
SELECT 'topics/o' || l_orderkey || '.dita' AS doc, '../parts/p' || l_partkey || '.dita#p' || l_partkey AS href,
       CASE WHEN p_size % 4 = 0 THEN p_name ELSE '../parts/p' || l_partkey || '.dita#p' || l_partkey END AS shown, count(*) AS n
FROM lineitem LEFT JOIN part ON p_partkey = l_partkey GROUP BY ALL""")
def xref_titles(spark, sf_dir):
    nodes = X.stored_nodes(spark, corpus.order_topics(spark, sf_dir).unionByName(corpus.part_topics(spark, sf_dir)), columns=D.LINKS, own=("topic/title", "topic/xref"), bare=True)
    return D.xref_titles(nodes).groupBy("doc", "href", "shown").agg(F.count("*").alias("n"))


@query("""
SELECT 'topics/o' || l_orderkey || '.dita' AS doc, md5('<article id="o' || l_orderkey || '" class="topic"><h1>Order ' || l_orderkey || '</h1><main class="body">' || chr(10) ||
  string_agg('<p><span class="xref-external">→ ' || x || '</span><span class="keyword"></span></p>', '' ORDER BY l_linenumber, l_partkey, l_suppkey) || chr(10) || '</main></article>') AS hash
FROM (SELECT *, CASE WHEN p_size % 4 = 0 THEN p_name ELSE '../parts/p' || l_partkey || '.dita#p' || l_partkey END AS x FROM lineitem LEFT JOIN part ON p_partkey = l_partkey) GROUP BY l_orderkey""")
def topic_html(spark, sf_dir):
    both = X.stored_nodes(spark, corpus.order_topics(spark, sf_dir).unionByName(corpus.part_topics(spark, sf_dir)), columns=D.PAGES, own=("topic/title",))
    return D.topic_html(both.where("doc LIKE 'topics/%'"), targets=both).select("doc", F.md5("html").alias("hash"))


@query("""
SELECT 'copy/p' || p_partkey || '.dita' AS doc, CASE WHEN p_size % 4 = 0 THEN p_name || p_brand ELSE 'literal' END AS shown, p_size % 4 = 0 AS resolved FROM part WHERE p_size % 2 = 0""")
def conref_text(spark, sf_dir):
    c = F.col
    parts = table(spark, sf_dir, "part").where("p_size % 2 = 0")
    users = parts.select(cat("copy/p", c("p_partkey"), ".dita").alias("path"), cat('<topic id="c"><title>C</title><body><p conref="../parts/p', c("p_partkey"), ".dita#p", c("p_partkey"), '">literal</p></body></topic>').alias("content"))
    return D.conref_text(X.stored_nodes(spark, users.unionByName(corpus.part_topics(spark, sf_dir)))).select("doc", "shown", "resolved")


@query("""
SELECT 'tables/t' || l_orderkey || '.dita' AS doc, CAST(k AS BIGINT) AS "row", cell, col, colspan, rowspan, txt AS text FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem) JOIN LATERAL (
  SELECT 1 AS cell, 1 AS col, CASE WHEN l_linenumber % 2 = 0 THEN 2 ELSE 1 END AS colspan, 1 AS rowspan, CAST(l_partkey AS VARCHAR) AS txt
  UNION ALL SELECT 2, 3, 1, l_linenumber % 3 + 1, CAST(l_suppkey AS VARCHAR)) ON true""")
def cals_cells(spark, sf_dir):
    cells = D.cals_cells(X.stored_nodes(spark, corpus.table_topics(spark, sf_dir), columns=D.CELLS, own=("topic/entry",), only=D.TABLE_TYPES, kept=D.cell_rows))
    return cells.select("doc", F.col("row").cast("long").alias("row"), "cell", "col", "colspan", "rowspan", "text")


@query("""
SELECT 'tables/t' || k || '.dita' AS doc, col, width FROM (SELECT DISTINCT l_orderkey AS k, l_orderkey % 3 + 1 AS a FROM lineitem)
CROSS JOIN LATERAL (VALUES (1, printf('%.2f%%', 100.0 * a / (a + 2))), (2, printf('%.2f%%', 200.0 / (a + 2))), (3, '120px')) AS w(col, width)""")
def cals_widths(spark, sf_dir):
    return D.cals_columns(X.shred(corpus.table_topics(spark, sf_dir), columns=D.COLSPECS)).select("doc", "col", "width")


@query("""
SELECT 'topics/o' || o || '.dita' AS doc, line, col, tag, exact FROM (SELECT DISTINCT l_orderkey AS o FROM lineitem)
CROSS JOIN (VALUES (0, 0, 'topic', true), (0, 1, 'topic', true), (1, 1, 'p', true), (1, 5, 'xref', true), (2, 1, 'body', true), (2, 9, 'topic', true), (3, 0, 'p', false)) AS v(line, col, tag, exact)""")
def position_element(spark, sf_dir):
    """Seven places in every topic: ends of ranges, columns that tell siblings from parents, and one after the end."""
    topics = corpus.order_topics(spark, sf_dir)
    places = F.explode(F.array(*[F.struct(F.lit(line).alias("line"), F.lit(col).alias("col")) for line, col in ((0, 0), (0, 1), (1, 1), (1, 5), (2, 1), (2, 9), (3, 0))]))
    points = topics.select(F.col("path").alias("doc"), places.alias("x")).select("doc", "x.*")
    return D.elements_at(points, X.stored_nodes(spark, topics, columns=D.POSITIONS)).select("doc", "line", "col", "tag", "exact")


# ------------------------------------------------------------------ references


def _topics_dir(spark):
    return spark.createDataFrame([("topics",)], "scope_dir string")


def _keys(spark, sf_dir):
    """The key spaces of the topics folder: nearer maps first, then those at the root (which expand to maps/)."""
    maps = corpus.key_maps(spark, sf_dir)
    nodes = X.stored_nodes(spark, maps)
    definitions = K.key_definitions(M.expand_maps(nodes), nodes)
    return written(spark, K.key_space(K.visible_maps(_topics_dir(spark), maps), definitions))


_MISSING_FILE = "SELECT count(*) AS n FROM lineitem LEFT JOIN part ON p_partkey = l_partkey WHERE p_size IS NULL OR p_size % 2 <> 0"
_MISSING_ID = "SELECT count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size % 4 = 2"
_UNDEFINED = "SELECT count(*) AS n FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey WHERE s_suppkey IS NULL OR s_suppkey % 3 = 0 AND s_suppkey % 5 <> 0"


@query(f"""
SELECT 'missing-file' AS code, n FROM ({_MISSING_FILE}) UNION ALL SELECT 'missing-id', n FROM ({_MISSING_ID}) UNION ALL SELECT 'undefined-key', n FROM ({_UNDEFINED})""")
def diagnostics_by_code(spark, sf_dir):
    docs = corpus.order_topics(spark, sf_dir).unionByName(corpus.part_topics(spark, sf_dir))
    return R.diagnostics(docs, _keys(spark, sf_dir)).groupBy("code").agg(F.count("*").alias("n"))


@query("""
SELECT 'topics/o' || l_orderkey || '.dita' AS doc, '../parts/p' || l_partkey || '.dita#p' || l_partkey AS value, count(*) AS n
FROM lineitem LEFT JOIN part ON p_partkey = l_partkey WHERE p_size IS NULL OR p_size % 2 <> 0 GROUP BY ALL""")
def missing_file(spark, sf_dir):
    topics = corpus.order_topics(spark, sf_dir)
    return R.missing_files(R.collect_refs(topics), topics.select("path").unionByName(corpus.part_topics(spark, sf_dir).select("path"))).groupBy("doc", "value").agg(F.count("*").alias("n"))


@query("""
SELECT 'topics/o' || l_orderkey || '.dita' AS doc, 'p' || l_partkey AS topic, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size % 4 = 2 GROUP BY ALL""")
def missing_id(spark, sf_dir):
    topics = corpus.order_topics(spark, sf_dir)
    docs = topics.unionByName(corpus.part_topics(spark, sf_dir))
    scanned = written(spark, R.scan_texts(docs))
    return R.missing_ids(R.references(scanned).where("doc LIKE 'topics/%'"), docs, scanned).groupBy("doc", "topic").agg(F.count("*").alias("n"))


@query("""
SELECT 's' || l_suppkey AS key, count(*) AS n FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey
WHERE s_suppkey IS NULL OR s_suppkey % 3 = 0 AND s_suppkey % 5 <> 0 GROUP BY ALL""")
def undefined_key(spark, sf_dir):
    return R.undefined_keys(R.collect_refs(corpus.order_topics(spark, sf_dir)), _keys(spark, sf_dir)).groupBy("key").agg(F.count("*").alias("n"))


@query("""
SELECT 's' || s_suppkey AS key, CASE WHEN s_suppkey % 5 = 0 THEN 'near ' ELSE '' END || s_name AS value, CASE WHEN s_suppkey % 5 = 0 THEN 0 ELSE 1 END AS distance
FROM supplier WHERE s_suppkey % 5 = 0 OR s_suppkey % 3 <> 0""")
def key_space_nearest(spark, sf_dir):
    return _keys(spark, sf_dir).select("key", "value", "distance")


@query("""
SELECT 's' || l_suppkey AS key, CASE WHEN s_suppkey % 5 = 0 THEN 'near ' || s_name WHEN s_suppkey % 3 <> 0 THEN s_name ELSE '' END AS shown, count(*) AS n
FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL""")
def keyref_text(spark, sf_dir):
    # Every use is read once and carries its text, so no node is stored.
    nodes = X.shred(corpus.order_topics(spark, sf_dir), columns=("base", "attrs", "tag"), own=("topic/keyword",), bare=True)
    uses = D.with_own(nodes, ("topic/keyword",)).where("tag = 'keyword'").select(T.dirname("doc").alias("scope_dir"), F.col("attrs")["keyref"].alias("key"), "tag", "own")
    return K.resolve_keyrefs(uses, _keys(spark, sf_dir)).groupBy("key", "shown").agg(F.count("*").alias("n"))


@query("""
WITH m AS (SELECT DISTINCT s_suppkey // 1000 AS n FROM supplier WHERE s_suppkey % 5 = 0), r AS (SELECT DISTINCT s_suppkey // 1000 AS n FROM supplier WHERE s_suppkey % 3 <> 0)
SELECT 'topics' AS scope_dir, (SELECT min('topics/keys' || n || '.ditamap') FROM m) AS map_path, (SELECT count(*) FROM m) AS candidates
UNION ALL SELECT 'parts', (SELECT min('root' || n || '.ditamap') FROM r), (SELECT count(*) FROM r)""")
def owning_map(spark, sf_dir):
    dirs = corpus.order_topics(spark, sf_dir).select("path").unionByName(corpus.part_topics(spark, sf_dir).select("path")).select(T.dirname("path").alias("scope_dir"))
    return K.owning_map(dirs, corpus.key_maps(spark, sf_dir)).select("scope_dir", "map_path", F.size("candidates").cast("long").alias("candidates"))


# ------------------------------------------------------------------ maps and books


def _entries(spark, sf_dir):
    maps = corpus.book_maps(spark, sf_dir)
    nodes = X.stored_nodes(spark, maps)
    return M.map_entries(M.expand_maps(nodes, maps.where("path LIKE 'maps/r%'")), nodes)


_BOOK = """
WITH e AS (
  SELECT n_regionkey AS r, n_nationkey AS n, -1 AS c, 0 AS depth, n_name AS name, ['chapter', 'part', 'appendix'][n_nationkey % 3 + 1] AS tag, 'n' || n_nationkey || '.ditamap' AS href FROM nation
  UNION ALL SELECT n_regionkey, n_nationkey, c_custkey, 1, c_name, 'topicref', 'c' || c_custkey || '.dita' FROM customer JOIN nation ON n_nationkey = c_nationkey),
p AS (SELECT *, 'maps/r' || r || '.ditamap' AS root_map, CAST(row_number() OVER (PARTITION BY r ORDER BY n, c) AS BIGINT) AS pos FROM e)
"""


@query(_BOOK + "SELECT root_map, pos, depth, tag, href, name AS display_name FROM p")
def map_entries(spark, sf_dir):
    return _entries(spark, sf_dir).select("root_map", F.col("pos").cast("long").alias("pos"), "depth", "tag", "href", "display_name")


@query(_BOOK + "SELECT root_map, depth, count(*) AS n FROM p GROUP BY ALL")
def map_depth_counts(spark, sf_dir):
    return _entries(spark, sf_dir).groupBy("root_map", "depth").agg(F.count("*").alias("n"))


@query(_BOOK + """, d AS (SELECT *, row_number() OVER (PARTITION BY r, tag ORDER BY pos) AS k FROM p WHERE depth = 0)
SELECT root_map, pos, CASE tag WHEN 'chapter' THEN 'Chapter ' || k WHEN 'part' THEN 'Part ' || ['I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX', 'X'][k]
       ELSE 'Appendix ' || chr(CAST(64 + k AS INTEGER)) END AS role FROM d""")
def book_numbering(spark, sf_dir):
    return M.number_divisions(_entries(spark, sf_dir)).where("n IS NOT NULL").select("root_map", F.col("pos").cast("long").alias("pos"), "role")


@query(_BOOK + "SELECT root_map, pos, row_number() OVER (PARTITION BY r, href ORDER BY pos) > 1 AS repeat FROM p")
def book_dedupe(spark, sf_dir):
    return M.first_occurrences(_entries(spark, sf_dir)).select("root_map", F.col("pos").cast("long").alias("pos"), "repeat")


@query(_BOOK + """
SELECT root_map, pos, replace(href, '.dita', '.html') AS file, replace(lag(href) OVER w, '.dita', '.html') AS prev, replace(lead(href) OVER w, '.dita', '.html') AS next
FROM p WHERE tag = 'topicref' WINDOW w AS (PARTITION BY r ORDER BY pos)""")
def nav_prev_next(spark, sf_dir):
    return M.prev_next(M.nav_manifest(_entries(spark, sf_dir))).select("root_map", F.col("pos").cast("long").alias("pos"), "file", "prev", "next")


@query("""
SELECT 'rel/n' || a.c_nationkey || '.ditamap' AS doc, 'c' || a.c_custkey AS href_a, 'c' || b.c_custkey AS href_b
FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_custkey // 10 = b.c_custkey // 10 AND a.c_custkey % 2 = 0 AND b.c_custkey % 2 = 1""")
def rel_pairs(spark, sf_dir):
    c, cu = F.col, table(spark, sf_dir, "customer")
    side = lambda k: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(c("c_custkey") % 2 == k, c("c_custkey")))), lambda x: F.concat(F.lit('<topicref href="c'), x.cast("string"), F.lit('"/>'))), "")
    rows = cu.groupBy("c_nationkey", F.expr("c_custkey div 10").alias("g")).agg(cat("<relrow><relcell>", side(0), "</relcell><relcell>", side(1), "</relcell></relrow>").alias("x"))
    maps = rows.groupBy("c_nationkey").agg(corpus.joined(c("x"), ["g"]).alias("x")).select(cat("rel/n", c("c_nationkey"), ".ditamap").alias("path"), cat("<map><reltable>", c("x"), "</reltable></map>").alias("content"))
    return M.reltable_pairs(X.stored_nodes(spark, maps)).select("doc", "href_a", "href_b")


@query(_BOOK + """
SELECT root_map, md5('<div class="ditamap-book">' || string_agg(CASE
    WHEN depth = 0 THEN '<div class="book-entry book-entry--placeholder">' || chr(10) || '  <h1 class="book-section-heading">' || name || '</h1>' || chr(10) || '</div>'
    WHEN c % 7 = 0 THEN '<div class="book-entry book-entry--error">' || chr(10) || '  <h2 class="book-entry-title">' || name || '</h2>' || chr(10) || '  <p class="book-error">File not found: maps/c' || c || '.dita</p>' || chr(10) || '</div>'
    ELSE '<div class="book-entry"><article class="topic"><h2>' || name || '</h2></article></div>' END, chr(10) ORDER BY pos) || '</div>') AS hash FROM p GROUP BY root_map""")
def book_html(spark, sf_dir):
    c = F.col
    topics = table(spark, sf_dir, "customer").where("c_custkey % 7 <> 0").select(cat("maps/c", c("c_custkey"), ".dita").alias("path"), cat("<topic><title>", c("c_name"), "</title></topic>").alias("content"))
    entries = written(spark, M.first_occurrences(_entries(spark, sf_dir)))
    levels = entries.where("file IS NOT NULL").select(F.col("file").alias("doc"), D.heading_level("depth").alias("level")).distinct()
    return D.book_html(entries, D.topic_html(X.stored_nodes(spark, topics), levels=levels)).select("root_map", F.md5("html").alias("hash"))


# ------------------------------------------------------------------ functions and audits


@query("""
SELECT p_partkey, 'x/y/' || p_size || '/f.dita' AS resolved, 'f' AS stem, '../' || p_size || '/f.dita' AS rel FROM part""")
def path_functions(spark, sf_dir):
    c = F.col
    p = table(spark, sf_dir, "part").select("p_partkey", T.resolve(F.lit("x/y/z"), cat(".././", c("p_size"), "/f.dita#a/b")).alias("resolved"))
    return p.select("p_partkey", "resolved", T.stem("resolved").alias("stem"), T.relative("resolved", F.lit("x/y/z")).alias("rel"))


@query("""
WITH n AS (SELECT DISTINCT l_orderkey % 3999 + 1 AS n FROM lineitem)
SELECT n, repeat('M', CAST(n // 1000 AS INTEGER)) || ['', 'C', 'CC', 'CCC', 'CD', 'D', 'DC', 'DCC', 'DCCC', 'CM'][n // 100 % 10 + 1] || ['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'][n // 10 % 10 + 1] || ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][n % 10 + 1] AS roman,
       CASE WHEN n <= 26 THEN '' WHEN n <= 702 THEN chr(CAST(64 + (n - 1) // 26 AS INTEGER))
            ELSE chr(CAST(65 + (n - 703) // 676 AS INTEGER)) || chr(CAST(65 + (n - 703) // 26 % 26 AS INTEGER)) END || chr(CAST(65 + (n - 1) % 26 AS INTEGER)) AS letters FROM n""")
def ordinals_all(spark, sf_dir):
    """Every order number folded to 1..3999, what ``roman`` is made for: all rows, thousands and three letters."""
    n = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 3999 + 1).alias("n")).distinct()
    return n.select("n", T.roman("n").alias("roman"), T.letters("n").alias("letters"))


_CAT = """
WITH a AS (SELECT p_brand || '-' || p_size AS tag, min(p_type) AS t FROM part WHERE p_partkey % 3 <> 0 GROUP BY 1),
b AS (SELECT p_brand || '-' || p_size AS tag, min(p_type) AS t FROM part WHERE p_partkey % 3 <> 1 GROUP BY 1),
d AS (SELECT coalesce(a.tag, b.tag) AS tag, CASE WHEN a.tag IS NULL THEN 'only-new' WHEN b.tag IS NULL THEN 'only-code' WHEN a.t = b.t THEN 'matched' ELSE 'conflict' END AS status, a.t AS code_type, b.t AS found_type FROM a FULL JOIN b ON a.tag = b.tag)
"""


def _diff(spark, sf_dir):
    tags = lambda k: table(spark, sf_dir, "part").where(f"p_partkey % 3 <> {k}").groupBy(cat(F.col("p_brand"), "-", F.col("p_size")).alias("tag")).agg(F.min("p_type").alias("base_type"))
    return S.catalogue_diff(tags(0), tags(1))


@query(_CAT + "SELECT tag, status, code_type, found_type FROM d")
def catalog_diff(spark, sf_dir):
    return _diff(spark, sf_dir).select("tag", "status", "code_type", "found_type")


@query(_CAT + "SELECT status, CASE WHEN grouping(status) = 1 THEN NULL ELSE left(min(tag), 5) END AS sample, count(*) AS n FROM d GROUP BY ROLLUP (status)")
def catalog_diff_rollup(spark, sf_dir):
    r = _diff(spark, sf_dir).rollup("status").agg(F.min("tag").alias("t"), F.count("*").alias("n"), F.grouping("status").alias("g"))
    return r.select("status", F.when(F.col("g") == 0, F.substring("t", 1, 5)).alias("sample"), "n")


@query("""
SELECT p_brand AS tag, CAST(p_size % 2 AS BIGINT) AS bucket, count(DISTINCT p_type) AS n_types, arg_max(p_type, p_partkey) AS base_type FROM part GROUP BY ALL""")
def declared_conflicts(spark, sf_dir):
    d = table(spark, sf_dir, "part").select(F.col("p_brand").alias("tag"), (F.col("p_size") % 2).cast("long").alias("bucket"), F.col("p_type").alias("base_type"), F.col("p_partkey").alias("ord"))
    return S.declared_conflicts(d)


@query("""
SELECT 'dtd/' || p_partkey || '.mod' AS path, line, unnest(['a' || p_partkey, 'b']) AS tag, '- topic/ph ' || p_brand || '/x %gone;' AS class_value
FROM part CROSS JOIN (VALUES (2), (4)) AS v(line)""")
def schema_scan(spark, sf_dir):
    """Every declaration comes twice: the second one has a line of its own."""
    c = F.col
    one = cat("<!ATTLIST (a", c("p_partkey"), ' | b) id ID #IMPLIED\n class CDATA "- topic/ph %dom;/x %gone;">')
    f = table(spark, sf_dir, "part").select(cat("dtd/", c("p_partkey"), ".mod").alias("path"), cat('<!ENTITY % dom "', c("p_brand"), '">\n', one, "\n", one).alias("content"))
    return S.scan_classes(f).select("path", "line", "tag", "class_value")


@query("""
SELECT c_nationkey AS scope, CAST(c_custkey % 7 AS BIGINT) AS name, arg_min(c_name, c_custkey) AS path FROM customer GROUP BY ALL""")
def layered_lookup(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("scope"), (F.col("c_custkey") % 7).alias("name"), F.col("c_custkey").alias("layer"), F.col("c_name").alias("path"))
    return S.layered_lookup(c).select("scope", "name", "path")


# ------------------------------------------------------------------ change and log streams (batch twins)


def _log(spark, sf_dir):
    """Each user's events as one log text, cut into chunks in the middle of a line."""
    e = table(spark, sf_dir, "events")
    line = cat(F.when(F.col("event_type") == "error", F.lit("[ERROR] ")).otherwise(F.lit("")), F.col("event_type"), " ", F.col("event_id"), "\n")
    half = F.expr("length(line) div 2")
    x = e.select(F.col("user_id").alias("run"), "event_id", line.alias("line")).select("run", F.explode(F.array(F.struct((F.col("event_id") * 2).alias("seq"), F.substring("line", F.lit(1), half).alias("chunk")), F.struct((F.col("event_id") * 2 + 1).alias("seq"), F.substring("line", half + 1, F.length("line")).alias("chunk")))).alias("x"))
    return x.select("run", "x.seq", "x.chunk")


@query("""
SELECT user_id AS run, CASE WHEN event_type = 'error' THEN '[ERROR] ' ELSE '' END || event_type || ' ' || event_id AS line,
       CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS level, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS BIGINT) AS line_no FROM events""")
def log_lines(spark, sf_dir):
    return C.log_lines(_log(spark, sf_dir)).select("run", "line", "level", "line_no")


@query("SELECT CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS level, count(*) AS n FROM events GROUP BY 1")
def log_levels(spark, sf_dir):
    return C.log_lines(_log(spark, sf_dir)).groupBy("level").agg(F.count("*").alias("n"))


@query("""
WITH s AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM s)
SELECT user_id AS path, arg_max(CAST(event_id AS VARCHAR), ts) AS content, count(*) AS n FROM g GROUP BY user_id, k""")
def debounced_changes(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), F.col("ts").cast("timestamp").alias("ts"), F.lit("change").alias("op"), F.col("event_id").cast("string").alias("content"))
    return C.debounced(e, "10 minutes").select("path", "content", "n")


@query("""
WITH cut AS (SELECT max(ts) - INTERVAL 1 DAY AS t FROM events),
a AS (SELECT user_id AS path, max(ts) AS m FROM events, cut WHERE ts <= t GROUP BY 1), b AS (SELECT user_id AS path, max(ts) AS m FROM events GROUP BY 1)
SELECT b.path AS path, CASE WHEN a.m IS NULL THEN 'added' ELSE 'touched' END AS change FROM b LEFT JOIN a ON a.path = b.path WHERE a.m IS DISTINCT FROM b.m""")
def snapshot_changes_all(spark, sf_dir):
    """All events up to a day before the last one, and all events."""
    events = table(spark, sf_dir, "events")
    cut = events.agg(F.max("ts").alias("last")).select(F.expr("last - INTERVAL 1 DAY").alias("t"))
    snap = lambda e: e.groupBy(F.col("user_id").alias("path")).agg(F.max("ts").alias("mtime"))
    return C.snapshot_changes(snap(events.join(F.broadcast(cut), F.col("ts") <= F.col("t"))), snap(events))


from . import catalog_maps, catalog_more, catalog_topics  # noqa: E402, F401  # they register more
