"""The outline of a map as HTML: nested lists of its references with badges, containers, and tables of related topics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.store import big
from . import maps as M
from .scan import ranked

#: Base types below which nothing is drawn, and those that are drawn.
SILENT = ("map/map-title", "map/topicmeta", "map/linktext", "map/navtitle", "map/shortdesc", "map/keywords", "map/keyword", "map/anchor", "map/navref", "map/relcolspec")
DRAWN = (*M.ENTRY_TYPES, "map/topicgroup", "map/bookmap-structural", "map/reltable", "map/relheader", "map/relrow", "map/relcell", "map/relcolspec")
#: Class names of the outline, and the elements of tables of related topics.
ITEM, LABEL, LINK, LIST = "map-tree-item", "map-tree-label", "map-tree-link", '<ul class="map-tree">'
TABLES = {
    "reltable": ('<div class="map-reltable"><h2 class="map-reltable-title">Related Information</h2><table class="map-reltable-table"><tbody>', "</tbody></table></div>"),
    "relheader": ('<tr class="relheader">', "</tr>"), "relrow": ('<tr class="relrow">', "</tr>"),
    "relcell": ('<td><span class="relcell-content"><ul class="map-tree map-tree--inline">', "</ul></span></td>"),
}
FILE, KEY = '<span class="map-tree-icon map-tree-icon--file">\U0001f4c4</span>', '<span class="map-tree-icon map-tree-icon--key">\U0001f511</span>'


def map_html(expanded: DataFrame, nodes: DataFrame, keys: DataFrame | None = None, role: Callable[[Column, Column], Column] = M.plain_role) -> DataFrame:
    """(root_map, html) of expanded maps by event assembly: each drawn element opens and closes at its place in the order.

    References are links where they have a href and keys otherwise; roles are numbered by the depth of entries. A map's
    title page comes first. keys: key, value, for titles and names that hold key references.
    """
    a, drawn = F.col("attrs"), lambda types: F.coalesce(F.col("base").isin(*types), F.lit(False))
    v = expanded.where(drawn(DRAWN) & ~F.arrays_overlap("path", F.array(*map(F.lit, SILENT))))
    in_head = F.element_at("path", -1) == "map/relheader"
    v = v.where((F.col("base") != "map/relcolspec") | in_head)
    refs = v.where(drawn(M.MAP_REF_TYPES)).select("root_map", "order_key", F.size(F.filter("path", lambda b: b.isin(*M.ENTRY_TYPES))).alias("depth"), "tag")
    roles = M.number_divisions(ranked(refs, "root_map", "order_key"), role).select("root_map", "order_key", "role")
    up = F.array_max(F.transform(F.sequence(F.lit(1), F.greatest(F.size("path") - 1, F.lit(1))), lambda k: F.when((k < F.size("path")) & F.get("path", k).isin(*DRAWN), k)))
    kids = v.select("root_map", F.when(up.isNotNull(), F.slice("order_key", F.lit(1), up)).alias("order_key")).where("order_key IS NOT NULL").distinct().withColumn("has_kids", F.lit(True))
    texts = M.keyed_text(nodes, keys, ("map/relcolspec",)).select(F.col("doc").alias("src_map"), "pre", "own")
    names = M.display_names(nodes, keys).select(F.col("doc").alias("src_map"), "pre", "meta_name")
    v = v.join(big(roles), ["root_map", "order_key"], "left").join(big(kids), ["root_map", "order_key"], "left").join(big(names), ["src_map", "pre"], "left").join(big(texts), ["src_map", "pre"], "left")

    name, href, some = T.escape_attr(M.shown_name()), F.coalesce(a["href"], F.lit("")), F.coalesce("has_kids", F.lit(False))
    badge = F.coalesce(F.concat(F.lit('<span class="map-tree-badge">'), T.escape_attr("role"), F.lit("</span>")), F.lit(""))
    data = F.concat(T.safe_attr("data-keys", F.coalesce(a["keys"], F.lit(""))), F.when(href != "", T.safe_attr("data-href", href)).otherwise(""))
    inner, after = F.when(some, LIST).otherwise(""), F.when(some, "</ul>").otherwise("")
    of = lambda *types: F.col("base").isin(*(f"map/{t}" for t in types))
    header = T.escape_attr(F.coalesce(F.when(a["navtitle"] != "", a["navtitle"]), T.js_trim("own")))
    item = lambda kind, *more: F.concat(F.lit(f'<li class="{ITEM} {ITEM}--{kind}"'), *more, F.lit(">"))
    label = lambda kind, text: F.concat(F.lit(f'<span class="{LABEL}{f" {LABEL}--{kind}" if kind else ""}">'), text, F.lit("</span>"))
    done = F.concat(after, F.lit("</li>"))
    link = F.concat(F.lit(f'<a href="#" class="{LINK}" data-href="'), T.escape_attr(href), F.lit(f'">{FILE}'), badge, label("", name), F.lit("</a>"))
    rules = [
        (of("topicref", "keydef", "mapref") & (href != ""), F.concat(item("nav", data), link, inner), done),
        (of("topicref", "keydef", "mapref"), F.concat(item("keydef", data), F.lit(KEY), badge, label("keydef", name), inner), done),
        (of("topichead"), F.concat(item("head"), label("head", name), inner), done),
        (of("bookmap-structural"), F.concat(item("structural"), label("structural", T.escape_attr(T.capitalised("tag"))), inner), done),
        (of("topicgroup"), F.concat(item("group"), F.lit(LIST)), F.lit("</ul></li>")),
        *[(of(base), F.lit(begin), F.lit(finish)) for base, (begin, finish) in TABLES.items()],
        (of("relcolspec"), F.concat(F.lit("<th>"), header), F.lit("</th>")),
    ]
    opening, closing = F.lit(""), F.lit("")
    for when, begin, finish in reversed(rules):
        opening, closing = F.when(when, begin).otherwise(opening), F.when(when, finish).otherwise(closing)
    at = lambda k: F.concat("order_key", F.array(F.lit(k)))
    events = v.select("root_map", F.explode(F.array(F.struct(at(-1).alias("pos"), opening.alias("html")), F.struct(at((1 << 31) - 1).alias("pos"), closing.alias("html")))).alias("x")).select("root_map", "x.*")
    body = events.groupBy("root_map").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "html"))), lambda x: x["html"]), "").alias("body"))
    titles = M.map_titles(nodes, keys).select(F.col("doc").alias("root_map"), "title", "subtitles", "paged")
    heads = nodes.where("depth = 0 AND error IS NULL").select(F.col("doc").alias("root_map")).join(big(expanded.select("root_map").distinct()), "root_map", "left_semi")
    page = F.concat(F.lit('<h1 class="map-title">'), T.escape_attr(F.coalesce("title", F.lit(""))), F.lit("</h1>"))
    subs = F.array_join(F.transform("subtitles", lambda t: F.concat(F.lit('<p class="book-subtitle">'), T.escape_attr(t), F.lit("</p>"))), "")
    titled = F.when(F.col("paged"), F.concat(F.lit('<div class="book-titlepage">'), page, subs, F.lit("</div>"))).when(F.col("paged").isNotNull(), page).otherwise("")
    out = heads.join(big(titles), "root_map", "left").join(big(body), "root_map", "left")
    return out.select("root_map", F.concat(F.lit('<div class="ditamap-container">'), titled, F.lit(LIST), F.coalesce("body", F.lit("")), F.lit("</ul></div>")).alias("html"))
