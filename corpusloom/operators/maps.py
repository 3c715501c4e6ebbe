"""Maps: expansion of sub-maps, names, entries, numbering of book divisions, outlines, page order, relationship tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.store import Layers, big, shared_dir, written
from .documents import text_rows, text_slices
from .scan import neighbours, ranked, restarting_counts

#: Base types that give an entry, that may refer to another map, and that the explorer shows.
ENTRY_TYPES = ("map/topicref", "map/keydef", "map/mapref", "map/topichead")
MAP_REF_TYPES = ("map/topicref", "map/keydef", "map/mapref")
SHOWN_TYPES = (*ENTRY_TYPES, "map/bookmap-structural")
#: The divisions of a book and their names; the first three are numbered.
ROLES = {
    "chapter": "Chapter", "part": "Part", "appendix": "Appendix", "preface": "Preface", "notices": "Notices", "draftintro": "Draft Intro",
    "dedication": "Dedication", "colophon": "Colophon", "bookabstract": "Abstract", "amendments": "Amendments", "glossaryref": "Glossary",
}
NUMBERED = ("chapter", "part", "appendix")
#: Role texts by locale; {0} is the ordinal.
ROLE_TEXTS = {
    "en": {"chapter": "Chapter {0}", "part": "Part {0}", "appendix": "Appendix {0}"} | {k: v for k, v in ROLES.items() if k not in NUMBERED},
    "zh": {
        "chapter": "第 {0} 章", "part": "第 {0} 部分", "appendix": "附录 {0}", "preface": "前言", "notices": "声明", "draftintro": "草稿介绍",
        "dedication": "献词", "colophon": "版权页", "bookabstract": "摘要", "amendments": "修订", "glossaryref": "词汇表",
    },
}
ORDER = "array<int>"


def _map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def _count(path, types: tuple[str, ...]) -> Column:
    """How many ancestors have one of these base types."""
    return F.size(F.filter(path, lambda b: b.isin(*types)))


def is_map_ref(base="base", attrs="attrs") -> Column:
    """A reference to another map: local, and by extension or format."""
    a = F.col(attrs)
    named = F.lower(T.path_part(a["href"])).endswith(".ditamap") | F.coalesce(a["format"] == "ditamap", F.lit(False))
    return F.coalesce(F.col(base).isin(*MAP_REF_TYPES) & ~T.is_external(a["href"], a["scope"]) & ~a["href"].startswith("#") & named, F.lit(False))


def map_refs(nodes: DataFrame) -> DataFrame:
    """(src_map, pre, ord, path, target, n_own, top): references from maps to maps. n_own counts the reference's own
    children; top is the order of the outermost reference around it (or its own)."""
    refs = nodes.where("type = 'element' AND depth > 0").where(is_map_ref())
    refs = refs.select(F.col("doc").alias("src_map"), "pre", "ord", "anc", "path", "base", T.resolve(T.dirname("doc"), F.col("attrs")["href"]).alias("target"))
    kids = nodes.where("parent IS NOT NULL").select(F.col("doc").alias("src_map"), F.col("parent").alias("pre"), "sib").groupBy("src_map", "pre").agg((F.max("sib") + 1).alias("n_own"))
    ups = refs.select("src_map", F.col("pre").alias("up"), F.size("ord").alias("len"))
    outer = refs.select("src_map", "pre", F.explode("anc").alias("up")).join(big(ups), ["src_map", "up"]).groupBy("src_map", "pre").agg(F.min("len").alias("len"))
    out = refs.join(big(kids), ["src_map", "pre"], "left").join(big(outer), ["src_map", "pre"], "left")
    return out.select("src_map", "pre", "ord", "path", "base", "target", F.coalesce("n_own", F.lit(0)).alias("n_own"), F.slice("ord", F.lit(1), F.coalesce("len", F.size("ord"))).alias("top"))


def expand_maps(nodes: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """Expanded element nodes: root_map, src_map, pre, order_key, path, tag, base, attrs, raw_href.

    Local hrefs of inlined maps are rebased to the root map's folder; ``raw_href`` is what the file says. A referenced map's elements are appended below the reference, after its own children; sorting by order_key is document
    order. Below one outermost reference each map is expanded at its first occurrence only, and own children of a reference
    know what their reference has expanded. Unreadable maps add nothing. Only references between maps are followed round
    by round (each written, until none is left, however deep); all other nodes are joined once at the end.
    """
    spark = nodes.sparkSession
    folder = shared_dir(spark)
    e = written(spark, map_refs(nodes), f"{folder}/refs")
    e = e.join(big(nodes.where("depth = 0 AND error IS NULL").select(F.col("doc").alias("target"))), "target")
    start = e.join(big(roots.select(F.col("path").alias("src_map")).distinct()), "src_map", "left_semi") if roots is not None else e
    inst = start.select(
        F.col("src_map").alias("root_map"), F.col("ord").alias("via"), F.col("path"), "base", "target", "n_own",
        F.array("target").alias("chain"), F.col("top").alias("branch"), F.lit(None).cast(ORDER).alias("holder"),
    )
    last = written(spark, inst, f"{folder}/0")
    inner = e.select(F.col("src_map").alias("at"), F.col("target").alias("to"), F.col("ord").alias("o"), F.col("path").alias("p"), F.col("base").alias("b"), F.col("n_own").alias("n"))
    known, k = Layers(spark), 0
    known.add(last)
    while not last.isEmpty():
        k += 1
        key = F.concat("via", F.array(F.col("n_own") + F.get("o", 0)), F.slice("o", F.lit(2), F.size("o")))
        path = F.concat("path", F.array("base"), F.slice("p", F.lit(2), F.size("p")))
        new = last.join(big(inner), F.col("target") == F.col("at")).where(~F.array_contains("chain", F.col("to")))
        new = new.select("root_map", key.alias("via"), path.alias("path"), F.col("b").alias("base"), F.col("to").alias("target"), F.col("n").alias("n_own"), F.concat("chain", F.array("to")).alias("chain"), "branch", F.col("via").alias("holder"))
        # An occurrence after a known one of the same map in the same branch is never the first: it need not be followed. Only the
        # new occurrences of a round are joined with the known ones, which are never grouped again.
        on = ["root_map", "branch", "target"]
        old = known.all().select(*[F.col(c).alias(f"__{c}") for c in (*on, "via")])
        met_before = [F.col(c) == F.col(f"__{c}") for c in on]
        last = written(spark, new.join(big(old), [*met_before, F.col("__via") <= F.col("via")], "left_anti"), f"{folder}/{k}")
        known.add(last)
    known = known.all()
    # The first occurrence in each branch counts; what lies in a map that is not expanded goes with it.
    w = Window.partitionBy("root_map", "branch", "target")
    kept = known.withColumn("__first", F.min("via").over(w) == F.col("via"))
    gone = kept.where("NOT __first").select("root_map", F.col("via").alias("cut"), F.col("n_own").alias("own"))
    under = F.explode(F.transform(F.sequence(F.lit(1), F.size("via")), lambda n: F.slice("via", F.lit(1), n))).alias("cut")
    inside = kept.where("holder IS NOT NULL").select("root_map", "via", under).join(big(gone), ["root_map", "cut"]).where("size(via) > size(cut) AND via[size(cut)] >= own").select("root_map", "via").distinct()
    kept = written(spark, kept.where("__first").drop("__first").join(big(inside), ["root_map", "via"], "left_anti"), f"{folder}/kept")
    el = nodes.where("type = 'element' AND depth > 0").select(F.col("doc").alias("src_map"), "pre", "ord", "path", "tag", "base", "attrs")
    own = el.join(big(roots.select(F.col("path").alias("src_map")).distinct()), "src_map", "left_semi") if roots is not None else el
    own = own.select(F.col("src_map").alias("root_map"), "src_map", "pre", F.col("ord").alias("order_key"), "path", "tag", "base", "attrs")
    key = F.concat("via", F.array(F.col("n_own") + F.get("ord", 0)), F.slice("ord", F.lit(2), F.size("ord")))
    path = F.concat("ipath", F.array("ibase"), F.slice("path", F.lit(2), F.size("path")))
    inst = kept.select("root_map", "via", F.col("path").alias("ipath"), F.col("base").alias("ibase"), F.col("target").alias("src_map"), "n_own")
    out = own.unionByName(inst.join(big(el), "src_map").select("root_map", "src_map", "pre", key.alias("order_key"), path.alias("path"), "tag", "base", "attrs"))
    a = F.col("attrs")
    seen = rebased(a["href"], a["scope"], T.dirname("src_map"), T.dirname("root_map"))
    moved = F.map_concat(F.map_filter(a, lambda k, _: k != "href"), F.create_map(F.lit("href"), seen))
    out = out.select(*[c for c in out.columns if c != "attrs"], F.when(seen != a["href"], moved).otherwise(a).alias("attrs"), a["href"].alias("raw_href"))
    return written(spark, out, f"{folder}/expanded")  # most users read it several times


def own_elements(nodes: DataFrame) -> DataFrame:
    """Elements of each map in the form of ``expand_maps``, without what its references would bring."""
    el = nodes.where("type = 'element' AND depth > 0")
    return el.select(F.col("doc").alias("root_map"), F.col("doc").alias("src_map"), "pre", F.col("ord").alias("order_key"), "path", "tag", "base", "attrs", F.col("attrs")["href"].alias("raw_href"))


# ---------------------------------------------------------------- names


def keyed_text(nodes: DataFrame, keys: DataFrame | None = None, types: tuple[str, ...] | None = None) -> DataFrame:
    """(doc, pre, own): text below each element (of these base types), in order, '' without any. With ``keys`` (key, value) an
    element with a keyref and no text of its own shows its key's value, the innermost such element first."""
    asked = F.coalesce(F.col("base").isin(*types), F.lit(False)) if types else F.lit(True)
    if keys is None:
        return text_slices(nodes.select("doc", *text_rows(asked, F.lit(True))).where("e IS NOT NULL OR t IS NOT NULL"))
    keyed = F.coalesce(F.col("attrs")["keyref"] != "", F.lit(False))
    own = text_slices(nodes.select("doc", *text_rows(keyed, F.lit(True))).where("e IS NOT NULL OR t IS NOT NULL")).where(T.is_blank("own"))
    refs = nodes.where("type = 'element'").where(keyed).select("doc", "pre", "post", F.col("attrs")["keyref"].alias("key"))
    empty = refs.join(big(own.select("doc", "pre")), ["doc", "pre"]).join(big(keys.select("key", F.col("value").alias("__v"))), "key").where("__v <> ''")
    in_doc = Window.partitionBy("doc").orderBy("pre")
    # Of empty elements inside each other the innermost one shows its key; the blank texts in it go.
    empty = empty.withColumn("__next", F.lead("pre").over(in_doc)).where("__next IS NULL OR __next > post").select("doc", "pre", F.col("post").alias("__end"), "__v")
    marked = nodes.join(big(empty), ["doc", "pre"], "left").select("doc", "pre", "post", "type", "base", "text", "__v", F.max("__end").over(in_doc.rowsBetween(Window.unboundedPreceding, -1)).alias("__until"))
    shown = (F.col("type") == "text") & ~F.coalesce(F.col("__until") > F.col("pre"), F.lit(False))
    t = F.when(F.col("__v").isNotNull(), F.struct("pre", F.col("__v").alias("text"))).when(shown, F.struct("pre", "text")).alias("t")
    return text_slices(marked.select("doc", text_rows(asked, F.lit(True))[0], t).where("e IS NOT NULL OR t IS NOT NULL"))


META_TYPES = ("map/navtitle", "map/linktext", "map/shortdesc", "map/keyword")


def meta_texts(nodes: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """(doc, pre, kind, wrapped, value): what the topicmeta of an element says, not blank. Only first children count: the first
    topicmeta, in it the first element of a kind, and the first of a kind in its first keywords (wrapped)."""
    kids = nodes.where("type = 'element'").where(F.col("base").isin("map/topicmeta", "map/keywords", *META_TYPES))
    kids = kids.select("doc", "pre", "parent", F.element_at("path", -1).alias("under"), "base").withColumn("__k", F.row_number().over(Window.partitionBy("doc", "parent", "base").orderBy("pre"))).where("__k = 1")
    of = lambda base, pre, up: big(kids.where(F.col("base") == base).select("doc", F.col("pre").alias(pre), F.col("parent").alias(up)))
    meta = of("map/topicmeta", "meta", "owner")
    kinds = kids.where(F.col("base").isin(*META_TYPES))
    direct = kinds.where("under = 'map/topicmeta'").join(meta, (kinds["doc"] == meta["doc"]) & (kinds["parent"] == F.col("meta"))).select(kinds["doc"], "pre", "base", "owner", F.lit(False).alias("wrapped"))
    wrap = of("map/keywords", "kw", "kw_up")
    inner = kinds.where("under = 'map/keywords'").join(wrap, (kinds["doc"] == wrap["doc"]) & (kinds["parent"] == F.col("kw"))).select(kinds["doc"].alias("doc"), "pre", "base", "kw_up")
    inner = inner.join(meta, (inner["doc"] == meta["doc"]) & (F.col("kw_up") == F.col("meta"))).select(inner["doc"], "pre", "base", "owner", F.lit(True).alias("wrapped"))
    own = keyed_text(nodes, keys, META_TYPES).where(~T.is_blank("own"))
    out = direct.unionByName(inner).join(big(own), ["doc", "pre"])
    return out.select("doc", F.col("owner").alias("pre"), F.substring("base", 5, 20).alias("kind"), "wrapped", T.js_trim("own").alias("value"))


def _best(texts: DataFrame, ranks: dict[tuple[str, bool], int], name: str) -> DataFrame:
    rank = F.lit(None).cast("int")
    for (kind, wrapped), r in ranks.items():
        rank = F.when((F.col("kind") == kind) & (F.col("wrapped") == wrapped), r).otherwise(rank)
    t = texts.withColumn("__r", rank).where("__r IS NOT NULL")
    return t.groupBy("doc", "pre").agg(F.min_by("value", "__r").alias(name))


def display_names(nodes: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """(doc, pre, meta_name): navtitle, linktext, shortdesc, keyword of the topicmeta, the first that says anything."""
    return _best(meta_texts(nodes, keys), {("navtitle", False): 1, ("linktext", False): 2, ("shortdesc", False): 3, ("keyword", True): 4}, "meta_name")


def outline_names(nodes: DataFrame) -> DataFrame:
    """(doc, pre, meta_name): navtitle or linktext of the topicmeta."""
    return _best(meta_texts(nodes), {("navtitle", False): 1, ("linktext", False): 2}, "meta_name")


def key_values(nodes: DataFrame) -> DataFrame:
    """(doc, pre, value): keyword, linktext, navtitle, shortdesc, each directly in the topicmeta and then in its keywords."""
    kinds = ("keyword", "linktext", "navtitle", "shortdesc")
    return _best(meta_texts(nodes), {(kind, wrapped): 2 * k + wrapped for k, kind in enumerate(kinds) for wrapped in (False, True)}, "value")


def _named(expanded: DataFrame, names: DataFrame) -> DataFrame:
    return expanded.join(big(names.select(F.col("doc").alias("src_map"), "pre", "meta_name")), ["src_map", "pre"], "left")


def shown_name(attrs: str = "attrs") -> Column:
    """meta_name, else the stem of the href's file, else the keys."""
    a = F.col(attrs)
    file = F.substring_index(F.replace(a["href"], F.lit("\\"), F.lit("/")), "/", -1)
    return F.coalesce("meta_name", F.when(a["href"] != "", T.stem(file)), F.when(a["keys"] != "", a["keys"]), F.lit("(unnamed)"))


def outline_name(attrs: str = "attrs") -> Column:
    """meta_name, else the navtitle attribute, the whole href, the keys."""
    a = F.col(attrs)
    return F.coalesce("meta_name", *[F.when(a[n] != "", a[n]) for n in ("navtitle", "href", "keys")], F.lit("(unnamed)"))


# ---------------------------------------------------------------- entries and numbers


def map_entries(expanded: DataFrame, nodes: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Expanded nodes that give an entry: root_map, order_key, pos (1-based, in order), depth (entries around it), tag, base,
    href, keys, display_name, src_map, attrs. Relationship tables give none; groups and containers are transparent."""
    e = expanded.where(F.col("base").isin(*ENTRY_TYPES) & ~F.array_contains("path", "map/reltable"))
    e = _named(e, display_names(nodes, keys))
    e = ranked(e, "root_map", "order_key")
    return e.select("root_map", "order_key", "pos", _count("path", ENTRY_TYPES).alias("depth"), "tag", "base", F.col("attrs")["href"].alias("href"), F.col("attrs")["keys"].alias("keys"), shown_name().alias("display_name"), "src_map", "attrs")


def plain_role(tag: Column, ordinal: Column) -> Column:
    return F.when(tag.isin(*ROLES), F.concat_ws(" ", F.element_at(_map(ROLES), tag), ordinal))


def localised_role(locale: str) -> Callable[[Column, Column], Column]:
    """A formatter of roles in a locale (en, zh)."""
    table = ROLE_TEXTS[locale]
    return lambda tag, ordinal: F.when(tag.isin(*table), F.replace(F.element_at(_map(table), tag), F.lit("{0}"), F.coalesce(ordinal, F.lit(""))))


def number_divisions(entries: DataFrame, role: Callable[[Column, Column], Column] = plain_role) -> DataFrame:
    """entries (root_map, pos, depth, tag) with n, ordinal and role.

    Chapters, parts and appendixes are counted per tag and depth; every division, numbered or not, restarts the counters
    below its depth. ``role`` draws the text from the tag and the ordinal.
    """
    tag = F.col("tag")
    e = restarting_counts(entries, "root_map", "pos", "depth", "tag", F.coalesce(tag.isin(*ROLES), F.lit(False)), F.coalesce(tag.isin(*NUMBERED), F.lit(False)))
    ordinal = F.when(F.col("tag") == "chapter", F.col("n").cast("string")).when(F.col("tag") == "part", T.roman("n")).when(F.col("tag") == "appendix", T.letters("n"))
    return e.withColumn("ordinal", ordinal).withColumn("role", role(F.col("tag"), F.col("ordinal")))


def first_occurrences(entries: DataFrame) -> DataFrame:
    """entries with ``file`` (corpus path of the href) and ``repeat``: whether that file occurred before in the same book."""
    e = entries.withColumn("file", T.resolve(T.dirname("root_map"), "href"))
    w = Window.partitionBy("root_map", "file").orderBy("order_key")
    return e.withColumn("repeat", F.col("file").isNotNull() & (F.row_number().over(w) > 1))


def rebased(href, scope, from_dir, to_dir) -> Column:
    """A local href of a file in one folder as seen from another; the path stays as it is encoded, the fragment too."""
    path = T.path_part(href)
    moved = F.concat(T.relative(T.normalise(T.under(from_dir, path)), to_dir), F.when(href.contains("#"), F.concat(F.lit("#"), T.fragment(href))).otherwise(""))
    local = ~T.is_external(href, scope) & ~href.startswith("#") & (path != "")
    return F.when((from_dir != to_dir) & local, moved).otherwise(href)


# ---------------------------------------------------------------- outlines, explorer, titles


def map_outline(nodes: DataFrame, role: Callable[[Column, Column], Column] = plain_role) -> DataFrame:
    """outline(doc, pre, pos, depth, parent_pre, name, detail, kind) of each map, not expanded.

    References, keydefs and heads deepen; containers are shown and do not; relationship tables give nothing.
    """
    o = nodes.where("type = 'element' AND depth > 0").where(F.col("base").isin(*SHOWN_TYPES) & ~F.array_contains("path", "map/reltable"))
    o = o.join(big(outline_names(nodes)), ["doc", "pre"], "left")
    kind = F.when(F.col("base") == "map/keydef", "keydef").when(F.col("base") == "map/topichead", "head").when(F.col("base") == "map/bookmap-structural", "structural").otherwise("ref")
    shown = F.filter(F.arrays_zip(F.col("anc").alias("a"), F.col("path").alias("b")), lambda x: x["b"].isin(*SHOWN_TYPES))
    o = o.select(F.col("doc").alias("root_map"), "pre", "tag", "base", kind.alias("kind"), "attrs", "meta_name", _count("path", ENTRY_TYPES).alias("depth"), F.get(shown, F.size(shown) - 1)["a"].alias("parent_pre"), "line", "end_line")
    o = ranked(o, "root_map", "pre")
    # Only references count as divisions here; other kinds keep the numbers of their neighbours.
    o = number_divisions(o.withColumn("__tag", F.col("tag")).withColumn("tag", F.when(F.col("kind") == "ref", F.col("tag")).otherwise("")), role).withColumn("tag", F.col("__tag"))
    name = F.when(F.col("kind") == "keydef", F.coalesce(F.when(F.col("attrs")["keys"] != "", F.col("attrs")["keys"]), F.lit("(keydef)"))).when(F.col("kind") == "structural", F.col("tag")).otherwise(outline_name())
    detail = F.when(F.col("kind") == "ref", F.coalesce("role", "tag")).when(F.col("kind") != "structural", F.col("tag"))
    return o.select(F.col("root_map").alias("doc"), "pre", "pos", "depth", "parent_pre", name.alias("name"), detail.alias("detail"), "kind", "line", "end_line")


def visible_nodes(expanded: DataFrame) -> DataFrame:
    """Expanded nodes that the explorer shows, with parent_key (the nearest shown ancestor's order_key; null at the top).

    Groups are flattened; an element under anything else that is not shown is not shown either.
    """
    shown = F.forall(F.slice("path", F.lit(2), F.size("path")), lambda b: b.isin(*SHOWN_TYPES, "map/topicgroup"))
    v = expanded.where(F.col("base").isin(*SHOWN_TYPES) & shown)
    up = F.array_max(F.transform(F.sequence(F.lit(1), F.greatest(F.size("path") - 1, F.lit(1))), lambda k: F.when((k < F.size("path")) & F.get("path", k).isin(*SHOWN_TYPES), k)))
    return v.withColumn("parent_key", F.when(up.isNotNull(), F.slice("order_key", F.lit(1), up)))


def explorer_depth(path="path") -> Column:
    """Every element deepens but groups and containers: the explorer's levels."""
    return F.size(F.filter(F.slice(path, F.lit(2), F.size(path)), lambda b: ~b.isin("map/topicgroup", "map/bookmap-structural")))


def tree_roles(expanded: DataFrame, role: Callable[[Column, Column], Column] = plain_role) -> DataFrame:
    """(root_map, order_key, role) of divisions, numbered over the whole tree by the explorer's levels."""
    transparent = F.coalesce(F.col("base").isin("map/topicgroup", "map/bookmap-structural"), F.lit(False))
    depth = explorer_depth() - F.when(transparent, 1).otherwise(0)
    e = ranked(expanded.select("root_map", "order_key", F.greatest(depth, F.lit(0)).alias("depth"), "tag"), "root_map", "order_key")
    return number_divisions(e, role).where("role IS NOT NULL").select("root_map", "order_key", "role")


def explorer_rows(expanded: DataFrame, nodes: DataFrame, paths: DataFrame, keys: DataFrame | None = None, role: Callable[[Column, Column], Column] = plain_role) -> DataFrame:
    """(root_map, order_key, parent_key, label, description, icon, opens): the rows of the map explorer. ``paths`` (path) are
    the files that exist; opens is the file that a click opens."""
    roles = tree_roles(expanded, role)
    v = _named(visible_nodes(expanded), display_names(nodes, keys)).join(big(roles), ["root_map", "order_key"], "left")
    box, a = F.col("base") == "map/bookmap-structural", F.col("attrs")
    label = F.when(box, F.col("tag")).otherwise(shown_name())
    about = F.coalesce("role", F.when(F.col("base") == "map/keydef", a["keys"]).otherwise(a["href"]))
    icon = F.when(F.col("base") == "map/keydef", "key").when(box | (F.col("base") == "map/topichead"), "folder").when(F.col("role").isNotNull(), "book").otherwise("file")
    local = (a["href"] != "") & ~a["href"].rlike("(?i)^[a-z][a-z0-9+.-]*:") & ~F.coalesce(a["scope"] == "external", F.lit(False))
    v = v.withColumn("target", F.when(local, T.resolve(T.dirname("root_map"), a["href"])))
    there = big(paths.select(F.col("path").alias("target"), F.col("path").alias("opens")).distinct())
    opened = v.where("target IS NOT NULL").select("root_map", "order_key", "target").join(there, "target").select("root_map", "order_key", "opens")
    return v.join(big(opened), ["root_map", "order_key"], "left").select("root_map", "order_key", "parent_key", label.alias("label"), F.when(about != "", about).alias("description"), icon.alias("icon"), "opens")


def map_titles(nodes: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """(doc, title, subtitles, paged): the main title of each map that has one, its other inner titles that are not blank, and
    whether it has inner titles at all.

    Of the first title's inner titles mainbooktitle wins, then the first; without inner titles it is the title itself.
    """
    t = nodes.where("base = 'map/map-title' AND type = 'element'").select("doc", "pre", "parent", "depth", "path", "tag").join(big(keyed_text(nodes, keys, ("map/map-title",))), ["doc", "pre"])
    outer = t.where("depth = 1").groupBy("doc").agg(F.min_by(F.struct("pre", "own"), "pre").alias("o"))
    inner = t.where("element_at(path, -1) = 'map/map-title'").select("doc", F.col("parent").alias("up"), "pre", "own", "tag")
    j = outer.select("doc", F.col("o.pre").alias("up"), F.col("o.own").alias("whole")).join(big(inner), ["doc", "up"], "left")
    best = j.groupBy("doc", "whole").agg(F.min_by(F.struct("pre", "own"), F.struct(F.col("tag") != "mainbooktitle", "pre")).alias("b"), F.sort_array(F.collect_list(F.struct("pre", "own"))).alias("all"))
    others = F.filter(F.transform(F.filter("all", lambda x: x["pre"] != F.col("b.pre")), lambda x: T.js_trim(x["own"])), lambda x: x != "")
    title = T.js_trim(F.coalesce("b.own", "whole"))
    return best.select("doc", F.when(title != "", title).alias("title"), F.coalesce(others, F.array().cast("array<string>")).alias("subtitles"), F.col("b.pre").isNotNull().alias("paged"))


# ---------------------------------------------------------------- pages and related topics


def nav_manifest(entries: DataFrame) -> DataFrame:
    """(root_map, pos, file, title): pages of entries whose href ends in .dita, in order. The manifest of a published map takes its
    own entries (``own_elements``), not those of maps that it refers to."""
    return entries.where(F.lower("href").endswith(".dita")).select("root_map", "pos", F.concat(T.stem("href"), F.lit(".html")).alias("file"), F.col("display_name").alias("title"))


def prev_next(manifest: DataFrame) -> DataFrame:
    """manifest with the files before and after each page."""
    return neighbours(manifest, "root_map", "pos", "file")


def reltable_cells(nodes: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """(doc, rel, row, col, header, hrefs): cells of relationship tables with their references in order; header is the title of
    the column (its navtitle, else its text) from the table's header row."""
    at = lambda base: nodes.where(F.col("base") == base).where("type = 'element'")
    w = Window.partitionBy("doc", "parent").orderBy("pre")
    cells = at("map/relcell").select("doc", F.col("pre").alias("cell"), F.col("parent").alias("row"), F.get("anc", F.size("anc") - 2).alias("rel"), F.row_number().over(w).alias("col"))
    spec = at("map/relcolspec").join(big(keyed_text(nodes, keys, ("map/relcolspec",))), ["doc", "pre"])
    title = F.coalesce(F.when(F.col("attrs")["navtitle"] != "", F.col("attrs")["navtitle"]), T.js_trim("own"))
    spec = spec.select("doc", F.get("anc", F.size("anc") - 2).alias("rel"), F.row_number().over(w).alias("col"), title.alias("header"))
    refs = nodes.where(F.col("base").isin(*ENTRY_TYPES) & F.array_contains("path", "map/relcell")).select("doc", F.get("anc", (F.array_position("path", "map/relcell") - 1).cast("int")).alias("cell"), "pre", F.col("attrs")["href"].alias("href"))
    hrefs = refs.where("href <> ''").groupBy("doc", "cell").agg(F.transform(F.sort_array(F.collect_list(F.struct("pre", "href"))), lambda x: x["href"]).alias("hrefs"))
    out = cells.join(big(spec), ["doc", "rel", "col"], "left").join(big(hrefs), ["doc", "cell"], "left")
    return out.select("doc", "rel", "row", "col", "header", F.coalesce("hrefs", F.array().cast("array<string>")).alias("hrefs"))


def reltable_pairs(nodes: DataFrame) -> DataFrame:
    """(doc, row, col_a, col_b, href_a, href_b): related topics in different cells of one row of a relationship table."""
    r = reltable_cells(nodes).select("doc", "row", "col", F.explode("hrefs").alias("href"))
    a, b = (r.select("doc", "row", F.col("col").alias(f"col_{x}"), F.col("href").alias(f"href_{x}")) for x in "ab")
    return a.join(big(b), ["doc", "row"]).where("col_a < col_b")
