"""Operators inside documents: texts, titles, links, transclusion, outlines, tables, HTML. Joins and windows on nodes.

Elements are known by their base type, so specialised tags count as what they specialise. ``path`` (base types of the
ancestors) answers most questions about surroundings without a join; sides that were exploded are joined by sort and merge.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shred import own_types
from ..sources.store import SMALL, big, bytes_of, dealt, met, shared_dir, written
from .site import data_uris

#: Tags that are topics whatever their base type; base types that render to nothing; whose content is not shown;
#: that deepen headings; that end the header state of a table, or begin it.
TOPICS = ("topic", "concept", "task", "reference", "glossentry", "glossgroup", "troubleshooting")
SILENT = tuple(
    "topic/prolog topic/keywords topic/metadata topic/publisher topic/indexterm topic/indextermref topic/index-see topic/index-see-also topic/index-sort-as topic/index-base "
    "topic/colspec topic/param topic/hazardsymbol topic/anchorkey topic/anchorref map/relcolspec map/topicmeta map/linktext map/navtitle map/shortdesc map/keywords map/keyword map/anchor map/navref".split()
)
LEAVES = ("topic/image", "topic/anchor", "topic/anchorid")
CONTAINERS = ("topic/section", "topic/example", "topic/fig", "topic/related-links")
HEADS, BODIES = ("topic/thead", "topic/sthead"), ("topic/tbody", "topic/strow")

#: Columns of the node table that operators read, for ``shred`` and ``stored_nodes`` where the uses are known: texts, titles and link
#: titles; outlines; column specifications; cells of tables (with the texts of entries, and only ``TABLE_TYPES``); positions; HTML without source
#: ranges.
TITLES = ("pre", "post", "parent", "depth", "type", "base", "path", "attrs", "text")
OUTLINE = (*TITLES, "anc", "tag", "line", "end_line")
COLSPECS = ("pre", "parent", "base", "attrs")
CELLS, TABLE_TYPES = ("pre", "parent", "anc", "base", "attrs"), ("topic/entry", "topic/colspec")
POSITIONS = ("pre", "type", "tag", "line", "col", "end_line", "end_col")
DRAWN = (*TITLES, "ord", "tag", "error")
#: The same for nodes whose titles carry their texts.
PAGES = tuple(c for c in DRAWN if c != "post")
#: With the texts that elements carry (``own`` of ``shred``): titles and links; cells of simple tables.
LINKS, SIMPLE = ("pre", "parent", "depth", "type", "base", "attrs"), ("pre", "parent", "anc", "path", "base")


def _has(path, types: tuple[str, ...]) -> Column:
    # Not arrays_overlap, which fills a hash set for each row.
    return F.array_contains(path, types[0]) if len(types) == 1 else F.exists(path, lambda b: b.isin(*types))


def _is(types: tuple[str, ...]) -> Column:
    return F.coalesce(F.col("base").isin(*types), F.lit(False))


def is_topic() -> Column:
    return _is(("topic/topic",)) | F.coalesce(F.col("tag").isin(*TOPICS), F.lit(False))


def suppress(nodes: DataFrame, types: tuple[str, ...] = SILENT) -> DataFrame:
    """nodes without the subtrees that render to nothing. Texts that elements carry hold those of such subtrees, so they go."""
    if "own" in nodes.columns:
        if "text" not in nodes.columns:
            raise ValueError("nodes that carry texts only cannot be suppressed")
        nodes = nodes.drop("own")
    return nodes.where(~_is(types) & ~_has("path", types)) if types else nodes


def text_slices(rows: DataFrame) -> DataFrame:
    """(doc, pre, own) of rows (doc, e: struct pre, post; t: struct pre, text): for each e the texts of the document from pre to post, in
    order; '' without any.

    One group per document: its texts are sorted once, and an element takes the slice between two places that binary search
    finds, so each text is copied only into what is wanted around it.
    """
    one = rows.groupBy("doc").agg(F.collect_list("e").alias("es"), F.sort_array(F.collect_list("t")).alias("ts"))
    one = one.select("doc", "es", F.transform("ts", lambda t: t["pre"]).alias("at"), F.transform("ts", lambda t: t["text"]).alias("texts"))
    first, after = (lambda e, k=k: T.lower_bound("at", e[k]) for k in ("pre", "post"))
    own = F.transform("es", lambda e: F.struct(e["pre"].alias("pre"), F.array_join(F.slice("texts", first(e) + 1, after(e) - first(e)), "").alias("own")))
    return one.select("doc", F.inline(own)).select("doc", "pre", "own")


def text_rows(wanted, text) -> tuple[Column, Column]:
    """Columns e and t of ``text_slices`` from nodes: elements that are wanted, and texts."""
    is_text = F.col("type") == "text"
    return F.when((F.col("type") == "element") & wanted, F.struct("pre", "post")).alias("e"), F.when(is_text & text, F.struct("pre", "text")).alias("t")


def element_text(nodes: DataFrame, types: tuple[str, ...] | None = None) -> DataFrame:
    """(doc, pre, own): the text below each element (of these base types), in order; '' where there is none. Nodes that carry it
    (``own`` of ``shred``) are only read."""
    if types and own_types(nodes).issuperset(types):
        return nodes.where(_is(types)).select("doc", "pre", "own")
    wanted, text = (_is(types), _has("path", types)) if types else (F.lit(True), F.lit(True))
    return text_slices(nodes.select("doc", *text_rows(wanted, text)).where("e IS NOT NULL OR t IS NOT NULL"))


def with_own(nodes: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """The elements of these base types with ``own``, the text below each."""
    e = nodes.where(_is(types))
    return e if own_types(nodes).issuperset(types) else e.drop("own").join(big(element_text(nodes, types)), ["doc", "pre"])


def titles(nodes: DataFrame) -> DataFrame:
    """(doc, pre, id, title) of every element with a title child; the first title child counts."""
    if "topic/title" in own_types(nodes):
        return _titled(nodes).where("title IS NOT NULL").select("doc", "pre", "id", "title")
    t = nodes.where(_is(("topic/title",))).select("doc", "pre", "parent").join(big(element_text(nodes, ("topic/title",))), ["doc", "pre"])
    t = t.groupBy("doc", F.col("parent").alias("pre")).agg(F.min_by("own", "pre").alias("title"))
    return nodes.where("type = 'element'").select("doc", "pre", F.col("attrs")["id"].alias("id")).join(big(t), ["doc", "pre"])


def _titled(nodes: DataFrame) -> DataFrame:
    """(doc, pre, id, root, title) of every element that has an id or a title child, or is a root; title is null without a title child. For
    nodes that carry the texts of titles: elements and their titles meet in one group, so nothing is joined."""
    a = F.col("attrs")["id"]
    held = F.when((F.coalesce(a, F.lit("")) != "") | (F.col("depth") == 0), F.struct(F.col("pre").alias("at"), a.alias("id"), (F.col("depth") == 0).alias("root"), F.lit(None).cast("struct<pre:int,own:string>").alias("t")))
    title = F.when(_is(("topic/title",)) & F.col("parent").isNotNull(), F.struct(F.col("parent").alias("at"), F.lit(None).cast("string").alias("id"), F.lit(False).alias("root"), F.struct("pre", "own").alias("t")))
    rows = nodes.where(F.expr("type = 'element'") & ((F.coalesce(a, F.lit("")) != "") | (F.col("depth") == 0) | _is(("topic/title",)))).select("doc", F.inline(F.filter(F.array(held, title), lambda x: x.isNotNull())))
    return rows.groupBy("doc", F.col("at").alias("pre")).agg(F.max("id").alias("id"), F.max("root").alias("root"), F.min("t")["own"].alias("title"))


def title_map(nodes: DataFrame) -> DataFrame:
    """(doc, id, title): of several titled elements with one id the last counts."""
    return titles(nodes).where("id <> ''").groupBy("doc", "id").agg(F.max_by("title", "pre").alias("title"))


def root_titles(nodes: DataFrame) -> DataFrame:
    """(doc, title) of root elements."""
    if "topic/title" in own_types(nodes):
        # The root's title is a child of it: no other element is needed.
        t = nodes.where(_is(("topic/title",)) & (F.col("depth") == 1)).groupBy("doc").agg(F.min(F.struct("pre", "own"))["own"].alias("title"))
        return t
    return titles(nodes).join(big(nodes.where("depth = 0").select("doc", "pre")), ["doc", "pre"]).select("doc", "title")


def note_locales(nodes: DataFrame) -> DataFrame:
    """(doc, locale): zh where the root's language begins so, else en."""
    lang = F.coalesce(F.col("attrs")["xml:lang"], F.col("attrs")["http://www.w3.org/XML/1998/namespace lang"], F.lit(""))
    return nodes.where("depth = 0 AND error IS NULL").select("doc", F.when(lang.startswith("zh"), "zh").otherwise("en").alias("locale"))


def target_titles(nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Titles that links show: (doc, tid, title) inside a file by the last element with the id; (target, tid, by_id) from other
    files by the first one, which may have no title; (target, root_title)."""
    if "topic/title" in own_types(nodes):
        named = _titled(nodes).where("id <> ''").groupBy("doc", F.col("id").alias("tid"))
        named = named.agg(F.max_by("title", F.when(F.col("title").isNotNull(), F.col("pre"))).alias("here"), F.min(F.struct("pre", "title"))["title"].alias("by_id"))
        other = named.where("by_id IS NOT NULL").select(F.col("doc").alias("target"), "tid", "by_id")
        return named.where("here IS NOT NULL").select("doc", "tid", "here"), other, root_titles(nodes).select(F.col("doc").alias("target"), F.col("title").alias("root_title"))
    named = titles(nodes)
    local = title_map(nodes).select("doc", F.col("id").alias("tid"), F.col("title").alias("here"))
    first = nodes.where("type = 'element' AND attrs['id'] <> ''").groupBy("doc", F.col("attrs")["id"].alias("tid")).agg(F.min("pre").alias("pre"))
    other = first.join(big(named.select("doc", "pre", "title")), ["doc", "pre"]).select(F.col("doc").alias("target"), "tid", F.col("title").alias("by_id"))
    return local, other, root_titles(nodes).select(F.col("doc").alias("target"), F.col("title").alias("root_title"))


#: What a reference without content may show: a title in its own file, by an id in another, of another's root, or none.
LINK_KINDS = ("here", "id", "root", "none")


def _outside() -> Column:
    href = F.col("href")
    return F.coalesce(~href.startswith("#") & ~T.is_external("href", F.lit(None)) & (T.path_part("href") != ""), F.lit(False))


def link_kind() -> Column:
    """Which of ``LINK_KINDS`` the column href is. It is known without resolving paths, so filters by it are cheap."""
    href = F.col("href")
    kind = F.when(href.startswith("#"), "here").when(~_outside(), "none").when(href.contains("#"), "id").when(T.path_part("href").rlike(r"(?i)\.(dita|xml)$"), "root").otherwise("none")
    return F.coalesce(kind, F.lit("none"))


def with_link_titles(links: DataFrame, nodes: DataFrame, kinds: Collection[str] = LINK_KINDS) -> DataFrame:
    """links (doc, href, ...) with ``found``: the title that a reference without content shows, null if there is none.

    In the same file the last part of the fragment names the element, in another the first; without a fragment a .dita
    or .xml file gives its root title. ``kinds``: those that occur, where that is known; titles of others are not looked for.
    """
    local, other, roots = target_titles(nodes)
    here, frag = F.col("href").startswith("#"), T.fragment("href")
    x = links.withColumns({"__kind": link_kind(), "target": F.when(_outside(), T.resolve(T.dirname("doc"), "href")), "tid": F.when(here, F.substring_index(frag, "/", -1)).otherwise(F.split_part(frag, F.lit("/"), F.lit(1)))})
    # Each kind of link meets only the titles that it can have, so no join sees a null key.
    out = x.where("__kind = 'none'").withColumn("found", F.lit(None).cast("string"))
    for name, side, on, title in (("here", local, ["doc", "tid"], "here"), ("id", other, ["target", "tid"], "by_id"), ("root", roots, ["target"], "root_title")):
        if name in kinds:
            out = out.unionByName(x.where(F.col("__kind") == name).join(big(side), on, "left").withColumn("found", F.when(F.col(title) != "", F.col(title))).drop(title))
    return out.drop("__kind", "target", "tid")


def xref_titles(nodes: DataFrame) -> DataFrame:
    """(doc, pre, href, shown, kind): what each xref shows: its own text, else the target's title, else the href."""
    x = with_own(nodes, ("topic/xref",)).select("doc", "pre", F.col("attrs")["href"].alias("href"), "own")
    # Nodes that carry the texts are as cheap to read again as what is made of them.
    j = with_link_titles(x if own_types(nodes).issuperset(("topic/xref", "topic/title")) else written(nodes.sparkSession, x), nodes)
    shown = F.when(~T.is_blank("own"), F.col("own")).otherwise(F.coalesce("found", "href", F.lit("")))
    return j.select("doc", "pre", "href", shown.alias("shown"), F.when(F.col("found").isNotNull(), "title").otherwise("href").alias("kind"))


# ---------------------------------------------------------------- transclusion


def conref_targets(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """refs (doc, conref, ...) with target, target_pre, target_base, target_tag, target_attrs, target_ord, target_path of the element
    that a conref into another file names. The element id is looked up in the whole file and its first holder counts; a
    conref without a path never resolves."""
    names = ("pre", "base", "tag", "attrs", "ord", "path", *places_of(nodes))
    r = refs.withColumns({"target": T.resolve(T.dirname("doc"), "conref"), "tid": F.coalesce(T.element_id("conref"), T.topic_id("conref"))}).where("target IS NOT NULL AND tid <> ''")
    el = nodes.where("type = 'element' AND attrs['id'] <> ''")
    t = el.groupBy(F.col("doc").alias("target"), F.col("attrs")["id"].alias("tid")).agg(F.min_by(F.struct(*names), "pre").alias("t"))
    return r.join(big(t), ["target", "tid"]).select(*refs.columns, "target", *[F.col(f"t.{n}").alias(f"target_{n}") for n in names])


def conref_text(nodes: DataFrame) -> DataFrame:
    """(doc, pre, conref, shown, resolved): the text of the element that a conref names, or the literal one."""
    r = nodes.where("attrs['conref'] <> ''").select("doc", "pre", F.col("attrs")["conref"].alias("conref"))
    found = conref_targets(r, nodes).select("doc", "pre", "target", "target_pre")
    own = element_text(nodes)
    theirs = own.select(F.col("doc").alias("target"), F.col("pre").alias("target_pre"), F.col("own").alias("theirs"))
    got = found.join(big(theirs), ["target", "target_pre"]).select("doc", "pre", "theirs")
    out = r.join(big(own), ["doc", "pre"]).join(big(got), ["doc", "pre"], "left")
    return out.select("doc", "pre", "conref", F.coalesce("theirs", "own").alias("shown"), F.col("theirs").isNotNull().alias("resolved"))


#: Sibling numbers before and after all others.
_FIRST, _LAST = -1, (1 << 31) - 1
PLACES = ("line", "col", "end_line", "end_col")
VIEW = ("doc", "key", "path", "type", "tag", "base", "attrs", "text")


def places_of(nodes: DataFrame) -> list[str]:
    """The columns of source ranges that a node table has: all or none."""
    return [c for c in PLACES if c in nodes.columns]


def document_view(nodes: DataFrame) -> DataFrame:
    """nodes by key (the sibling numbers from the root down) instead of pre: what rendering works on. Without source ranges if nodes has
    none."""
    return nodes.where("error IS NULL").withColumnRenamed("ord", "key").select(*VIEW, *places_of(nodes))


def _prefixes(key: str = "key") -> Column:
    """The keys of all ancestors."""
    return F.when(F.size(key) > 0, F.transform(F.sequence(F.lit(0), F.size(key) - 1), lambda n: F.slice(key, F.lit(1), n))).otherwise(F.array().cast("array<array<int>>"))


def splice_conrefs(nodes: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """The view of documents (``docs``: doc; all without it) with conrefs replaced by what they name, however deeply nested.

    A target of the same base type gives its children; of another type it takes the element's place, with its own source
    range, the referencing element's attributes winning, without the target's id and conref. Conrefs inside spliced content are followed, seen
    from the document that shows it; one that was resolved above it is left alone with its literal content, as is one
    that names nothing. Rounds are written and end when nothing is left to follow.
    """
    spark, places = nodes.sparkSession, places_of(nodes)
    view_columns = (*VIEW, *places)
    folder, view = shared_dir(spark), document_view(nodes)
    if docs is not None:
        view = view.join(big(docs.select("doc").distinct()), "doc", "left_semi")
    if not view.agg(F.max(F.expr("type = 'element' AND attrs['conref'] <> ''"))).head()[0]:
        return view
    open_refs = lambda v: v.where("type = 'element' AND attrs['conref'] <> ''")
    last = open_refs(view).withColumn("chain", F.array().cast("array<string>"))
    swaps, added, k = None, None, 0
    while True:
        refs = last.withColumn("conref", F.col("attrs")["conref"]).where(~F.array_contains("chain", F.col("conref")))
        refs = written(spark, refs.select("doc", "key", "path", "base", "tag", "attrs", "chain", "conref", *places), f"{folder}/open{k}")
        # Only the documents that are named are looked into.
        asked = met(spark, refs.select(T.resolve(T.dirname("doc"), "conref").alias("doc")).where("doc IS NOT NULL").distinct())
        named = written(spark, nodes.where("error IS NULL").join(asked, "doc", "left_semi"), f"{folder}/named{k}")
        got = conref_targets(refs, named).withColumn("chain", F.concat("chain", F.array("conref")))
        # A reference in the literal content of one that is followed goes with that content.
        over = F.max(F.concat("key", F.array(F.lit(_LAST)))).over(Window.partitionBy("doc").orderBy("key").rowsBetween(Window.unboundedPreceding, -1))
        got = written(spark, got.withColumn("__over", over).where(~F.coalesce(F.col("__over") > F.col("key"), F.lit(False))).drop("__over"), f"{folder}/found{k}")
        if got.isEmpty():
            break
        subtree = named.select(F.col("doc").alias("target"), F.explode(_prefixes("ord")).alias("target_ord"), "ord", F.col("path").alias("npath"), *[F.col(c).alias(f"n_{c}") for c in view_columns[3:]])
        same = F.coalesce(F.col("target_base") == F.col("base"), F.lit(False))
        rest = F.map_filter("attrs", lambda name, _: name != "conref")
        theirs = F.map_filter("target_attrs", lambda name, _: ~name.isin("conref", "id") & ~F.map_contains_key(rest, name))
        swap = got.select("doc", "key", F.struct(F.when(same, F.col("tag")).otherwise(F.col("target_tag")).alias("tag"), F.when(same, F.col("base")).otherwise(F.col("target_base")).alias("base"), F.when(same, rest).otherwise(F.map_concat(rest, theirs)).alias("attrs"), *[F.when(same, F.col(n)).otherwise(F.col(f"target_{n}")).alias(n) for n in places]).alias("swap"))
        base = F.when(same, F.col("base")).otherwise(F.col("target_base"))
        depth = F.size("target_ord")
        inner = got.select("doc", "key", "path", base.alias("b"), "chain", "target", "target_ord", depth.alias("d")).join(big(subtree), ["target", "target_ord"])
        new = inner.select(
            "doc", F.concat("key", F.slice("ord", F.col("d") + 1, F.size("ord"))).alias("key"), F.concat("path", F.array(F.coalesce("b", F.lit(""))), F.slice("npath", F.col("d") + 2, F.size("npath"))).alias("path"),
            *[F.col(f"n_{c}").alias(c) for c in view_columns[3:]], "chain", F.lit(k).alias("round"),
        )
        new = dealt(spark, new)
        swap = swap.withColumn("round", F.lit(k - 1))  # replaces an element that the round before brought
        swaps, added = (swap, new) if swaps is None else (swaps.unionByName(swap), added.unionByName(new))
        last, k = open_refs(new).select(*view_columns, "chain"), k + 1
    if swaps is None:
        return view
    swaps = dealt(spark, swaps)
    all_nodes = view.withColumn("round", F.lit(-1)).unionByName(added.select(*view_columns, "round")).join(big(swaps), ["doc", "round", "key"], "left")
    # The literal content of a replaced element goes: nodes of the same round below it, which follow it in document order.
    cut = F.max(F.when(F.col("swap").isNotNull(), F.concat("key", F.array(F.lit(_LAST))))).over(Window.partitionBy("doc", "round").orderBy("key").rowsBetween(Window.unboundedPreceding, -1))
    out = all_nodes.withColumn("__cut", cut).where(~F.coalesce(F.col("__cut") > F.col("key"), F.lit(False)))
    pick = lambda c: F.when(F.col("swap").isNotNull(), F.col(f"swap.{c}")).otherwise(F.col(c)).alias(c)
    # The join has dealt the rows by document, as ``swaps`` is.
    return dealt(spark, out.select(*[pick(c) if c in ("tag", "base", "attrs", *places) else F.col(c) for c in view_columns]), placed=True)


# ---------------------------------------------------------------- outline


def topic_outline(nodes: DataFrame) -> DataFrame:
    """outline(doc, pre, parent_pre, depth, name, detail, kind, line, end_line): topics, sections and examples, nested by containment."""
    kind = F.when(is_topic(), "topic").when(_is(("topic/section", "topic/example")), "section")
    kept = nodes.where("type = 'element'").withColumn("kind", kind).where("kind IS NOT NULL").select("doc", "pre", "anc", "tag", "base", "kind", "line", "end_line", F.col("attrs")["id"].alias("id"))
    ups = kept.select("doc", F.col("pre").alias("up"))
    above = kept.select("doc", "pre", F.explode("anc").alias("up")).join(big(ups), ["doc", "up"]).groupBy("doc", "pre").agg(F.max("up").alias("parent_pre"), F.count("*").cast("int").alias("depth"))
    name = titles(nodes).select("doc", "pre", T.js_trim("title").alias("title"))
    o = kept.join(big(above), ["doc", "pre"], "left").join(big(name), ["doc", "pre"], "left")
    plain = F.when(F.col("kind") == "topic", "(topic)").when(F.col("base") == "topic/example", "(example)").otherwise("(section)")
    shown = F.coalesce(F.when(F.col("title") != "", F.col("title")), F.when((F.col("kind") == "topic") & (F.col("id") != ""), F.col("id")), plain)
    return o.select("doc", "pre", "parent_pre", F.coalesce("depth", F.lit(0)).alias("depth"), shown.alias("name"), F.col("tag").alias("detail"), "kind", "line", "end_line")


# ---------------------------------------------------------------- tables


def cals_columns(nodes: DataFrame) -> DataFrame:
    """(doc, tgroup, colname, col, width): column numbers and their width as CSS."""
    c = nodes.where(_is(("topic/colspec",))).select("doc", F.col("parent").alias("tgroup"), "pre", "attrs")
    w = Window.partitionBy("doc", "tgroup")
    col = F.coalesce(F.col("attrs")["colnum"].try_cast("int"), F.row_number().over(w.orderBy("pre")))
    text = T.js_trim(F.col("attrs")["colwidth"])
    part = F.when(text == "*", F.lit(1.0)).otherwise(F.regexp_extract(text, r"^([0-9.]+)\*$", 1).try_cast("double"))
    return c.withColumns({"col": col, "total": F.sum(part).over(w)}).select("doc", "tgroup", "pre", F.col("attrs")["colname"].alias("colname"), "col", T.cals_width(F.col("attrs")["colwidth"], "total").alias("width"))


def in_header(path: str = "path") -> Column:
    """Whether the nearest head or body around a cell is a head."""
    marks = F.filter(path, lambda b: b.isin(*HEADS, *BODIES))
    return F.coalesce(F.get(marks, F.size(marks) - 1).isin(*HEADS), F.lit(False))


def cell_rows(nodes: DataFrame) -> DataFrame:
    """What ``cals_cells`` looks at, in plain columns: cells with their text and place, and column specifications. Nodes that carry the texts
    of entries are only read, so this is cheap to store in their place. Without ``path`` section and header are left out."""
    a, spec, n = F.col("attrs"), F.col("base") == "topic/colspec", F.size("anc")
    e = nodes.where(_is(TABLE_TYPES))
    if not own_types(nodes).issuperset(("topic/entry",)):
        e = e.drop("own").join(big(element_text(nodes, ("topic/entry",))), ["doc", "pre"], "left")
    tgroup = F.when(spec, F.col("parent")).otherwise(F.get("anc", n - 3))
    names = [F.when(F.col("base") == ("topic/colspec" if name == "colnum" else "topic/entry"), a[name]).alias(name) for name in ("colnum", "namest", "nameend", "morerows")]
    cell = lambda c, name: F.when(~spec, c).alias(name)
    around = [cell(F.substring(F.get("path", n - 2), 7, 20), "section"), cell(in_header(), "header")] if "path" in nodes.columns else []
    return e.select("doc", "pre", (~spec).alias("entry"), tgroup.alias("tgroup"), cell(F.col("parent"), "row_pre"), *around, a["colname"].alias("colname"), *names, cell(F.col("own"), "own"))


def cals_cells(nodes: DataFrame) -> DataFrame:
    """table_cells(doc, tgroup, row, cell, section, header, col, colspan, rowspan, text): entries with their spans. ``nodes``: the node table, or
    ``cell_rows`` of it; section and header are there if these were made with ``path``.

    One sort: column specifications come first in their group, and its cells see them all; rows and cells are counted as they follow.
    """
    e = nodes if "tgroup" in nodes.columns else cell_rows(nodes)
    e = e.withColumn("cell", F.row_number().over(Window.partitionBy("doc", "tgroup", "entry", "row_pre").orderBy("pre")))
    # A row's first cell begins it; the specifications are one such row, and their count is their number.
    e = e.withColumn("row", F.count_if(F.col("cell") == 1).over(Window.partitionBy("doc", "tgroup", "entry").orderBy("row_pre", "pre").rowsBetween(Window.unboundedPreceding, 0)))
    number = F.coalesce(F.col("colnum").try_cast("int"), "cell")
    specs = F.collect_list(F.when(~F.col("entry") & (F.col("colname") != ""), F.struct("colname", number.alias("col"))))
    e = e.withColumn("specs", specs.over(Window.partitionBy("doc", "tgroup").orderBy("entry", "row_pre", "pre").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    # Of several columns with one name the last counts; what is in no group has no columns.
    e = e.where("entry").withColumn("specs", F.when(F.col("tgroup").isNotNull(), F.reverse("specs")))
    at = lambda name: F.get(F.col("specs")["col"], (F.array_position(F.col("specs")["colname"], F.col(name)) - 1).cast("int"))
    return e.select("doc", "tgroup", F.col("row").cast("int").alias("row"), "cell", *(c for c in ("section", "header") if c in e.columns), F.coalesce(at("namest"), at("colname"), "cell").alias("col"), F.coalesce(F.greatest(at("nameend") - at("namest") + 1, F.lit(1)), F.lit(1)).alias("colspan"), (F.coalesce(F.col("morerows").try_cast("int"), F.lit(0)) + 1).alias("rowspan"), F.col("own").alias("text"))


def simple_cells(nodes: DataFrame) -> DataFrame:
    """The same columns for simple, choice and property tables; every cell spans one column and one row. tgroup is the table."""
    e = with_own(nodes, ("topic/stentry",)).select("doc", "pre", F.col("parent").alias("row_pre"), F.get("anc", F.size("anc") - 2).alias("tgroup"), F.substring(F.element_at("path", -1), 7, 20).alias("section"), in_header().alias("header"), "own")
    e = e.withColumn("cell", F.row_number().over(Window.partitionBy("doc", "row_pre").orderBy("pre")))
    row = F.dense_rank().over(Window.partitionBy("doc", "tgroup").orderBy("row_pre"))
    return e.select("doc", "tgroup", row.alias("row"), "cell", "section", "header", F.col("cell").alias("col"), F.lit(1).alias("colspan"), F.lit(1).alias("rowspan"), F.col("own").alias("text"))


# ---------------------------------------------------------------- HTML

#: Base types that become an element with a class of their own name.
BY_CLASS = {
    "span": "keyword term uicontrol wintitle menucascade filepath userinput systemoutput apiname option parmname cmdname varname msgnum coderef synph kwd var oper sep delim fragment fragref synnoteref msgph tm desc alt glossref typeofhazard overline",
    "div": "itemgroup dlentry synnote syntaxdiagram figgroup plentry glossgroup hazardstatement", "pre": "synblk screen msgblock lines", "p": "shortdesc howtoavoid consequence",
    "dl": "parml glossentry", "dt": "pt", "dd": "pd glossdef", "code": "codeph", "dfn": "glossterm", "main": "body",
}
#: Base types that become a plain element.
PLAIN = {
    "p": "p", "ul": "ul", "ol": "ol", "li": "li", "sli": "li", "dl": "dl", "dt": "dt", "dd": "dd", "thead": "thead", "tbody": "tbody", "row": "tr", "sthead": "thead", "strow": "tr",
    "b": "strong", "i": "em", "u": "u", "tt": "code", "sup": "sup", "sub": "sub", "line-through": "s", "q": "q", "lq": "blockquote", "cite": "cite",
}
#: Base types whose opening and closing differ from both rules.
OTHER = {
    "sl": ('<ul class="simple-list">', "</ul>"), "pre": ('<pre class="preformatted">', "</pre>"), "div": ('<div class="body-div">', "</div>"), "bodydiv": ('<div class="body-div">', "</div>"),
    "sectiondiv": ('<div class="section-div">', "</div>"), "related-links": ('<aside class="related-links"><h2>Related links</h2>', "</aside>"), "object": ('<object class="dita-object">', "</object>"),
}
#: Base types with rules of their own in ``topic_html``.
SPECIAL = "topic title section example fig note table simpletable tgroup entry stentry image codeblock xref link ph fn boolean abbreviated-form anchor anchorid colspec".split()
#: Labels of notes by locale.
NOTE_LABELS = {
    "en": {"note": "Note", "notice": "Notice", "warning": "Warning", "danger": "Danger", "important": "Important", "tip": "Tip", "restriction": "Restriction"},
    "zh": {"note": "注", "notice": "注意", "warning": "警告", "danger": "危险", "important": "重要", "tip": "提示", "restriction": "限制"},
}


def html_templates() -> dict[str, tuple[str, str]]:
    """Base type -> (opening, closing) of those that need nothing but their type. Users add rows of their own."""
    out = {f"topic/{n}": (f'<{tag} class="{n}">', f"</{tag}>") for tag, names in BY_CLASS.items() for n in names.split()}
    return out | {f"topic/{n}": (f"<{tag}>", f"</{tag}>") for n, tag in PLAIN.items()} | {f"topic/{n}": pair for n, pair in OTHER.items()}


def note_label(kind: Column, locale: Column) -> Column:
    """The label of a note type; an unknown type is its own label."""
    table = F.create_map(*[F.lit(x) for lang, labels in NOTE_LABELS.items() for k, v in labels.items() for x in (f"{lang}/{k}", v)])
    return F.coalesce(F.try_element_at(table, F.concat(locale, F.lit("/"), kind)), kind)


def _bases_of(rows: DataFrame, types: Collection[str]) -> set[str]:
    """Which of these base types occur: one row for each comes back, at most."""
    return {r.base for r in rows.where(F.col("base").isin(*types)).select("base").distinct().collect()}


def _with_values(v: DataFrame, keys: DataFrame) -> DataFrame:
    """v with ``__value``, the value of the key that ``__keyref`` names. Few keys meet all nodes, many only the elements that name one."""
    spark = v.sparkSession
    path = shared_dir(spark)
    values = written(spark, keys.select("scope_dir", F.col("key").alias("__keyref"), F.col("value").alias("__value")), path)
    scoped = v.withColumn("scope_dir", F.when(F.col("__keyref").isNotNull(), T.dirname("doc")))
    if bytes_of(spark, path) <= SMALL:
        return scoped.join(F.broadcast(values), ["scope_dir", "__keyref"], "left").drop("scope_dir")
    named = scoped.where("__keyref IS NOT NULL").select("doc", "key", "scope_dir", "__keyref").join(big(values), ["scope_dir", "__keyref"]).select("doc", "key", "__value")
    return v.join(big(named), ["doc", "key"], "left")


def _column_groups(specs: DataFrame) -> DataFrame:
    """(doc, key, __cols, __colgroup): column numbers by name, and the drawn columns, of the elements that hold column specifications."""
    a = F.col("attrs")
    specs = specs.where(F.col("base") == "topic/colspec").select("doc", F.slice("key", F.lit(1), F.size("key") - 1).alias("group"), "key", "attrs")
    w = Window.partitionBy("doc", "group")
    width = T.js_trim(a["colwidth"])
    part = F.when(width == "*", F.lit(1.0)).otherwise(F.regexp_extract(width, r"^([0-9.]+)\*$", 1).try_cast("double"))
    specs = specs.withColumns({"n": F.coalesce(a["colnum"].try_cast("int"), F.row_number().over(w.orderBy("key"))), "css": T.cals_width(a["colwidth"], F.sum(part).over(w))})
    draw_col = F.when(F.col("css") != "", F.concat(F.lit('<col style="width: '), T.escape_attr("css"), F.lit('">'))).otherwise("<col>")
    groups = specs.groupBy("doc", "group").agg(F.sort_array(F.collect_list(F.struct("key", F.col("attrs")["colname"].alias("name"), "n", draw_col.alias("html")))).alias("specs"))
    numbers = F.aggregate("specs", F.create_map().cast("map<string,int>"), lambda m, x: F.when(x["name"] != "", F.map_concat(F.map_filter(m, lambda k, _: k != x["name"]), F.create_map(x["name"], x["n"]))).otherwise(m))
    return groups.select("doc", F.col("group").alias("key"), numbers.alias("__cols"), F.concat(F.lit("<colgroup>"), F.array_join(F.col("specs")["html"], ""), F.lit("</colgroup>")).alias("__colgroup"))


def topic_html(
    nodes: DataFrame, keys: DataFrame | None = None, templates: dict[str, tuple[str, str]] | None = None, levels: DataFrame | int = 1,
    targets: DataFrame | None = None, positions: bool = False, view: DataFrame | None = None, image_uri=lambda href: href, images: DataFrame | None = None,
) -> DataFrame:
    """(doc, level, html) by event assembly: opening, closing and text events of a document in the order of their keys.

    Conrefs are spliced in, key references show their key's value (``keys``: scope_dir, key, value) where an element has no
    content, links without content show titles from ``targets`` (nodes; the same ones by default). ``levels`` is the level
    of headings, or a table (doc, level) of the levels a document is needed at. Elements without a template are
    transparent. ``positions`` adds tag and source range to each element's first tag. ``view`` replaces the nodes that are
    drawn (from ``splice_conrefs``). ``image_uri`` rewrites the hrefs of images; with ``images`` (path, content) they are put
    into the page as data URIs, '' where there is no such file.
    """
    templates = html_templates() if templates is None else templates
    a = F.col("attrs")
    shown = view if view is not None else splice_conrefs(nodes)
    # Rules for base types that do not occur are left out: most documents need few of them.
    has = _bases_of(shown, {*templates, *SILENT, *LEAVES, *CONTAINERS, *(f"topic/{n}" for n in SPECIAL)})
    v = suppress(shown, tuple(t for t in SILENT if t in has))
    # What single elements get from elsewhere comes by (doc, key), the order in which everything below looks at a document: one sort.
    v = v.withColumn("__keyref", F.when((F.col("type") == "element") & (a["keyref"] != ""), a["keyref"]))
    if keys is not None:
        v = _with_values(v, keys)
    else:
        v = v.withColumn("__value", F.lit(None).cast("string"))
    if "topic/fig" in has:
        # Of several titles of a figure only the first shows.
        fig_titles = v.where((F.col("base") == "topic/title") & (F.element_at("path", -1) == "topic/fig")).select("doc", "key")
        w = Window.partitionBy("doc", F.slice("key", F.lit(1), F.size("key") - 1)).orderBy("key")
        spare = fig_titles.withColumn("__spare", F.row_number().over(w) > 1).where("__spare")
        v = v.join(big(spare), ["doc", "key"], "left").withColumn("__spare", F.col("__spare").isNotNull())
    else:
        v = v.withColumn("__spare", F.lit(False))
    if images is not None:
        pictures = v.where((F.col("base") == "topic/image") & (a["href"] != "")).select("doc", "key", a["href"].alias("href"))
        v = v.join(big(data_uris(pictures, images).select("doc", "key", F.col("uri").alias("__uri"))), ["doc", "key"], "left")
    # Column numbers of table groups, by the key of the group.
    specs = view if view is not None else nodes.where("error IS NULL").withColumnRenamed("ord", "key")
    if _bases_of(specs, ("topic/colspec",)):
        v = v.join(big(_column_groups(specs)), ["doc", "key"], "left")
    else:
        v = v.withColumns({"__cols": F.lit(None).cast("map<string,int>"), "__colgroup": F.lit(None).cast("string")})

    # In document order the nodes below an element follow it: whether it holds anything, anything but blanks, and what is hidden are
    # seen from the rows after and before it.
    leaf = _is(tuple(t for t in LEAVES if t in has))
    short_form = F.lit(keys is not None) & _is(("topic/abbreviated-form",)) & (F.coalesce(a["keyref"], F.lit("")) != "")
    shut = leaf | short_form | _is(("topic/xref",)) & (F.coalesce(a["href"], F.lit("")) == "") | _is(("topic/boolean",)) & (F.coalesce(a["value"], F.lit("")) != "")
    solid = F.col("type").eqNullSafe("element") | ~T.is_blank("text")
    v = v.withColumns({"__deep": F.size("key"), "__solid": F.when(solid, F.size("key")), "__cut": F.when(shut | F.col("__spare"), F.concat("key", F.array(F.lit(_LAST))))})
    w = Window.partitionBy("doc").orderBy("key")
    v = v.withColumns({
        "__next": F.lead("__deep").over(w), "__after": F.expr("lead(__solid) IGNORE NULLS OVER (PARTITION BY doc ORDER BY key)"),
        "__until": F.max("__cut").over(w.rowsBetween(Window.unboundedPreceding, -1)),
    })
    # Only whole subtrees are gone, so what follows an element is below it if it is deeper.
    below = lambda c: F.coalesce(F.col(c) > F.col("__deep"), F.lit(False))
    v = v.where(~F.col("__spare") & ~F.coalesce(F.col("__until") > F.col("key"), F.lit(False)))
    v = v.withColumns({"__any": below("__next"), "__real": below("__after"), "__value": F.when(F.col("__value") != "", F.col("__value"))})
    by_key = ~F.col("__real") & F.col("__value").isNotNull() if keys is not None else F.lit(False)
    unresolved = F.coalesce((F.col("base") == "topic/ph") & (F.coalesce(a["keyref"], F.lit("")) != "") & ~F.col("__real") & ~by_key, F.lit(False)) if keys is not None else F.lit(False)
    # Blanks of an element that shows a key go; cells know the outermost table group around them, the last one that began.
    element, in_group = F.col("type") == "element", F.array_contains("path", "topic/tgroup")
    up = F.slice("key", F.lit(1), F.size("key") - 1)
    before, around = w.rowsBetween(Window.unboundedPreceding, -1), {}
    if keys is not None:
        around["__held"] = F.when(element & (by_key | unresolved), F.col("key"))
    if "topic/tgroup" in has:
        around["__outer"] = F.when(_is(("topic/tgroup",)) & ~in_group, F.struct("__cols"))
    if around:
        v = v.withColumns(around)
        v = v.withColumns({name: F.last(name, True).over(before) for name in around})
    if "__held" in around:
        v = v.where(element | ~F.coalesce(F.col("__held") == up, F.lit(False)))
    e = v
    if "__outer" in around:
        e = v.withColumns({"__cols": F.when(_is(("topic/entry",)) & in_group, F.col("__outer.__cols")), "__colgroup": F.when(_is(("topic/tgroup",)), F.col("__colgroup"))})
    if "topic/note" in has:
        e = e.join(big(note_locales(nodes)), "doc", "left")
    else:
        e = e.withColumn("locale", F.lit(None).cast("string"))
    e = e.join(big(levels.select("doc", "level").distinct()), "doc") if isinstance(levels, DataFrame) else e.withColumn("level", F.lit(levels))

    esc, attr = T.escape_attr, lambda name: T.safe_attr(name, a[name])
    base = F.col("base")
    of = lambda n: base == f"topic/{n}"
    heading = F.least(F.lit(6), F.greatest(F.lit(1), F.col("level") + F.size(F.filter("path", lambda b: b.isin(*CONTAINERS))))).cast("string")
    caption = of("title") & (F.get("path", F.size("path") - 1) == "topic/fig")
    href, cell = F.coalesce(a["href"], F.lit("")), F.when(in_header(), "th").otherwise("td")
    number = lambda name: F.try_element_at("__cols", a[name])
    colspan = F.coalesce(F.when(a["colspan"] != "", a["colspan"]), F.when((a["namest"] != "") & (a["nameend"] != ""), (number("nameend") - number("namest") + 1).cast("string")))
    rowspan = F.coalesce(F.when(a["rowspan"] != "", a["rowspan"]), (F.regexp_extract(a["morerows"], r"^\s*([+-]?\d+)", 1).try_cast("int") + 1).cast("string"))
    kind = F.coalesce(F.when(a["type"] != "", a["type"]), F.lit("note"))
    lang = F.regexp_replace(F.coalesce(a["outputclass"], F.lit("")), "^language-", "")
    local = F.when(href.contains("/"), F.concat(F.lit("#"), F.substring_index(href, "/", -1))).otherwise(href)
    link = F.coalesce(F.when(href != "", href), F.when((a["keyref"] != "") & ~by_key, a["keyref"]), F.lit(""))
    uri = F.when(href != "", image_uri(href)).otherwise("") if images is None else F.coalesce("__uri", F.lit(""))
    special = [  # (base type, condition, opening, closing)
        ("topic", of("topic"), F.concat(F.lit("<article"), attr("id"), F.lit(' class="topic">')), "</article>"),
        ("title", caption, F.lit("<figcaption>"), "</figcaption>"),
        ("title", of("title"), F.concat(F.lit("<h"), heading, F.lit(">")), F.concat(F.lit("</h"), heading, F.lit(">"))),
        ("section", of("section"), F.concat(F.lit("<section"), attr("id"), F.lit(">")), "</section>"),
        ("example", of("example"), F.concat(F.lit("<section"), attr("id"), F.lit(' class="example">')), "</section>"),
        ("fig", of("fig"), F.concat(F.lit("<figure"), attr("id"), F.lit(">")), "</figure>"),
        ("note", of("note"), F.concat(F.lit('<div class="note note--'), esc(kind), F.lit('"><span class="note__label">'), esc(note_label(kind, F.coalesce("locale", F.lit("en")))), F.lit(":</span> ")), "</div>"),
        ("table", of("table"), F.concat(F.lit("<table"), attr("id"), F.lit(' class="cals-table">')), "</table>"),
        ("simpletable", of("simpletable"), F.concat(F.lit("<table"), attr("id"), F.lit(' class="simple-table">')), "</table>"),
        ("tgroup", of("tgroup"), F.coalesce("__colgroup", F.lit("")), ""),
        ("entry", of("entry"), F.concat(F.lit("<"), cell, T.safe_attr("colspan", colspan), T.safe_attr("rowspan", rowspan), F.lit(">")), F.concat(F.lit("</"), cell, F.lit(">"))),
        ("stentry", of("stentry"), F.concat(F.lit("<"), cell, F.lit(">")), F.concat(F.lit("</"), cell, F.lit(">"))),
        ("image", of("image"), F.concat(F.lit('<img src="'), esc(uri), F.lit('"'), T.safe_attr("alt", F.coalesce(a["alt"], F.lit(""))), attr("width"), attr("height"), F.when(a["placement"] == "break", ' class="image-break"').otherwise(""), F.lit(' loading="lazy" data-dita-src="'), esc(href), F.lit('">')), ""),
        ("codeblock", of("codeblock"), F.concat(F.lit('<pre class="codeblock '), esc(F.coalesce(a["outputclass"], F.lit(""))), F.lit('"><code>')), F.concat(F.lit("</code>"), F.when(lang != "", F.concat(F.lit('<div class="codeblock-lang">'), esc(lang), F.lit("</div>"))).otherwise(""), F.lit("</pre>"))),
        ("xref", of("xref") & (href == ""), F.lit(""), ""),
        ("xref", of("xref") & href.startswith("#"), F.concat(F.lit('<a href="'), esc(local), F.lit('" class="xref">')), "</a>"),
        ("xref", of("xref"), F.lit('<span class="xref-external">→ '), "</span>"),
        ("link", of("link") & (link != ""), F.concat(F.lit('<a href="'), esc(link), F.lit('" class="link">')), "</a>"),
        ("ph", unresolved, F.concat(F.lit('<span class="ph unresolved-keyref" title="Unresolved key: '), esc(a["keyref"]), F.lit('">[' ), esc(a["keyref"]), F.lit("]")), "</span>"),
        ("ph", of("ph"), F.lit('<span class="ph">'), "</span>"),
        ("fn", of("fn"), F.concat(F.lit('<sup class="fn'), F.when(a["id"] != "", F.concat(F.lit(" fn-call-"), esc(a["id"]))).otherwise(""), F.lit('">')), "</sup>"),
        ("boolean", of("boolean"), F.concat(F.lit('<span class="boolean" data-value="'), esc(F.coalesce(a["value"], F.lit(""))), F.lit('">'), esc(F.coalesce(a["value"], F.lit("")))), "</span>"),
        ("abbreviated-form", short_form & ~by_key, F.concat(F.lit('<abbr class="abbreviated-form" title="'), esc(a["keyref"]), F.lit('">'), esc(F.coalesce("__value", a["keyref"]))), "</abbr>"),
        ("abbreviated-form", of("abbreviated-form"), F.lit('<abbr class="abbreviated-form">'), "</abbr>"),
        ("anchor", of("anchor") & (a["id"] != ""), F.concat(F.lit("<a"), attr("id"), F.lit("></a>")), ""),
        ("anchorid", of("anchorid") & (a["id"] != ""), F.concat(F.lit("<span"), attr("id"), F.lit("></span>")), ""),
    ]
    opens, closes = (F.create_map(F.lit(""), F.lit(""), *[F.lit(x) for k, pair in templates.items() if k in has for x in (k, pair[i])]) for i in (0, 1))
    opening, closing = F.coalesce(F.try_element_at(opens, base), F.lit("")), F.coalesce(F.try_element_at(closes, base), F.lit(""))
    for name, when, begin, finish in reversed(special):
        if f"topic/{name}" in has:
            opening, closing = F.when(when, begin).otherwise(opening), F.when(when, finish).otherwise(closing)
    if positions:
        where = F.concat(F.lit('<$1 title="'), "tag", *[x for name, c in (("data-line", "line"), ("data-end-line", "end_line"), ("data-start-col", "col"), ("data-end-col", "end_col")) for x in (F.lit(f'" {name}="'), F.col(c).cast("string"))], F.lit('"'))
        opening = F.when(of("tgroup") | of("link") | of("linktext") | F.coalesce(caption, F.lit(False)), opening).otherwise(F.regexp_replace(opening, F.lit("^<([a-zA-Z][a-zA-Z0-9]*)"), where))
    # The title of a link without content is looked up when the page is put together: its href marks the place.
    link_to = F.when(_is(("topic/xref",)) & ~F.col("__any") & ~by_key & (a["href"] != ""), a["href"])
    shows = F.when(by_key & ~leaf & ~F.coalesce(of("xref") & (href == ""), F.lit(False)), _kept(T.escape_html("__value")))
    shows = F.coalesce(shows, F.concat(F.lit(_HOLE), _kept(link_to), F.lit(_HOLE)), F.lit(""))
    # The title of a figure comes last, as its caption.
    full = F.concat("path", F.array(F.coalesce("base", F.lit(""))))
    moved = F.col("key")
    if "topic/fig" in has:
        moved = F.when(F.array_contains("path", "topic/fig"), F.transform("key", lambda x, i: F.when((F.get(full, i) == "topic/fig") & (F.get(full, i + 1) == "topic/title"), _LAST - 1).otherwise(x))).otherwise(moved)
    e = e.select("doc", "level", "__any", moved.alias("place"), element.alias("element"), *[F.when(element, x).alias(n) for n, x in (("opening", _kept(opening)), ("shows", shows), ("closing", _kept(F.lit(closing) if isinstance(closing, str) else closing)))], F.when(~element, _kept(T.escape_html("text"))).alias("text"))
    at = lambda html, *more: F.struct((F.concat("place", F.array(*map(F.lit, more))) if more else F.col("place")).alias("pos"), F.coalesce(html, F.lit("")).alias("html"))
    whole = F.array(at(F.concat("opening", "shows", "closing"), _FIRST))
    parts = F.array(at(F.col("opening"), _FIRST), at(F.col("shows"), 0, _FIRST), at(F.col("closing"), _LAST))
    kept = F.when(~F.col("element"), F.array(at(F.col("text")))).when(~F.col("__any"), whole).otherwise(parts)
    events = F.sort_array(F.flatten(F.collect_list(kept)))["html"]
    pages = e.groupBy("doc", "level").agg(F.array_join(events, "").alias("html"))
    return _with_links(pages, targets if targets is not None else nodes)


#: Where a link's title goes: its href between two of these marks. A zero character of the page itself is followed by another letter.
_HOLE, _ZERO = "\0l", "\0n"


def _kept(html) -> Column:
    return F.replace(html, F.lit("\0"), F.lit(_ZERO))


def _with_links(pages: DataFrame, targets: DataFrame) -> DataFrame:
    """pages (doc, level, html) with the titles of links in their places. A link is looked up once for each folder that has it (or document, for
    a link inside one), however many pages show it."""
    spark = targets.sparkSession
    pages = written(spark, pages)
    back = lambda c: F.replace(c, F.lit(_ZERO), F.lit("\0"))
    href = F.col("href")
    held = pages.where(F.col("html").contains(_HOLE)).select("doc", "level", F.posexplode(F.split("html", "\\x00l")).alias("n", "href")).where("n % 2 = 1")
    held = held.withColumn("href", back(href)).select("doc", "level", "n", "href", F.when(href.startswith("#"), F.col("doc")).otherwise(T.dirname("doc")).alias("at"))
    links = dealt(spark, held, key="href")
    # A name in the folder stands for all documents there.
    named = links.select("at", "href").distinct()
    named = dealt(spark, named.withColumn("doc", F.when(href.startswith("#"), F.col("at")).otherwise(T.file_in("at"))), key="href", placed=True)
    kinds = {r.kind for r in named.select(link_kind().alias("kind")).distinct().collect()}  # four at most
    found = with_link_titles(named, targets, kinds).where("found IS NOT NULL").select("at", "href", "found")
    shown = links.join(met(spark, found), ["at", "href"], "left").select("doc", "level", "n", T.escape_attr(F.coalesce("found", "href")).alias("html"))
    titles_of = shown.groupBy("doc", "level").agg(F.sort_array(F.collect_list(F.struct("n", "html")))["html"].alias("__titles"))
    pieces = F.transform(F.split("html", "\\x00l"), lambda x, n: F.when(n % 2 == 1, F.get("__titles", F.shiftright(n, 1))).otherwise(back(x)))
    return pages.join(big(titles_of), ["doc", "level"], "left").select("doc", "level", F.array_join(pieces, "").alias("html"))


def standalone_html(title, body, css: str = "") -> Column:
    """A whole page around a body; the title is escaped."""
    b = F.col(body) if isinstance(body, str) else body
    return F.concat(F.lit('<!DOCTYPE html>\n<html><head><meta charset="utf-8"><title>'), T.escape_html(title), F.lit(f"</title><style>{css}</style></head><body>"), b, F.lit("</body></html>"))


def write_pages(pages: DataFrame, folder: str) -> None:
    """Sink: pages (root_map, file, html) as an archive: a partition of text files for each map, a page is one line of JSON with its
    file. ``sources.pages`` writes a file for each page."""
    pages.select("root_map", F.to_json(F.struct("file", "html")).alias("value")).write.partitionBy("root_map").mode("overwrite").text(folder)


def heading_level(depth) -> Column:
    return F.least(F.lit(6), (F.col(depth) if isinstance(depth, str) else depth) + 1)


def book_heading(name, depth, role) -> Column:
    """A heading of a book with its role as a badge."""
    level = heading_level(depth).cast("string")
    badge = F.coalesce(F.concat(F.lit('<span class="map-tree-badge">'), T.escape_attr(role), F.lit("</span> ")), F.lit(""))
    return F.concat(F.lit("<h"), level, F.lit(' class="book-heading">'), badge, T.escape_attr(name), F.lit("</h"), level, F.lit(">"))


def _with_pages(e: DataFrame, html: DataFrame) -> DataFrame:
    """Entries with the page of their file at their level; those without a file have none and join nothing."""
    pages = html.select(F.col("doc").alias("file"), "level", F.col("html").alias("__page"))
    with_file = e.where("file IS NOT NULL").join(big(pages), ["file", "level"], "left")
    return with_file.unionByName(e.where("file IS NULL").withColumn("__page", F.lit(None).cast("string")))


def book_parts(entries: DataFrame, html: DataFrame) -> DataFrame:
    """(root_map, pos, html): what each entry adds to its book. entries: from ``first_occurrences``; html: (doc, level, html).

    A reference to a map and an entry without a file give a heading, a file's first occurrence its page at the level
    of its depth, later ones a note, a file that cannot be read an error block.
    """
    e = entries.withColumn("level", heading_level("depth"))
    j = _with_pages(e, html)
    level, name = F.col("level").cast("string"), "display_name"
    head = F.concat(F.lit('<div class="book-entry book-entry--placeholder">\n  <h'), level, F.lit(' class="book-section-heading">'), T.escape_attr(name), F.lit("</h"), level, F.lit(">\n</div>"))
    error = F.concat(F.lit('<div class="book-entry book-entry--error">\n  <h'), level, F.lit(' class="book-entry-title">'), T.escape_html(name), F.lit("</h"), level, F.lit('>\n  <p class="book-error">'), T.escape_html(F.concat(F.lit("File not found: "), "file")), F.lit("</p>\n</div>"))
    skip = F.concat(F.lit('<p class="book-skip">(Skipped: '), T.escape_html("href"), F.lit(" already included above)</p>"))
    page = F.concat(F.lit('<div class="book-entry">'), "__page", F.lit("</div>"))
    part = F.when(F.coalesce(F.col("href"), F.lit("")) == "", head).when(F.lower(T.path_part("href")).endswith(".ditamap"), head).when(F.col("repeat"), skip).when(F.col("__page").isNull(), error).otherwise(page)
    return j.select("root_map", "pos", part.alias("html"))


def export_parts(entries: DataFrame, html: DataFrame) -> DataFrame:
    """(root_map, pos, html): what each entry adds to an exported book. entries: from ``first_occurrences``, with role.

    Unlike the preview, repeats and entries that only define keys are left out, roles head their pages, and a file that
    cannot be read leaves a heading.
    """
    e = entries.withColumn("level", heading_level("depth"))
    j = _with_pages(e, html)
    head = book_heading("display_name", "depth", "role")
    page = F.concat(F.lit('<div class="book-entry">'), "__page", F.lit("</div>"))
    is_page = (F.coalesce(F.col("href"), F.lit("")) != "") & ~F.lower(T.path_part(F.coalesce("href", F.lit("")))).endswith(".ditamap")
    shown = F.when(F.col("__page").isNull(), head).when(F.col("role").isNotNull(), F.concat(head, F.lit("\n"), page)).otherwise(page)
    part = F.when(is_page, F.when(~F.col("repeat"), shown)).when(F.coalesce(F.col("keys"), F.lit("")) == "", head)
    return j.select("root_map", "pos", part.alias("html")).where("html IS NOT NULL")


def book_html(entries: DataFrame, html: DataFrame, parts=book_parts) -> DataFrame:
    """(root_map, html): whole books, their parts (``book_parts`` or ``export_parts``) in order."""
    drawn = parts(entries, html).groupBy("root_map").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "html"))), lambda x: x["html"]), "\n").alias("html"))
    return drawn.select("root_map", F.concat(F.lit('<div class="ditamap-book">'), "html", F.lit("</div>")).alias("html"))


# ---------------------------------------------------------------- positions


def elements_at(points: DataFrame, nodes: DataFrame, block: int = 64) -> DataFrame:
    """points(doc, line, col, ...) with tag, pre and exact: the smallest element whose range holds the point (lines weigh 100,000
    columns; of equal ones the first), else the one that starts on the nearest line, the first of them.

    Elements are dealt to the blocks of lines that they touch, but those that span several blocks only to blocks that
    hold a point; so a point meets the elements around it, not all of its document.
    """
    p = points.withColumn("__id", F.monotonically_increasing_id())
    spark = nodes.sparkSession
    # Points are dealt as the nodes are, so nothing below is shuffled again.
    p = dealt(spark, p.withColumn("block", F.expr(f"line div {block}")))
    e = nodes.where("type = 'element'").select("doc", "pre", "tag", F.col("line").alias("sl"), F.col("col").alias("sc"), F.col("end_line").alias("el"), F.col("end_col").alias("ec"))
    spread = e.withColumn("block", F.explode(F.sequence(F.expr(f"sl div {block}"), F.expr(f"el div {block}"))))
    asked = p.select("doc", "block").distinct()
    spread = spread.join(big(asked), ["doc", "block"], "left_semi")
    j = p.join(big(spread), ["doc", "block"]).where("(line > sl OR line = sl AND col >= sc) AND (line < el OR line = el AND col <= ec)")
    best = j.groupBy("doc", "__id").agg(F.min_by(F.struct("tag", "pre"), F.struct(((F.col("el") - F.col("sl")).cast("long") * 100_000 + F.col("ec") - F.col("sc")).alias("s"), "pre")).alias("hit"))
    rest = p.join(big(best.select("doc", "__id")), ["doc", "__id"], "left_anti").select("__id", "doc", "line")
    # The nearest start line: the last start at or before the point and the first one after it, by windows over both kinds.
    starts = e.groupBy("doc", "sl").agg(F.min_by(F.struct("tag", "pre"), "pre").alias("at"))
    both = starts.select("doc", F.col("sl").alias("l"), F.struct("sl", "at").alias("s"), F.lit(None).cast("long").alias("__id")).unionByName(rest.select("doc", F.col("line").alias("l"), F.lit(None).cast("struct<sl:int,at:struct<tag:string,pre:int>>").alias("s"), "__id"))
    w = Window.partitionBy("doc").orderBy("l", F.col("__id").isNotNull())
    both = both.withColumns({"a": F.last("s", True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "b": F.first("s", True).over(w.rowsBetween(0, Window.unboundedFollowing))}).where("__id IS NOT NULL")
    da, db = F.col("l") - F.col("a.sl"), F.col("b.sl") - F.col("l")
    # Of two equally near lines the element that comes first in the document counts.
    near = F.when(F.col("b").isNull() | (da < db), F.col("a.at")).when(F.col("a").isNull() | (db < da), F.col("b.at")).when(F.col("a.at.pre") < F.col("b.at.pre"), F.col("a.at")).otherwise(F.col("b.at"))
    out = p.join(big(best), ["doc", "__id"], "left").join(big(both.select("doc", "__id", near.alias("near"))), ["doc", "__id"], "left")
    hit = F.coalesce("hit", "near")
    return out.select(*points.columns, hit["tag"].alias("tag"), hit["pre"].alias("pre"), F.col("hit").isNotNull().alias("exact")).where("pre IS NOT NULL")
