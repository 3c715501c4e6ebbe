"""References and identifiers in raw document text (malformed XML is tolerated), where they lead, and reports on broken ones.

Offsets are code points. Texts are scanned in Arrow batches, once per operator and in time linear in their length.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.store import Layers, big, written

#: Attributes that refer to something; what counts as a tag and as an attribute of it, as an id, as a list of keys
#: and as a link to a map.
REF_ATTRS = ("href", "conref", "conkeyref", "keyref")
TAG = r"""<([A-Za-z][\w.-]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>"""
ATTRIBUTE = r'([\w:.-]+)\s*=\s*"([^"]*)"'
ID, KEYS, MAP_LINK = r'\bid\s*=\s*"([^"]+)"', r'\bkeys\s*=\s*"([^"]*)"', r'href\s*=\s*"([^"]+\.ditamap)"'


def _scan(docs: DataFrame, find: Callable[[str], Iterator[tuple]], schema: str, empty: bool = False) -> DataFrame:
    """(doc, columns of ``schema``): what ``find`` yields for each content, with ``empty`` for a missing one too. docs: path, content."""

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        kinds = {"string": pa.string(), "int": pa.int32(), "array<int>": pa.list_(pa.int32())}
        fields = [x.split(" ") for x in schema.split(", ")]
        for b in batches:
            rows = [(path, *r) for path, text in zip(b.column(0).to_pylist(), b.column(1)) if (t := text.as_py()) or empty for r in find(t or "")]
            cols = list(zip(*rows)) or [()] * (len(fields) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.string(), *(kinds[k] for _, k in fields)])], ["doc", *(n for n, _ in fields)])

    return docs.select("path", "content").mapInArrow(run, f"doc string, {schema}")


_REFS = "tag string, attr string, value string, value_start int, value_end int, scope string, format string"


def _refs(text: str, tag: re.Pattern, attribute: re.Pattern) -> Iterator[tuple]:
    for m in tag.finditer(text):
        segment = m[2]
        if not segment or "ref" not in segment:
            continue
        found = list(attribute.finditer(segment))
        named = {a[1]: a[2] for a in found}  # of several scopes or formats the last counts
        for a in found:
            if a[1] in REF_ATTRS:
                yield m[1], a[1], a[2], m.start(2) + a.start(2), m.start(2) + a.end(2), named.get("scope"), named.get("format")


def collect_refs(docs: DataFrame) -> DataFrame:
    """refs(doc, tag, attr, value, value_start, value_end, scope, format): every reference attribute in double quotes, in text
    order. Other attributes of the tag may be bare or in single quotes."""
    tag, attribute = re.compile(TAG, re.ASCII), re.compile(ATTRIBUTE)
    return _scan(docs, lambda text: _refs(text, tag, attribute), _REFS)


def scan_texts(docs: DataFrame) -> DataFrame:
    """What reports on references need of documents, from one pass over each text: rows (doc, tag, attr, value, value_start,
    value_end, scope, format) of references as in ``collect_refs``; attr ``id`` with the id as value and its offset for each
    non-empty id attribute; and one row without attr for each document. Local references have the columns of ``with_targets`` too, so
    that where the rows are stored a path is resolved once."""
    tag, attribute, ident = re.compile(TAG, re.ASCII), re.compile(ATTRIBUTE), re.compile(ID, re.ASCII)

    def find(text: str) -> Iterator[tuple]:
        yield None, None, None, None, None, None, None
        yield from _refs(text, tag, attribute)
        for m in ident.finditer(text):
            yield None, "id", m[1], m.start(), None, None, None

    found = _scan(docs, find, _REFS, empty=True)
    return found.withColumns({name: F.when(_is_local(), value) for name, value in _targets().items()})


#: Different tags that a task remembers.
_TAGS = 50_000


def scan_places(docs: DataFrame) -> DataFrame:
    """What leads to places and what places are needs of documents, from one pass over each text: rows (doc, attr, value, value_start, scope,
    breaks) of references, without their offsets; attr ``id`` as in ``scan_texts``; and one row without attr for each document, with the offsets
    of its line ends."""
    tag, attribute, ident, line = re.compile(TAG, re.ASCII), re.compile(ATTRIBUTE), re.compile(ID, re.ASCII), re.compile("\n")
    known: dict[str, list[tuple]] = {}  # what tags met before refer to

    def find(text: str) -> Iterator[tuple]:
        yield None, None, None, None, [m.start() for m in line.finditer(text)]
        for _, segment in tag.findall(text):
            if "ref" in segment:
                refs = known.get(segment)
                if refs is None:
                    found = attribute.findall(segment)
                    scope = dict(found).get("scope")
                    refs = [(name, value, None, scope, None) for name, value in found if name in REF_ATTRS]
                    if len(known) >= _TAGS:
                        known.clear()
                    known[segment] = refs
                yield from refs
        for m in ident.finditer(text):
            yield "id", m[1], m.start(), None, None

    return _scan(docs, find, "attr string, value string, value_start int, scope string, breaks array<int>", empty=True)


def references(scanned: DataFrame) -> DataFrame:
    """The references of ``scan_texts``, as ``collect_refs`` gives them, or of ``scan_places``."""
    return scanned.where(F.col("attr").isin(*REF_ATTRS))


def alike(refs: DataFrame) -> DataFrame:
    """(doc, attr, value, scope, n): references that lead to one place, counted: those with one value from one folder, or from one document
    where the value names no file. ``doc`` is that document, or a name in that folder."""
    inside = F.col("attr").isin("href", "conref") & (T.path_part("value") == "")
    at = F.when(inside, F.col("doc")).otherwise(T.dirname("doc"))
    groups = refs.groupBy(inside.alias("__inside"), at.alias("__at"), "attr", "value", "scope").agg(F.count("*").alias("n"))
    return groups.select(F.when(F.col("__inside"), F.col("__at")).otherwise(T.file_in("__at")).alias("doc"), "attr", "value", "scope", "n")


def id_positions(docs: DataFrame) -> DataFrame:
    """(doc, id, off): every non-empty id attribute with the offset where it begins; duplicates stay."""
    pattern = re.compile(ID, re.ASCII)
    return _scan(docs, lambda text: ((m[1], m.start()) for m in pattern.finditer(text)), "id string, off int")


def collect_ids(docs: DataFrame) -> DataFrame:
    """(doc, id) of every non-empty id attribute; duplicates stay."""
    return id_positions(docs).select("doc", "id")


def key_positions(maps: DataFrame) -> DataFrame:
    """(doc, key, off): the first keys attribute that names each key; an attribute may name several."""
    pattern = re.compile(KEYS, re.ASCII)
    found = _scan(maps, lambda text: ((k, m.start()) for m in pattern.finditer(text) for k in m[1].split()), "key string, off int")
    return found.groupBy("doc", "key").agg(F.min("off").alias("off"))


def refs_at(points: DataFrame, refs: DataFrame, block: int = 256) -> DataFrame:
    """points(doc, off, ...) with the reference whose value holds the offset (ends included; of several the first).

    References are dealt to the blocks of text that their value touches, so points meet only references nearby.
    """
    r = refs.select("doc", "tag", "attr", "value", "value_start", "value_end", "scope", F.explode(F.sequence(F.expr(f"value_start div {block}"), F.expr(f"value_end div {block}"))).alias("__block"))
    # Points are numbered once and written: equal ones stay apart.
    p = written(refs.sparkSession, points.withColumn("__id", F.monotonically_increasing_id()))
    j = p.withColumn("__block", F.expr(f"off div {block}")).join(big(r), ["doc", "__block"]).where("off BETWEEN value_start AND value_end")
    best = j.groupBy("__id").agg(F.min_by(F.struct("tag", "attr", "value", "value_start", "value_end", "scope"), "value_start").alias("r"))
    return p.join(big(best), "__id").select(*points.columns, "r.*")


def _is_local() -> Column:
    return F.col("attr").isin("href", "conref") & ~T.is_external("value", "scope")


def _targets() -> dict[str, Column]:
    elem = T.element_id("value")
    return {"target": F.coalesce(T.resolve(T.dirname("doc"), "value"), F.col("doc")), "topic": F.when(T.fragment("value") != "", T.topic_id("value")), "elem": F.when(elem != "", elem)}


def with_targets(refs: DataFrame) -> DataFrame:
    """Local href and conref references and target (corpus path; the document itself for an empty path), topic and elem of
    the fragment; an empty element part is none. References that have a target (``scan_texts``) keep it."""
    if "target" in refs.columns:
        return refs.where("target IS NOT NULL")
    return refs.where(_is_local()).withColumns(_targets())


def missing_files(refs: DataFrame, paths: DataFrame) -> DataFrame:
    """Local references whose file is not in ``paths`` (path)."""
    return with_targets(refs).join(big(paths.select(F.col("path").alias("target")).distinct()), "target", "left_anti")


def target_offsets(refs: DataFrame, docs: DataFrame, scanned: DataFrame | None = None) -> DataFrame:
    """References to an existing file that name a topic, with target_off: where the topic's id begins in the target, or the
    element's after it; null where either is missing. ``scanned``: ``scan_texts`` of the documents, if it is stored."""
    paths = docs.select("path") if scanned is None else scanned.where("attr IS NULL").select(F.col("doc").alias("path"))
    t = with_targets(refs).where("topic IS NOT NULL").join(big(paths.select(F.col("path").alias("target")).distinct()), "target", "left_semi")
    # The places of an id in one file, in order: bounded by the file. Documents are scanned once for them.
    places = id_positions(docs) if scanned is None else scanned.where("attr = 'id'").select("doc", F.col("value").alias("id"), F.col("value_start").alias("off"))
    ids = places.groupBy(F.col("doc").alias("target"), "id").agg(F.array_sort(F.collect_set("off")).alias("offs"))
    ids = written(docs.sparkSession, ids)
    t = t.join(big(ids.select("target", F.col("id").alias("topic"), F.get("offs", F.lit(0)).alias("topic_off"))), ["target", "topic"], "left")
    # Only references that name an element meet the places of elements.
    named = t.where("elem IS NOT NULL").join(big(ids.withColumnRenamed("id", "elem")), ["target", "elem"], "left")
    named = named.withColumn("target_off", F.when(F.col("topic_off").isNotNull(), F.get("offs", T.lower_bound("offs", "topic_off")))).drop("offs")
    return named.unionByName(t.where("elem IS NULL").withColumn("target_off", F.col("topic_off"))).drop("topic_off")


def missing_ids(refs: DataFrame, docs: DataFrame, scanned: DataFrame | None = None) -> DataFrame:
    """References to an existing .dita or .xml file whose topic id, or element id after it, does not occur there. ``scanned``: as in
    ``target_offsets``; with it ``references`` gives the refs without reading the texts again."""
    return target_offsets(refs.where(F.coalesce(F.nullif(T.path_part("value"), F.lit("")), F.col("doc")).rlike(r"(?i)\.(dita|xml)$")), docs, scanned).where("target_off IS NULL").drop("target_off")


def undefined_keys(refs: DataFrame, keys: DataFrame) -> DataFrame:
    """Key references (the part before a slash) that no key space of the document's folder defines. keys: scope_dir, key."""
    k = refs.where(F.col("attr").isin("keyref", "conkeyref")).withColumns({"key": F.split_part("value", F.lit("/"), F.lit(1)), "scope_dir": T.dirname("doc")})
    return k.where("key <> ''").join(big(keys.select("scope_dir", "key").distinct()), ["scope_dir", "key"], "left_anti")


def diagnostics(docs: DataFrame, keys: DataFrame, extra_paths: DataFrame | None = None) -> DataFrame:
    """diagnostics(doc, value_start, value_end, severity, code, value) of all documents. Each text is made and
    read once: references, ids and paths come from one stored scan."""
    scanned = written(docs.sparkSession, scan_texts(docs))
    refs, paths = references(scanned).where("value <> ''"), scanned.where("attr IS NULL").select(F.col("doc").alias("path"))
    paths = paths.unionByName(extra_paths.select("path")) if extra_paths is not None else paths
    row = lambda df, severity, code: df.select("doc", "value_start", "value_end", F.lit(severity).alias("severity"), F.lit(code).alias("code"), "value")
    return row(undefined_keys(refs, keys), "warning", "undefined-key").unionByName(row(missing_files(refs, paths), "error", "missing-file")).unionByName(row(missing_ids(refs, docs, scanned), "warning", "missing-id"))


# ---------------------------------------------------------------- where references lead


def map_links(maps: DataFrame) -> DataFrame:
    """(doc, k, target): the local .ditamap hrefs of each map, in text order, malformed maps included."""
    pattern = re.compile(MAP_LINK, re.IGNORECASE)
    found = _scan(maps, lambda text: ((k, m[1]) for k, m in enumerate(pattern.finditer(text))), "k int, value string")
    return found.where(~T.is_external("value", F.lit(None))).select("doc", "k", T.resolve(T.dirname("doc"), "value").alias("target"))


def key_search_order(visible: DataFrame, maps: DataFrame, most: int | None = 50) -> DataFrame:
    """(scope_dir, map_path, rank): maps in the order in which a folder searches them for a key: those it sees, nearest first,
    then breadth-first those that they link to; the first ``most`` of them (all for None).

    visible: from ``keys.visible_maps``; maps: path, content. Rounds are written and end when no new map is found.
    """
    spark = maps.sparkSession
    links = written(spark, map_links(maps).join(big(maps.select(F.col("path").alias("target"))), "target"))
    at = F.row_number().over(Window.partitionBy("scope_dir").orderBy("distance", "map_path"))
    last = written(spark, visible.select("scope_dir", "map_path", F.lit(0).alias("hop"), F.array(at).alias("way")))
    known = Layers(spark)
    known.add(last)
    while not last.isEmpty():
        new = last.join(big(links.select(F.col("doc").alias("map_path"), "k", "target")), "map_path")
        new = new.groupBy("scope_dir", F.col("target").alias("map_path")).agg((F.min("hop") + 1).alias("hop"), F.min(F.concat("way", F.array("k"))).alias("way"))
        last = written(spark, new.join(big(known.all().select("scope_dir", "map_path")), ["scope_dir", "map_path"], "left_anti"))
        known.add(last)
    ranked = known.all().withColumn("rank", F.row_number().over(Window.partitionBy("scope_dir").orderBy("hop", "way")))
    return (ranked.where(F.col("rank") <= most) if most else ranked).select("scope_dir", "map_path", "rank")


def key_locations(order: DataFrame, maps: DataFrame) -> DataFrame:
    """(scope_dir, key, map_path, off): where a folder finds each key defined. order: from ``key_search_order``."""
    j = order.join(big(key_positions(maps).withColumnRenamed("doc", "map_path")), "map_path")
    best = j.groupBy("scope_dir", "key").agg(F.min_by(F.struct("map_path", "off"), "rank").alias("b"))
    return best.select("scope_dir", "key", "b.*")


def definitions(refs: DataFrame, docs: DataFrame, locations: DataFrame, scanned: DataFrame | None = None) -> DataFrame:
    """refs (doc, attr, value, scope and any more) with target and the 0-based target_line and target_col that each leads to; references that
    lead nowhere are left out.

    Key references lead to their key's definition; others to the id that their fragment names, or to the top of the
    file without a fragment or where it names nothing. docs (path, content) holds topics and maps; ``scanned``: ``scan_places`` of
    them, if it is stored. Paths are resolved once for each row of refs, so many of one kind are best given as ``alike`` counts them.
    """
    spark = docs.sparkSession
    scanned = written(spark, scan_places(docs)) if scanned is None else scanned
    cols = [c for c in refs.columns if c not in ("scope", "format", "target", "topic", "elem")]
    if "target" not in refs.columns:
        refs = written(spark, refs.withColumns({name: F.when(_is_local(), value) for name, value in _targets().items()}))
    k = refs.where(F.col("attr").isin("keyref", "conkeyref")).withColumns({"key": F.split_part("value", F.lit("/"), F.lit(1)), "scope_dir": T.dirname("doc")})
    k = k.join(big(locations), ["scope_dir", "key"]).select(*cols, F.col("map_path").alias("target"), "off")
    held = scanned.where("attr IS NULL").select(F.col("doc").alias("target"), "breaks")
    f = with_targets(refs).where("value <> ''")
    plain = f.where("topic IS NULL").join(big(held.select("target").distinct()), "target", "left_semi").select(*cols, "target", F.lit(0).alias("off"))
    inside = target_offsets(refs, docs, scanned).select(*cols, "target", F.coalesce("target_off", F.lit(0)).alias("off"))
    all_refs = written(spark, k.unionByName(plain).unionByName(inside))
    # Lines and columns are taken once for each place, so a text's line ends are joined once however many references lead there.
    places = all_refs.select("target", "off").distinct().groupBy("target").agg(F.collect_list("off").alias("offs"))
    at = places.join(big(held), "target").select("target", F.inline(F.transform("offs", lambda o: F.struct(o.alias("off"), *places_of("breaks", o)))))
    return all_refs.join(big(at), ["target", "off"]).drop("off")


def places_of(breaks: str, off) -> tuple[Column, Column]:
    """0-based target_line and target_col of an offset, by binary search in the line ends of its text."""
    line = T.lower_bound(breaks, off)
    start = F.coalesce(F.get(F.col(breaks), line - 1) + 1, F.lit(0))
    return line.alias("target_line"), (off - start).alias("target_col")


# ---------------------------------------------------------------- attribute catalogue

#: Attributes that every element may carry, and those of single elements.
UNIVERSAL_ATTRS = "id conref conkeyref keyref outputclass props audience platform product rev importance translate xml:lang".split()
_REFERENCE = "href keys keyref navtitle format scope processing-role toc type collection-type"
TAG_ATTRS = {tag: names.split() for tag, names in {
    "xref": "href format scope type", "link": "href format scope type", "image": "href height width placement align scale", "note": "type othertype",
    "topicref": _REFERENCE, "keydef": "keys href format scope processing-role", "mapref": "href format processing-role", "chapter": _REFERENCE, "part": _REFERENCE, "appendix": _REFERENCE,
    "preface": _REFERENCE, "glossaryref": _REFERENCE, "topichead": "navtitle collection-type", "table": "frame colsep rowsep pgwide", "tgroup": "cols", "colspec": "colname colwidth colnum",
    "entry": "colname namest nameend morerows valign align", "codeblock": "outputclass scale", "ph": "keyref", "keyword": "keyref", "term": "keyref", "lq": "href reftitle", "fig": "frame expanse", "section": "spectitle",
}.items()}


def attributes_of(tag):
    """The attributes known for a tag: its own first, then the universal ones, each once."""
    table = F.create_map(*[x for t, names in TAG_ATTRS.items() for x in (F.lit(t), F.array(*map(F.lit, names)))])
    return F.array_union(F.coalesce(F.try_element_at(table, F.col(tag) if isinstance(tag, str) else tag), F.array().cast("array<string>")), F.array(*map(F.lit, UNIVERSAL_ATTRS)))


def unknown_attributes(nodes: DataFrame) -> DataFrame:
    """(tag, attr, n): attributes in use that the catalogue does not know for their tag."""
    used = nodes.where("type = 'element'").select("tag", F.explode(F.map_keys("attrs")).alias("attr")).groupBy("tag", "attr").agg(F.count("*").alias("n"))
    return used.where(~F.array_contains(attributes_of("tag"), F.col("attr")))
