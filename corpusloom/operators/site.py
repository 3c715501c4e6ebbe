"""Published HTML pages: asset injection, on-page contents, code languages, search."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import cache
from html import unescape
from itertools import islice

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shred import bucket_of, derive_base_type
from ..sources.store import big, written


def _before_first(html: Column, mark: str, insert) -> Column:
    at = F.instr(html, mark)
    return F.when(at > 0, F.concat(F.substring(html, F.lit(1), at - 1), insert, F.substring(html, at, F.length(html)))).otherwise(html)


def inject_assets(html, depth, css: str = "site.css", script: str = "site.js", marker: str = "data-site-assets") -> Column:
    """A page with its style link before the first </head> and its script before the first </body>; done only once."""
    h = F.col(html) if isinstance(html, str) else html
    up = F.repeat(F.lit("../"), depth if isinstance(depth, Column) else F.lit(depth))
    styled = _before_first(h, "</head>", F.concat(F.lit(f'<link rel="stylesheet" {marker} href="'), up, F.lit(f'{css}">')))
    done = _before_first(styled, "</body>", F.concat(F.lit(f'<script {marker} src="'), up, F.lit(f'{script}"></script>')))
    return F.when(h.contains(marker), h).otherwise(done)


def toc_items(pages: DataFrame) -> DataFrame:
    """(page, pos, id, title): sections with an id and an h2 or h3 section title, after the first h1 with an id if there is any
    section; pages with fewer than two items have none. Pages need not be well-formed; titles may hold markup."""
    name, kind = next((f.name, f.dataType.simpleString()) for f in pages.schema.fields if f.name == "page")

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for b in batches:
            rows = [(page, pos, *item) for page, html in zip(b.column(0), b.column(1)) for pos, item in enumerate(_page_items(html.as_py() or ""))]
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array([x.as_py() for x in cols[0]], b.column(0).type), *(pa.array(c, k) for c, k in zip(cols[1:], (pa.int32(), pa.string(), pa.string())))], ["page", "pos", "id", "title"])

    return pages.select(name, "html").mapInArrow(run, f"page {kind}, pos int, id string, title string")


#: What pages are mostly made of: text, end and start tags in small letters with plain attributes, short comments, elements whose content
#: is raw. A page of nothing else is cut up by one pattern; others are left to the tolerant parser, which says the same of these.
_RAW = ("script", "style", "title", "textarea")
_ATTRIBUTES = r"""(?:\s+[a-z][a-z0-9-]*=(?:"[^"&<>]*"|[^\s"'&<>=/`]+))*+\s*+"""
_START = rf"(?!(?:{'|'.join(_RAW)}|xmp|iframe|noembed|noframes|plaintext|noscript|svg|math)\b)[a-z][a-z0-9]*+"
_PARTS = re.compile(rf"([^<]++)|</([a-z][a-z0-9]*+)>|<({'|'.join(_RAW)})({_ATTRIBUTES})>([^<]*+)</\3>|<({_START})({_ATTRIBUTES})>|<!--([^<>-]*+)-->", re.ASCII)
_WHOLE = re.compile(rf"(?:[^<]++|</[a-z][a-z0-9]*+>|{'|'.join(f'<{t}{_ATTRIBUTES}>[^<]*+</{t}>' for t in _RAW)}|<{_START}{_ATTRIBUTES}>|<!--[^<>-]*+-->)*+", re.ASCII)
_PLAIN_ATTRIBUTE = re.compile(r"""([a-z][a-z0-9-]*)=(?:"([^"]*)"|([^\s"]+))""", re.ASCII)


def _read(reader, page: str) -> None:
    """Show a page to a reader of the kind of HTMLParser, plain pages without its parser."""
    if _WHOLE.match(page).end() < len(page):
        reader.feed(page)
        reader.close()
        return
    attributes = lambda x: [(n, a or b) for n, a, b in _PLAIN_ATTRIBUTE.findall(x)] if x else []
    for text, end, raw, raw_attrs, inner, start, attrs, comment in _PARTS.findall(page):
        if text:
            reader.handle_data(unescape(text) if "&" in text else text)
        elif start:
            reader.handle_starttag(start, attributes(attrs))
        elif end:
            reader.handle_endtag(end)
        elif raw:
            reader.handle_starttag(raw, attributes(raw_attrs))
            if inner:
                reader.handle_data(inner if raw in ("script", "style") or "&" not in inner else unescape(inner))
            reader.handle_endtag(raw)
        else:
            reader.handle_comment(comment)


@cache
def _contents_reader() -> type:
    """The reader of a page's contents; its class is made once for each process, not for each page."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.sections: list[list] = []  # [id, title or None] of open sections, '' without an id
            self.done: list[list] = []
            self.top: list | None = None
            self.into: list | None = None
            self.until = ""

        def handle_starttag(self, tag, attrs):
            a = dict(attrs)
            if tag == "section":
                self.sections.append([a.get("id") or "", None])
                if self.sections[-1][0]:
                    self.done.append(self.sections[-1])
            elif tag in ("h2", "h3") and "sectiontitle" in (a.get("class") or "").split():
                # A section's title may lie in a section inside it, so every open one without a title takes this one.
                waiting = [s for s in self.sections if s[0] and s[1] is None]
                if waiting:
                    self.into, self.until = [], tag
                    for s in waiting:
                        s[1] = self.into
            elif tag == "h1" and a.get("id") and self.top is None:
                self.into, self.until = [], tag
                self.top = [a["id"], self.into]

        def handle_endtag(self, tag):
            if tag == "section" and self.sections:
                self.sections.pop()
            elif self.into is not None and tag == self.until:
                self.into = None

        def handle_data(self, data):
            if self.into is not None:
                self.into.append(data)

    return Reader


def _page_items(html: str) -> list[tuple[str, str]]:
    """(id, title) of one page."""
    reader = _contents_reader()()
    _read(reader, html)
    items = [(i, "".join(t)) for i, t in reader.done if t is not None]
    if items and reader.top:
        items.insert(0, (reader.top[0], "".join(reader.top[1])))
    return items if len(items) > 1 else []


def code_languages(pages: DataFrame) -> DataFrame:
    """(lang, n): languages of code blocks; blocks without one count as code."""
    cls = F.explode(F.regexp_extract_all("html", F.lit(r'<pre[^>]*\bclass="([^"]*)"'), F.lit(1)))
    lang = F.regexp_extract("cls", r"(?:^|\s)language-(\S+)", 1)
    return pages.select(cls.alias("cls")).groupBy(F.when(lang != "", lang).otherwise("code").alias("lang")).agg(F.count("*").alias("n"))


def source_languages(nodes: DataFrame) -> DataFrame:
    """(lang, n): languages of code blocks in documents, by their outputclass."""
    lang = F.regexp_replace(F.coalesce(F.col("attrs")["outputclass"], F.lit("")), "^language-", "")
    return nodes.where("base = 'topic/codeblock'").groupBy(F.when(lang != "", lang).otherwise("code").alias("lang")).agg(F.count("*").alias("n"))


def pattern_error(term: str, regex: bool = True) -> str | None:
    """What is wrong with a user's pattern; null if nothing is."""
    import re

    try:
        re.compile(term if regex else re.escape(term))
    except re.error as e:
        return str(e)
    return None


def search(docs: DataFrame, term: str, regex: bool = False, case_sensitive: bool = False, most: int = 1000) -> DataFrame:
    """(doc, n, total, start, end): the first ``most`` matches in each text, numbered. Offsets are code points.

    An empty or invalid pattern matches nothing (``pattern_error`` says why); empty matches are passed over. Letters of all
    scripts compare without case unless ``case_sensitive``.
    """
    import re

    usable = bool(term) and pattern_error(term, regex) is None
    pattern = re.compile((term if regex else re.escape(term)) if usable else "(?!)", 0 if case_sensitive else re.IGNORECASE)
    kind = docs.schema["doc"].dataType.simpleString()

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for b in batches:
            at, starts, ends, numbers, totals = [], [], [], [], []
            for row, text in enumerate(b.column(1)):
                found = list(islice(((m.start(), m.end()) for m in pattern.finditer(text.as_py() or "") if m.end() > m.start()), most))
                at += [row] * len(found)
                numbers += range(1, len(found) + 1)
                totals += [len(found)] * len(found)
                starts += (s for s, _ in found)
                ends += (e for _, e in found)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(x, pa.int32()) for x in (numbers, totals, starts, ends))], ["doc", "n", "total", "start", "end"])

    return docs.where(F.lit(usable)).select("doc", "content").mapInArrow(run, f"doc {kind}, n int, total int, start int, end int")


#: Elements whose text is not shown, and ids of the parts of a page that are its tools.
UNSHOWN_TAGS, TOOL_IDS = ("script", "style", "mark"), ("__toolbar", "__search_bar")
#: Elements that hold nothing, and those whose start ends an open paragraph.
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS_PARAGRAPH = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())


@cache
def _text_reader() -> type:
    """The reader of a page's shown text, as above."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self, tools: tuple[str, ...]):
            super().__init__(convert_charrefs=True)
            self.open: list[tuple[str, bool]] = []  # (tag, whether it or one around it is a tool)
            self.buffer: list[str] = []
            self.out: list[tuple[int, str, str]] = []
            self.tools, self.number = tools, 0

        def flush(self):
            text, self.buffer = "".join(self.buffer), []
            if not text:
                return
            tag, tool = self.open[-1] if self.open else ("body", False)
            if not tool and tag not in UNSHOWN_TAGS and not any(t == "head" for t, _ in self.open) and text.strip():
                self.out.append((self.number, tag, text))
            self.number += 1

        def handle_starttag(self, tag, attrs):
            self.flush()
            if tag in ENDS_PARAGRAPH and self.open and self.open[-1][0] == "p":
                self.open.pop()
            if tag == "body":
                self.open = [x for x in self.open if x[0] != "head"]
            if tag not in VOID_TAGS:
                self.open.append((tag, bool(self.open and self.open[-1][1]) or dict(attrs).get("id") in self.tools))

        def handle_startendtag(self, tag, attrs):
            self.handle_starttag(tag, attrs)

        def handle_endtag(self, tag):
            self.flush()
            at = next((k for k in range(len(self.open) - 1, -1, -1) if self.open[k][0] == tag), None)
            if at is not None:
                del self.open[at:]

        def handle_data(self, data):
            self.buffer.append(data)

        def handle_comment(self, data):
            self.flush()

    return Reader


def _text_nodes(html: str, tools: tuple[str, ...]) -> list[tuple[int, str, str]]:
    """(number, tag of the parent, text) of the text nodes of a page's body that a reader sees; tag soup is taken as it comes: an end
    tag closes what is open up to its start, one without a start is passed over."""
    reader = _text_reader()(tools)
    _read(reader, html)
    reader.flush()
    return reader.out


def page_text_nodes(pages: DataFrame, tools: tuple[str, ...] = TOOL_IDS) -> DataFrame:
    """(doc, node, tag, text): the text nodes of pages (doc, html) that a reader sees, numbered in the order of the page. Blank ones
    are left out, and what is in the head, in scripts and styles, or in a page's tools (elements with one of these ids)."""
    kind = pages.schema["doc"].dataType.simpleString()

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for b in batches:
            found = [(row, *x) for row, html in enumerate(b.column(1)) for x in _text_nodes(html.as_py() or "", tools)]
            cols = list(zip(*found)) or [()] * 4
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string())], ["doc", "node", "tag", "text"])

    return pages.select("doc", "html").mapInArrow(run, f"doc {kind}, node int, tag string, text string")


def search_pages(pages: DataFrame, term: str, regex: bool = False, case_sensitive: bool = False, most: int = 1000) -> DataFrame:
    """(doc, node, start, end, n, total): matches in the shown text of pages (doc, html): the first ``most`` of each text node, numbered
    through the page, of ``total`` on it. Offsets are code points inside the node; a match does not cross nodes."""
    nodes = page_text_nodes(pages)
    hits = search(nodes.select(F.struct("doc", "node").alias("doc"), F.col("text").alias("content")), term, regex, case_sensitive, most)
    hits = hits.select("doc.doc", "doc.node", "start", "end")
    w = Window.partitionBy("doc")
    return hits.withColumns({"n": F.row_number().over(w.orderBy("node", "start")), "total": F.count("*").over(w).cast("int")})


# ---------------------------------------------------------------- images

#: Media types of images by extension.
IMAGE_TYPES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "svg": "image/svg+xml", "webp": "image/webp"}


def data_uris(refs: DataFrame, assets: DataFrame) -> DataFrame:
    """refs (doc, href, ...) with ``uri``: the image that a href names as a data URI, '' where there is no such file. assets: path,
    content (binary)."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in IMAGE_TYPES.items() for x in kv]), ext), F.lit("application/octet-stream"))
    uri = F.concat(F.lit("data:"), kind, F.lit(";base64,"), F.regexp_replace(F.base64("content"), r"\s", ""))
    drawn = assets.select(F.col("path").alias("__target"), uri.alias("uri"))
    j = refs.withColumn("__target", T.resolve(T.dirname("doc"), "href")).join(big(drawn), "__target", "left")
    return j.withColumn("uri", F.coalesce("uri", F.lit(""))).drop("__target")


# ---------------------------------------------------------------- lookups and catalogues


def layered_lookup(candidates: DataFrame) -> DataFrame:
    """candidates(scope, name, layer, path): for each scope and file name the path of the nearest layer."""
    return candidates.groupBy("scope", "name").agg(F.min_by(F.struct("path", "layer"), F.struct("layer", "path")).alias("b")).select("scope", "name", "b.*")


def catalogue_diff(code: DataFrame, found: DataFrame) -> DataFrame:
    """(tag, status, code_type, found_type) of two tag catalogues (tag, base_type): matched, conflict, only-new, only-code."""
    a, b = code.select("tag", F.col("base_type").alias("code_type")), found.select("tag", F.col("base_type").alias("found_type"))
    status = F.when(F.col("code_type").isNull(), "only-new").when(F.col("found_type").isNull(), "only-code").when(F.col("code_type") == F.col("found_type"), "matched").otherwise("conflict")
    return a.join(big(b), "tag", "full_outer").withColumn("status", status)


def declared_conflicts(declared: DataFrame) -> DataFrame:
    """(tag, bucket, n_types, base_type): declarations (tag, bucket, base_type, ord); the last one is retained."""
    return declared.groupBy("tag", "bucket").agg(F.count_distinct("base_type").alias("n_types"), F.max_by("base_type", "ord").alias("base_type"))


def schema_files(files: DataFrame) -> DataFrame:
    """The schema files of a folder listing (path, ...): .mod, .ent and .dtd below base, technicalContent or bookmap, without
    foreign namespaces."""
    parts = F.split("path", "/")
    return files.where(F.col("path").rlike(r"\.(mod|ent|dtd)$") & F.exists(parts, lambda p: p.isin("base", "technicalContent", "bookmap")) & ~F.exists(parts, lambda p: p.isin("mathml", "svg")))


def scan_classes(files: DataFrame) -> DataFrame:
    """(path, line, ord, tag, class_value) declared by ATTLISTs in schema files (path, content), parameter entities resolved. Lines
    are 1-based; of several definitions of an entity the last counts; an unknown one stays as it is."""
    import re

    entity = re.compile(r'<!ENTITY\s+%\s+([A-Za-z0-9_.\-]+)\s+"((?:[^"\\]|\\.)*)"\s*>')
    attlist, cls, use = re.compile(r"<!ATTLIST\s+(\([^)]*\)|[^\s>]+)([^>]*)>"), re.compile(r'\bclass\s+CDATA\s+"([^"]*)"'), re.compile(r"%([A-Za-z0-9_.\-]+);")

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for b in batches:
            rows = []
            for path, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = text.as_py() or ""
                known = {m[1]: m[2] for m in entity.finditer(text)}
                line, at, k = 1, 0, 0
                for m in attlist.finditer(text):
                    line, at = line + text.count("\n", at, m.start()), m.start()
                    if c := cls.search(m[2]):
                        value = use.sub(lambda x: known.get(x[1], x[0]), c[1])
                        for tag in filter(None, (t.strip() for t in m[1].strip("()").split("|"))):
                            rows.append((path, line, k, tag, value))
                            k += 1
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 5, kinds)], ["path", "line", "ord", "tag", "class_value"])

    return files.select("path", "content").mapInArrow(run, "path string, line int, ord int, tag string, class_value string")


def schema_catalogue(declared: DataFrame) -> DataFrame:
    """(tag, bucket, base_type, n_types, path, line) from ``scan_classes``: the base type of each tag on the topic and on the map
    side. Declarations that stand for no base type and other sides are left out; the last of several counts."""
    d = declared.withColumn("base_type", derive_base_type("class_value")).where("base_type IS NOT NULL").withColumn("bucket", bucket_of("base_type")).where("bucket <> 'other'")
    last = F.max_by(F.struct("base_type", "path", "line"), F.struct("path", "line", "ord"))
    return d.groupBy("tag", "bucket").agg(last.alias("b"), F.count_distinct("base_type").alias("n_types")).select("tag", "bucket", "b.base_type", "n_types", "b.path", "b.line")


def known_types(*tables: DataFrame) -> DataFrame:
    """(base_type): the base types in use in several catalogues, each once."""
    out = tables[0].select("base_type")
    for t in tables[1:]:
        out = out.unionByName(t.select("base_type"))
    return out.distinct()


def missing_renderers(found: DataFrame, known: DataFrame, rendered: DataFrame) -> DataFrame:
    """(base_type, tag): base types of ``found`` (tag, base_type) that neither ``known`` nor ``rendered`` (base_type) holds, with
    their first tag."""
    new = found.join(big(known.select("base_type").distinct()), "base_type", "left_anti").join(big(rendered.select("base_type").distinct()), "base_type", "left_anti")
    return new.groupBy("base_type").agg(F.min("tag").alias("tag"))


def schema_audit(files: DataFrame, code: DataFrame, rendered: DataFrame) -> DataFrame:
    """The audit of schema files (path, content) against a catalogue (tag, bucket, base_type): one row per side and finding:
    side, finding (matched, conflict, only-new, only-code, duplicate, missing-renderer), n, sample (the first tag)."""
    found = written(files.sparkSession, schema_catalogue(scan_classes(files)))
    known, parts = written(files.sparkSession, known_types(code)), []
    for side in ("topic", "map"):
        mine = found.where(F.col("bucket") == side)
        diff = catalogue_diff(code.where(F.col("bucket") == side), mine).select("tag", F.col("status").alias("finding"))
        new = catalogue_diff(code.where(F.col("bucket") == side), mine).where("status = 'only-new'").select("tag", F.col("found_type").alias("base_type"))
        rows = diff.unionByName(mine.where("n_types > 1").select("tag", F.lit("duplicate").alias("finding"))).unionByName(missing_renderers(new, known, rendered).select("tag", F.lit("missing-renderer").alias("finding")))
        parts.append(rows.groupBy("finding").agg(F.count("*").alias("n"), F.min("tag").alias("sample")).select(F.lit(side).alias("side"), "finding", "n", "sample"))
    return parts[0].unionByName(parts[1])


def write_catalogue(catalogue: DataFrame, folder: str) -> None:
    """Sink: the catalogue as JSON lines, sorted by tag."""
    catalogue.orderBy("bucket", "tag").write.mode("overwrite").json(folder)


def diff_report(diff: DataFrame, side: str) -> DataFrame:
    """(section, ord, line): the lines of a markdown report of a catalogue diff, by finding and tag."""
    told = F.concat(F.lit("- `"), "tag", F.lit("`: "), F.concat_ws(" vs ", "code_type", "found_type"))
    head = diff.groupBy("status").agg(F.count("*").alias("n")).select(F.col("status").alias("section"), F.lit("").alias("ord"), F.concat(F.lit(f"## {side}: "), "status", F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("line"))
    return head.unionByName(diff.select(F.col("status").alias("section"), F.col("tag").alias("ord"), told.alias("line"))).orderBy("section", "ord")


def style_candidates(docs: DataFrame, styles: DataFrame, configured: DataFrame | None = None) -> DataFrame:
    """candidates(scope, name, layer, path) for ``layered_lookup``: style files (path) of every folder from a document's own up to the
    root, nearest first, and of the folders that are configured for it (scope, dir), which come last; each folder once."""
    up = docs.select(T.dirname("path").alias("scope")).distinct()
    up = up.select("scope", F.posexplode(T.ancestors("scope")).alias("layer", "dir"))
    if configured is not None:
        up = up.unionByName(configured.select("scope", F.lit(1 << 20).alias("layer"), "dir"))
    up = up.groupBy("scope", "dir").agg(F.min("layer").alias("layer"))
    files = styles.select("path", T.dirname("path").alias("dir"), T.basename("path").alias("name"))
    return up.join(big(files), "dir").select("scope", "name", "layer", "path")


def default_style(found: DataFrame, preferred: str = "custom.css") -> DataFrame:
    """(scope, path): the style that a scope uses unless it chooses: the preferred name, else the first."""
    return found.groupBy("scope").agg(F.min_by("path", F.struct(F.col("name") != preferred, "layer", "name")).alias("path"))
