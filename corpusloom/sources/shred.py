"""XML documents as tables of nodes; entity preprocessing; folders of files as documents."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Collection, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .store import big, dealt

#: One row per node. ``ord``: sibling numbers from the root down, so sorting by it is document order; ``anc``: the ancestors'
#: ``pre``; ``path``: the ancestors' base types ('' where one has none); lines and columns are 0-based code points, ends
#: lie after the closing tag; texts carry the line on which they begin.
NODES = (
    "doc string, pre int, post int, parent int, depth int, sib int, ord array<int>, anc array<int>, path array<string>, type string, tag string, base string, "
    "attrs map<string,string>, text string, line int, col int, end_line int, end_col int, error string"
)

#: Entities that every document may use without declaring them (a parameter of ``clean_entities``).
ENTITIES = {
    "nbsp": " ", "copy": "©", "reg": "®", "trade": "™", "deg": "°", "plusmn": "±", "micro": "µ", "middot": "·", "laquo": "«", "raquo": "»",
    "sect": "§", "para": "¶", "times": "×", "divide": "÷", "frac12": "½", "frac14": "¼", "frac34": "¾", "sup1": "¹", "sup2": "²", "sup3": "³",
    "cent": "¢", "pound": "£", "yen": "¥", "euro": "€", "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”",
    "hellip": "…", "bull": "•", "dagger": "†", "Dagger": "‡", "prime": "′", "Prime": "″", "larr": "←", "uarr": "↑", "rarr": "→", "darr": "↓", "harr": "↔",
}
BUILT_IN = ("amp", "lt", "gt", "quot", "apos")

#: Elements of topics whose base type is topic/ and their own name.
TOPIC_NAMES = """
abbreviated-form alt anchor anchorid anchorkey anchorref apiname b body bodydiv boolean cite cmdname codeblock codeph coderef colspec
consequence data data-about dd delim desc div dl dlentry draft-comment dt entry example fig figgroup filepath fn foreign fragment fragref
glossdef glossentry glossgroup glossref glossterm hazardstatement hazardsymbol howtoavoid i image index-base index-see index-see-also
index-sort-as indexterm indextermref itemgroup keyword keywords kwd li line-through lines link linktext lq menucascade metadata msgblock
msgnum msgph note object ol oper option overline p param parml parmname pd ph plentry pre prolog pt publisher q related-links
required-cleanup row screen section sectiondiv sep shortdesc simpletable sl sli state stentry sthead strow sub sup synblk synnote
synnoteref synph syntaxdiagram systemoutput table tbody term tgroup thead title tm topic tt typeofhazard u uicontrol ul userinput var
varname wintitle xref
"""
#: Specialised elements of topics by base type.
TOPIC_SPECIAL = {
    "topic/topic": "task concept reference troubleshooting",
    "topic/body": "taskbody conbody refbody troublebody glossBody",
    "topic/bodydiv": "conbodydiv refbodydiv troubleSolution",
    "topic/section": "prereq context steps-informal result tasktroubleshooting postreq refsyn cause condition remedy glossAlt prelreqs closereqs",
    "topic/title": "glossAbbreviation glossAcronym glossShortForm glossSynonym booktitle",
    "topic/p": "responsibleParty glossSurfaceForm supequip supplies spares",
    "topic/ph": "cmd equation-inline equation-number coords repsep booklibrary booktitlealt completed day mainbooktitle month revisionid started summary year",
    "topic/keyword": "shape markupname shortcut numcharref parameterentity textentity xmlatt xmlelement xmlnsname xmlpi",
    "topic/keywords": "exportanchors",
    "topic/metadata": "change-historylist",
    "topic/publisher": "publisherinformation",
    "topic/note": "glossScopeNote glossUsage",
    "topic/image": "glossSymbol",
    "topic/fig": "equation-figure imagemap",
    "topic/figgroup": "area groupchoice groupcomp groupseq",
    "topic/div": "equation-block",
    "topic/foreign": "mathml svg-container",
    "topic/xref": "glossAlternateFor mathmlref svgref",
    "topic/itemgroup": "info tutorialinfo stepxmp stepresult steptroubleshooting",
    "topic/ol": "steps substeps safety",
    "topic/ul": "steps-unordered choices reqconds reqpers supeqli supplyli sparesli messagepanel",
    "topic/li": "step stepsection substep choice noconds reqcond reqcontp personnel perscat perskill esttime supequi supply spare nosafety safecond",
    "topic/simpletable": "choicetable properties",
    "topic/sthead": "chhead prophead",
    "topic/strow": "chrow property",
    "topic/stentry": "choptionhd chdeschd choption chdesc proptypehd propvaluehd propdeschd proptype propvalue propdesc",
    "topic/data": (
        "glossPartOfSpeech glossProperty glossStatus nosupeq nosupply nospares dvrResourcePrefix dvrResourceSuffix dvrKeyscopePrefix dvrKeyscopeSuffix sort-as change-item "
        "change-person change-organization change-revisionid change-request-reference change-request-system change-request-id change-started change-completed change-summary "
        "approved bookchangehistory bookevent bookeventtype bookid booknumber bookowner bookpartno bookrestriction bookrights copyrfirst copyrlast edited edition isbn "
        "maintainer organization person printlocation published publishtype reviewed tested volume"
    ),
}
#: Elements of maps by base type.
MAP_TYPES = {
    "map/map": "map bookmap",
    "map/map-title": "title booktitle mainbooktitle booktitlealt subtitle",
    "map/topicmeta": "topicmeta bookmeta ditavalmeta",
    "map/navtitle": "navtitle", "map/linktext": "linktext", "map/shortdesc": "shortdesc", "map/keywords": "keywords", "map/keyword": "keyword",
    "map/topicref": "topicref chapter appendix part preface notices draftintro glossaryref dedication colophon bookabstract amendments ditavalref anchorref topicset topicsetref glossref appendices booklist",
    "map/topichead": "topichead", "map/topicgroup": "topicgroup", "map/keydef": "keydef", "map/mapref": "mapref",
    "map/bookmap-structural": "frontmatter backmatter booklists toc figurelist tablelist indexlist glossarylist abbrevlist bibliolist trademarklist",
    "map/reltable": "reltable", "map/relheader": "relheader", "map/relrow": "relrow", "map/relcell": "relcell", "map/relcolspec": "relcolspec",
    "map/anchor": "anchor", "map/navref": "navref",
}


def tag_types() -> dict[str, dict[str, str]]:
    """side (topic or map) -> tag -> base type. A copy: users add their own tags and pass it on."""
    spread = lambda table: {tag: base for base, tags in table.items() for tag in tags.split()}
    return {"topic": {n: f"topic/{n}" for n in TOPIC_NAMES.split()} | spread(TOPIC_SPECIAL), "map": spread(MAP_TYPES)}


def docs_from_dir(spark: SparkSession, root: str) -> DataFrame:
    """docs(path, root_dir, content, mtime) of the XML documents below a folder of any file system. Paths are relative to the folder,
    so that references, folders and key spaces look alike wherever it lies; ``root_dir`` is its full name."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    full = folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toString().rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(F.col("path").rlike(r"(?i)\.(dita|ditamap|xml)$"))
    return files.select(relative_path("path", full).alias("path"), F.lit(full).alias("root_dir"), F.decode("content", "UTF-8").alias("content"), F.col("modificationTime").alias("mtime"))


def relative_path(path, root: str) -> Column:
    """A file's path relative to the root folder; slashes after the scheme do not count, a root without a scheme names its folder in any
    file system, and what lies elsewhere stays as it is."""
    c = F.col(path) if isinstance(path, str) else path
    scheme = "^([A-Za-z][A-Za-z0-9+.\\-]*):"
    bare = (lambda x: F.regexp_replace(x, scheme + "/+", "$1:/")) if re.match(scheme, root) else (lambda x: F.regexp_replace(x, scheme + "(//[^/]*)?/+", "/"))
    p, r = bare(c), F.concat(bare(F.lit(root.rstrip("/"))), F.lit("/"))
    return F.when(p.startswith(r), F.substring(p, F.length(r) + 1, F.length(p))).otherwise(c)


def referenceable_files(paths: DataFrame, dirs: DataFrame, max_depth: int = 3, most: int = 200) -> DataFrame:
    """(dir, rel): for each folder (dirs: dir) the documents (paths: path, relative to the root) that it may refer to."""
    up = paths.select("path", F.explode(T.ancestors(T.dirname("path"))).alias("dir"))
    rel = F.when(F.col("dir") == "", F.col("path")).otherwise(F.substring("path", F.length("dir") + 2, F.length("path")))
    inside = up.join(big(dirs.select("dir").distinct()), "dir", "left_semi").select("dir", rel.alias("rel"))
    return list_files(inside, max_depth, most)


def list_files(files: DataFrame, max_depth: int = 3, most: int = 200) -> DataFrame:
    """(dir, rel) of the documents that a directory may refer to: no hidden or build folders, ``max_depth`` levels,
    the first ``most`` by name in each directory. ``files``: dir, rel."""
    from pyspark.sql import Window

    parts = F.split("rel", "/")
    ok = files.where(F.col("rel").rlike(r"(?i)\.(dita|ditamap|xml)$") & (F.size(parts) <= max_depth + 1) & ~F.exists(parts, lambda p: p.startswith(".") | p.isin("node_modules", "out")))
    return ok.withColumn("__k", F.row_number().over(Window.partitionBy("dir").orderBy("rel"))).where(F.col("__k") <= most).drop("__k")


#: How a document declares an entity, and what counts as a reference to one.
DECLARED = r'<!ENTITY\s+(\S+)\s+"((?:[^"\\]|\\.)*)">'
REFERENCE = r"&([a-zA-Z_][a-zA-Z0-9_.-]*);"


def clean_entities(content, known: dict[str, str] = ENTITIES) -> Column:
    """A document without its DOCTYPE, with declared and known entities replaced and unknown ones deleted.

    Declared ones come first, in order of declaration, and replacement is literal. What does not look like a reference to
    an entity (``REFERENCE``) and is not declared stays.
    """
    c = F.col(content) if isinstance(content, str) else content
    names, values = (F.regexp_extract_all(c, F.lit(DECLARED), F.lit(k)) for k in (1, 2))
    at = F.instr(c, "<!DOCTYPE")
    rest = F.substring(c, at, F.length(c))
    bracket, close = F.instr(rest, "["), F.instr(rest, ">")
    ends = F.locate("]>", F.substring(rest, bracket, F.length(rest)))
    cut = F.when((bracket > 0) & ((close == 0) | (bracket < close)) & (ends > 0), bracket + ends).otherwise(close)
    body = F.when((at > 0) & (cut > 0), F.concat(F.substring(c, F.lit(1), at - 1), F.substring(rest, cut + 1, F.length(rest)))).otherwise(c)
    body = F.aggregate(F.arrays_zip(names.alias("n"), values.alias("v")), body, lambda acc, e: F.replace(acc, F.concat(F.lit("&"), e["n"], F.lit(";")), e["v"]))
    for n, v in known.items():
        body = F.replace(body, F.lit(f"&{n};"), F.lit(v))
    return F.regexp_replace(body, rf"&(?!(?:{'|'.join(BUILT_IN)});)[a-zA-Z_][a-zA-Z0-9_.-]*;", "")


class Shifted:
    """A text with replacements, and where each of its characters stands in the source."""

    def __init__(self, text: str):
        self.text = text
        self.at, self.source, self.moves = [0], [0], [True]  # from ``at`` on, places move along from ``source`` or stand still

    def origin(self, at: int) -> int:
        k = bisect_right(self.at, at) - 1
        return self.source[k] + (at - self.at[k] if self.moves[k] else 0)

    def replace(self, found: Iterable[tuple[int, int, str]]) -> None:
        """Put new text in the place of (start, end, new), in order."""
        out, at, source, moves, n, done = [], [], [], [], 0, 0

        def mark(place: int, origin: int, moving: bool) -> None:
            if at and at[-1] == place:
                at.pop(), source.pop(), moves.pop()
            at.append(place), source.append(origin), moves.append(moving)

        def keep(a: int, b: int) -> None:
            nonlocal n
            k = bisect_right(self.at, a) - 1
            mark(n, self.origin(a), self.moves[k])
            for k in range(k + 1, bisect_right(self.at, b)):
                mark(n + self.at[k] - a, self.source[k], self.moves[k])
            out.append(self.text[a:b])
            n += b - a

        for a, b, new in found:
            keep(done, a)
            if new:
                mark(n, self.origin(a), False)
                out.append(new)
                n += len(new)
            done = b
        keep(done, len(self.text))
        self.text, self.at, self.source, self.moves = "".join(out), at, source, moves


def clean_source(xml: str, known: dict[str, str] = ENTITIES) -> Shifted:
    """As ``clean_entities``, for one document, with the places of its characters in the source."""
    s = Shifted(xml)
    declared = re.findall(DECLARED, xml)
    at = xml.find("<!DOCTYPE")
    if at >= 0:
        bracket, close = xml.find("[", at), xml.find(">", at)
        ends = xml.find("]>", bracket) if bracket >= 0 and (close < 0 or bracket < close) else -1
        if ends >= 0 or close >= 0:
            s.replace([(at, ends + 2 if ends >= 0 else close + 1, "")])
    for name, value in declared:
        s.replace((m.start(), m.end(), value) for m in re.finditer(re.escape(f"&{name};"), s.text))
    if "&" in s.text:
        s.replace((m.start(), m.end(), known.get(m[1], "")) for m in re.finditer(REFERENCE, s.text) if m[1] not in BUILT_IN)
    return s


_TAG_END = re.compile(rb"""(?:[^>"']++|"[^"]*"|'[^']*')*+>""")
_TYPED = re.compile("^(topic|map)/")
#: Columns of NODES by name, with their types; those that say where a node stands; bytes from which on a document is parsed in pieces.
_KINDS = dict(x.split(" ") for x in NODES.split(", ")) | {"own": "string"}
_PLACES, _DEEP = ("line", "col", "end_line", "end_col"), ("ord", "anc", "path")
_LARGE, _PIECE = 4 << 20, 1 << 20


#: What a plain document may hold: characters; tags (before their >) whose attributes need no normalisation. All else is expat's.
_PLAIN_BYTES = bytes([9, 10, *range(32, 127)])
_PLAIN_TEXT = re.compile("[\t\n -~\xa0-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]*")
_PLAIN_TAG = re.compile(r"""([A-Za-z_][\w.-]*)((?:[ \t\n]+[A-Za-z_][\w.:-]*[ \t\n]*=[ \t\n]*(?:"[^"\t\n]*"|'[^'\t\n]*'))*)[ \t\n]*(/?)""", re.ASCII)
_PLAIN_ATTRS = re.compile(r"""([A-Za-z_][\w.:-]*)[ \t\n]*=[ \t\n]*(?:"([^"]*)"|'([^']*)')""", re.ASCII)
_PLAIN_CLOSE = re.compile(r"/([A-Za-z_][\w.-]*)[ \t\n]*", re.ASCII)
_OPEN, _EMPTY, _CLOSE = 0, 1, 2
#: Different tags that a task remembers.
_TAGS = 50_000


def _tag(text: str, types: dict[str, dict[str, str]], side: str | None) -> tuple | None:
    """What a tag (without < and >) of a plain document says: (kind, name, base type, attributes, side), None if it is not a plain one.
    ``side``: the one whose base types count; None for the root, which decides it."""
    if text[:1] == "/":
        m = _PLAIN_CLOSE.fullmatch(text)
        return m and (_CLOSE, m[1], None, None, side)
    m = _PLAIN_TAG.fullmatch(text)
    if m is None:
        return None
    name, inner, empty = m.groups()
    found = _PLAIN_ATTRS.findall(inner) if inner else []
    if len(found) > 1 and len({a for a, _, _ in found}) < len(found):
        return None
    cls = next((t for a, x, y in found if a == "class" for t in (x or y).split() if _TYPED.match(t)), None) if "class" in inner else None
    if side is None:
        side = "map" if name in ("map", "bookmap") or (cls or "").startswith("map/") else "topic"
    return _EMPTY if empty else _OPEN, name, types[side].get(name, cls), [x for a, v, w in found for x in (a, v or w)], side


def _plain_nodes(xml: str, types: dict[str, dict[str, str]], memory: dict, own: frozenset, bare: bool, deep: Collection[str], only: frozenset | None) -> list[list] | None:
    """As ``_nodes`` without places, for a document of tags and texts alone (most are), cut up at its tags; None for any other, well-formed
    or not. ``memory``: what tags met before say, by side."""
    if "&" in xml or "<!" in xml or "<?" in xml or "]]>" in xml or (xml.encode().translate(None, _PLAIN_BYTES) if xml.isascii() else not _PLAIN_TEXT.fullmatch(xml)):
        return None
    pieces = iter(xml.split("<"))
    if next(pieces).strip(" \t\n"):
        return None
    rows, said, heard = [], [], []
    above: list[tuple] = []  # around the innermost open element
    row, name, ords, anc, path, sib, parent_of = None, None, [], [], [], 0, False
    side, known, tick, depth = None, None, 0, 0
    ordered, nested, typed = ("ord" in deep), ("anc" in deep), ("path" in deep)
    for piece in pieces:
        tag, closed, text = piece.partition(">")
        if not closed:
            return None
        got = known.get(tag) if known is not None else None
        if got is None:
            got = _tag(tag, types, side)
            if got is None or side is None and got[0] == _CLOSE:
                return None
            if side is None:
                side = got[4]
                known = memory.setdefault(side, {})
            if len(known) >= _TAGS:
                known.clear()
            known[tag] = got
        kind, tag, base, attrs, _ = got
        tick += 1
        if kind != _CLOSE:
            if depth:
                new = [tick, None, row[0], depth, sib, [*ords, sib] if ordered else ords, anc, path, "element", tag, base, attrs, None, None, None, None, None, None]
            elif row is None:
                new = [tick, None, None, 0, 0, [], anc, path, "element", tag, base, attrs, None, None, None, None, None, None]
            else:
                return None  # a second root
            above.append((row, name, ords, anc, path, sib, parent_of))
            if own:
                new.append(None)
                parent_of = False
                if base in own:
                    heard.append((new, len(said)))
            if not bare and (only is None or base in only):
                rows.append(new)
            row, name, sib = new, tag, 0
            depth += 1
            if kind == _OPEN:
                ords = new[5]
                if nested:
                    anc = [*anc, tick]
                if typed:
                    path = [*path, base or ""]
            if kind == _EMPTY:
                tick += 1
        elif not depth or tag != name:
            return None
        if kind != _OPEN:
            row[1], done, last = tick, row, parent_of
            row, name, ords, anc, path, sib, parent_of = above.pop()
            depth -= 1
            sib += 1
            if own:
                if heard and heard[-1][0] is done:
                    done[18] = "".join(said[heard.pop()[1] :])
                    if not heard:
                        said.clear()
                    parent_of = True
                if bare and (last or done[18] is not None or not depth or "id" in done[11][::2]):
                    rows.append(done)
            if not depth:
                row = done  # the root is closed
        if text:
            if not depth:
                if text.strip(" \t\n"):
                    return None
                continue
            tick += 1
            if heard:
                said.append(text)
            if not bare and only is None:
                rows.append([tick, tick, row[0], depth, sib, [*ords, sib] if ordered else ords, anc, path, "text", None, None, None, text, None, None, None, None, None])
                if own:
                    rows[-1].append(None)
            sib += 1
    return rows if row is not None and not depth else None


def _nodes(
    xml: str | None, types: dict[str, dict[str, str]], clean: bool = True, places: bool = True, large: int = _LARGE, piece: int = _PIECE, own: Iterable[str] = (), bare: bool = False, deep: Collection[str] = _DEEP,
    only: frozenset | None = None, memory: dict | None = None,
) -> Iterator[list[list]]:
    """Nodes of one document (columns of NODES after doc; attributes as one list of names and values), or one row with an error.
    With ``own`` a last column holds the text below each element of these base types. ``bare``: only elements that have an own
    text or a child with one, the root, and those with an id. ``deep``: which of ``_DEEP`` are needed (others may be made).
    ``only``: of all nodes only elements of these base types. With ``memory`` plain documents are read by ``_plain_nodes``.

    Small documents come as one list, in pre-order unless ``bare``. Large ones are read twice: once for errors, then in pieces, and what a piece has
    closed is handed out before the next one, so memory holds the text, a piece's nodes and the open elements."""
    from xml.parsers import expat

    xml, own = xml or "", frozenset(own)
    if memory is not None and not places and len(xml) <= large >> 2:
        done = _plain_nodes(xml, types, memory, own, bare, deep, only)
        if done is not None:
            yield done
            return
    shifted = clean_source(xml) if clean and ("&" in xml or "<!DOCTYPE" in xml) else None
    data = (shifted.text if shifted else xml).encode("utf-8", "surrogatepass")
    plain = shifted is None and len(data) == len(xml)  # bytes are characters of the source
    breaks = [-1, *(m.start() for m in re.finditer("\n", xml))] if places else []
    rows: list[list] = []
    # Open elements: their row, and what their children share: ancestors, base types and the next sibling number.
    open_: list[tuple[list, list, list]] = []
    kids: list[int] = []
    tick, buffer, begun, table = 0, [], 0, None
    # Texts since the outermost open element with an own text; those elements with the place where their texts begin; whether an open
    # element has such a child.
    said: list[str] = []
    heard: list[tuple[list, int]] = []
    asked: list[bool] = []
    parser = expat.ParserCreate("utf-8")
    parser.ordered_attributes, parser.buffer_text = True, not places
    POST, ORD, ATTRS, END_LINE, END_COL, OWN = 1, 5, 11, 15, 16, 18

    last = [0, 0]  # byte and character of the last place: places only go forward, so each byte is counted once

    def place(at: int) -> tuple[int, int]:
        if plain:
            source = at
        else:
            last[:] = at, last[1] + len(data[last[0] : at].decode("utf-8", "replace"))
            source = shifted.origin(last[1]) if shifted else last[1]
        k = bisect_right(breaks, source - 1) - 1
        return k, source - breaks[k] - 1

    def flush():
        nonlocal tick
        if open_:
            top, anc, path = open_[-1]
            text = "".join(buffer)
            if heard:
                said.append(text)
            if not bare and only is None:
                line, col = place(begun) if places else (None, None)
                rows.append([tick + 1, tick + 1, top[0], len(open_), kids[-1], [*top[ORD], kids[-1]] if deep else anc, anc, path, "text", None, None, None, text, line, col, None, None, None])
                if own:
                    rows[-1].append(None)
            kids[-1] += 1
            tick += 1
        buffer.clear()

    def start(tag, attrs):
        nonlocal table, tick
        if buffer:
            flush()
        base = table.get(tag) if table is not None else None
        if base is None:
            cls = next((t for k, v in zip(attrs[::2], attrs[1::2]) if k == "class" for t in v.split() if _TYPED.match(t)), None)
            if table is None:
                table = types["map"] if tag in ("map", "bookmap") or (cls or "").startswith("map/") else types["topic"]
            base = table.get(tag, cls)
        tick += 1
        if open_:
            top, anc, path = open_[-1]
            row = [tick, None, top[0], len(open_), kids[-1], [*top[ORD], kids[-1]] if deep else anc, anc, path, "element", tag, base, attrs, None, None, None, None, None, None]
            kids[-1] += 1
        else:
            anc, path = [], []
            row = [tick, None, None, 0, 0, [], anc, path, "element", tag, base, attrs, None, None, None, None, None, None]
        if places:
            at = parser.CurrentByteIndex
            row[13], row[14] = place(at)
            closed = _TAG_END.match(data, at).end()
            if data[closed - 2 : closed] == b"/>":
                row[END_LINE], row[END_COL] = place(closed)
        open_.append((row, [*anc, tick], [*path, base or ""]) if deep else (row, anc, path))
        kids.append(0)
        if own:
            row.append(None)
            asked.append(False)
            if base in own:
                heard.append((row, len(said)))
        if not bare and (only is None or base in only):
            rows.append(row)

    def end(tag):
        nonlocal tick
        if buffer:
            flush()
        tick += 1
        done = open_.pop()[0]
        kids.pop()
        done[POST] = tick
        if places and done[END_LINE] is None:
            done[END_LINE], done[END_COL] = place(data.index(b">", parser.CurrentByteIndex) + 1)
        if own:
            parent_of = asked.pop()
            if heard and heard[-1][0] is done:
                done[OWN] = "".join(said[heard.pop()[1] :])
                if not heard:
                    said.clear()
                if asked:
                    asked[-1] = True
            if bare and (parent_of or done[OWN] is not None or not open_ or "id" in done[ATTRS][::2]):
                rows.append(done)

    def chars(s):
        nonlocal begun
        if places and not buffer:
            begun = parser.CurrentByteIndex
        buffer.append(s)

    def failed(e) -> list[list]:
        return [[None] * 17 + [f"{expat.ErrorString(e.code)} at {e.lineno}:{e.offset}" if e else "no root element"] + [None] * bool(own)]

    in_pieces = len(data) > large
    if in_pieces:
        try:
            expat.ParserCreate("utf-8").Parse(data, True)
        except expat.ExpatError as e:
            yield failed(e)
            return
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, chars
    try:
        if not in_pieces:
            parser.Parse(data, True)
            yield rows if table is not None else failed(None)
        else:
            for at in range(0, len(data), piece):
                parser.Parse(data[at : at + piece], at + piece >= len(data))
                done = [r for r in rows if r[POST] is not None]
                rows[:] = [r for r in rows if r[POST] is None]
                if done:
                    yield done
    except expat.ExpatError as e:
        yield failed(e)
    finally:  # no ring of references is left behind
        parser.StartElementHandler = parser.EndElementHandler = parser.CharacterDataHandler = None


def shred_document(xml: str | None, types: dict[str, dict[str, str]], clean: bool = True) -> list[list]:
    """Nodes of one document in pre-order (columns of NODES after doc), or one row with an error. Starts and ends share one
    counter. A document is a map if its root element is one, by name or by class. Entities are cleaned first unless
    ``clean`` is off; places are those of the source."""
    rows = sorted((r for rows in _nodes(xml, types, clean) for r in rows), key=lambda r: r[0] or 0)
    for r in rows:
        r[11] = list(zip(r[11][::2], r[11][1::2])) if r[11] is not None else None
    return rows


def shred(docs: DataFrame, types: dict[str, dict[str, str]] | None = None, clean: bool = True, columns: Iterable[str] | None = None, own: tuple[str, ...] = (), bare: bool = False, only: tuple[str, ...] | None = None) -> DataFrame:
    """NODES of docs(path, content); a document that is not well-formed gives one row with its error. Entities are cleaned before
    parsing (``clean_entities``); ranges refer to the source as it is.

    ``base`` is the tag's base type in ``types`` (``tag_types()``), else the first class token of the form topic/x or map/x.
    ``columns``: only these columns of NODES are made, beside doc. ``own``: base types whose elements carry the text below them in a
    column of that name (null on all other nodes), so that texts need not be put together from their nodes. ``bare``: of all nodes
    only elements with such a text or a child with one, roots, elements with an id, and errors. ``only``: of all nodes only elements of
    these base types, and errors.
    """
    if bare and not own:
        raise ValueError("bare nodes need the base types whose texts are wanted")
    if bare and only is not None:
        raise ValueError("nodes are either bare or of some base types only")
    types = types or tag_types()
    wanted = ["doc", *(n for n in _KINDS if n not in ("doc", "own") and (columns is None or n in set(columns))), *(["own"] if own else [])]
    places, deep = any(n in _PLACES for n in wanted), [n for n in _DEEP if n in wanted]
    kept = None if only is None else frozenset(only)

    def run(batches: Iterable) -> Iterator:
        import gc
        from itertools import chain

        import numpy as np
        import pyarrow as pa

        simple = {"int": pa.int32(), "string": pa.string()}

        def offsets(lengths: list[int]):
            return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)

        def column(name: str, values, whole: bool) -> pa.Array:
            kind = _KINDS[name]
            if kind in simple:
                return pa.array(values, simple[kind])
            if kind.startswith("array"):
                inner = simple[kind[6:-1]]
                if not whole:
                    return pa.array(values, pa.list_(inner))
                return pa.ListArray.from_arrays(pa.array(offsets(list(map(len, values)))), pa.array(list(chain.from_iterable(values)), inner))
            held = [v or () for v in values]
            at = pa.array(offsets([len(v) >> 1 for v in held]), mask=np.array([v is None for v in values] + [False]))
            flat = list(chain.from_iterable(held))
            return pa.MapArray.from_arrays(at, pa.array(flat[::2], pa.string()), pa.array(flat[1::2], pa.string()))

        place = [list(_KINDS).index(n) - 1 for n in wanted[1:]]

        def batch(doc: list, rows: list[list]) -> pa.RecordBatch:
            cols = list(zip(*rows)) if place else []
            whole = not any(cols[17]) if place else True  # only rows of errors have no lists
            return pa.RecordBatch.from_arrays([pa.array(doc, pa.string()), *(column(n, cols[k], whole) for n, k in zip(wanted[1:], place))], wanted)

        def made() -> Iterator:
            memory: dict = {}
            for b in batches:
                doc, rows = [], []
                for path, xml in zip(b.column(0).to_pylist(), b.column(1)):
                    for part in _nodes(xml.as_py(), types, clean, places, own=own, bare=bare, deep=deep, only=kept, memory=memory):
                        doc += [path] * len(part)
                        rows += part
                        if len(rows) >= 20_000:
                            yield batch(doc, rows)
                            doc, rows = [], []
                if rows:
                    yield batch(doc, rows)

        # Nodes are many small lists without rings: looking for rings again and again would cost more than making them.
        gc.disable()
        try:
            yield from made()
        finally:
            gc.enable()

    nodes = docs.select("path", "content").mapInArrow(run, ", ".join(f"{n} {_KINDS[n]}" for n in wanted))
    return nodes.withMetadata("own", {"types": sorted(own)}) if own else nodes


def own_types(nodes: DataFrame) -> set[str]:
    """The base types whose elements carry their text in the column own."""
    return set(nodes.schema["own"].metadata.get("types", ())) if "own" in nodes.columns else set()


def stored_nodes(
    spark: SparkSession, docs: DataFrame, types: dict[str, dict[str, str]] | None = None, columns: Iterable[str] | None = None, own: tuple[str, ...] = (), bare: bool = False,
    only: tuple[str, ...] | None = None, kept: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """NODES stored in the shared folder, dealt by document: documents are parsed once, every use reads only the columns it needs,
    and what stays inside documents is not shuffled again. Documents are dealt before they are parsed, so their nodes, many
    times their size, are neither shuffled nor sorted. Documents are sorted, though: then their nodes lie in order, and sorting those later takes one
    look at each. ``columns``, ``own``, ``bare``, ``only``: as in ``shred``, where the uses are known; ``kept``: what is made of single nodes and stored
    in their place."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    nodes = shred(docs.select("path", "content").repartition(n, "path").sortWithinPartitions("path"), types, columns=columns, own=own, bare=bare, only=only)
    return dealt(spark, kept(nodes) if kept else nodes, buckets=n, placed=True)


def class_tokens(cls) -> Column:
    return F.filter(F.split(F.trim(F.coalesce(F.col(cls) if isinstance(cls, str) else cls, F.lit(""))), r"\s+"), lambda x: x != "")


def derive_base_type(class_value) -> Column:
    """The base type that a declared class value stands for: its first pair, if another follows and it looks like one."""
    pairs = F.filter(class_tokens(class_value), lambda t: ~t.isin("-", "+"))
    first = F.get(pairs, 0)
    return F.when((F.size(pairs) > 1) & first.rlike("^[a-z][a-z0-9]*/[a-z]"), first)


def bucket_of(base) -> Column:
    """topic, map or other."""
    b = F.col(base) if isinstance(base, str) else base
    return F.when(b.startswith("topic/"), "topic").when(b.startswith("map/"), "map").otherwise("other")
