"""Column functions on text, hrefs, paths and ordinals. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as white space when trimming (NBSP and Unicode spaces too).
_WS = r"[\s\x{00A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def js_trim(x) -> Column:
    return F.regexp_replace(_c(x), f"^{_WS}+|{_WS}+$", "")


def is_blank(x) -> Column:
    return F.coalesce(js_trim(x), F.lit("")) == ""


def escape_html(x) -> Column:
    """& < > and double quotes; the ampersand first."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(_c(x), F.lit(a), F.lit(b))
    return x


def escape_attr(x) -> Column:
    return F.replace(escape_html(x), F.lit("'"), F.lit("&#39;"))


def capitalised(x) -> Column:
    """The first letter in upper case, the rest as it is."""
    return F.concat(F.upper(F.substring(_c(x), 1, 1)), F.substring(_c(x), 2, 1 << 30))


def json_in_page(x) -> Column:
    """JSON text for a script element: no closing tag inside ends it."""
    return F.regexp_replace(_c(x), "(?i)</script>", r"<\\/script>")


def safe_attr(name: str, value) -> Column:
    """`` name="value"``, or nothing for null."""
    return F.coalesce(F.concat(F.lit(f' {name}="'), escape_attr(value), F.lit('"')), F.lit(""))


def is_external(value, scope) -> Column:
    """Empty, scope external or peer, a URL scheme, or an absolute path (POSIX, drive, UNC)."""
    v = F.coalesce(_c(value), F.lit(""))
    return (v == "") | F.coalesce(_c(scope), F.lit("")).isin("external", "peer") | v.rlike(r"^([A-Za-z][A-Za-z0-9+.\-]*:|/|\\\\)")


def is_local_href(value) -> Column:
    """As not external, and not a fragment of the same file."""
    return ~is_external(value, F.lit(None)) & ~F.coalesce(_c(value), F.lit("")).startswith("#")


def let(value, use) -> Column:
    """``use`` of a value that is made once for each row, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(_c(value)), use), F.lit(0))


def path_part(href) -> Column:
    return F.substring_index(_c(href), "#", 1)


def fragment(href) -> Column:
    """What follows the first ``#``; null without one."""
    h = _c(href)
    return F.when(h.contains("#"), F.substring(h, F.instr(h, "#") + 1, F.length(h)))


def topic_id(href) -> Column:
    return F.split_part(fragment(href), F.lit("/"), F.lit(1))


def element_id(href) -> Column:
    """The part after the first slash of a fragment; null if there is none."""
    f = fragment(href)
    return F.when(f.contains("/"), F.split_part(f, F.lit("/"), F.lit(2)))


def decode_href(href) -> Column:
    """Percent-decoded; malformed input is returned as it is."""
    decoded = lambda h: let(F.try_url_decode(F.replace(h, F.lit("+"), F.lit("%2B"))), lambda d: F.when(d.isNull() | d.contains("�"), h).otherwise(d))
    return let(href, lambda h: F.when(h.contains("%"), decoded(h)).otherwise(h))


#: What comes before the first folder of a path: scheme and host, or slashes; nothing for a relative path.
_ROOT = r"^([A-Za-z][A-Za-z0-9+.\-]*:(?://[^/]*)?/?|/+)"


#: A path that has a root, or a part to be resolved; a folder that is left by the next part.
_UNSETTLED = _ROOT + r"|(?:^|/)\.{0,2}(?:/|$)"
_LEFT_AT_ONCE = r"(^|/)(?!\.{1,2}/)[^/:]+/\.\./"


def root_of(path) -> Column:
    """Scheme and host (``hdfs://nn/``, ``file:/``) or the slash of an absolute path; '' for a relative one."""
    return F.regexp_replace(F.regexp_extract(_c(path), _ROOT, 1), "^/+$", "/")


def normalise(path) -> Column:
    """``.`` and ``..`` resolved; what a path is rooted in stays, and a relative path keeps a leading ``..`` beyond its root."""

    def walked(root, p):
        parts = F.filter(F.split(F.regexp_replace(p, _ROOT, ""), "/"), lambda x: ~x.isin("", "."))
        step = lambda a, x: F.when((x == "..") & (F.size(a) > 0) & (F.get(a, F.size(a) - 1) != ".."), F.slice(a, 1, F.size(a) - 1)).when((x == "..") & (root != ""), a).otherwise(F.concat(a, F.array(x)))
        return F.concat(root, F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/"))

    # The path is made once for each row; one that is settled, or is so without the folders that a ``..`` leaves at once, is not taken apart.
    walk = lambda p: let(F.when(p.rlike(_ROOT), root_of(p)).otherwise(""), lambda root: walked(root, p))
    shorter = lambda p: let(F.regexp_replace(p, _LEFT_AT_ONCE, "$1"), lambda q: F.when(q.rlike(_UNSETTLED), walk(p)).otherwise(q))
    return let(path, lambda p: F.when(p.rlike(_UNSETTLED), shorter(p)).otherwise(p))


def dirname(path) -> Column:
    p = _c(path)
    at = F.length(p) - F.length(F.substring_index(p, "/", -1))
    return F.when(p.contains("/"), F.when(at == 1, "/").otherwise(F.substring(p, F.lit(1), at - 1))).otherwise("")


def file_in(directory) -> Column:
    """A name whose ``dirname`` is this folder."""
    d = _c(directory)
    return F.when(d == "", "_").when(d == "/", "/_").otherwise(F.concat(d, F.lit("/_")))


def ancestors(directory) -> Column:
    """A folder and the folders above it, nearest first, as ``dirname`` names them."""
    d = _c(directory)
    root, parts = root_of(d), F.filter(F.split(F.regexp_replace(d, _ROOT, ""), "/"), lambda x: x != "")
    top = F.when(root == "/", root).otherwise(F.regexp_replace(root, "/+$", ""))
    return F.transform(F.sequence(F.size(parts), F.lit(0)), lambda k: F.when(k == 0, top).otherwise(F.concat(root, F.array_join(F.slice(parts, F.lit(1), k), "/"))))


def under(directory, path) -> Column:
    """A relative path seen from a folder; the empty folder is the root of relative paths."""
    d = _c(directory)
    return F.concat(d, F.when((d == "") | d.endswith("/"), "").otherwise("/"), _c(path))


def basename(path) -> Column:
    return F.substring_index(_c(path), "/", -1)


def stem(path) -> Column:
    """File name without its last extension; a dot at the start is no extension."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def resolve(directory, href) -> Column:
    """Corpus path of a local href seen from a directory; null for a path-less one."""
    return let(decode_href(path_part(href)), lambda p: F.when(p != "", normalise(let(directory, lambda d: under(d, p)))))


def relative(path, directory) -> Column:
    """The href that leads from a directory to a path."""
    to, at = F.split(_c(path), "/"), F.filter(F.split(_c(directory), "/"), lambda x: x != "")
    same = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(at), F.lit(1))), F.lit(0), lambda a, k: F.when((a == k - 1) & (k <= F.size(at)) & (F.get(to, k - 1) == F.get(at, k - 1)), k).otherwise(a))
    return F.concat(F.repeat(F.lit("../"), F.size(at) - same), F.array_join(F.slice(to, same + 1, F.greatest(F.size(to) - same, F.lit(0))), "/"))


def roman(n) -> Column:
    """1..3999 as a Roman numeral."""
    n = _c(n).cast("int")
    digits = lambda one, five, ten: F.array(*[F.lit(x) for x in ("", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten)])
    at = lambda table, k: F.get(table, (F.floor(n / k) % 10).cast("int"))
    return F.concat(F.repeat(F.lit("M"), F.floor(n / 1000).cast("int")), at(digits("C", "D", "M"), 100), at(digits("X", "L", "C"), 10), at(digits("I", "V", "X"), 1))


def letters(n) -> Column:
    """1 -> A, 26 -> Z, 27 -> AA, and so on without bound."""
    n = _c(n).cast("long")
    # Digits from the last one on; fourteen letters name every long.
    step = lambda a, _: F.when(a["m"] > 0, F.struct(F.floor((a["m"] - 1) / 26).cast("long").alias("m"), F.concat(F.chr(F.lit(65) + (a["m"] - 1) % 26), a["s"]).alias("s"))).otherwise(a)
    return F.aggregate(F.sequence(F.lit(1), F.lit(14)), F.struct(n.alias("m"), F.lit("").alias("s")), step)["s"]


def lower_bound(numbers, x) -> Column:
    """How many of a sorted array's numbers are smaller than ``x``, by binary search."""
    a, x = _c(numbers), _c(x)
    half = lambda s: F.shiftright(s["lo"] + s["hi"], 1)
    step = lambda s, _: F.when(s["lo"] >= s["hi"], s).when(F.get(a, half(s)) < x, F.struct((half(s) + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), half(s).alias("hi")))
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(a) + 1)).cast("int"))
    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(a).alias("hi")), step)["lo"]


def line_of(text, offset) -> Column:
    """0-based line of a 0-based offset in code points."""
    p = F.substring(_c(text), F.lit(1), _c(offset))
    return F.length(p) - F.length(F.replace(p, F.lit("\n"), F.lit("")))


def column_of(text, offset) -> Column:
    p = F.substring(_c(text), F.lit(1), _c(offset))
    return F.length(F.substring_index(p, "\n", -1))


def log_level(line) -> Column:
    """error before warn, case-insensitive, else info."""
    u = F.upper(_c(line))
    return F.when(u.contains("[ERROR]"), "error").when(u.contains("[WARN]"), "warn").otherwise("info")


def cals_width(text, total) -> Column:
    """Proportional ``N*`` as a percentage of the total, a bare number as pixels, anything else as it is."""
    w = js_trim(text)
    part = F.when(w == "*", F.lit(1.0)).otherwise(F.regexp_extract(w, r"^([0-9.]+)\*$", 1).try_cast("double"))
    return F.when(w.rlike(r"^[0-9.]*\*$"), F.format_string("%.2f%%", 100 * part / _c(total))).when(w.rlike(r"^[0-9.]+$"), F.concat(w, F.lit("px"))).otherwise(w)
