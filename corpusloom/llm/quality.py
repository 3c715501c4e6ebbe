"""Operator 8: quality rules whose thresholds come from mergeable quantile sketches per language and source.

Base rules are fixed by contract (``text_stats``). The adaptive part measures three ratios (symbols per character, repeated lines, word length) per document, in whole
per-mille or hundredths, and keeps one sketch of each ratio per (language, source): a histogram over integer bins of
seven significant bits (relative error below 1/64, at most a few thousand bins whatever the input). Sketches merge by
adding counts, so they are built by partial aggregation and rolled up to language and corpus level; a group of fewer
than ``min_rows`` documents takes its language's thresholds, then the corpus's. A document fails when a ratio lies
beyond ``median + max(reach * (q75 - median), slack)``; short mean word length fails below the mirrored lower fence.

Null texts count as empty (no words, base_failed). Null languages and sources form groups of their own. Empty tables
give empty results. Repeated rows are judged alike. Extra columns pass through ``filter_documents`` untouched, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import forget, shared_dir, small_batches, splitmix, written

STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"
#: White space and symbols of the base rules.
SPACE, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
#: Ratio -> least distance of the fence from the median.
SLACK = {"symbols": 30, "dup_lines": 300, "word_length": 200}
REACH, MIN_ROWS = 4, 200


def text_stats(text: str | None) -> tuple[int, ...]:
    """The counts of STATS for one whole text."""
    import numpy as np

    if not text:
        return (0,) * 6
    words = text.encode("utf-8", "surrogatepass").split()  # on bytes: exactly the six ASCII white-space characters
    n = len(words)
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    repeats = 0
    if n > 8:
        seen: dict = {}
        v = splitmix(np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.uint64, n))
        with np.errstate(over="ignore"):
            h = v[: n - 7].copy()
            for k in range(1, 8):
                h = h * np.uint64(0x9E3779B97F4A7C15) + v[k : n - 7 + k]
        _, where, counts = np.unique(h, return_inverse=True, return_counts=True)
        if len(counts) < len(h):
            starts = np.flatnonzero(counts[where] > 1)
            edge = np.zeros(n + 1, np.int64)
            np.add.at(edge, starts, 1)
            np.add.at(edge, starts + 8, -1)
            repeats = int((np.cumsum(edge)[:n] > 0).sum())
    return n, len(text) - sum(map(text.count, SPACE)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeats, len(lines)


def stats_column(text_col: str) -> Column:
    """The struct of STATS of a text column."""

    def stats(texts):
        import pandas as pd

        forget()
        return pd.DataFrame([text_stats(t) for t in texts], columns=[c.split()[0] for c in STATS.split(", ")], dtype="int64")

    # Declared nondeterministic so that the plan never runs it again for each use of its column.
    return F.pandas_udf(stats, STATS).asNondeterministic()(F.col(text_col))


def base_failed(s: str) -> Column:
    return (F.col(f"{s}.n_words") < 20) | (100 * F.col(f"{s}.n_repeat_words") > 30 * F.col(f"{s}.n_words"))


def ratios(s: str) -> dict[str, Column]:
    """The adaptive ratios of a document that passed the base rules, as whole numbers."""
    per = lambda a, b: F.expr(f"{a} div greatest({b}, 1)")
    return {
        "symbols": per(f"1000 * {s}.n_symbols", f"{s}.word_chars"), "dup_lines": per(f"1000 * {s}.n_dup_lines", f"{s}.n_lines"),
        "word_length": per(f"100 * {s}.word_chars", f"{s}.n_words"),
    }


def bin_of(v: str) -> Column:
    """The lower edge of a value's bin: its seven leading bits."""
    return F.expr(f"CASE WHEN {v} < 128 THEN {v} ELSE shiftleft(shiftright({v}, length(bin({v})) - 7), length(bin({v})) - 7) END")


def thresholds(stats: DataFrame, min_rows: int = MIN_ROWS, reach: int = REACH, slack: dict[str, int] = SLACK) -> DataFrame:
    """(__lang, __source, <ratio>_lo, <ratio>_hi): one row per language and source that occurs.

    ``stats`` has __lang, __source and the struct __stats.
    """
    ok = stats.where(~base_failed("__stats")).select("__lang", "__source", *[c.alias(k) for k, c in ratios("__stats").items()])
    long = ok.select("__lang", "__source", F.explode(F.array(*[F.struct(F.lit(k).alias("ratio"), F.col(k).alias("v")) for k in slack])).alias("x")).select("__lang", "__source", "x.ratio", bin_of("x.v").alias("bin"))
    sketch = long.groupBy("__lang", "__source", "ratio", "bin").agg(F.count("*").alias("n"))
    merged = sketch.unionByName(sketch.groupBy("__lang", "ratio", "bin").agg(F.sum("n").alias("n")).withColumn("__source", F.lit(None).cast("string"))).unionByName(
        sketch.groupBy("ratio", "bin").agg(F.sum("n").alias("n")).withColumns({"__lang": F.lit(None).cast("string"), "__source": F.lit(None).cast("string")}))
    group = ["__lang", "__source", "ratio"]
    run = merged.withColumn("below", F.sum("n").over(Window.partitionBy(*group).orderBy("bin"))).withColumn("total", F.sum("n").over(Window.partitionBy(*group)))
    at = lambda p: F.min(F.when(100 * F.col("below") >= p * F.col("total"), F.col("bin")))
    q = run.groupBy(*group).agg(F.max("total").alias("total"), at(25).alias("q25"), at(50).alias("q50"), at(75).alias("q75"))
    least = F.create_map(*[F.lit(x) for kv in slack.items() for x in kv])[F.col("ratio")].cast("long")
    fence = q.select(
        *group, "total",
        (F.col("q50") - F.greatest(reach * (F.col("q50") - F.col("q25")), least)).alias("lo"), (F.col("q50") + F.greatest(reach * (F.col("q75") - F.col("q50")), least)).alias("hi"),
    )
    wide = fence.groupBy("__lang", "__source").agg(F.max("total").alias("total"), *[F.max(F.when(F.col("ratio") == k, F.col(e))).alias(f"{k}_{e}") for k in slack for e in ("lo", "hi")])
    names = [f"{k}_{e}" for k in slack for e in ("lo", "hi")]
    own = wide.where("__source IS NOT NULL")
    of_lang = wide.where("__source IS NULL AND __lang IS NOT NULL").select("__lang", F.struct("total", *names).alias("l"))
    of_all = wide.where("__lang IS NULL").select(F.struct(*names).alias("a"))  # one row
    groups = stats.select("__lang", "__source").distinct()
    out = groups.join(own.select("__lang", "__source", F.struct("total", *names).alias("o")), ["__lang", "__source"], "left").join(of_lang, "__lang", "left").join(F.broadcast(of_all), F.lit(True), "left")
    pick = lambda n: F.when(F.col("o.total") >= min_rows, F.col(f"o.{n}")).when(F.col("l.total") >= min_rows, F.col(f"l.{n}")).otherwise(F.col(f"a.{n}"))
    return out.select("__lang", "__source", *[pick(n).alias(n) for n in names])


#: Groups up to this number (about 100 bytes each) are broadcast; more are joined by shuffle.
MOST_BROADCAST = 50_000


def judged(spark: SparkSession, docs: DataFrame, limits: DataFrame, n_groups: int) -> DataFrame:
    """``docs`` (with __lang, __source, __stats) and booleans __base_failed and __kept, by a join with the thresholds."""
    joined = docs.join(limits.hint("broadcast" if n_groups <= MOST_BROADCAST else "merge"), ["__lang", "__source"], "left")
    inside = F.lit(True)
    for k, c in ratios("__stats").items():
        inside &= (c <= F.coalesce(F.col(f"{k}_hi"), c)) & ((c >= F.coalesce(F.col(f"{k}_lo"), c)) if k == "word_length" else F.lit(True))
    return joined.withColumn("__base_failed", base_failed("__stats")).withColumn("__kept", ~F.col("__base_failed") & inside)


def _with_groups(docs: DataFrame) -> DataFrame:
    """Null languages and sources take a name of their own, apart from every text."""
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    return docs.withColumns({"__lang": name("lang"), "__source": name("source")})


def quality_report(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed and kept for every document."""
    small_batches(spark)
    folder = shared_dir(spark)
    stats = written(spark, _with_groups(docs.select("doc_id", "lang", "source", "text")).select("doc_id", "__lang", "__source", stats_column("text").alias("__stats")), f"{folder}/stats")
    limits = written(spark, thresholds(stats), f"{folder}/thresholds")
    out = judged(spark, stats, limits, limits.count())
    return out.select("doc_id", *[f"__stats.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], F.col("__base_failed").alias("base_failed"), F.col("__kept").alias("kept"))


def filter_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns.

    Counts are taken once for the sketches and once in the filter: reading twice is cheaper than shuffling the texts.
    """
    small_batches(spark)
    folder = shared_dir(spark)
    # The row travels as one column, so none of its names can meet those used here.
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), "lang", "source", "text")
    counted = _with_groups(rows).withColumn("__stats", stats_column("text")).drop("lang", "source", "text")
    limits = written(spark, thresholds(counted.select("__lang", "__source", "__stats")), f"{folder}/thresholds")
    return judged(spark, counted, limits, limits.count()).where("__kept").select("__row.*")
