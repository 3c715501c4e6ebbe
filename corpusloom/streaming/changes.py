"""Streams of document changes and log chunks, and their batch twins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.store import big
from .lifecycle import watched


def debounced(changes: DataFrame, gap: str = "700 milliseconds", watermark: str = "10 seconds") -> DataFrame:
    """The last content of each burst of changes of a document. changes: path, ts, op, content; batch or stream."""
    c = changes.withWatermark("ts", watermark) if changes.isStreaming else changes
    return c.groupBy("path", F.session_window("ts", gap).alias("w")).agg(F.max_by("content", F.struct("ts", "content")).alias("content"), F.count("*").alias("n")).select("path", F.col("w.start").alias("first_ts"), F.col("w.end").alias("due"), "content", "n")


def validated(changes: DataFrame, validate: Callable[[DataFrame], None], checkpoint: str, gap_ms: int = 700, watermark: str = "10 seconds"):
    """A streaming query: signals of documents (``lifecycle.SIGNALS``) reach ``validate``: opens and saves at once, changes when nothing
    followed them in time, closes as tombstones; what a close finds waiting never comes."""
    return watched(changes, validate, checkpoint, gap_ms, watermark)


def republished(changes: DataFrame, publish: Callable[[DataFrame], None], checkpoint: str, gap: str = "300 milliseconds", available_now: bool = False):
    """A streaming query: when a burst of changes of a document has ended, ``publish`` gets (path, content, ...) to draw it anew."""
    w = debounced(changes.where("op IN ('change', 'save')"), gap).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: publish(df))
    return (w.trigger(availableNow=True) if available_now else w).start()


def open_documents(changes: DataFrame) -> DataFrame:
    """Batch: (path, open, content): the last state of each document; a close drops what was pending and found for it."""
    last = changes.groupBy("path").agg(F.max_by(F.struct("op", "content"), F.struct("ts", F.col("op") == "close")).alias("x"))
    is_open = F.col("x.op") != "close"
    return last.select("path", is_open.alias("open"), F.when(is_open, F.col("x.content")).alias("content"))


def stream_closed(changes: DataFrame) -> DataFrame:
    """Stream: (path, content, closed) per document: the content to check after each batch of changes, or a tombstone when it was
    closed; a close also forgets the state, so nothing that was pending comes out later."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key: tuple, frames: Iterator, state) -> Iterator:
        import pandas as pd

        rows = sorted(((r.ts, r.op == "close", r.content) for f in frames for r in f.itertuples()), key=lambda r: r[:2])
        _, closed, content = rows[-1]
        if closed:
            if state.exists:
                state.remove()
        else:
            state.update((content,))
        yield pd.DataFrame({"path": [key[0]], "content": [None if closed else content], "closed": [closed]})

    return changes.groupBy("path").applyInPandasWithState(step, "path string, content string, closed boolean", "content string", "append", GroupStateTimeout.NoTimeout)


def affected_scopes(changed: DataFrame, reach: DataFrame) -> DataFrame:
    """(scope_dir): folders whose key space must be made anew: those that search a changed map. changed: path; reach: scope_dir,
    map_path (all maps that a folder's keys come from, for example ``refs.key_search_order``)."""
    return reach.join(big(changed.select(F.col("path").alias("map_path")).distinct()), "map_path", "left_semi").select("scope_dir").distinct()


def affected_roots(changed: DataFrame, expanded: DataFrame) -> DataFrame:
    """(root_map): maps to draw anew: those that changed or that show an element of a map that did. expanded: ``maps.expand_maps``."""
    saved = changed.where(F.lower("path").endswith(".ditamap")).select("path").distinct()
    held = expanded.select("root_map", "src_map").distinct().join(big(saved.select(F.col("path").alias("src_map"))), "src_map", "left_semi").select("root_map")
    return held.unionByName(saved.select(F.col("path").alias("root_map"))).distinct()


def refreshed_maps(changes: DataFrame, refresh: Callable[[DataFrame], None], checkpoint: str):
    """A streaming query: saved maps (path) of each batch reach ``refresh``, which draws the roots of ``affected_roots``."""
    saved = changes.where((F.col("op") == "save") & F.lower("path").endswith(".ditamap")).select("path", "ts")
    return saved.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: refresh(df.select("path").distinct())).start()


def log_lines(chunks: DataFrame) -> DataFrame:
    """Batch: lines (run, line_no, line, level) of chunks (run, seq, chunk); a last line without its end counts.

    Lines are cut where chunks hold their ends, so a run is never gathered: only the pieces of one line are.
    """
    w = Window.partitionBy("run").orderBy("seq")
    pieces = chunks.select("run", "seq", F.posexplode(F.split("chunk", "\n")).alias("k", "piece"))
    total = chunks.select("run", "seq", (F.size(F.split("chunk", "\n")) - 1).alias("ends"))
    base = total.withColumn("before", F.coalesce(F.sum("ends").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    lines = pieces.join(big(base.select("run", "seq", "before")), ["run", "seq"]).groupBy("run", (F.col("before") + F.col("k")).alias("line_no")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "k", "piece"))), lambda x: x["piece"]), "").alias("line"))
    last = base.groupBy("run").agg(F.sum("ends").alias("last"))
    return lines.join(big(last), "run").where("line <> '' OR line_no < last").select("run", F.col("line_no").cast("long").alias("line_no"), "line", T.log_level("line").alias("level"))


def stream_log_lines(chunks: DataFrame) -> DataFrame:
    """Stream: complete lines of each run; the tail is kept as state and comes out when 30 s pass without a chunk."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def cut(key: tuple, frames: Iterator, state) -> Iterator:
        import pandas as pd

        if state.hasTimedOut:
            tail = state.get[0]
            state.remove()
            yield pd.DataFrame({"run": [key[0]] * bool(tail), "line": [tail] * bool(tail)})
            return
        tail = state.get[0] if state.exists else ""
        rows = sorted((r for f in frames for r in zip(f["seq"], f["chunk"])), key=lambda r: r[0])
        *lines, tail = (tail + "".join(r[1] for r in rows)).split("\n")
        state.update((tail,))
        state.setTimeoutDuration(30_000)
        yield pd.DataFrame({"run": [key[0]] * len(lines), "line": lines})

    out = chunks.groupBy("run").applyInPandasWithState(cut, "run string, line string", "tail string", "append", GroupStateTimeout.ProcessingTimeTimeout)
    return out.withColumn("level", T.log_level("line"))


def level_counts(lines: DataFrame, every: str = "1 minute", watermark: str = "10 seconds") -> DataFrame:
    """(run, start, level, n) in tumbling windows of lines (run, ts, level); batch or stream."""
    c = lines.withWatermark("ts", watermark) if lines.isStreaming else lines
    return c.groupBy("run", F.window("ts", every).alias("w"), "level").agg(F.count("*").alias("n")).select("run", F.col("w.start").alias("start"), "level", "n")


def snapshot_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change): added, removed or touched between two snapshots (path, mtime)."""
    j = before.select("path", F.col("mtime").alias("m0")).join(after.select("path", F.col("mtime").alias("m1")), "path", "full_outer")
    kind = F.when(F.col("m0").isNull(), "added").when(F.col("m1").isNull(), "removed").when(F.col("m0") != F.col("m1"), "touched")
    return j.select("path", kind.alias("change")).where("change IS NOT NULL")
