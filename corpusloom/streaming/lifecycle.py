"""Open documents as a stream: one stateful operator per document for its pending change, its saves and its close.

A change waits for ``delay_ms`` of event time; a newer change takes its place; opens and saves pass at once and leave what
waits alone; a close drops what waits and passes as a tombstone. State is one value and one timer per document that has
something waiting, and nothing else: when the timer fires or the document is closed, both are gone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: What comes out: ``at_ms`` is the event time at which it is due.
SIGNALS = "path string, at_ms long, kind string, content string"
_STORE, _ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class PendingChange(StatefulProcessor):
    """The state of one document: the content that waits, and the time at which it is due."""

    def __init__(self, delay_ms: int):
        self.delay_ms = delay_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.waits = handle.getValueState("waits", "content string, due long")

    def handleInputRows(self, key: tuple, rows: Iterator, timerValues) -> Iterator:
        import pandas as pd

        out: list[tuple] = []
        waits = self.waits.get() if self.waits.exists() else None
        before = waits[1] if waits else None
        # Rows of a batch come in any order; of equal times a close is the last.
        for ms, _, op, content in sorted(((r.ms, r.op == "close", r.op, r.content) for f in rows for r in f.itertuples()), key=lambda r: r[:2]):
            if waits and waits[1] <= ms:
                out.append((key[0], waits[1], "settled", waits[0]))
                waits = None
            if op == "change":
                waits = (content, ms + self.delay_ms)
            elif op == "close":
                waits = None
                out.append((key[0], ms, "closed", None))
            elif op in ("open", "save"):
                out.append((key[0], ms, "now", content))
        if before is not None and (waits is None or waits[1] != before):
            self.handle.deleteTimer(before)
        if waits is None:
            self.waits.clear()
        else:
            self.waits.update((waits[0], int(waits[1])))
            if waits[1] != before:
                self.handle.registerTimer(int(waits[1]))
        if out:
            yield pd.DataFrame(out, columns=["path", "at_ms", "kind", "content"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        if self.waits.exists():
            content, due = self.waits.get()
            if due <= expiredTimerInfo.getExpiryTimeInMs():
                self.waits.clear()
                yield pd.DataFrame([(key[0], due, "settled", content)], columns=["path", "at_ms", "kind", "content"])

    def close(self) -> None:
        pass


def document_signals(changes: DataFrame, delay_ms: int = 700, watermark: str = "10 seconds") -> DataFrame:
    """Stream: signals (path, at_ms, kind, content) of changes(path, ts, op, content): ``now`` for opens and saves, ``settled`` for
    changes that nothing followed in time, ``closed`` for closes.

    Rows later than the watermark are dropped. The session must keep state in RocksDB (``keeping_state``).
    """
    c = changes.select("path", "ts", F.unix_millis("ts").alias("ms"), "op", "content").withWatermark("ts", watermark)
    return c.groupBy("path").transformWithStateInPandas(PendingChange(delay_ms), SIGNALS, "Append", "EventTime")


@contextmanager
def keeping_state(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, as timers need; the session's own setting comes back afterwards."""
    own = spark.conf.get(_STORE)
    spark.conf.set(_STORE, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_STORE, own)


def watched(changes: DataFrame, handle: Callable[[DataFrame], None], checkpoint: str, delay_ms: int = 700, watermark: str = "10 seconds", available_now: bool = False):
    """A streaming query: every batch of signals reaches ``handle``, which validates what is ``now`` or ``settled`` and drops what it
    knows of what is ``closed``. ``available_now``: stop when all there is has been read."""
    with keeping_state(changes.sparkSession):
        w = document_signals(changes, delay_ms, watermark).writeStream.outputMode("append").option("checkpointLocation", checkpoint)
        w = w.foreachBatch(lambda df, _: handle(df))
        return (w.trigger(availableNow=True) if available_now else w).start()


def settled_signals(changes: DataFrame, delay_ms: int = 700, until: Column | None = None) -> DataFrame:
    """Batch: the signals that the stream gives for all of ``changes``; what still waits at ``until`` (event time in ms; all of it
    without) does not come out."""
    ms = F.unix_millis("ts").alias("ms")
    w = Window.partitionBy("path").orderBy("ms", F.col("op") == "close")
    x = changes.select("path", ms, "op", "content").where("op IN ('change', 'close', 'open', 'save')")
    x = x.withColumn("next", F.min(F.when(F.col("op").isin("change", "close"), F.col("ms"))).over(w.rowsBetween(1, Window.unboundedFollowing)))
    due = F.col("ms") + delay_ms
    fires = (F.col("op") != "change") | F.col("next").isNull() | (F.col("next") >= due)
    x = x.where(fires)
    if until is not None:
        last = F.max("ms").over(Window.partitionBy("path"))
        x = x.withColumn("last", last).where((F.col("op") != "change") | (due <= until) | (due <= F.col("last")))
    kind = F.when(F.col("op") == "change", "settled").when(F.col("op") == "close", "closed").otherwise("now")
    return x.select("path", F.when(F.col("op") == "change", due).otherwise(F.col("ms")).alias("at_ms"), kind.alias("kind"), F.when(F.col("op") != "close", F.col("content")).alias("content"))
