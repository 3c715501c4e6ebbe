"""Operator 11: byte-level BPE of long texts in overlapping chunks.

A text longer than a chunk is cut into chunks of ``chunk`` characters that overlap by ``overlap``; every chunk is
pre-tokenised in its own task from its first character, although that may lie inside a word. Scanning is left to right
and looks at nothing before its place, so from the first boundary that a chunk shares with its predecessor inside the
overlap both agree: there the two are stitched. Each chunk then encodes the words between its stitch and the next one,
and the ids of a text are put together in chunk order. Boundaries in the last eight characters of a chunk are not trusted (what follows
could move them). If an overlap holds no common boundary (one word longer than it), that text is done again with chunks and overlaps
sixteen times as long, until it fits or is one chunk: the result does not depend on the cut. Texts of one chunk have
nothing to stitch and are encoded where they lie. Decoding concatenates the bytes of the ids.

Words are encoded one by one by the ranks of the vocabulary, distinct ones once per task. Null and empty texts give no
ids and decode to no bytes. Repeated rows give repeated results. Extra columns pass through (``ids`` and ``decoded``
are replaced). The
strings of special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import CACHES, drop, forget, fresh, shared_dir, small_batches, written

CHUNK, OVERLAP, GROW = 1 << 15, 1 << 10, 16
#: Characters behind a boundary that must be seen to trust it: more than any alternative of the pattern looks ahead.
AHEAD = 8
#: Words that an encoder remembers, and how long they may be: bounds memory, never results.
REMEMBERED, REMEMBERED_CHARS = 200_000, 64
_LOADED: dict = {}
CACHES.append(_LOADED)


def _classes(members: str) -> str:
    """A set of characters as ranges of a pattern."""
    at = np.sort(np.frombuffer(members.encode("utf-32-le"), np.uint32)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(at) != 1) + 1
    return "".join(f"\\U{a[0]:08x}-\\U{a[-1]:08x}" for a in np.split(at, cuts) if len(a))


class WordEncoder:
    """Cuts texts by the vocabulary's pattern and encodes their words by its ranks."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.model = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = {b: a for a, b in ranks.items()}
        # The library's own idea of letters, digits and spaces: its Unicode tables may be older or newer than Python's.
        every, single = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)])), {bytes([i]): i for i in range(256)}
        of = lambda cls: bytes(tiktoken.Encoding("class", pat_str=cls, mergeable_ranks=single, special_tokens={}).encode_ordinary(every)).decode()
        members = {name: of(rf"\{name}") for name in ("p{L}", "p{N}", "s")}

        def spelled(most: int) -> re.Pattern:
            """The pattern with every class, inside brackets or not, written out as ranges of characters below ``most``."""
            sets = {name: _classes("".join(x for x in m if ord(x) < most)) for name, m in members.items()}
            sets["S"] = "^" + sets["s"]
            inside = lambda m: re.sub(r"\\(p\{[LN]\}|s)", lambda x: sets[x[1]], m[0])
            return re.compile(re.sub(r"\\(p\{[LN]\}|[sS])", lambda x: f"[{sets[x[1]]}]", re.sub(r"\[[^\]]*\]", inside, pattern)))

        # Three spellings of one pattern, all exact: for ASCII texts, for texts without a character that Python's tables class
        # otherwise, and for all texts.
        odd = set().union(*(set(m) ^ set(regex.findall(rf"\{name}", every)) for name, m in members.items()))
        self.ascii, self.common, self.exact = spelled(128), regex.compile(pattern), spelled(0x110000)
        self.odd = re.compile(f"[{_classes(''.join(odd))}]") if odd else None
        self.known: dict[str, bytes] = {}

    def words(self, text: str) -> re.Pattern:
        """The fastest spelling of the pattern that is exact for this text."""
        return self.ascii if text.isascii() else self.exact if self.odd and self.odd.search(text) else self.common

    def boundaries(self, text: str, last: bool) -> list[int]:
        """Where words begin, as far as that can be trusted."""
        out = [m.start() for m in self.words(text).finditer(text)]
        return out if last else [x for x in out if x + AHEAD <= len(text)]

    def encode(self, text: str, upto: int | None = None) -> bytes:
        """Ids (little-endian, four bytes each) of the words before ``upto``, a boundary; the text behind it decides where they end."""
        known, words = self.known, self.words(text).findall(text)
        over = len(text) - upto if upto is not None else 0
        while over > 0:
            over -= len(words.pop())
        single = lambda w: array("I", self.model._encode_single_piece(w)).tobytes()
        new = set(words).difference(known)
        known.update((w, single(w)) for w in new)
        out = b"".join(map(known.__getitem__, words))
        if len(known) > REMEMBERED:
            known.clear()
        else:
            for w in new:
                if len(w) > REMEMBERED_CHARS:
                    del known[w]
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


def encoder(path: str, pattern: str) -> WordEncoder:
    if (path, pattern) not in _LOADED:
        forget()
        _LOADED[path, pattern] = WordEncoder(path, pattern)
    return _LOADED[path, pattern]


def _ids_array(ids: list[bytes]):
    import pyarrow as pa

    ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32)))


def encode_column(path: str, pattern: str, text) -> Column:
    """Struct (ids, decoded): the ids of whole texts and the bytes that they stand for."""

    def run(texts: pd.Series) -> pd.DataFrame:
        enc = encoder(path, pattern)
        ids = [np.frombuffer(enc.encode(t), "<i4") if t else np.zeros(0, np.int32) for t in texts]
        return pd.DataFrame({"ids": ids, "decoded": list(map(enc.decode, ids))})

    return F.pandas_udf(run, "ids array<int>, decoded binary")(text)


def decode_column(path: str, pattern: str, ids) -> Column:
    """Bytes of ids."""

    def run(ids: pd.Series) -> pd.Series:
        enc = encoder(path, pattern)
        return pd.Series([enc.decode(np.asarray(x)) for x in ids])

    return F.pandas_udf(run, "binary")(ids)


def cut_texts(texts: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(row, k, last, piece): chunks of texts(row, text); chunk k begins at k * chunk and reaches ``overlap`` beyond its end."""

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        names, rows, size = ["row", "k", "last", "piece"], [], 0
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.bool_(), pa.string()))], names)
        for b in batches:
            for row, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = text.as_py()
                n = max(1, -(-(len(text) - overlap) // chunk))
                for k in range(n):
                    rows.append((row, k, k + 1 == n, text[k * chunk :] if k + 1 == n else text[k * chunk : (k + 1) * chunk + overlap]))
                    size += len(rows[-1][3])
                    if size >= 1 << 21:
                        yield batch()
                        rows, size = [], 0
        if rows:
            yield batch()

    return texts.select("row", "text").mapInArrow(run, "row long, k int, last boolean, piece string")


def chunk_boundaries(chunks: DataFrame, chunk: int, overlap: int, path: str, pattern: str) -> DataFrame:
    """(row, k, last, head, tail): word boundaries of each chunk in the overlap with its predecessor and with its successor, both
    counted from where that overlap begins."""

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        enc, ints = encoder(path, pattern), pa.list_(pa.int32())
        for b in batches:
            head, tail = [], []
            for last, piece in zip(b.column(2).to_pylist(), b.column(3)):
                at = enc.boundaries(piece.as_py(), last)
                head.append([x for x in at if x <= overlap])
                tail.append([] if last else [x - chunk for x in at if x >= chunk])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(head, ints), pa.array(tail, ints)], ["row", "k", "last", "head", "tail"])

    return chunks.select("row", "k", "last", "piece").mapInArrow(run, "row long, k int, last boolean, head array<int>, tail array<int>")


def stitches(bounds: DataFrame) -> DataFrame:
    """(row, k, from, to, whole): the part of each chunk that is its own, from its stitch to the next one; ``whole``: every chunk of
    the text found its stitch."""
    c, w = F.col, Window.partitionBy("row").orderBy("k")
    met = bounds.withColumn("from", F.when(c("k") == 0, 0).otherwise(F.array_min(F.array_intersect("head", F.lag("tail").over(w)))))
    nexts = met.withColumn("to", F.lead("from").over(w))
    return nexts.select("row", "k", "last", "from", "to", F.min(c("from").isNotNull()).over(Window.partitionBy("row")).alias("whole"))


def encode_parts(parts: DataFrame, chunk: int, path: str, pattern: str) -> DataFrame:
    """(row, k, ids binary) of parts(row, k, from, to, piece)."""

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        enc = encoder(path, pattern)
        for b in batches:
            cut = lambda lo, hi, p: enc.encode(p[lo:]) if hi is None else enc.encode(p[lo : chunk + hi + AHEAD], chunk + hi - lo)
            ids = [cut(*x) for x in zip(*(b.column(n).to_pylist() for n in (2, 3, 4)))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.binary())], ["row", "k", "ids"])

    return parts.select("row", "k", "from", "to", "piece").mapInArrow(run, "row long, k int, ids binary")


def join_parts(parts: DataFrame) -> DataFrame:
    """(row, ids): the ids of each text's parts in order."""

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        row, held = None, []
        out = lambda: pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), _ids_array([b"".join(held)])], ["row", "ids"])
        for b in batches:
            for r, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if r != row and row is not None:
                    yield out()
                    held = []
                row = r
                held.append(ids)
        if row is not None:
            yield out()

    return parts.repartition("row").sortWithinPartitions("row", "k").select("row", "k", "ids").mapInArrow(run, "row long, ids array<int>")


def encode_long(spark: SparkSession, texts: DataFrame, path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """(row, ids) of texts(row, text), in overlapping chunks."""
    done = None
    while True:
        chunks = written(spark, cut_texts(texts, chunk, overlap), shared_dir(spark))
        cuts = written(spark, stitches(chunk_boundaries(chunks, chunk, overlap, path, pattern)), shared_dir(spark))
        parts = chunks.drop("last").hint("merge").join(cuts.where("whole").select("row", "k", "from", "to"), ["row", "k"])
        ids = join_parts(encode_parts(parts, chunk, path, pattern))
        done = ids if done is None else done.unionByName(ids)
        left = cuts.where("NOT whole").select("row").distinct()
        if left.isEmpty():
            return done
        texts = texts.join(left.hint("merge"), "row", "left_semi")
        chunk, overlap = chunk * GROW, overlap * GROW


def encode_documents(spark: SparkSession, docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``docs`` with ``ids`` (array of int), the ids of its column ``text``, and ``decoded`` (binary), the bytes of these ids."""
    small_batches(spark)
    docs = docs.drop("ids", "decoded")
    long_ = F.coalesce(F.length("text") > chunk + overlap, F.lit(False))
    both = fresh(docs, "coded")
    short = docs.where(~long_).withColumn(both, encode_column(path, pattern, F.col("text"))).withColumns({"ids": F.col(both)["ids"], "decoded": F.col(both)["decoded"]}).drop(both)
    row = fresh(docs, "row")
    # Rows are numbered once and written: a repeated task must give a text the same number.
    kept = written(spark, docs.where(long_).withColumn(row, F.monotonically_increasing_id()), folder := shared_dir(spark))
    if kept.isEmpty():
        drop(spark, folder)
        return short
    ids = encode_long(spark, kept.select(F.col(row).alias("row"), "text"), path, pattern, chunk, overlap).select(F.col("row").alias(row), "ids")
    whole = kept.hint("merge").join(ids, row).drop(row)
    return short.unionByName(whole.withColumn("decoded", decode_column(path, pattern, F.col("ids"))))


def roundtrip(spark: SparkSession, docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    coded = encode_documents(spark, docs.select("doc_id", "text"), path, pattern, chunk, overlap)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
