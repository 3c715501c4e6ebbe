"""Operator 7: token ids as length-delimited binary records with a separate offset index.

File format, all integers little-endian: per record ``length u64 | masked crc32(length) u32 | payload | masked
crc32(payload) u32``; the mask rotates a checksum right by 15 bits and adds 0xA282EAD8. The payload is ``doc_id i64``
and the ids: two bytes each where the vocabulary fits, else four. Checksums are CRC-32 (zlib), which runs at memory speed in Python. The index is a Parquet table:
one row per record with file, byte offset, payload length, number of tokens and the token position in the whole output,
so that a reader can fetch records in any order. Files hold documents in ascending doc_id order, and file numbers
follow that order too.

Nulls and empty texts become records with the end id alone; repeated rows and equal doc_ids are kept (order among
them is by text). Rows without doc_id come first and are stored under the smallest integer, read back as null.
Each attempt writes files under names of its own, and only files named in the committed index are ever read: a lost
executor or a repeated task leaves files behind, never wrong results.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import Encoder, Vocabulary, byte_symbols, slices
from .common import CACHES, open_fs, shared_dir, small_batches, written

INDEX = "part int, file string, doc_id long, seq long, offset long, length long, n_tokens long, before long"
_NO_ID = -(1 << 63)


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def u32(n: int) -> bytes:
    return n.to_bytes(4, "little")


def frame(payload: bytes) -> bytes:
    head = len(payload).to_bytes(8, "little")
    return head + u32(masked(head)) + payload + u32(masked(payload))


def key_bytes(key: int | None) -> bytes:
    return (_NO_ID if key is None else key).to_bytes(8, "little", signed=True)


def key_of(payload: bytes) -> int | None:
    key = int.from_bytes(payload[:8], "little", signed=True)
    return None if key == _NO_ID else key


def unframe(data: bytes, at: int = 0) -> tuple[bytes, int]:
    """(payload, position after the record); a wrong checksum or a short record is an error."""
    head = data[at : at + 8]
    if len(head) < 8 or int.from_bytes(data[at + 8 : at + 12], "little") != masked(head):
        raise ValueError(f"record at {at}: bad length")
    n = int.from_bytes(head, "little")
    payload = data[at + 12 : at + 12 + n]
    if len(payload) < n or int.from_bytes(data[at + 12 + n : at + 16 + n], "little") != masked(payload):
        raise ValueError(f"record at {at}: bad payload")
    return payload, at + 16 + n


def id_width(vocabulary_path: str) -> int:
    """Bytes of an id in the files: 2 if the vocabulary's ids (with special tokens) fit, else 4."""
    import json

    with open(vocabulary_path, encoding="utf-8") as f:
        spec = json.load(f)
    return 2 if max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]) < 1 << 16 else 4


def resize(ids: bytes, old: int, new: int) -> bytes:
    """Little-endian ids of ``old`` bytes each as ids of ``new`` bytes."""
    import numpy as np

    return ids if old == new else np.frombuffer(ids, f"<u{old}").astype(f"<u{new}").tobytes()


#: Pieces remembered by an encoder: the library's model takes words one by one, so more are kept (about 160 MB), and from task to task.
REMEMBERED = 800_000
_LOADED: dict = {}
CACHES.append(_LOADED)


class LibraryEncoder(Encoder):
    """Words encoded by the tokenizers library's own model; pre-tokenizing and remembering words as in ``bpe``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        v, model = Vocabulary(path), Tokenizer.from_file(path).model
        if hasattr(model, "_resize_cache"):
            model._resize_cache(0)  # words are remembered here; the library's own cache would only be filled
        self.tokenize, self.table = model.tokenize, dict(enumerate(byte_symbols()))
        self.id_bytes = [u32(i) for i in range(max(v.bytes_of) + 1)]
        super().__init__(lambda words: [self._word(w.decode("utf-8", "surrogatepass")) for w in words], v.special, v.split, REMEMBERED, aged=True)

    def _word(self, w: str) -> bytes:
        plain = w.isascii() and w.isprintable()  # such characters, but for the space, stand for themselves
        symbols = w.replace(" ", "\u0120") if plain else w.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.table)
        return b"".join([self.id_bytes[t.id] for t in self.tokenize(symbols)])


def library_encoder(path: str) -> Encoder:
    """The library's encoder of this Python worker."""
    if path not in _LOADED:
        _LOADED.clear()
        _LOADED[path] = LibraryEncoder(path)
    return _LOADED[path]


def write_records(spark: SparkSession, docs: DataFrame, vocabulary_path: str, folder: str, end_id: int = 0, partitions: int | None = None) -> DataFrame:
    """Encode ``docs`` (doc_id, text), write record files into ``folder``, return the index of the files that count."""

    small_batches(spark)
    width = id_width(vocabulary_path)

    def write(batches: Iterable) -> Iterator:
        import uuid

        import pyarrow as pa
        from pyspark import TaskContext

        enc, (fs, root) = library_encoder(vocabulary_path), open_fs(folder)
        part, out, name = TaskContext.get().partitionId(), None, None
        offset = before = seq = 0
        for b in batches:
            rows, buf = [], []
            encoded = (ids for part in slices(t.as_py() for t in b.column(1)) for ids in enc.encode_many(part))
            for doc_id, ids in zip(b.column(0), encoded):
                ids += u32(end_id)
                key = doc_id.as_py()
                payload = key_bytes(key) + resize(ids, 4, width)
                buf.append(frame(payload))
                rows.append((part, None, key, seq, offset, len(payload), len(ids) // 4, before))
                seq, offset, before = seq + 1, offset + len(buf[-1]), before + len(ids) // 4
            if out is None:
                name = f"records-{part:06d}-{uuid.uuid4().hex}.bin"
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(f"{root}/{name}", compression=None)
            out.write(b"".join(buf))
            cols = list(zip(*rows)) or [()] * 8
            cols[1] = [name] * len(rows)
            kinds = [pa.int32(), pa.string(), *[pa.int64()] * 6]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [c.split(" ")[0] for c in INDEX.split(", ")])
        if out is not None:
            out.close()

    keyed = docs.select("doc_id", "text")
    ordered = (keyed.repartitionByRange(partitions, "doc_id", F.xxhash64("text")) if partitions else keyed.repartitionByRange("doc_id", F.xxhash64("text"))).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    index = written(spark, ordered.mapInArrow(write, INDEX), f"{folder}-index-raw")
    files = index.groupBy("part").agg(F.sum("n_tokens").alias("total"))  # one row per file
    base = files.select("part", F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return index.join(base.hint("shuffle_hash"), "part").withColumn("start", F.col("base") + F.col("before")).drop("before", "base")


def read_records(index: DataFrame, folder: str, gap: int = 1 << 16, most: int = 8 << 20) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the records an index names, checksums tested.

    Records are dealt by (file, 8 MB range), sorted by offset, and neighbours are fetched in one ranged read.
    """

    def read(batches: Iterable) -> Iterator:
        import pyarrow as pa

        fs, root = open_fs(folder)
        handles: dict = {}

        def flush(run: list):
            if handles.get("name") != run[0][0]:
                if "file" in handles:
                    handles["file"].close()
                handles.update(name=run[0][0], file=fs.open_input_file(f"{root}/{run[0][0]}"))
            lo = run[0][1]
            handles["file"].seek(lo)
            data = handles["file"].read(run[-1][1] + run[-1][2] + 16 - lo)
            ids, keys = [], []
            for _, off, length, _, _ in run:
                payload, _ = unframe(data[off - lo : off - lo + length + 16])
                keys.append(key_of(payload))
                n = run[len(ids)][4]
                ids.append(resize(payload[8:], (len(payload) - 8) // n, 4))
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([r[3] for r in run], pa.int64()), pa.array([r[4] for r in run], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

        run: list = []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if run and (row[0] != run[0][0] or row[1] + row[2] - run[0][1] > most or row[1] - (run[-1][1] + run[-1][2]) > gap):
                    yield flush(run)
                    run = []
                run.append(row)
        if run:
            yield flush(run)
        if "file" in handles:
            handles["file"].close()

    dealt = index.select("file", "offset", "length", "start", "n_tokens", F.expr(f"offset div {most}").alias("range"))
    # The number of tasks follows the bytes they will read, not the index's own few.
    tasks = max(1, -(-(index.agg(F.sum("length")).head()[0] or 0) // most))
    dealt = dealt.repartition(tasks, "file", "range").sortWithinPartitions("file", "offset").drop("range")
    return dealt.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def binary_output(spark: SparkSession, docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the written files."""
    folder = shared_dir(spark) + "/records"
    back = read_records(write_records(spark, docs, vocabulary_path, folder), folder)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
