"""Operator 10: WARC archives written with an index first, read back by coalesced byte ranges.

Records are gzip members of ``*.warc.gz`` files, one file per task. Each task returns an index row per record (file,
offset, length, URL, digest, type and ids), and the index is a table of its own: selecting records is a query on the
index, and only the selected byte ranges are read, sorted and merged where they lie close together. A payload that
occurs again (``min_bytes`` and longer) is stored once, in the response with the largest page_id; the others are revisit
records that carry the digest and, in their HTTP header, the full payload's length.

Null html is an empty payload, null urls are written as an empty URI. Rows with the same page_id and payload are all
responses if theirs is the largest id; a null page_id never is the largest (if all are null, all are responses). Extra
columns are ignored, an empty table gives no records. Files of failed attempts are never in the index.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import open_fs, shared_dir, small_batches, written

INDEX = "file string, offset long, length long, url string, digest string, record_type string, page_id long, refers_to long"
GAP, MOST = 1 << 16, 8 << 20


def with_types(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """page_id, url, payload, digest (hex SHA-1), record_type, refers_to."""
    p = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha1("payload"))
    narrow = pages.select("page_id", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")).where(F.octet_length("payload") >= min_bytes)
    first = narrow.groupBy(F.sha1("payload").alias("digest"), F.octet_length("payload").alias("size")).agg(F.max("page_id").alias("holder"), F.count("*").alias("n")).where("n > 1 AND holder IS NOT NULL")
    out = p.withColumn("size", F.octet_length("payload")).join(first.drop("n").hint("merge"), ["digest", "size"], "left")
    again = F.col("holder").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("holder"))
    return out.select("page_id", "url", "payload", "digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("holder")).alias("refers_to"))


def record(kind: str, page_id, url: str, digest: str, payload: bytes, refers_to) -> bytes:
    """One WARC/1.1 record."""
    import base64

    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if kind == "revisit" else http + payload
    sha = base64.b32encode(bytes.fromhex(digest)).decode()
    uri = "".join(c for c in url or "" if c not in "\r\n")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{sha}", "Content-Type: application/http;msgtype=response"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return ("\r\n".join([*head, f"Content-Length: {len(block)}"]) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC headers, HTTP headers, payload) of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = lambda lines: {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines.decode().split("\r\n")[1:])}
    warc = fields(head)
    http, _, payload = rest[: int(warc["content-length"])].partition(b"\r\n\r\n")
    return warc, fields(http), payload


def write_archives(spark: SparkSession, typed: DataFrame, folder: str, level: int = 3) -> DataFrame:
    """Write ``typed`` (from ``with_types``) into ``folder``; returns the written index."""

    def write(batches: Iterable) -> Iterator:
        import uuid

        import pyarrow as pa
        from pyspark import TaskContext

        fs, root = open_fs(folder)
        out, name, offset = None, f"pages-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0
        for b in batches:
            rows = []
            for page_id, url, payload, digest, kind, refers in zip(*(c for c in b.columns)):
                page_id, url, digest, kind, refers = page_id.as_py(), url.as_py(), digest.as_py(), kind.as_py(), refers.as_py()
                z = zlib.compressobj(level, zlib.DEFLATED, 31)
                data = z.compress(record(kind, page_id, url, digest, payload.as_py(), refers)) + z.flush()
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                out.write(data)
                rows.append((name, offset, len(data), url, digest, kind, page_id, refers))
                offset += len(data)
            kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 3, pa.int64(), pa.int64()]
            cols = list(zip(*rows)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [x.split(" ")[0] for x in INDEX.split(", ")])
        if out is not None:
            out.close()

    small_batches(spark)
    return written(spark, typed.mapInArrow(write, INDEX), f"{folder}-index")


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest (hex) and payload (null for revisits) of the
    records named by ``index``: any selection of its rows."""

    def read(batches: Iterable) -> Iterator:
        import base64
        import hashlib

        import pyarrow as pa

        fs, root = open_fs(folder)
        held: dict = {}

        def flush(run: list):
            if held.get("name") != run[0][0]:
                if held:
                    held["file"].close()
                held.update(name=run[0][0], file=fs.open_input_file(f"{root}/{run[0][0]}"))
            lo = run[0][1]
            held["file"].seek(lo)
            data = held["file"].read(run[-1][1] + run[-1][2] - lo)
            rows = []
            for _, off, length in run:
                warc, http, payload = parse(zlib.decompress(data[off - lo : off - lo + length], 31))
                number = lambda name: int(x) if (x := warc.get(name, "").removeprefix("<urn:page:").removesuffix(">")) else None  # noqa: B023, E731
                revisit = warc["warc-type"] == "revisit"
                claimed = base64.b32decode(warc["warc-payload-digest"].removeprefix("sha1:")).hex()
                digest = claimed if revisit else hashlib.sha1(payload).hexdigest()
                if digest != claimed or not revisit and len(payload) != int(http["content-length"]):
                    raise ValueError(f"{run[0][0]} at {off}: payload and digest differ")
                rows.append((number("warc-record-id"), warc["warc-target-uri"], warc["warc-type"], number("warc-refers-to"), int(http["content-length"]), digest, None if revisit else payload))
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"])

        run: list = []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if run and (row[0] != run[0][0] or row[1] + row[2] - run[0][1] > MOST or row[1] - (run[-1][1] + run[-1][2]) > GAP):
                    yield flush(run)
                    run = []
                run.append(row)
        if run:
            yield flush(run)
        if held:
            held["file"].close()

    # The number of tasks follows the bytes they will read, not the index's own few.
    tasks = max(1, -(-(index.agg(F.sum("length")).head()[0] or 0) // MOST))
    dealt = index.select("file", "offset", "length", F.expr(f"offset div {MOST}").alias("range")).repartition(tasks, "file", "range").sortWithinPartitions("file", "offset").drop("range")
    return dealt.mapInArrow(read, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")


def warc_roundtrip(spark: SparkSession, pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, from the archives."""
    folder = shared_dir(spark) + "/warc"
    back = read_archives(write_archives(spark, with_types(pages, min_bytes), folder), folder)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
