"""Log files that grow, as a stream: a data source whose offsets are the sizes of the files."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

CHUNKS = "run string, seq long, chunk string"


def _open(folder: str):
    from pyarrow import fs

    if "://" not in folder and folder.startswith("file:"):
        folder = "file://" + folder[len("file:"):]
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


#: Bytes of a file that one task reads, in as many chunks as they hold.
TASK = 4 << 20


class Range(InputPartition):
    """Bytes of a file, read by one task and handed out in chunks of ``piece`` bytes (one chunk without it)."""

    def __init__(self, name: str, start: int, end: int, piece: int | None = None):
        self.name, self.start, self.end, self.piece = name, start, end, piece or max(1, end - start)


class LogReader(DataSourceStreamReader):
    """Bytes that were added to the files since the last offset, cut into ranges that tasks read on their own."""

    def __init__(self, options: dict):
        self.folder, self.suffix = options["path"], options.get("suffix", ".log")
        self.piece = int(options.get("chunkBytes", 1 << 20))
        self.known: dict[str, tuple[int, int]] = {}  # size of a file, and its size without an unfinished character

    def initialOffset(self) -> dict:
        return {"sizes": "{}"}

    def latestOffset(self) -> dict:
        from pyarrow import fs as pafs

        fs, root = _open(self.folder)
        found = fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
        files = [f for f in found if f.is_file and f.path.endswith(self.suffix)]
        # Only files that have grown are opened.
        self.known = {f.path: old if (old := self.known.get(f.path)) and old[0] == f.size else (f.size, self._whole(fs, f)) for f in files}
        sizes = {p[len(root) :].lstrip("/"): whole for p, (_, whole) in self.known.items()}
        return {"sizes": json.dumps(dict(sorted(sizes.items())))}

    @staticmethod
    def _whole(fs, file) -> int:
        """The size without a character whose last bytes have not been written yet."""
        with fs.open_input_file(file.path) as f:
            f.seek(max(0, file.size - 4))
            tail = f.read(min(4, file.size))
        for back in range(1, len(tail) + 1):
            b = tail[-back]
            if b < 0x80:
                break
            if b >= 0xC0:  # the first byte of a character of two to four bytes
                return file.size - back if back < (2 if b < 0xE0 else 3 if b < 0xF0 else 4) else file.size
        return file.size

    def partitions(self, start: dict, end: dict) -> list[Range]:
        old, new = json.loads(start["sizes"]), json.loads(end["sizes"])
        # A file that has become shorter was begun anew.
        begin = lambda n, size: old[n] if old.get(n, size + 1) <= size else 0
        task = max(1, TASK // self.piece) * self.piece
        return [Range(n, at, min(at + task, size), self.piece) for n, size in new.items() for at in range(begin(n, size), size, task)]

    def read(self, partition: Range) -> Iterator[tuple]:
        fs, root = _open(self.folder)
        with fs.open_input_file(f"{root}/{partition.name}") as f:
            f.seek(partition.start)
            data = f.read(partition.end - partition.start + 3)
        # A character belongs to the chunk in which it begins.
        within = lambda at: at < len(data) and data[at] & 0xC0 == 0x80
        for at in range(0, partition.end - partition.start, partition.piece):
            first, last = at, min(at + partition.piece, partition.end - partition.start)
            while first < at + 3 and within(first):
                first += 1
            while last < min(at + partition.piece, partition.end - partition.start) + 3 and within(last):
                last += 1
            yield partition.name, partition.start + at, data[first:last].decode("utf-8", "replace")

    def commit(self, end: dict) -> None:
        pass


class LogSource(DataSource):
    """``spark.readStream.format("log_chunks").option("path", folder)``: (run, seq, chunk), one run per file; ``seq`` is the byte at
    which a chunk begins. Options: suffix (.log), chunkBytes. Each chunk comes once, also after a restart from a checkpoint."""

    @classmethod
    def name(cls) -> str:
        return "log_chunks"

    def schema(self) -> str:
        return CHUNKS

    def streamReader(self, schema) -> LogReader:
        return LogReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LogSource)
