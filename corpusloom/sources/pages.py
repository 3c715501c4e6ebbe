"""Sink for pages: one HTML file per page, books as ordered parts, nothing visible before the whole job has succeeded."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .logs import _open


class Staged(WriterCommitMessage):
    def __init__(self, folder: str, files: list[str]):
        self.folder, self.files = folder, files


class PageWriter(DataSourceWriter):
    """Tasks write below a hidden folder of this job; the commit moves what successful tasks wrote into place."""

    def __init__(self, options: dict, overwrite: bool):
        self.root, self.job, self.overwrite = options["path"], uuid.uuid4().hex, overwrite

    def _hidden(self, root: str) -> str:
        return f"{root}/_pages-{self.job}"

    def write(self, rows: Iterator) -> Staged:
        fs, root = _open(self.root)
        at, files = f"{self._hidden(root)}/{uuid.uuid4().hex}", []
        for row in rows:
            name = row["file"]
            if not name or name.startswith(("/", "_", ".")) or ".." in name.split("/"):
                raise ValueError(f"not a file name below the folder: {name!r}")
            path = f"{at}/{name}"
            fs.create_dir(path.rpartition("/")[0], recursive=True)
            with fs.open_output_stream(path, compression=None) as f:
                f.write((row["html"] or "").encode("utf-8"))
            files.append(name)
        return Staged(at, files)

    def commit(self, messages: list) -> None:
        fs, root = _open(self.root)
        names = [n for m in messages if m for n in m.files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("two pages have one file name")
        fs.create_dir(root, recursive=True)
        if self.overwrite:
            from pyarrow import fs as pafs

            for old in fs.get_file_info(pafs.FileSelector(root)):
                if not old.base_name.startswith("_pages-"):
                    (fs.delete_dir if old.type == pafs.FileType.Directory else fs.delete_file)(old.path)
        for m in messages:
            for n in m.files if m else ():
                fs.create_dir(f"{root}/{n}".rpartition("/")[0], recursive=True)
                fs.move(f"{m.folder}/{n}", f"{root}/{n}")
        self._clear(fs, root)

    def abort(self, messages: list) -> None:
        self._clear(*_open(self.root))

    def _clear(self, fs, root: str) -> None:
        from pyarrow import fs as pafs

        if fs.get_file_info(self._hidden(root)).type == pafs.FileType.Directory:
            fs.delete_dir(self._hidden(root))


class PageSink(DataSource):
    """``df.write.format("html_pages").option("path", folder)`` of (file, html)."""

    @classmethod
    def name(cls) -> str:
        return "html_pages"

    def schema(self) -> str:
        return "file string, html string"

    def writer(self, schema, overwrite: bool) -> PageWriter:
        return PageWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PageSink)


def write_pages(pages: DataFrame, folder: str, mode: str = "append") -> None:
    """Write pages (file, html): a file each, named by ``file`` below the folder."""
    register(pages.sparkSession)
    pages.select("file", "html").write.format("html_pages").option("path", folder).mode(mode).save()


def book_files(parts: DataFrame, title, css: str = "", rows: int = 2000) -> DataFrame:
    """(file, html) of books by parts (root_map, pos, html): every book a folder of pages of at most ``rows`` parts each, in order, with
    links to the pages before and after; no book is ever one string. ``title``: of a book, from root_map."""
    from ..operators.documents import standalone_html

    page = F.floor(F.col("pos") / rows).cast("int")
    drawn = parts.withColumn("page", page).groupBy("root_map", "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "html"))), lambda x: x["html"]), "\n").alias("body"))
    last = parts.groupBy("root_map").agg(F.max(page).alias("last"))
    name = lambda n: F.format_string("part-%06d.html", n)
    j = drawn.join(last.hint("merge"), "root_map")
    nav = lambda rel, n, ok: F.when(ok, F.concat(F.lit(f'<a rel="{rel}" href="'), name(n), F.lit(f'">{rel}</a>'))).otherwise("")
    body = F.concat(F.lit('<div class="ditamap-book">'), "body", F.lit("</div>"), nav("prev", F.col("page") - 1, F.col("page") > 0), nav("next", F.col("page") + 1, F.col("page") < F.col("last")))
    folder = F.regexp_replace(F.regexp_replace("root_map", r"(?i)\.ditamap$", ""), r"^[/_.]+|:", "")
    return j.select(F.concat(folder, F.lit("/"), name(F.col("page"))).alias("file"), standalone_html(title, body, css).alias("html"))
