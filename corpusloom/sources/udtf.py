"""Shredding for SQL: a table function over the content of a document, for LATERAL joins."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from .shred import NODES, shred_document, tag_types

#: NODES without the document, which the query has beside it.
COLUMNS = NODES.split(", ", 1)[1]


@udtf(returnType=COLUMNS)
class DitaNodes:
    """dita_nodes(content, side): the nodes of a document. side: topic, map or auto (null), as which its elements are known; auto
    goes by the root element, like ``shred``."""

    def __init__(self):
        self.types = tag_types()

    def eval(self, content: str, side: str) -> Iterator[tuple]:
        types = self.types
        if side in ("topic", "map"):  # both sides know elements by the same table
            types = {"topic": types[side], "map": types[side]}
        for row in shred_document(content, types):
            row[11] = dict(row[11]) if row[11] is not None else None
            yield tuple(row)


def register(spark: SparkSession, name: str = "dita_nodes") -> None:
    """Make the function known to the session's SQL: ``SELECT ... FROM docs, LATERAL dita_nodes(content, 'topic')``."""
    spark.udtf.register(name, DitaNodes)
