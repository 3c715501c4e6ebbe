"""Points lie where the nodes of their documents lie."""

from corpusloom.operators import documents as D
from corpusloom.sources import shred as X


def test_points_meet_nodes_without_a_shuffle(spark):
    docs = spark.createDataFrame([("a", "<topic>\n<p>x</p>\n</topic>\n"), ("b", "<topic><p/></topic>")], "path string, content string")
    nodes = X.stored_nodes(spark, docs, columns=D.POSITIONS)
    points = spark.createDataFrame([("a", 1, 1, 7), ("a", 0, 0, 8), ("a", 9, 0, 9), ("b", 0, 8, 1), ("b", 0, 8, 1), ("none", 0, 0, 2), (None, 0, 0, 3)], "doc string, line int, col int, x int")
    got = D.elements_at(points, nodes)
    assert "hashpartitioning(__id" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.doc, r.x, r.tag, r.exact) for r in got.collect()) == [("a", 7, "p", True), ("a", 8, "topic", True), ("a", 9, "p", False), ("b", 1, "p", True), ("b", 1, "p", True)]
