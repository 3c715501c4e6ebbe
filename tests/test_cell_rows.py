"""Plain documents are cut up at their tags, all others go to the XML parser; cells are placed by one sort of the rows that count."""

import io
from contextlib import redirect_stdout

import pytest

from corpusloom.operators import documents as D
from corpusloom.sources import shred as X

TYPES = X.tag_types()
PLAIN = [
    '<topic id="o"><title>A <b>x</b>y</title>\n<p><xref href="a/b"/>1 > 0<keyword keyref=\'s\'/></p ><odd class="- topic/p x/y">é</odd></topic>\n', " <map><topicref keys = 'k'><topicmeta/></topicref></map>",
    '<a class="+ map/map a/b"><topicref><entry>1<entry>2</entry>3</entry></topicref></a>',
]
OTHER = [
    '<a b="1>0"/>', "", "x", "<a", "<a>", "</a>", "<a></b>", "<a/><b/>", "<a/>x", "x<a/>", '<a b="1" b="2"/>', "<a b=1/>", '<a b="<"/>', "<a>]]></a>", "<a>&amp;</a>", "<a><!-- c --></a>", "<a><![CDATA[x]]></a>", "<?p x?><a/>",
    "<a>\r\n</a>", '<a b="1\t2"/>', "<a>\x01</a>", "<x:a/>", "<é/>", "﻿<a/>", "<a>￿</a>", '<a b="1"c="2"/>', "< a/>", "<a></ a>", "<!DOCTYPE a [<!ENTITY e 'v'>]><a>&e;</a>",
]


@pytest.mark.parametrize("how", [{}, {"own": ("topic/title", "topic/entry")}, {"own": ("topic/title",), "bare": True}, {"own": ("topic/entry",), "only": frozenset(("topic/entry", "topic/xref"))}])
def test_plain_documents_give_the_nodes_of_the_parser(how):
    memory = {}
    for xml in [*PLAIN, *OTHER, *PLAIN]:
        parsed = [r for part in X._nodes(xml, TYPES, places=False, **how) for r in part]
        assert [r for part in X._nodes(xml, TYPES, places=False, memory=memory, **how) for r in part] == parsed
        assert (X._plain_nodes(xml, TYPES, memory, frozenset(how.get("own", ())), "bare" in how, X._DEEP, how.get("only")) is not None) == (xml in PLAIN)


def test_memory_of_tags_is_bounded(monkeypatch):
    monkeypatch.setattr(X, "_TAGS", 8)
    memory = {}
    for i in range(50):
        assert len(X._plain_nodes(f'<a><b n="{i}"/></a>', TYPES, memory, frozenset(), False, X._DEEP, None)) == 2
    assert len(memory["topic"]) <= 8


DOCS = [
    ("t.dita", '<topic><table><tgroup><colspec colname="a"/><colspec/><colspec colname="b" colnum="7"/><colspec colname="a" colnum="x"/><thead><row><entry namest="a" nameend="b">H<b>h</b></entry></row></thead>'
     '<tbody><row><entry colname="a">1</entry><entry colname="" morerows="2"><table><tgroup><tbody><row/><row><entry colname="a">in</entry></row></tbody></tgroup></table></entry></row><row><entry namest="b" nameend="a"/><entry>z</entry></row></tbody></tgroup></table></topic>'),
    ("root.dita", '<entry colname="a">r<colspec colname="a"/></entry>'), ("bad.dita", "<topic><entry>"),
]
CELLS = [
    ("root.dita", 1, 1, 1, 1, 1, "r"),
    ("t.dita", 1, 1, 4, 4, 1, "Hh"), ("t.dita", 1, 1, 1, 1, 1, "in"), ("t.dita", 2, 1, 4, 1, 1, "1"), ("t.dita", 2, 2, 2, 1, 3, "in"), ("t.dita", 3, 1, 7, 1, 1, ""), ("t.dita", 3, 2, 2, 1, 1, "z"),
]


def test_cells_are_placed_by_one_sort(spark):
    docs = spark.createDataFrame(DOCS, "path string, content string")
    stored = X.stored_nodes(spark, docs, columns=D.CELLS, own=("topic/entry",), only=D.TABLE_TYPES, kept=D.cell_rows)
    assert stored.count() == 12  # entries and column specifications, nothing else
    cells, columns = D.cals_cells(stored), ("doc", "row", "cell", "col", "colspan", "rowspan", "text")
    assert sorted(map(tuple, cells.select(*columns).collect())) == sorted(CELLS)
    whole = D.cals_cells(X.shred(docs))
    assert sorted(map(tuple, whole.select(*columns).collect())) == sorted(CELLS)
    assert {(r.section, r.header) for r in whole.collect()} == {("thead", True), ("tbody", False), (None, False)}
    with redirect_stdout(io.StringIO()) as shown:
        cells.explain()
    plan = shown.getvalue()
    assert plan.count("Sort [") == 1 and "Join" not in plan and "Exchange" not in plan
