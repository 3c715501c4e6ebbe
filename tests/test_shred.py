"""Large documents are read in pieces, and only the columns asked for are made."""

from corpusloom.sources import shred as X

TYPES = X.tag_types()


def rows(xml, **how):
    return sorted((r for part in X._nodes(xml, TYPES, **how) for r in part), key=lambda r: r[0] or 0)


def test_pieces_give_the_nodes_of_the_whole():
    xml = '<map>é\n' + "".join(f'<topicref href="c{i}.dita"><topicmeta><navtitle>N &amp; {i}</navtitle></topicmeta></topicref>\n' for i in range(50)) + "<!-- x --><x\n a='>'/></map>"
    whole = rows(xml)
    parts = list(X._nodes(xml, TYPES, large=0, piece=64))
    # What is held at once is bounded by a piece, not by the document.
    assert max(map(len, parts)) < 10 and rows(xml, large=0, piece=64) == whole
    assert [r[:13] for r in rows(xml, places=False, large=0, piece=64)] == [r[:13] for r in whole]
    # Nothing of a document comes out that turns out to be broken at its end.
    broken = rows("<map>" + "<p/>" * 100 + "</mop>", large=0, piece=8)
    assert len(broken) == 1 and broken == rows("<map>" + "<p/>" * 100 + "</mop>")


def test_columns(spark):
    d = spark.createDataFrame([("a", '<topic id="t"><p>x</p><b/></topic>'), ("b", "<a>")], "path string, content string")
    whole, few = X.shred(d), X.shred(d, columns=("pre", "anc", "attrs", "error"))
    assert few.columns == ["doc", "pre", "anc", "attrs", "error"]
    key = lambda r: (r.doc, r.pre or 0)
    assert sorted(few.collect(), key=key) == sorted(whole.select(*few.columns).collect(), key=key)
    stored = X.stored_nodes(spark, d, columns=("tag",))
    assert sorted(map(tuple, stored.collect()), key=repr) == sorted(map(tuple, whole.select("doc", "tag").collect()), key=repr)
