"""Stored tables, scans of large groups, streams with state, files and sources."""

import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import documents as D
from corpusloom.operators import keys as K
from corpusloom.operators import maps as M
from corpusloom.operators import refs as R
from corpusloom.operators import scan
from corpusloom.operators import site as S
from corpusloom.sources import logs, pages
from corpusloom.sources import shred as X
from corpusloom.sources import store
from corpusloom.streaming import lifecycle as L
from corpusloom.streaming.keyspaces import KeySpaces, kept_key_spaces
from tests.test_documents import docs, one, simulate


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_texts_of_dealt_documents_need_no_exchange(spark):
    rng = random.Random(2)

    def draw(depth):
        return "".join(rng.choice(["x", " y ", "é", f"<p>{draw(depth + 1)}</p>" if depth < 5 else "z", f"<title>{rng.random()}</title>"]) for _ in range(rng.randrange(4)))

    d = docs(spark, *((f"d{k}", f"<topic>{draw(0)}</topic>") for k in range(40)), ("empty", "<topic/>"), ("bad", "<t>"))
    nodes = X.stored_nodes(spark, d)
    text = D.element_text(nodes)
    assert exchanges(text) == 0
    rows = nodes.where("error IS NULL").collect()
    own = {(r.doc, r.pre): "".join(t.text for t in sorted(rows, key=lambda t: t.pre) if t.type == "text" and t.doc == r.doc and r.pre in t.anc) for r in rows if r.type == "element"}
    assert {(r.doc, r.pre): r.own for r in text.collect()} == own
    titles = {(r.doc, r.pre): r.own for r in D.element_text(nodes, ("topic/title",)).collect()}
    assert titles == {k: v for k, v in own.items() if any(r.doc == k[0] and r.pre == k[1] and r.tag == "title" for r in rows)}


def test_temporary_tables_are_deleted(spark):
    before = {t.name for t in spark.catalog.listTables()}
    with store.temporary_tables(spark):
        nodes = X.stored_nodes(spark, docs(spark, ("a", "<topic/>")))
        kept = store.written(spark, nodes)
        folders = [f.replace("file://", "").replace("file:", "") for f in {os.path.dirname(f) for f in [*nodes.inputFiles(), *kept.inputFiles()]}]
        assert len(folders) == 2 and all(map(os.path.isdir, folders)) and nodes.count() == 1
    assert not any(map(os.path.isdir, folders)) and {t.name for t in spark.catalog.listTables()} == before


def test_layers_hold_every_piece_in_few_tables(spark):
    grown = store.Layers(spark)
    for k in range(20):
        grown.add(spark.range(k, k + 1))
    assert sorted(r.id for r in grown.all().collect()) == list(range(20)) and sum(map(len, grown.levels)) < 8


def test_binary_search(spark):
    df = spark.createDataFrame([([1, 3, 3, 7],), ([],), ([5],)], "a array<int>")
    for x in (0, 1, 2, 3, 4, 7, 8):
        assert [r.n for r in df.select(T.lower_bound("a", F.lit(x)).alias("n")).collect()] == [sum(v < x for v in a) for a in ([1, 3, 3, 7], [], [5])]


# ------------------------------------------------------------------ scans


@pytest.mark.parametrize("block", [7, 1 << 16])
def test_numbers_do_not_depend_on_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(scan, "BLOCK", block)
    rng = random.Random(5)
    books = {f"m{k}": [(rng.choice(["chapter", "part", "appendix", "topicref", "preface"]), rng.choice([0, 1, 1, 2, 5])) for _ in range(n)] for k, n in enumerate((1, 3, 50, 90))}
    rows = [(m, [p // 10, p % 10], t, d) for m, b in books.items() for p, (t, d) in enumerate(b)]
    rng.shuffle(rows)
    entries = scan.ranked(spark.createDataFrame(rows, "root_map string, order_key array<int>, tag string, depth int").repartition(5), "root_map", "order_key")
    got = M.number_divisions(entries).collect()
    for m, b in books.items():
        mine = sorted((r for r in got if r.root_map == m), key=lambda r: r.pos)
        assert [r.pos for r in mine] == list(range(1, len(b) + 1)) and [r.tag for r in mine] == [t for t, _ in b]
        assert [r.n for r in mine] == simulate(b)
    near = scan.neighbours(entries.where("pos % 3 <> 1"), "root_map", "pos", "pos").collect()
    for m in books:
        at = sorted(r.pos for r in near if r.root_map == m)
        assert {(r.pos, r.prev, r.next) for r in near if r.root_map == m} == set(zip(at, [None, *at], [*at[1:], None]))


def test_one_map_of_a_million_entries(spark):
    rng = random.Random(8)
    book = [(rng.choice(["chapter", "part", "topicref"]), rng.choice([0, 1, 2, 2])) for _ in range(1_000_000)]
    frame = spark.createDataFrame(pd.DataFrame({"pos": range(1, len(book) + 1), "tag": [t for t, _ in book], "depth": pd.Series([d for _, d in book], dtype="int32")}))
    numbered = M.number_divisions(frame.withColumn("root_map", F.lit("m"))).select("pos", "n").toPandas().sort_values("pos")
    assert [None if pd.isna(x) else int(x) for x in numbered["n"]] == simulate(book)


def test_long_chain_of_maps(spark):
    d = docs(spark, *((f"f{k}/m.ditamap", f'<map><topicref href="../f{k + 1}/m.ditamap"/><topicref href="t.dita"/></map>') for k in range(40)))
    nodes = X.stored_nodes(spark, d)
    e = M.first_occurrences(M.map_entries(M.expand_maps(nodes, d.where("path = 'f0/m.ditamap'")), nodes))
    rows = e.orderBy("pos").collect()
    assert len(rows) == 80 and max(r.depth for r in rows) == 40 - 1 + 0 or max(r.depth for r in rows) == 39
    assert {r.href for r in rows if r.href.endswith(".dita")} == {"t.dita", *(f"../f{k}/t.dita" for k in range(1, 40))}
    assert {r.file for r in rows if r.href.endswith(".dita")} == {f"f{k}/t.dita" for k in range(40)}


# ------------------------------------------------------------------ sources


def test_places_are_those_of_the_source():
    text = '<!DOCTYPE t [\n<!ENTITY n "N&amp;\n">\n<!ENTITY b.x "<b>q</b>">]>\n<t>A&n;é &copy;&gone;\n<p>&b.x;z</p>&amp;&#65;<i/></t>'
    rows = {r[9]: r for r in X.shred_document(text, X.tag_types()) if r[8] == "element"}
    lines = text.split("\n")
    for tag, mark in (("t", "<t>"), ("p", "<p>"), ("i", "<i/>")):
        assert lines[rows[tag][13]][rows[tag][14] :].startswith(mark), tag
    assert lines[rows["b"][13]][rows["b"][14] :].startswith("&b.x;")
    assert [r[12] for r in X.shred_document(text, X.tag_types()) if r[8] == "text"] == ["AN&\né ©\n", "q", "z", "&A"]
    assert X.shred_document("<t>&nbsp;</t>", X.tag_types(), clean=False)[0][-1]
    assert [X.clean_source(x).text for x in ("&über;&1a;&a-b.c;", '<!DOCTYPE t><t/>', '<!DOCTYPE t [ <!ENTITY ü "v"> ]><t>&ü;</t>', "<!DOCTYPE")] == ["&über;&1a;", "<t/>", "<t>v</t>", "<!DOCTYPE"]


def test_both_forms_of_cleaning_agree(spark):
    cases = ['<!DOCTYPE t [<!ENTITY a "&b;"><!ENTITY b "B">]><t>&a;&b;&c;&amp;</t>', "a & b &x; &lt;", "&1a;&über;&_x;", '<!DOCTYPE x SYSTEM "y"><t>&nbsp;</t>', '<!DOCTYPE x [ <t>', "x<!DOCTYPE a [b]>c", '<!DOCTYPE t [<!ENTITY a "\\"q">]>&a;']
    for c in cases:
        assert one(spark, X.clean_entities(F.lit(c))) == X.clean_source(c).text, c


def test_paths_of_any_file_system(spark, tmp_path):
    at = lambda f, *a: one(spark, f(*map(F.lit, a)))
    assert [at(T.resolve, *a) for a in (("hdfs://nn/c", "b.dita"), ("s3a://b/x", "../../c.dita"), ("/", "a"), ("/a", "../../b"), ("", "../a"), ("file:/t/x", "./y"))] == ["hdfs://nn/c/b.dita", "s3a://b/c.dita", "/a", "/b", "../a", "file:/t/x/y"]
    assert at(T.ancestors, "hdfs://nn/a/b") == ["hdfs://nn/a/b", "hdfs://nn/a", "hdfs://nn"] and at(T.ancestors, "a/b") == ["a/b", "a", ""] and at(T.ancestors, "/a") == ["/a", "/"] and at(T.ancestors, "") == [""]
    assert [at(T.dirname, p) for p in ("/a", "a", "a/b", "hdfs://nn/m")] == ["/", "", "a", "hdfs://nn"]
    dirs, maps = spark.createDataFrame([("hdfs://nn/c",)], "scope_dir string"), docs(spark, ("hdfs://nn/c/m.ditamap", ""), ("hdfs://nn/m.ditamap", ""), ("hdfs://other/m.ditamap", ""))
    assert {(r.map_path, r.distance) for r in K.visible_maps(dirs, maps).collect()} == {("hdfs://nn/c/m.ditamap", 0), ("hdfs://nn/m.ditamap", 1)}
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a b.dita").write_text('<topic><xref href="../c.dita"/></topic>')
    (tmp_path / "c.dita").write_text("<topic/>")
    d = X.docs_from_dir(spark, str(tmp_path))
    assert {r.path for r in d.collect()} == {"sub/a b.dita", "c.dita"}
    assert R.missing_files(R.collect_refs(d), d).count() == 0


def test_logs_come_once_after_a_restart(spark, tmp_path):
    logs.register(spark)
    folder = tmp_path / "logs"
    folder.mkdir()

    def run():
        chunks = spark.readStream.format("log_chunks").option("path", str(folder)).option("chunkBytes", 5).load()
        q = chunks.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        got = {}
        for r in spark.read.parquet(str(tmp_path / "out")).orderBy("run", "seq").collect():
            got[r.run] = got.get(r.run, "") + r.chunk
        return got

    (folder / "a.log").write_bytes("äöü one\nt".encode() + "é".encode()[:1])
    (folder / "b.txt").write_text("no")
    assert run() == {"a.log": "äöü one\nt"}
    with open(folder / "a.log", "ab") as f:
        f.write("é".encode()[1:] + "wo 日本🙂\n".encode())
    (folder / "c.log").write_text("")
    assert run() == {"a.log": "äöü one\ntéwo 日本🙂\n"}
    assert run() == {"a.log": "äöü one\ntéwo 日本🙂\n"}
    (folder / "d.log").write_text("shrinks")
    run()
    (folder / "d.log").write_text("new")
    n = spark.read.parquet(str(tmp_path / "out")).where("run = 'd.log' AND chunk = 'new'").count()
    assert n == 0 and run()["d.log"] and spark.read.parquet(str(tmp_path / "out")).where("run = 'd.log' AND chunk = 'new'").count() == 1


def test_pages_appear_only_when_all_are_written(spark, tmp_path):
    out = tmp_path / "site"
    rows = spark.createDataFrame([("a.html", "<p>é"), ("b/c.html", None)], "file string, html string").repartition(2)
    pages.write_pages(rows, str(out))
    assert {str(p.relative_to(out)): p.read_text() for p in out.rglob("*") if p.is_file()} == {"a.html": "<p>é", "b/c.html": ""} and not list(out.glob("_*"))
    broken = rows.unionByName(spark.createDataFrame([("../x.html", "")], rows.schema))
    for bad in (broken, rows.unionByName(rows)):
        with pytest.raises(Exception):  # noqa: B017
            pages.write_pages(bad, str(tmp_path / "none"))
        assert not [p for p in (tmp_path / "none").rglob("*") if p.is_file()]
    pages.write_pages(rows.where("file = 'a.html'"), str(out), "overwrite")
    assert [p.name for p in out.rglob("*") if p.is_file()] == ["a.html"]


def test_text_nodes_of_tag_soup(spark):
    html = "<head><title>t</title></head><body>a &amp; <b>b<i>c</b>d<p>e<div id=__toolbar>f<p>g</div></i>h<script>i<b></script><br/>j<!-- k -->l <style>m</style><mark>n</mark>"
    rows = S.page_text_nodes(spark.createDataFrame([(1, html), (2, None), (3, "plain")], "doc int, html string")).orderBy("doc", "node").collect()
    assert [(r.tag, r.text) for r in rows if r.doc == 1] == [("body", "a & "), ("b", "b"), ("i", "c"), ("body", "d"), ("p", "e"), ("body", "h"), ("body", "j"), ("body", "l ")]
    assert [(r.tag, r.text) for r in rows if r.doc > 1] == [("body", "plain")]
    page = spark.createDataFrame([(1, "<script>foo</script><p>foo foo</p>fo<b>o</b> FOO")], "doc int, html string")
    assert [(r.start, r.n, r.total) for r in S.search_pages(page, "foo").orderBy("n").collect()] == [(0, 1, 3), (4, 2, 3), (1, 3, 3)]
    assert [(r.start, r.n) for r in S.search_pages(page, "foo", most=1).orderBy("n").collect()] == [(0, 1), (1, 2)]


# ------------------------------------------------------------------ streams


def ts(s: float):
    return (pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=s)).to_pydatetime()


def test_close_cancels_what_waits(spark, tmp_path):
    """Batches one by one: replaced and cancelled changes never come, not even when their time comes later."""
    batches = [
        [("a", 1.0, "change", "a1"), ("b", 1.0, "change", "b1"), ("c", 1.0, "open", "c0"), ("d", 1.0, "change", "d1")],
        [("a", 1.2, "close", None), ("b", 1.5, "change", "b2"), ("c", 1.2, "change", "c1"), ("c", 1.3, "save", "c2")],
        [("x", 60.0, "save", "x")],
        [("y", 61.0, "save", "y"), ("d", 60.5, "change", "d2"), ("d", 60.9, "close", None)],
        [("z", 120.0, "save", "z")],
    ]
    src, seen = tmp_path / "in", []
    src.mkdir()
    schema = "path string, ts timestamp, op string, content string"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    q = L.watched(stream, lambda df: seen.extend(map(tuple, df.collect())), str(tmp_path / "c"))
    try:
        for k, rows in enumerate(batches):
            spark.createDataFrame([(p, ts(s), op, x) for p, s, op, x in rows], schema).coalesce(1).write.mode("append").parquet(str(src / f"_{k}"))
            for f in os.listdir(src / f"_{k}"):
                if f.endswith(".parquet"):
                    os.rename(src / f"_{k}" / f, src / f"{k}.parquet")
            q.processAllAvailable()
    finally:
        q.stop()
    base = int(pd.Timestamp("2024-01-01").timestamp() * 1000)
    got = sorted((p, at - base, kind, x) for p, at, kind, x in seen)
    assert got == [
        ("a", 1200, "closed", None), ("b", 2200, "settled", "b2"), ("c", 1000, "now", "c0"), ("c", 1300, "now", "c2"), ("c", 1900, "settled", "c1"),
        ("d", 1700, "settled", "d1"), ("d", 60900, "closed", None), ("x", 60000, "now", "x"), ("y", 61000, "now", "y"), ("z", 120000, "now", "z"),
    ]
    everything = spark.createDataFrame([(p, ts(s), op, x) for b in batches for p, s, op, x in b], schema)
    assert sorted((r.path, r.at_ms - base, r.kind, r.content) for r in L.settled_signals(everything).collect()) == got


def test_key_spaces_follow_changes(spark, tmp_path):
    def key(k, v):
        return f'<keydef keys="{k}"><topicmeta><keywords><keyword>{v}</keyword></keywords></topicmeta></keydef>'

    base = {f"s{k}/m.ditamap": (f"<map>{key('k', k)}<mapref href='../lib/l{k % 3}.ditamap' format='ditamap'/></map>".replace("'", '"'), 1) for k in range(12)}
    base |= {f"lib/l{k}.ditamap": (f"<map>{key('l', k)}</map>", 1) for k in range(2)}  # the third is missing
    dirs = spark.createDataFrame([(f"s{k}/t",) for k in range(12)] + [("alone",)], "scope_dir string")
    maps = lambda d: spark.createDataFrame([(p, x, ts(t)) for p, (x, t) in d.items()], "path string, content string, mtime timestamp")
    rows = lambda s: sorted(map(tuple, s.keys.collect()))
    files = lambda: {p for p in (tmp_path / "kept" / "keys").rglob("*.parquet")}
    kept = KeySpaces(spark, str(tmp_path / "kept"), parts=16)
    kept.refresh(maps(base), dirs)
    steps = [
        base | {"s4/m.ditamap": (f"<map>{key('k', 'new')}</map>", 2)},  # one map changes
        base | {"lib/l2.ditamap": (f"<map>{key('l', 2)}</map>", 1)},  # it changes back, and a missing map appears
        {p: x for p, x in base.items() if p != "lib/l0.ditamap"},  # a map goes
        base | {"top.ditamap": (f"<map>{key('z', 'top')}</map>", 3)},  # a map that all folders see
    ]
    for n, now in enumerate(steps):
        before = files()
        affected = {r.scope_dir for r in kept.refresh(maps(now), dirs).collect()}
        whole = KeySpaces(spark, str(tmp_path / f"whole{n}"), parts=16)
        whole.refresh(maps(now), dirs)
        assert rows(kept) == rows(whole) and sorted(map(tuple, kept.stamps.collect())) == sorted(map(tuple, whole.stamps.collect())), n
        if n == 0:
            assert affected == {"s4/t"} and len(files() - before) == 1 and len(before - files()) == 1
    assert not kept.refresh(maps(steps[-1]), dirs).collect()


def test_saved_maps_renew_key_spaces(spark, tmp_path):
    schema = "path string, ts timestamp, op string, content string"
    dirs = spark.createDataFrame([("a",)], "scope_dir string")
    state = {"x": "1"}

    def corpus():
        content = f'<map><keydef keys="k"><topicmeta><keywords><keyword>{state["x"]}</keyword></keywords></topicmeta></keydef></map>'
        return spark.createDataFrame([("a/m.ditamap", content, ts(int(state["x"])))], "path string, content string, mtime timestamp"), dirs

    spaces = KeySpaces(spark, str(tmp_path / "spaces"), parts=4)
    spaces.refresh(*corpus())
    state["x"] = "2"
    src = tmp_path / "in"
    spark.createDataFrame([("a/m.ditamap", ts(1), "save", None), ("a/t.dita", ts(1), "save", None)], schema).coalesce(1).write.parquet(str(src))
    q = kept_key_spaces(spark.readStream.schema(schema).parquet(str(src)), spaces, corpus, str(tmp_path / "c"))
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert [tuple(r) for r in spaces.keys.collect()] == [("a", "k", "2", "a/m.ditamap", 0)]
