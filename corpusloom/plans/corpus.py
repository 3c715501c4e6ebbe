"""A documentation corpus made from the given tables: topics, parts, maps, pages. Its size follows theirs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cat(*xs) -> Column:
    """Concatenation; numbers are written out."""
    return F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs])


def joined(items: Column, order: list[str], sep: str = "") -> Column:
    """Texts of a group in order."""
    return F.array_join(F.sort_array(F.collect_list(F.struct(*order, items.alias("__x"))))["__x"], sep)


def order_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """topics/o<k>.dita: one paragraph per line item with a link to its part and a key reference to its supplier."""
    li, c = table(spark, sf_dir, "lineitem"), F.col
    p = cat('<p><xref href="../parts/p', c("l_partkey"), ".dita#p", c("l_partkey"), '"/><keyword keyref="s', c("l_suppkey"), '"/></p>')
    body = li.groupBy("l_orderkey").agg(joined(p, ["l_linenumber", "l_partkey", "l_suppkey"]).alias("ps"))
    return body.select(cat("topics/o", c("l_orderkey"), ".dita").alias("path"), cat('<topic id="o', c("l_orderkey"), '"><title>Order ', c("l_orderkey"), "</title><prolog><author>nobody</author></prolog><body>\n", c("ps"), "\n</body></topic>").alias("content"))


def part_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """parts/p<k>.dita for parts of even size; without an id where the size leaves 2 when divided by 4."""
    p, c = table(spark, sf_dir, "part").where("p_size % 2 = 0"), F.col
    ident = F.when(c("p_size") % 4 == 2, F.lit("")).otherwise(cat(' id="p', c("p_partkey"), '"'))
    return p.select(cat("parts/p", c("p_partkey"), ".dita").alias("path"), cat("<topic", ident, "><title>", c("p_name"), "</title><body><p>", c("p_brand"), "</p></body></topic>").alias("content"))


def key_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """maps/keys<n>.ditamap (suppliers with suppkey % 3 <> 0, by the thousand), root<n>.ditamap that refers to it, and
    topics/keys<n>.ditamap (suppkey % 5 = 0) which is nearer to the topics."""
    s, c = table(spark, sf_dir, "supplier").withColumn("n", F.expr("s_suppkey div 1000")), F.col
    define = lambda value: cat('<keydef keys="s', c("s_suppkey"), '"><topicmeta><keywords><keyword>', value, "</keyword></keywords></topicmeta></keydef>")
    far = s.where("s_suppkey % 3 <> 0").groupBy("n").agg(joined(define(c("s_name")), ["s_suppkey"]).alias("x"))
    near = s.where("s_suppkey % 5 = 0").groupBy("n").agg(joined(define(cat("near ", c("s_name"))), ["s_suppkey"]).alias("x"))
    doc = lambda df, path, x: df.select(cat(path, c("n"), ".ditamap").alias("path"), cat("<map>", x, "</map>").alias("content"))
    return doc(far, "maps/keys", c("x")).unionByName(doc(far, "root", cat('<mapref href="maps/keys', c("n"), '.ditamap" format="ditamap"/>'))).unionByName(doc(near, "topics/keys", c("x")))


def book_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """maps/r<k>.ditamap: a book per region with a division per nation; maps/n<k>.ditamap: the nation's customers."""
    n, cu, c = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer"), F.col
    tag = F.when(c("n_nationkey") % 3 == 0, "chapter").when(c("n_nationkey") % 3 == 1, "part").otherwise("appendix")
    named = lambda name: cat("<topicmeta><navtitle>", name, "</navtitle></topicmeta>")
    division = cat("<", tag, ' href="n', c("n_nationkey"), '.ditamap">', named(c("n_name")), "</", tag, ">")
    books = n.groupBy("n_regionkey").agg(joined(division, ["n_nationkey"]).alias("x")).select(cat("maps/r", c("n_regionkey"), ".ditamap").alias("path"), cat("<bookmap>", c("x"), "</bookmap>").alias("content"))
    ref = cat('<topicref href="c', c("c_custkey"), '.dita">', named(c("c_name")), "</topicref>")
    inner = cu.groupBy("c_nationkey").agg(joined(ref, ["c_custkey"]).alias("x"))
    return books.unionByName(inner.select(cat("maps/n", c("c_nationkey"), ".ditamap").alias("path"), cat("<map>", c("x"), "</map>").alias("content")))


def table_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tables/t<k>.dita: an order's lines as a CALS table; the first cell of a line with an even number spans two columns."""
    li, c = table(spark, sf_dir, "lineitem"), F.col
    span = F.when(c("l_linenumber") % 2 == 0, F.lit(' namest="a" nameend="b"')).otherwise(F.lit(' colname="a"'))
    row = cat("<row><entry", span, ">", c("l_partkey"), '</entry><entry colname="c" morerows="', (c("l_linenumber") % 3), '">', c("l_suppkey"), "</entry></row>")
    rows = li.groupBy("l_orderkey").agg(joined(row, ["l_linenumber", "l_partkey", "l_suppkey"]).alias("x"))
    head = cat('<table><tgroup cols="3"><colspec colname="a" colwidth="', c("l_orderkey") % 3 + 1, '*"/><colspec colname="b" colwidth="2*"/><colspec colname="c" colwidth="120"/><tbody>')
    return rows.select(cat("tables/t", c("l_orderkey"), ".dita").alias("path"), cat('<topic id="t', c("l_orderkey"), '"><title>T</title><body>', head, c("x"), "</tbody></tgroup></table></body></topic>").alias("content"))


def html_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One HTML page per order with a titled section per line and a code block per line flag."""
    li, c = table(spark, sf_dir, "lineitem"), F.col
    sect = cat('<section id="l', c("l_linenumber"), "-", c("l_partkey"), '"><h2 class="sectiontitle">Line ', c("l_linenumber"), '</h2><pre class="', F.when(c("l_returnflag") == "N", F.lit("")).otherwise(cat("language-", F.lower("l_returnflag"))), '">x</pre></section>')
    return li.groupBy(F.col("l_orderkey").alias("page")).agg(cat("<html><body>", joined(sect, ["l_linenumber", "l_partkey", "l_suppkey"]), "</body></html>").alias("html"))


def guide_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """guides/g<n>.ditamap: a book per hundred customers. A customer is a preface, a part with chapters, a chapter, an appendix with
    a topic, a head with a keydef, or a topic in the front matter; a table of related topics ends each book."""
    c = F.col
    k, name = c("c_custkey"), c("c_name")
    file = lambda x="": cat(' href="t/c', k, x, '.dita"')
    kinds = [
        cat("<preface", file(), "><topicmeta><navtitle>Pre ", name, "</navtitle></topicmeta></preface>"),
        cat("<part", file(), "><topicmeta><navtitle> </navtitle><linktext>Part ", name, "</linktext></topicmeta><chapter", file("a"), '/><chapter keys="k', k, '"/></part>'),
        cat("<chapter", file(), ' navtitle="Nav ', k, '"/>'),
        cat("<appendix", file(), "><topicref", file("b"), "/></appendix>"),
        cat("<topichead><topicmeta><keywords><keyword>Head ", k, '</keyword></keywords></topicmeta><keydef keys="h', k, '"', file(), "/></topichead>"),
        cat("<frontmatter><topicgroup><topicref", file(), "/></topicgroup></frontmatter>"),
    ]
    one = F.lit(None).cast("string")
    for m, x in enumerate(kinds):
        one = F.when(k % 6 == m, x).otherwise(one)
    rows = table(spark, sf_dir, "customer").select(F.expr("c_custkey div 100").alias("g"), "c_custkey", one.alias("x")).groupBy("g").agg(joined(c("x"), ["c_custkey"]).alias("x"))
    title = cat("<booktitle><booktitlealt>Alt ", c("g"), "</booktitlealt><mainbooktitle>Guide ", c("g"), "</mainbooktitle></booktitle>")
    rel = '<reltable><relheader><relcolspec navtitle="A"/><relcolspec>B</relcolspec></relheader><relrow><relcell><topicref href="t/x.dita"/></relcell><relcell/></relrow></reltable>'
    return rows.select(cat("guides/g", c("g"), ".ditamap").alias("path"), cat("<bookmap>", title, c("x"), rel, "</bookmap>").alias("content"))


def ring_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ring/m<k>.ditamap: a map per customer with a topic and a reference to the next one; in each eight the last refers to the first."""
    c = F.col
    cu = table(spark, sf_dir, "customer").select("c_custkey", F.expr("c_custkey div 8").alias("b"))
    last = cu.groupBy("b").agg(F.max("c_custkey").alias("last"), F.min("c_custkey").alias("first"))
    rows = cu.join(last.hint("merge"), "b")
    after = F.when(c("c_custkey") == c("last"), c("first")).otherwise(c("c_custkey") + 1)
    return rows.select(cat("ring/m", c("c_custkey"), ".ditamap").alias("path"), cat('<map><topicref href="t', c("c_custkey"), '.dita"/><mapref href="m', after, '.ditamap"/></map>').alias("content"), (c("c_custkey") == c("first")).alias("root"))


def rich_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rich/p<k>.dita: one of everything that rendering has a rule for; a third of them in Chinese. rich/lib.dita<n> holds what they share."""
    p, c = table(spark, sf_dir, "part"), F.col
    lang = F.when(c("p_partkey") % 3 == 0, F.lit(' xml:lang="zh-CN"')).otherwise("")
    body = [
        "<shortdesc>S</shortdesc><prolog><author>x</author></prolog><conbody>",
        '<section id="s"><title>', c("p_brand"), '</title><p>a &amp; <uicontrol>', c("p_name"), '</uicontrol><fn id="f">n</fn></p></section>',
        '<note type="tip">N</note><note type="odd">O</note>',
        '<fig id="g"><title>Fig</title><image href="i.png" placement="break" width="5"/></fig>',
        '<codeblock outputclass="language-sql">x</codeblock><p><xref href="#t/s"/><xref href="#nowhere"/></p>',
        '<ph keyref="k', (c("p_size") % 4), '"/><ph keyref="gone"/><cmd>C</cmd>',
        '<table id="tb"><tgroup cols="2"><colspec colname="a" colwidth="1*"/><colspec colname="b" colwidth="3*"/><thead><row><entry namest="a" nameend="b">H</entry></row></thead><tbody><row><entry morerows="1">1</entry><entry>2</entry></row></tbody></tgroup></table>',
        "<simpletable><sthead><stentry>h</stentry></sthead><strow><stentry>d</stentry></strow></simpletable>",
        '<p conref="lib', F.expr("p_partkey div 100"), '.dita#l/q">literal</p><ph conref="lib', F.expr("p_partkey div 100"), '.dita#l/path">literal</ph>',
        '<indexterm>no</indexterm><boolean value="yes"/></conbody>',
    ]
    topic = p.select(cat("rich/p", c("p_partkey"), ".dita").alias("path"), cat('<concept id="t"', lang, "><title>", c("p_name"), "</title>", *body, "</concept>").alias("content"))
    inner = '<topic id="l"><title>L</title><body><p id="q">shared <b>bold</b><ph conref="lib' 
    lib = p.select(F.expr("p_partkey div 100").alias("n")).distinct().select(cat("rich/lib", c("n"), ".dita").alias("path"), cat(inner, c("n"), '.dita#l/path">x</ph></p><filepath id="path">/etc</filepath></body></topic>').alias("content"))
    return topic.unionByName(lib)
