"""The training-data pipeline: quality rules, near copies, repeated passages, benchmark leaks, BPE encoding.

Each stage takes the documents that its predecessor kept, and all but the last return the columns of documents, extra
ones included, whatever their names. Empty tables give empty tables of the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import bpe, decontam, parity_join, quality, suffix_dedup
from corpusloom.llm.common import shared_dir, written
from corpusloom.llm.queries import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive rules keep. Null and empty texts go (too few words); null languages and sources are groups of
    their own; repeated rows share their fate."""
    return quality.filter_documents(spark, docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest doc_id (nulls last), of equal ones the first row. Repeated rows
    are copies; rows whose text is null or has no word are in no group and all stay."""
    return parity_join.drop_near_copies(spark, docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of more than 50 words that occur again; n_chars follows the text. All copies of a passage
    go. Null texts stay null; shorter texts stay as they are; repeated rows are copies of each other."""
    out = suffix_dedup.remove_repeats(spark, docs, suffix_dedup.WORDS.length, suffix_dedup.WORDS)
    return out.withColumn("n_chars", F.length("text").cast("long"))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover no benchmark item. Null and empty texts cover none and stay; null and empty items are covered by
    none; repeated rows share their fate."""
    return decontam.drop_contaminated(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids (binary: little-endian unsigned 32-bit integers), n_tokens, ids_sha256 and whether decoding gives
    the text back. Null and empty texts have no ids; repeated rows give repeated results; extra columns end here."""
    name = bpe.build_lexicon(spark, docs, vocabulary())
    back = bpe.encode_and_decode(docs.select("doc_id", "lang", "source", "text"), vocabulary(), name)
    return back.select(
        "doc_id", "lang", "source", "ids", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("lossless"),
    )


STAGES = [("quality_rules", quality_rules), ("near_copies", near_copies), ("repeated_passages", repeated_passages), ("benchmark_leaks", benchmark_leaks), ("encode", encode)]

#: Near copies, suffix arrays and BPE are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    folder, docs = shared_dir(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = written(spark, out, f"{folder}/{k}-{name}") if k + 1 < len(STAGES) else out
    return docs
