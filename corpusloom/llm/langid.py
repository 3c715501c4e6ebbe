"""Operator 1: language identification by multinomial naive Bayes over hashed character n-grams.

Every labelled training text is counted (no sample): each task adds up n-gram counts per language and bucket, Spark
sums them, and the smoothed log-probability matrix is broadcast. Its size is bounded whatever the input: the number of
buckets is halved until languages x buckets x 4 bytes fits ``MATRIX_BYTES``. Scoring treats a text as a sparse row of
bucket indices and sums the matrix over them in numpy, in fixed blocks, so a score never depends on batching.

Null texts and texts without a letter are ``und`` with score 0, as is every text when nothing could be learned. Null
languages are not learned from. Ties go to the language first in code-point order. Repeated rows count as often as they
occur; a null doc_id counts as the empty id when rows are dealt into folds. Nothing but the text is used in a prediction.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, small_batches

ORDERS = (2, 3)
MATRIX_BYTES, MOST_BUCKET_BITS, ALPHA = 32 << 20, 16, 0.1
#: Code points handled at once; blocks overlap so that no n-gram is lost.
BLOCK = 1 << 18
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _folding() -> np.ndarray:
    """ASCII that is no letter becomes a space."""
    return np.array([c if chr(c).isalpha() else 32 for c in range(128)], np.uint32)


def ngram_buckets(text: str, bits: int) -> Iterator[np.ndarray]:
    """Bucket indices of all n-grams of a whole text, in blocks."""
    u = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    u = np.where(u < 128, _folding()[np.minimum(u, 127)], u).astype(np.uint64)
    most = max(ORDERS) - 1
    for at in range(0, len(u), BLOCK):
        part = u[at : at + BLOCK + most]
        out = []
        with np.errstate(over="ignore"):
            for n in ORDERS:
                m = min(len(part) - n + 1, BLOCK)
                if m > 0:
                    h = part[:m] + np.uint64(n << 32)
                    for k in range(1, n):
                        h = (h * _MIX) ^ part[k : k + m]
                    out.append(((h * _MIX) >> np.uint64(64 - bits)).astype(np.int64))
        if out:
            yield np.concatenate(out)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def train(spark: SparkSession, labelled: DataFrame) -> tuple[list[str], np.ndarray, int]:
    """(languages, log-probability matrix [language, bucket], bucket bits) from (lang, text).

    The last column of the matrix is the log prior.
    """
    labelled = labelled.where("lang IS NOT NULL AND text IS NOT NULL")
    share = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()}
    langs = sorted(share)
    bits = MOST_BUCKET_BITS
    while bits > 8 and (len(langs) << bits) * 4 > MATRIX_BYTES:
        bits -= 1
    if (len(langs) << bits) * 4 > MATRIX_BYTES:
        raise ValueError(f"{len(langs)} languages are more than the matrix bound allows")

    def count(batches: Iterable) -> Iterator:
        import pyarrow as pa

        forget()
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                if lang not in sums:
                    sums[lang] = np.zeros(1 << bits, np.int64)
                for idx in ngram_buckets(text.as_py(), bits):
                    sums[lang] += np.bincount(idx, minlength=1 << bits)
        for lang, c in sums.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(c[at])], ["lang", "bucket", "n"])

    counts = np.zeros((len(langs), 1 << bits))
    if langs:
        summed = labelled.select("lang", "text").mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
        # Blocks of buckets as arrays, partition by partition: the driver never holds the counts as rows.
        blocks = summed.groupBy("lang", F.expr("bucket div 4096")).agg(F.collect_list(F.struct("bucket", "n")).alias("x"))
        at = {x: k for k, x in enumerate(langs)}
        for r in blocks.select("lang", F.col("x.bucket").alias("bucket"), F.col("x.n").alias("n")).coalesce(8).toLocalIterator():
            counts[at[r.lang], r.bucket] = r.n
    logp = np.log(counts + ALPHA) - np.log(counts.sum(axis=1, keepdims=True) + ALPHA * (1 << bits))
    prior = np.log(np.array([share[x] for x in langs], float) / max(1, sum(share.values())))
    return langs, np.ascontiguousarray(np.hstack([logp, prior[:, None]]).astype(np.float32)), bits


def predict_column(spark: SparkSession, model: tuple[list[str], np.ndarray, int], text: Column) -> Column:
    """Struct (lang_pred, score, margin): margin is the log-odds per n-gram of the best against the next language."""
    langs, _, bits = model
    held = spark.sparkContext.broadcast(model[1])

    def predict(texts):
        import pandas as pd

        forget()
        m, out = held.value, []
        for t in texts:
            if not langs or not has_letter(t):
                out.append(("und", 0.0, 0.0))
                continue
            score, n = m[:, -1].astype(np.float64), 1
            for idx in ngram_buckets(t, bits):
                score += [float(row.take(idx).sum(dtype=np.float64)) for row in m]
                n += len(idx)
            best = int(np.argmax(score))
            p = np.exp(score - score[best])
            rest = np.delete(score, best)
            out.append((langs[best], float(min(1.0, 1 / p.sum())), float((score[best] - rest.max()) / n) if len(rest) else 0.0))
        return pd.DataFrame(out, columns=["lang_pred", "score", "margin"])

    return F.pandas_udf(predict, "lang_pred string, score double, margin double")(text)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def identify(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, margin; learned from the rows that are not held out."""
    small_batches(spark)
    model = train(spark, docs.where(~held_out()).select("lang", "text"))
    out = docs.select("doc_id", held_out().alias("held_out"), predict_column(spark, model, F.col("text")).alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score", "p.margin")
