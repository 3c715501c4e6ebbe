"""Queries opN_<name>: each operator on its whole table, and the same result in DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chunked_bpe, decontam, divergence, hard_negatives, langid, parity_join, preference, quality, records, sharding, suffix_dedup, warc


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(spark, _table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated_pairs(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations")
    return preference.format_preferences(turns, preference.neighbour_pairs(turns))


def op4_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.jaccard_components(spark, _table(spark, sf_dir, "documents"), shingle=4, percent=85)


def op5_bpe_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_roundtrip(spark, _table(spark, sf_dir, "documents"), vocabulary())


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeat_report(spark, _table(spark, sf_dir, "documents"))


def op7_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.binary_output(spark, _table(spark, sf_dir, "documents"), vocabulary())


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(spark, _table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_report(spark, _table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_roundtrip(spark, _table(spark, sf_dir, "pages"))


def op11_chunked_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return chunked_bpe.roundtrip(spark, _table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(spark, _table(spark, sf_dir, "embeddings"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(spark, _table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language_id, op2_decontamination, op3_preference_format, op4_parity_join, op5_bpe_lexicon, op6_suffix_dedup, op7_binary_records,
        op8_quality_rules, op9_sharding, op10_warc, op11_chunked_bpe, op12_hard_negatives, op13_source_divergence,
    )
}

_OP3 = """
WITH one AS (
  SELECT conv_id, turn, min({'role': role, 'text': text}) AS t FROM conversations
  WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, turn),
sides AS (SELECT conv_id >> 1 AS pair_id, turn, t, conv_id % 2 <> 0 AS rejected FROM one),
by_turn AS (
  SELECT pair_id, turn, max(CASE WHEN NOT rejected THEN t END) AS c, max(CASE WHEN rejected THEN t END) AS r,
         bool_or(NOT rejected) AS in_c, bool_or(rejected) AS in_r FROM sides GROUP BY pair_id, turn),
ends AS (
  SELECT pair_id, min(CASE WHEN NOT (in_c AND in_r AND c IS NOT DISTINCT FROM r) THEN turn END) AS fork
  FROM by_turn GROUP BY pair_id HAVING bool_or(in_c) AND bool_or(in_r)),
parts AS (
  SELECT pair_id, turn, 'prompt' AS section, c AS t FROM by_turn JOIN ends USING (pair_id) WHERE fork IS NULL OR turn < fork
  UNION ALL SELECT pair_id, turn, 'chosen', c FROM by_turn JOIN ends USING (pair_id) WHERE turn >= fork AND in_c
  UNION ALL SELECT pair_id, turn, 'rejected', r FROM by_turn JOIN ends USING (pair_id) WHERE turn >= fork AND in_r),
drawn AS (
  SELECT pair_id, section, CAST(floor(turn / 256) AS BIGINT) AS part, turn,
         '<|' || coalesce(t.role, 'unknown') || '|>' || chr(10) AS head, coalesce(t.text, '') || '<|end|>' || chr(10) AS body,
         section <> 'prompt' AND coalesce(t.role = 'assistant', false) AS learn FROM parts),
placed AS (
  SELECT *, coalesce(sum(length(head) + length(body)) OVER (PARTITION BY pair_id, section, part ORDER BY turn
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS from_char FROM drawn)
SELECT pair_id, section, part, CAST(count(*) AS BIGINT) AS n_turns, string_agg(head || body, '' ORDER BY turn) AS text,
       coalesce(string_agg(CAST(from_char + length(head) AS VARCHAR) || ':' || CAST(from_char + length(head) + length(body) AS VARCHAR), ',' ORDER BY turn)
                FILTER (WHERE learn), '') AS mask
FROM placed GROUP BY pair_id, section, part
"""

_OP8 = r"""
WITH w AS (
  SELECT doc_id, coalesce('=' || lang, 'null') AS lang, coalesce('=' || source, 'null') AS source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
l AS (SELECT *, [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines,
             row_number() OVER () AS k FROM w),
g AS (SELECT k, unnest(range(1, len(words) - 6)) AS i, words FROM l WHERE len(words) > 8),
h AS (SELECT k, i, count(*) OVER (PARTITION BY k, array_to_string(words[i:i + 7], ' ')) AS n FROM g),
rep AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest(range(i, i + 8)) AS p FROM h WHERE n > 1) GROUP BY k),
s AS (
  SELECT l.k, doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum([length(x) FOR x IN words]), 0) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
         len(lines) AS n_lines FROM l LEFT JOIN rep ON rep.k = l.k),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM s),
m AS (
  SELECT k, lang, source, unnest(['symbols', 'dup_lines', 'word_length']) AS ratio,
         unnest([1000 * n_symbols // greatest(word_chars, 1), 1000 * n_dup_lines // greatest(n_lines, 1), 100 * word_chars // greatest(n_words, 1)]) AS v
  FROM b WHERE NOT base_failed),
binned AS (SELECT lang, source, ratio, CASE WHEN v < 128 THEN v ELSE (v >> (length(bin(v)) - 7)) << (length(bin(v)) - 7) END AS bin FROM m),
sk AS (
  SELECT lang, source, ratio, bin, count(*) AS n FROM binned GROUP BY ALL
  UNION ALL SELECT lang, NULL, ratio, bin, count(*) FROM binned GROUP BY ALL
  UNION ALL SELECT NULL, NULL, ratio, bin, count(*) FROM binned GROUP BY ALL),
run AS (SELECT *, sum(n) OVER (PARTITION BY lang, source, ratio ORDER BY bin) AS below, sum(n) OVER (PARTITION BY lang, source, ratio) AS total FROM sk),
q AS (
  SELECT lang, source, ratio, max(total) AS total, min(CASE WHEN 100 * below >= 25 * total THEN bin END) AS q25,
         min(CASE WHEN 100 * below >= 50 * total THEN bin END) AS q50, min(CASE WHEN 100 * below >= 75 * total THEN bin END) AS q75 FROM run GROUP BY ALL),
f AS (
  SELECT *, q50 - greatest(4 * (q50 - q25), slack) AS lo, q50 + greatest(4 * (q75 - q50), slack) AS hi
  FROM q JOIN (VALUES ('symbols', 30), ('dup_lines', 300), ('word_length', 200)) AS x(ratio, slack) USING (ratio)),
bad AS (
  SELECT DISTINCT k FROM m LEFT JOIN f o ON (o.lang, o.source, o.ratio) = (m.lang, m.source, m.ratio) AND o.total >= 200
  LEFT JOIN f g ON g.lang = m.lang AND g.source IS NULL AND g.ratio = m.ratio AND g.total >= 200
  LEFT JOIN f a ON a.lang IS NULL AND a.ratio = m.ratio
  WHERE v > coalesce(o.hi, g.hi, a.hi) OR m.ratio = 'word_length' AND v < coalesce(o.lo, g.lo, a.lo))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND bad.k IS NULL AS kept
FROM b LEFT JOIN bad ON bad.k = b.k
"""

_OP10 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest, max(page_id) OVER (PARTITION BY html) AS holder FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND holder IS NOT NULL AND page_id IS DISTINCT FROM holder THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM holder THEN holder END AS refers_to
FROM d
"""

_OP12 = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.r, a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, other) AS k FROM s WHERE same) WHERE k <= 5),
n AS (
  SELECT p.anchor_id, p.other AS positive_id, row_number() OVER (PARTITION BY p.r, p.k ORDER BY s.score DESC, s.other) AS rank,
         s.other AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.r = p.r AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""

_OP13 = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
l AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
g AS (SELECT lang, source, coalesce(any_value(v), 0) AS v, coalesce(sum(c.n), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN l USING (lang) LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, term, coalesce(c.n, 0) AS n, 1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 1)) // (g.n + g.v) AS p
  FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
pair AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
one AS (
  SELECT p.lang, source, term AS item, p.p, 1 + (CAST(1000000000 AS HUGEINT) * (kept.n + 1)) // (l.n + l.v) AS q
  FROM p JOIN kept USING (lang, term) JOIN l USING (lang) WHERE p.n > 0),
term AS (SELECT lang, source, item, (p - q) * (p - q) // q AS value FROM one WHERE p > q),
r AS (
  SELECT 'pair' AS part, *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pair
  UNION ALL SELECT 'term', *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM term)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 200
"""

ORACLE_SQL: dict[str, str] = {"op3_preference_format": _OP3, "op8_quality_rules": _OP8, "op10_warc": _OP10, "op12_hard_negatives": _OP12, "op13_source_divergence": _OP13}
