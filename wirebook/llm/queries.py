"""One query for each operator, over its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirebook.llm import (
    byte_bpe, divergence, hard_negatives, language, mixing, near_dup, neighbours, packing, pii, quality, shards, token_files, toxicity,
)
from wirebook.llm.common import read
from wirebook.session import shared_dir

KEY = "corpus-pseudonyms-1"
SHARDS = 24
SEQUENCE = 1024
WEIGHTS, BUDGET, MOST = [3, 1, 2], 1.5, 2.0


def _fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def op1_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(read(spark, sf_dir, "documents").select("doc_id", "text"), KEY)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _fresh(spark, "tokens")
    token_files.write_token_files(read(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), 2)
    return token_files.read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_sampled_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint") + 8
    out = shards.write_shards(docs, _fresh(spark, "shards"), SHARDS, size, ["text"], ["doc_id"])
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32")
    return out.select("doc_id", size.alias("size"), crc, F.lit("bytes").alias("law"), "shard", F.col("slot").cast("bigint"), F.lit(None).cast("int").alias("grown_shard"))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents").select("doc_id", "source", "text"), WEIGHTS, BUDGET, MOST)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op5_quality_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = byte_bpe.encode_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return byte_bpe.digests(coded)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels").select("doc_id", "toxic")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = toxicity.fit(toxicity.learned_from(docs, labels.filter(~held)))
    scored = docs.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), toxicity.score("text", model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op8_neighbour_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(read(spark, sf_dir, "embeddings"), "vec_id % 100 = 0", 10)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = language.fit(docs.filter(~held))
    told = docs.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), language.predict("text", model).alias("p"))
    return told.select("doc_id", "held_out", "p.lang_pred", "p.score")


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dup.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "class_id", (F.col("doc_id") != F.col("class_id")).alias("is_copy"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(read(spark, sf_dir, "embeddings"), "vec_id % 100 = 0", noisy)


def op13_packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2, SEQUENCE)
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_pii_pseudonyms, op2_token_files, op3_sampled_shards, op4_source_mix, op5_quality_cutoffs, op6_byte_bpe,
        op7_toxicity, op8_neighbour_forest, op9_language, op10_near_duplicates, op11_source_divergence, op12_hard_negatives,
        op13_packed_sequences,
    )
}

# The mix: sums per source, targets by filling up to the caps, and the draw from the same md5 digits.
SQL: dict[str, str] = {
    "op4_source_mix": r"""
WITH d AS (
  SELECT doc_id, source, text, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST([3, 1, 2][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1] AS BIGINT) AS weight
  FROM d GROUP BY source
), o AS (
  SELECT *, CAST(1.5 AS DOUBLE) * CAST(sum(source_size) OVER () AS DOUBLE) - 2.0::DOUBLE * CAST(coalesce(sum(source_size) OVER ahead, 0) AS DOUBLE) AS rest,
         CAST(sum(weight) OVER () - coalesce(sum(weight) OVER ahead, 0) AS DOUBLE) AS open_weight,
         row_number() OVER (ORDER BY CAST(source_size AS DOUBLE) / weight, encode(source) NULLS LAST) AS nth
  FROM s WINDOW ahead AS (ORDER BY CAST(source_size AS DOUBLE) / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), u AS (
  SELECT *, rest / open_weight AS unit FROM o
), l AS (
  SELECT min_by(unit, nth) AS level FROM u WHERE NOT (unit * weight > 2.0::DOUBLE * source_size)
), t AS (
  SELECT source, source_size, coalesce(least(2.0::DOUBLE * source_size, level * weight), 2.0::DOUBLE * source_size) AS target FROM u LEFT JOIN l ON true
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate,
         CAST(concat('0x', substr(md5(concat_ws('|', '=mix', coalesce(concat('=', CAST(d.doc_id AS VARCHAR)), '-'), coalesce(concat('=', d.text), '-'))), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE AS draw
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST((floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM r
""",
    # Dense: every group of a language gets every kept term, and every pair of groups all of them.
    "op11_source_divergence": r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents
), o AS (
  SELECT id, lang, source, translate(unnest(words), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d
), k AS (
  SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT id) >= 30
), c AS (
  SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN k USING (lang, term) GROUP BY lang, source, term
), g AS (
  SELECT DISTINCT lang, source FROM d
), v AS (
  SELECT lang, count(*) AS v FROM k GROUP BY lang
), a AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, v.v,
         sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS n_group, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang) AS n_lang,
         sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, k.term) AS n_term
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), p AS (
  SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (n_group + 5 * v) AS p, 1 + (1000000000::HUGEINT * (n_term + 5)) // (n_lang + 5 * v) AS q FROM a
), f AS (
  SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
), r AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
  FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN f ON f.lang = x.lang AND f.source = x.source AND f.item = y.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE n > 0 AND p > q
)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM r)
WHERE part = 'pair' OR rank <= 50
""",
    "op12_hard_negatives": r"""
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS alike, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
  FROM e a JOIN e r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
       s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.alike AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
QUALIFY rank <= 5
""",
}
