"""Registered queries of the training-data operators: name -> (spark, sf_dir) -> DataFrame.

Each applies one operator with its production parameters to its whole table; the digest
columns are derived here from the operator's own output.
"""

from __future__ import annotations

import os
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm import (
    ann,
    bpe,
    hard_negatives,
    language_id,
    mixing,
    ngram_join,
    prefix_trie,
    quality_classifier,
    quality_rules,
    sharding,
    token_counts,
    token_files,
    url_filter,
)
from linkloom.session import checkpoint_dir

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
SHARDS = 16


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(_table(spark, sf_dir, "pages"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality_classifier(_table(spark, sf_dir, "documents"), carry=["doc_id"])


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.bpe_encode(_table(spark, sf_dir, "documents"), WORD_TOKENIZER)
    return bpe.bpe_decode(encoded, WORD_TOKENIZER).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_sampled_splitter_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = sharding.with_size(_table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "size", "key", F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).alias("text_crc32"))
    return sharding.shard_records(docs, SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(_table(spark, sf_dir, "documents"), carry=["doc_id"])


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_join(_table(spark, sf_dir, "documents"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = os.path.join(checkpoint_dir(spark), f"token-files-{uuid.uuid4().hex[:12]}")
    token_files.write_token_files(_table(spark, sf_dir, "documents"), path, BYTE_TOKENIZER)
    return token_files.read_token_files(spark, path).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    fold = language_id.held_out(F.col("doc_id"))
    model = language_id.train(docs.where(~fold))
    return language_id.identify(docs, model, carry=["doc_id"]).select(
        "doc_id", fold.alias("held_out"), "lang_pred", "score")


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(20)) == 0)


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), WORD_TOKENIZER)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(_table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (
    op1_url_filter,
    op2_quality_classifier,
    op3_bpe_round_trip,
    op4_sampled_splitter_shards,
    op5_quality_rules,
    op6_ngram_jaccard_join,
    op7_token_files,
    op8_language_id,
    op9_mix_sources,
    op10_nearest_neighbours,
    op11_token_counts,
    op12_prefix_trie,
    op13_hard_negatives,
)}

# The mix in SQL: shares by sources in order of size by weight, then a running sum by position.
_MIX = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 12))::BIGINT AS pos
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM s),
r AS (SELECT *,
        sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY source_size::DOUBLE / weight, source
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
        sum(weight) OVER (ORDER BY source_size::DOUBLE / weight, source
            ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS others
      FROM w),
c AS (SELECT *, weight * rest > 3 * source_size * others AS over FROM r),
t AS (SELECT source, source_size, CASE WHEN over THEN (3 * source_size)::DOUBLE
        ELSE (weight * (sum(source_size) OVER () - coalesce(sum(3 * source_size) FILTER (WHERE over) OVER (), 0)))::DOUBLE
             / sum(weight) FILTER (WHERE NOT over) OVER () END AS target
      FROM c),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS passes FROM t),
g AS (SELECT source, pos, sum(size)::BIGINT AS words, count(*) AS n FROM d GROUP BY source, pos),
m AS (SELECT source, pos, words, n, sum(words) OVER (PARTITION BY source ORDER BY pos) AS upto FROM g),
k AS (SELECT *, row_number() OVER (PARTITION BY source, pos ORDER BY size) AS nth FROM d)
SELECT d.doc_id, d.size, p.source_size, p.target,
       (d.size * (p.passes + CASE WHEN 2 * (m.upto - m.words) * n + (2 * nth - 1) * m.words <= 2 * n * (p.target - p.passes * p.source_size)
                                  THEN 1 ELSE 0 END))::BIGINT AS taken
FROM k AS d JOIN p ON d.source IS NOT DISTINCT FROM p.source
       JOIN m ON d.source IS NOT DISTINCT FROM m.source AND d.pos = m.pos
"""

ORACLE: dict[str, str] = {
    "op9_mix_sources": _MIX,
}
