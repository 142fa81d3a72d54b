"""Corpus pipeline: classify, filter, deduplicate, mix, tokenize.

``STAGES`` are (name, function) pairs; each function takes ``(spark, docs, sf_dir)`` and returns
a DataFrame, which is written as Parquet and reread as the next one's ``docs``. All but the
last keep the columns of ``documents``. ``run`` applies them to the whole table.

No stage accepts SQL for its rows (a trained model, a 64-bit hash of word n-grams, a token
vocabulary), so ``ORACLE_SQL`` is None; tests compare each stage with a brute-force version.
"""

from __future__ import annotations

import os
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.bpe import bpe_round_trip
from linkloom.llm.mixing import mix_sources
from linkloom.llm.ngram_join import ngram_jaccard_join
from linkloom.llm.quality_classifier import quality_classifier
from linkloom.llm.quality_rules import quality_rules
from linkloom.plans.materialize import materialize
from linkloom.session import checkpoint_dir

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
MAX_BROADCAST = 1 << 21  # row numbers (16 MB) that are broadcast


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps."""
    return quality_classifier(docs).where("kept").select(*docs.columns)


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules(docs).where("kept").select(*docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: of those with the smallest doc_id (null last), the first.

    Rows are told apart by their place in the table (``docs`` is read from Parquet), so rows that repeat an id, that have none, or
    that are equal throughout are judged each for itself. A row without words is in no group and stays.
    """
    rows = docs.withColumn("__row", F.monotonically_increasing_id())
    groups = ngram_jaccard_join(rows, "__row").join(rows.select("__row", "doc_id"), "__row")
    groups = materialize(groups, "duplicate-groups")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row")
    first = groups.where("n_shingles > 0").groupBy("component_id").agg(F.min(order).alias("first")).select(F.col("first.__row").alias("__row"))
    gone = materialize(groups.where("n_shingles > 0").select("__row").join(first, "__row", "left_anti"), "duplicates")
    gone = F.broadcast(gone) if gone.count() <= MAX_BROADCAST else gone
    return rows.join(gone, "__row", "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it (not at all, or up to three times). Rows without words take no part in the mix and go."""
    taken = mix_sources(docs, carry=docs.columns)
    names = [f"c{k}" for k in range(len(docs.columns))]
    taken = taken.toDF(*names, "__times").withColumn("__copy", F.explode(F.array_repeat(F.lit(1), F.col("__times"))))
    return taken.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left, and the text that they decode to: ``doc_id, n_tokens, ids, decoded``."""
    return bpe_round_trip(docs, TOKENIZER).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("quality classifier", classify),
    ("quality rules", apply_rules),
    ("n-gram Jaccard join", deduplicate),
    ("mixing sources to target weights", mix),
    ("BPE encoding and decoding", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's output is a table in the shared checkpoint folder."""
    folder = os.path.join(checkpoint_dir(spark), f"pipeline-{uuid.uuid4().hex[:12]}")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
