"""L2: TF-IDF cosine between a source page's text and a target page's topic.

Document frequencies are one partial count over all pages. Term counts are taken for the pages that occur
in a requested pair only: their word arrays are dealt by page once, and counting, weighting and collecting the
page's sparse vector all happen behind that exchange. A source's vector is a map column, in which a pair looks up the few
words of the target's topic, so no word is a join key between pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.functions.text import shingle_words
from linkloom.operators.entities import blank_fill, entity_rows
from linkloom.operators.linking import LinkParams, measure, ranked_links, with_anchors
from linkloom.plans.materialize import materialize


def idf_table(corpus: DataFrame, n_pages: int) -> DataFrame:
    """``(w, idf)`` with ``idf = ln(N / df)``; ``df`` counts the pages whose
    content holds the word (a partial count, so frequent words do not skew)."""
    words = blank_fill(corpus).select(F.explode(F.array_distinct(shingle_words(F.col("content")))).alias("w"))
    return words.groupBy("w").agg(F.count(F.lit(1)).alias("df")).select(
        "w", F.log(F.lit(float(n_pages)) / F.col("df")).alias("idf"))


def _weights(pages: DataFrame, idf: DataFrame) -> DataFrame:
    """``(page_id, w, x)`` of rows ``(page_id, text)``, several of which may be one page's; dealt by page."""
    words = pages.select("page_id", shingle_words(F.col("text")).alias("words")).repartition("page_id")
    tf = words.select("page_id", F.explode("words").alias("w")).groupBy("page_id", "w").agg(F.count(F.lit(1)).alias("tf"))
    return tf.join(idf, "w").select("page_id", "w", (F.col("tf") * F.col("idf")).alias("x"))


def _vectors(weights: DataFrame, name: str) -> DataFrame:
    """``(page_id, norm, vector)``: one row per page; ``vector`` is an array of its (word, weight) entries."""
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")))
    return weights.groupBy("page_id").agg(norm.alias(f"norm_{name}"), F.collect_list(F.struct("w", "x")).alias(name)).select(
        F.col("page_id").alias(f"{name}_id"), f"norm_{name}", name)


def topic_relevance(pairs: DataFrame, corpus: DataFrame, digits: int = 6,
                    broadcast_bytes: int = 256 << 20) -> DataFrame:
    """``pairs(source_id, target_id, ...)`` -> same rows plus ``relevance``
    (cosine, rounded to ``digits``; 0 when either vector is empty).

    The table of word weights is broadcast if its measured size allows; beyond it that one join shuffles the words of the
    pages in pairs. A page's vector is bounded by its own text."""
    n_pages = corpus.count()            # a scalar, passed as a literal
    idf = materialize(idf_table(corpus, n_pages), "idf")
    idf = F.broadcast(idf) if measure(idf)["bytes"] <= broadcast_bytes else idf
    keys = pairs.select("source_id", "target_id").distinct()
    sources, targets = (keys.select(F.col(c).alias("page_id")).distinct() for c in ("source_id", "target_id"))
    texts = blank_fill(corpus).join(sources, "page_id", "left_semi").select("page_id", F.col("content").alias("text"))
    topics = entity_rows(corpus.join(targets, "page_id", "left_semi")).select("page_id", F.col("entity").alias("text"))
    source = _vectors(_weights(texts, idf), "source").withColumn("source", F.map_from_entries("source"))
    target = _vectors(_weights(topics, idf), "target")
    met = keys.join(target, "target_id", "left").join(source, "source_id", "left")
    dot = F.aggregate("target", F.lit(0.0), lambda acc, e: acc + e["x"] * F.coalesce(F.try_element_at("source", e["w"]), F.lit(0.0)))
    norms = F.col("norm_source") * F.col("norm_target")
    relevance = F.when((F.col("norm_source") > 0) & (F.col("norm_target") > 0), dot / norms).otherwise(F.lit(0.0))
    scored = met.select("source_id", "target_id", F.round(relevance, digits).alias("relevance"))
    return pairs.join(scored, ["source_id", "target_id"])


def suggestions_with_relevance(corpus: DataFrame, p: LinkParams = LinkParams()) -> DataFrame:
    """L11 with L2 as a reported column (never a rank key):
    ``(source_url, anchor_text, target_url, entity_match, rank, relevance)``."""
    ranked = ranked_links(corpus, p)    # a table: ranked once, read twice
    relevance = topic_relevance(ranked.select("source_id", "target_id"), corpus)
    return with_anchors(ranked, corpus).join(relevance, ["source_id", "target_id"]).select(
        "source_url", F.col("anchor").alias("anchor_text"), "target_url",
        F.concat(F.col("origin"), F.lit(": "), F.col("gram")).alias("entity_match"),
        F.col("rank").cast("long").alias("rank"), "relevance")
