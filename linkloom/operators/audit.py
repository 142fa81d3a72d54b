"""Check any suggestion table against the link contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions.text import word_count
from linkloom.operators.entities import blank_fill

FLAGS = ["unknown_target", "self_link", "duplicate_target", "bad_length",
         "not_verbatim", "over_cap"]


def unknown_targets(sugg: DataFrame, catalogue: DataFrame) -> DataFrame:
    """L3: suggestions whose target is not a catalogue URL (anti join)."""
    cat = catalogue.select(F.col("url").alias("target_url")).distinct()
    return sugg.join(cat, "target_url", "left_anti")


def self_links(sugg: DataFrame) -> DataFrame:
    """L4."""
    return sugg.where(F.col("source_url") == F.col("target_url"))


def anchor_length_ok(anchor, lo: int = 2, hi: int = 6):
    """Anchor of 2..6 words."""
    return word_count(anchor).between(lo, hi)


def suggestion_audit(sugg: DataFrame, corpus: DataFrame, k: int = 5,
                     order_col: str = "seq") -> DataFrame:
    """One row per suggestion with one flag per rule.

    ``order_col`` gives the position of a suggestion in its source's list
    (first one kept for duplicates, first ``k`` kept for the cap)."""
    cat = corpus.select(F.col("url").alias("target_url"), F.lit(True).alias("_known")).distinct()
    src = blank_fill(corpus.select("page_id", F.col("url").alias("source_url"), "content"),
                     cols=("content",))
    # Only the audited sources' texts are moved.
    src = src.join(sugg.select("source_url").distinct(), "source_url", "left_semi")
    # A URL held by several pages is checked against its first page
    # (min_by is a partial aggregate: no group is ever collected).
    src = src.groupBy("source_url").agg(F.min_by("content", "page_id").alias("_content"))
    s = (sugg.join(cat, "target_url", "left")
             .join(src, "source_url", "left"))
    by_pair = Window.partitionBy("source_url", "target_url").orderBy(order_col, "anchor_text")
    by_src = Window.partitionBy("source_url").orderBy(order_col, "target_url", "anchor_text")
    anchor = F.coalesce(F.col("anchor_text"), F.lit(""))
    verbatim = F.coalesce(F.instr(F.col("_content"), anchor) > 0, F.lit(False))
    return s.select(
        "source_url", "anchor_text", "target_url", F.col(order_col).cast("long").alias(order_col),
        F.col("_known").isNull().alias("unknown_target"),
        (F.col("source_url") == F.col("target_url")).alias("self_link"),
        (F.row_number().over(by_pair) > 1).alias("duplicate_target"),
        (~anchor_length_ok(anchor)).alias("bad_length"),
        ((anchor == F.lit("")) | ~verbatim).alias("not_verbatim"),
        (F.row_number().over(by_src) > k).alias("over_cap"),
    )


def audit_totals(audit: DataFrame) -> DataFrame:
    """Per-rule violation counts over an audit table (partial aggregates)."""
    aggs = [F.count(F.lit(1)).alias("suggestions"),
            F.countDistinct("source_url").alias("sources")]
    aggs += [F.sum(F.col(f).cast("long")).alias(f) for f in FLAGS]
    aggs.append(F.sum(F.greatest(*[F.col(f).cast("int") for f in FLAGS]).cast("long"))
                .alias("any_violation"))
    return audit.agg(*aggs)
