"""Corpus, suggestion and job statistics (partial aggregates only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def corpus_stats(corpus: DataFrame) -> DataFrame:
    """A1-A3 over a corpus as read (missing values are NULL)."""
    return corpus.agg(F.count(F.lit(1)).alias("total_pages"),
                      F.count("h1").alias("pages_with_h1"),
                      F.count("meta_title").alias("pages_with_title"))


def suggestion_stats(sugg: DataFrame, approx: bool = False) -> DataFrame:
    """A4-A6. The average is the raw double (0 when there are no
    suggestions); rounding is for display only."""
    distinct = (F.approx_count_distinct("source_url") if approx
                else F.countDistinct("source_url"))
    s = sugg.agg(F.count(F.lit(1)).alias("total_suggestions"),
                 distinct.alias("pages_with_suggestions"))
    return s.select("total_suggestions", "pages_with_suggestions",
                    F.coalesce(F.try_divide(F.col("total_suggestions").cast("double"),
                                            F.col("pages_with_suggestions")),
                               F.lit(0.0)).alias("avg_per_page"))


def progress_ratio(current, total):
    """``current / max(1, total)``."""
    return current.cast("double") / F.greatest(F.lit(1), total).cast("double")


def progress_series(ordered: DataFrame, offset: int, total: int | None = None,
                    ordinal_col: str = "page_no") -> DataFrame:
    """Progress reported while resuming after ``offset`` pages:
    ``(current_page, total_pages)`` for every page after the checkpoint,
    against the original total (``ordered`` carries a 1-based ordinal)."""
    tot = F.lit(total).cast("long") if total is not None else F.lit(ordered.count()).cast("long")
    return ordered.where(F.col(ordinal_col) > F.lit(offset)).select(
        F.col(ordinal_col).cast("long").alias("current_page"), tot.alias("total_pages"))
