"""Bulk parse of model-style response texts into suggestion rows.

Each response is parsed with ``try_parse_json`` into a VARIANT. The text is
wrapped as ``[` + text + `]`` and must give exactly one element, which makes
trailing text (``[..] tail``) a failure as in a strict JSON parser. On
failure the greedy first-``[``-to-last-``]`` span is tried the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions.text import py_strip

# --- fixed value: greedy array span, dot matches newline ---
ARRAY_SPAN_RE = "(?s)\\[.*\\]"


def _single_json(text: Column) -> Column:
    wrapped = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    one = (F.try_variant_get(wrapped, "$[0]", "variant").isNotNull()
           & F.try_variant_get(wrapped, "$[1]", "variant").isNull())
    return F.when(one, F.try_variant_get(wrapped, "$[0]", "variant"))


def parse_responses(responses: DataFrame, text_col: str = "response_text") -> DataFrame:
    """Adds ``root`` (VARIANT or NULL) and ``parse_status``
    (``direct`` / ``fallback`` / ``failed``)."""
    t = py_strip(F.coalesce(F.col(text_col), F.lit("")))
    staged = responses.withColumn("_t", t)
    staged = staged.withColumn("_direct", _single_json(F.col("_t")))
    span = F.regexp_extract(F.col("_t"), ARRAY_SPAN_RE, 0)
    staged = staged.withColumn("_fb", F.when(F.col("_direct").isNull() & (span != F.lit("")),
                                             _single_json(span)))
    status = (F.when(F.col("_direct").isNotNull(), F.lit("direct"))
               .when(F.col("_fb").isNotNull(), F.lit("fallback")).otherwise(F.lit("failed")))
    return (staged.withColumn("root", F.coalesce("_direct", "_fb"))
                  .withColumn("parse_status", status)
                  .drop("_t", "_direct", "_fb"))


def _valid_items() -> Column:
    """Array of ``struct(pos, el)``: elements of ``root`` that are objects holding both required keys."""
    arr = F.try_variant_get(F.col("root"), "$", "array<variant>")
    numbered = F.transform(arr, lambda el, i: F.struct(i.alias("pos"), el.alias("el")))
    return F.filter(numbered, lambda e: (
        F.try_variant_get(e["el"], "$.anchor_text", "variant").isNotNull()
        & F.try_variant_get(e["el"], "$.target_url", "variant").isNotNull()))


def response_items(parsed: DataFrame, keep: list[str]) -> DataFrame:
    """R2: array elements that are objects holding both required keys (a
    JSON null value counts as present). A top-level object or scalar gives
    no items. ``pos`` is the 0-based element position."""
    return parsed.select(*keep, F.inline(_valid_items()))


def response_suggestions(responses: DataFrame, k: int = 5, source_col: str = "source_url",
                         keep: tuple[str, ...] = ()) -> DataFrame:
    """Suggestion rows, first ``k`` valid items of each response in order.

    The cap counts inside each response's own array, so several responses of one source each give up
    to ``k`` rows, and nothing is shuffled. ``keep``: columns that tell responses apart."""
    items = parse_responses(responses).select(
        F.col(source_col).alias("source_url"), *keep, F.inline(F.slice(_valid_items(), 1, k)))
    return items.select(
        "source_url", *keep,
        F.try_variant_get(F.col("el"), "$.anchor_text", "string").alias("anchor_text"),
        F.try_variant_get(F.col("el"), "$.target_url", "string").alias("target_url"),
        F.try_variant_get(F.col("el"), "$.entity_match", "string").alias("entity_match"),
        F.col("pos").cast("long").alias("item_pos"))


def response_outcomes(responses: DataFrame) -> DataFrame:
    """Number of responses per parse outcome."""
    return parse_responses(responses).groupBy("parse_status").agg(
        F.count(F.lit(1)).alias("responses"))
