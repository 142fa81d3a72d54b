"""Connected components of a link table, by distributed star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.plans.materialize import materialize


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``(id, root)`` for every id that occurs in a link; root = smallest linked id.

    Alternates two contractions until nothing changes: every node points its larger
    neighbours, then its smaller ones, at its smallest neighbour. Each keeps at most
    one row per link, minima are partial aggregates, and the round's table is written
    to the checkpoint folder, so no group and no lineage grows. Null ids and self
    links are ignored; an empty table gives an empty result.
    """
    edges = (links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
             .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
             .distinct())
    edges = materialize(edges, "links")
    before = _fingerprint(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("n")).select("u", F.least("u", "n").alias("m"))
        edges = (both.where("v > u").join(low, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        edges = (edges.join(low, "u")
                 .select(F.inline(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                                          F.struct(F.col("v").alias("u"), F.col("m").alias("v")))))
                 .where("u != v").distinct())
        edges = materialize(edges, "links")
        now = _fingerprint(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return roots.union(edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
