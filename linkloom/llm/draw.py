"""Bounded samples for fitting: the first distinct rows by a hash of their content.

A row's id plays no part, so null ids, one id on many rows and repeated rows change nothing: rows of equal content
are drawn once, and never more than the limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOP = (1 << 63) - 1
SPARE = 4  # times as many rows pass the first guess of the threshold as are wanted


def draw(rows: DataFrame, content: list[Column], limit: int, columns: list[str]) -> DataFrame:
    """``columns`` of at most ``limit`` rows with different ``content``: those whose content hash comes first (all, if there are fewer).

    Only hashes are compared over the table; a pass over a narrow range of them is repeated with a wider one if
    too few distinct rows fall into it. The columns are read for the drawn rows alone."""
    hashed = rows.withColumn("_draw", F.xxhash64(F.lit(17), *content))
    total = rows.count()
    share = SPARE * limit / max(total, 1)
    while True:
        bound = _TOP if share >= 1 else int(-(1 << 63) + (1 << 64) * share)
        first = (hashed.where(F.col("_draw") <= F.lit(bound)).select("_draw").distinct().orderBy("_draw").limit(limit)
                 .agg(F.count(F.lit(1)), F.max("_draw")).first())
        if first[0] == limit or bound == _TOP:
            break
        share *= 16
    last = first[1] if first[0] else -(1 << 63)
    one = hashed.where(F.col("_draw") <= F.lit(last)).groupBy("_draw").agg(*[F.first(c).alias(c) for c in columns])
    return one.select(*columns)
