"""Shards of near equal bytes by sampled splitters.

Records are ordered by key (a hash of the text, so that equal texts lie together), then the id, then the row's number in the
table, so that any run of records can be divided. A load-weighted sample of the keys gives quantile boundaries of many
fine ranges; a record's load is its bytes plus the table's mean, so that neither bytes nor rows pile up. The loads of
each range are then summed exactly. An overfull range is subdivided at boundaries
from a new sample of that range alone, until all fit or no boundary is left: a text that
makes up most of the table is divided by id and row. Neighbouring ranges make up shards of equal bytes.

The samples are bounded (``SAMPLE`` keys for the table, then for each round of overfull ranges) and the
boundaries with them; sums are partial aggregates. Slots are numbered inside one range at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.plans.materialize import materialize

RANGES_PER_SHARD = 128
SAMPLE = 16_384       # expected keys drawn from the table
OVERFULL = 1.5        # times the mean load of a range

ORDER = ["shard_key", "shard_id", "shard_row"]
_KEY = np.dtype([(c, np.int64) for c in ORDER])


def _keys(*columns: np.ndarray) -> np.ndarray:
    out = np.empty(len(columns[0]), _KEY)
    for c, x in zip(ORDER, columns):
        out[c] = x
    return out


def _range_of(records: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Number of boundaries (ascending) at or below each record."""
    low, high = (np.searchsorted(bounds["shard_key"], records["shard_key"], side) for side in ("left", "right"))
    out = low.astype(np.int64)
    rows = np.flatnonzero(high > low)  # the key of a boundary: the id and row decide
    out[rows] = np.searchsorted(bounds, records[rows], "right")
    return out


def _with_range(records: DataFrame, bounds: np.ndarray) -> DataFrame:
    names = records.columns
    at = [names.index(c) for c in ORDER]

    def run(batches):
        for batch in batches:
            keys = _keys(*(batch.column(k).to_numpy() for k in at))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_range_of(keys, bounds))], names=[*names, "range"])

    return records.mapInArrow(run, T.StructType([*records.schema.fields, T.StructField("range", T.LongType())]))


def _draw(records: DataFrame, step: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys drawn with probability load / step (all beyond), in order, with the load each stands for."""
    unit = F.shiftrightunsigned(F.xxhash64(*ORDER, F.lit(seed)), 11) / F.lit(float(1 << 53))
    rows = (records.where(unit < F.col("load") / F.lit(float(step)))
            .select(*ORDER, F.greatest("load", F.lit(step)).cast("double").alias("weight")))
    got = rows.toArrow()  # bounded: expected SAMPLE rows, each drawn on its own
    keys = _keys(*(got[c].to_numpy() for c in ORDER))
    order = np.argsort(keys, kind="stable")
    return keys[order], got["weight"].to_numpy()[order]


def _splitters(keys: np.ndarray, weights: np.ndarray, ranges: int) -> set[tuple]:
    """Keys at the weight quantiles of a sample."""
    if not len(keys):
        return set()
    upto = np.cumsum(weights)
    at = np.searchsorted(upto, upto[-1] * np.arange(1, ranges) / ranges)
    return {tuple(x) for x in keys[at].tolist()}


def _boundaries(records: DataFrame, shards: int) -> tuple[np.ndarray, list]:
    total, rows = records.agg(F.sum("size"), F.count(F.lit(1))).first()
    mean_size = -(-(total or 0) // max(rows, 1))
    records = records.withColumn("load", F.col("size") + mean_size)
    load = (total or 0) + rows * mean_size
    ranges = shards * RANGES_PER_SHARD
    bounds = _splitters(*_draw(records, max(load / SAMPLE, 1), 0), ranges)
    tried: set[tuple] = set()
    seed = 0
    while True:
        array = np.array(sorted(bounds), _KEY)
        measured = (_with_range(records, array).groupBy("range")
                    .agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")).orderBy("range").collect())
        mean = load / ranges
        loads = {r["range"]: r["size"] + r["rows"] * mean_size for r in measured}
        span = lambda k: (array[k - 1].item() if k else None, array[k].item() if k < len(array) else None)
        over = [r for r in measured if loads[r["range"]] > OVERFULL * mean and r["rows"] > 1 and span(r["range"]) not in tried]
        if not over:
            return array, [tuple(r) for r in measured]
        seed += 1
        before = len(bounds)
        located = _with_range(records, array).where(F.col("range").isin([r["range"] for r in over]))
        tried |= {span(r["range"]) for r in over}
        keys, weights = _draw(located, max(sum(loads[r["range"]] for r in over) / SAMPLE, 1), seed)
        at = _range_of(keys, array)
        for r in over:
            own = at == r["range"]
            bounds |= _splitters(keys[own], weights[own], int(np.ceil(2 * loads[r["range"]] / mean)))
        if len(bounds) == before:
            return array, [tuple(r) for r in measured]


def shard_records(records: DataFrame, shards: int, id_col: str = "doc_id", size_col: str = "size",
                  key_col: str = "key") -> DataFrame:
    """``records`` with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard).

    Law: the shards' sums of ``size_col`` are near equal (the error is a fraction of one fine
    range, or one record). ``key_col`` is a long; equal keys share a shard unless they overfill
    their range. A null id counts as the smallest, a null key as 0; records that repeat key
    and id are divided like any others. With fewer records than shards some stay empty; an empty
    table gives an empty result. Columns of ``records`` named shard or slot are replaced. The records are
    written once to the checkpoint folder, so that every step sees the same row numbers.
    """
    kept = [c for c in records.columns if c not in ("shard", "slot")]
    base = materialize(records.select(
        *kept, F.coalesce(F.col(key_col), F.lit(0)).cast("long").alias("shard_key"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("shard_id"),
        F.monotonically_increasing_id().alias("shard_row"), F.col(size_col).cast("long").alias("shard_size")), "shard-records")
    bounds, measured = _boundaries(base.select(*ORDER, F.col("shard_size").alias("size")), shards)
    total = sum(m[1] for m in measured)
    plan, before, filled = [], 0, {}
    for place, size, rows in measured:  # one row per range: bounded by the samples
        shard = min(shards - 1, int((before + size / 2) * shards / total)) if total else 0
        plan.append((int(place), shard, filled.get(shard, 0)))
        filled[shard] = filled.get(shard, 0) + rows
        before += size
    spark = records.sparkSession
    places = spark.createDataFrame(plan or [(0, 0, 0)], "range long, shard int, filled long")
    inside = Window.partitionBy("range").orderBy(*ORDER)
    return (_with_range(base, bounds).withColumn("nth", F.row_number().over(inside))
            .join(F.broadcast(places), "range")
            .select(*kept, "shard", (F.col("filled") + F.col("nth") - 1).cast("long").alias("slot")))


def write_shards(docs: DataFrame, path: str, shards: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the rows of ``docs`` as Parquet, one folder ``shard=N`` for each shard."""
    sized = with_size(docs, text_col)
    (shard_records(sized, shards, id_col).drop("size", "key").write.partitionBy("shard").parquet(path))


def with_size(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``size`` (UTF-8 bytes of the text, none for null, plus 1) and ``key`` (hash of the text)."""
    return docs.withColumns({"size": F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 1,
                             "key": F.xxhash64(text_col)})
