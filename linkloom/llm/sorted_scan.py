"""Running counts, sums and sequence hashes over a sorted table, without one task per group.

Rows are range-partitioned by the whole order, sorted, and scanned batch by batch inside
each partition; the scanned rows are written to the checkpoint folder. A summary of one row per
partition (so its size is bounded by the number of partitions) tells what the partitions before leave
open; that carry is then added row by row. A group with a third of all rows is spread over a third of the
partitions. All sums are modulo 2^64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.plans.materialize import materialize

# Odd multipliers of the two sequence hashes, and the largest power table that a scan grows at once.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(which: int, n: int) -> np.ndarray:
    """0th to n-th power of a multiplier."""
    have = _POWERS[which]
    if len(have) <= n:
        size = max(n + 1, 2 * len(have))
        with np.errstate(over="ignore"):
            _POWERS[which] = np.multiply.accumulate(
                np.concatenate([np.ones(1, np.uint64), np.full(size - 1, MULTIPLIERS[which], np.uint64)]))
    return _POWERS[which]


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def ranged(df: DataFrame, *order) -> DataFrame:
    """Rows dealt by ranges of the order and sorted in each partition. The order must tell rows apart
    well enough to split any large run of equal keys."""
    return df.repartitionByRange(partitions(df), *order).sortWithinPartitions(*order)


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys start."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def scan_sequences(df: DataFrame, group: str, order: list, hashes: tuple[str, str], carry: list[str]) -> DataFrame:
    """``(group, *carry, n, a, b, pa, pb, last)`` for each row of ``df``, in the order ``(group, *order)``.

    ``n`` is the row's place in its group (from 1); ``(a, b)`` are two 64-bit hashes of the group's sequence
    up to the row, built from the 64-bit columns ``hashes``; ``(pa, pb)`` the same up to the row before
    ((0, 0) for the first); ``last`` marks a group's last row. ``group`` is a long and not null.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    columns = [group, *carry]

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        state = (None, 0, np.uint64(0), np.uint64(0))  # open group, rows so far, hashes so far
        held = None  # the last row waits for the next, which tells whether it ends its group
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            n = batch.num_rows
            starts = _runs(keys)
            size = np.diff(np.append(starts, n))
            first = np.zeros(len(starts), np.int64)
            before = np.zeros((2, len(starts)), np.uint64)
            if state[0] is not None and state[0] == keys[0]:
                first[0], before[:, 0] = state[1], state[2:]
            place = np.arange(n) - np.repeat(starts - first, size) + 1
            out = [batch.column(i) for i in range(len(columns))] + [pa.array(place)]
            now = []
            with np.errstate(over="ignore"):
                for k in range(2):
                    value = batch.column(len(columns) + k).to_numpy(zero_copy_only=False).view(np.uint64)
                    run = np.cumsum(value * powers(k, int(place.max()))[place])
                    base = np.where(starts > 0, run[starts - 1], np.uint64(0)) - before[k]
                    total = run - np.repeat(base, size)
                    now.append(total)
                    back = np.concatenate([[np.uint64(0)], total[:-1]]).astype(np.uint64)
                    back[starts] = before[k]
                    now.append(back)
            ends = np.zeros(n, bool)
            ends[np.append(starts[1:], n) - 1] = True
            state = (keys[-1], int(place[-1]), now[0][-1], now[2][-1])
            edge = np.zeros(n, bool)
            edge[0] = held is None  # of the partition
            made = pa.table([*out, *(_signed(x) for x in (now[0], now[2], now[1], now[3])), pa.array(ends),
                             pa.array(np.full(n, part, np.int32)), pa.array(edge)], names=names)
            if held is not None:
                if held["__key"] == keys[0]:
                    held["row"] = held["row"].set_column(names.index("last"), "last", pa.array([False]))
                yield from held["row"].to_batches()
            held = {"row": made.slice(n - 1), "__key": keys[-1]}
            yield from made.slice(0, n - 1).to_batches()
        if held is not None:
            yield from held["row"].set_column(names.index("_edge"), "_edge", pa.array([True])).to_batches()

    names = [*columns, "n", "a", "b", "pa", "pb", "last", "_part", "_edge"]
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", n long, a long, b long, pa long, pb long, last boolean, _part int, _edge boolean"
    rows = materialize(ranged(df, group, *order).select(*columns, *hashes).mapInArrow(local, schema), "sequence-scan")
    found: dict[int, list] = {}  # a partition's first and last row
    for r in rows.where("_edge").select("_part", group, "n", "a", "b").collect():
        found.setdefault(r[0], []).append(tuple(r)[1:])
    ends = [{"_part": p, "first": min(found[p])[0], "last": max(found[p])} for p in sorted(found)]
    carried: dict[int, tuple] = {}  # partition -> rows and hashes of its first group in the partitions before
    more: dict[int, int] = {}       # partition -> group that goes on in the next one
    for before, here in zip(ends, ends[1:]):
        if before["last"][0] == here["first"]:
            more[before["_part"]] = here["first"]
            n, a, b = (int(x) for x in before["last"][1:])
            if before["first"] == here["first"] and before["_part"] in carried:
                n, a, b = _joined(carried[before["_part"]][1:], (n, a, b))
            carried[here["_part"]] = (here["first"], n, a, b)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            part = batch.column(batch.num_columns - 2).to_numpy()
            place, a, b, back_a, back_b = (batch.column(len(columns) + k).to_numpy().copy() for k in range(5))
            last = batch.column(len(columns) + 5).to_numpy(zero_copy_only=False).copy()
            for p in np.unique(part).tolist():
                if p in more:
                    last[(part == p) & (keys == more[p])] = False
                if p in carried:
                    key, n, *sums = carried[p]
                    own = (part == p) & (keys == key)
                    with np.errstate(over="ignore"):
                        for k, (now, back) in enumerate(((a, back_a), (b, back_b))):
                            base = np.uint64(sums[k] % (1 << 64))
                            scale = np.uint64(pow(MULTIPLIERS[k], n, 1 << 64))
                            for column in (now, back):
                                column[own] = (column[own].view(np.uint64) * scale + base).view(np.int64)
                    place[own] += n
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(len(columns))]
                + [pa.array(x) for x in (place, a, b, back_a, back_b, last)], names=names[:-2])

    return rows.mapInArrow(whole, schema.removesuffix(", _part int, _edge boolean"))


def _joined(first: tuple, second: tuple) -> tuple:
    """Count and hashes of two sequences, one after the other."""
    n, m = first[0], second[0]
    return (n + m, *((first[1 + k] + second[1 + k] * pow(MULTIPLIERS[k], n, 1 << 64)) % (1 << 64) for k in range(2)))


def running_sums(df: DataFrame, order: str, values: list[str], carry: list[str]) -> DataFrame:
    """``(order, *carry, *values)`` with each of the long columns ``values`` replaced by its sum up to and
    including the row, in the order of the unique long column ``order``."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    names = [order, *carry, *values]

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        total, held = [0] * len(values), None  # a batch waits for the next: the partition's last row is marked
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                yield held
            sums = []
            for k in range(len(values)):
                run = np.cumsum(batch.column(1 + len(carry) + k).to_numpy(zero_copy_only=False)) + total[k]
                total[k] = int(run[-1])
                sums.append(pa.array(run))
            held = pa.RecordBatch.from_arrays(
                [batch.column(k) for k in range(1 + len(carry))] + sums
                + [pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(np.zeros(batch.num_rows, bool))], names=[*names, "_part", "_edge"])
        if held is not None:
            edge = np.arange(held.num_rows) == held.num_rows - 1
            yield held.set_column(len(names) + 1, "_edge", pa.array(edge))

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", _part int, _edge boolean"
    rows = materialize(ranged(df.select(*names), order).mapInArrow(local, schema), "running-sums")
    offsets, total = [], [0] * len(values)
    for part, *last in sorted(map(tuple, rows.where("_edge").select("_part", *values).collect())):
        offsets.append((part, *total))
        total = [t + x for t, x in zip(total, last)]
    # One row per partition.
    offsets = df.sparkSession.createDataFrame(offsets, "_part int, " + ", ".join(f"_{v} long" for v in values))
    return rows.join(F.broadcast(offsets), "_part").select(
        order, *carry, *[(F.col(v) + F.col(f"_{v}")).alias(v) for v in values])
