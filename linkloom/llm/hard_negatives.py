"""Hard-negative mining over Hilbert-ordered blocks with zone maps.

* All usable rows, as integer vectors, are sorted by label and Hilbert index (of the ``DIMS`` components with
  the largest variance) and written to Parquet as blocks of ``BLOCK`` rows, each with the least and greatest value
  of every component. ``STRIPE`` blocks of one label are what a task reads; the anchors of ``GROUP`` stripes travel together.
* Interval arithmetic on those values bounds every inner product between a group of anchors and a
  stripe, and between an anchor and a block, from below and above. Only stripes that can reach a
  window are joined, and in them only such blocks are multiplied.
* The first search (same label) begins at the score that an anchor's own block already gives it; the second
  (other labels) reads the windows below the positives that were found.

The bounds are exact, so the result is too, however little they exclude. No task holds more than a
stripe and a group of anchors, whatever label or vector is common.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.sorted_scan import ranged
from linkloom.plans.materialize import materialize

BLOCK = 256          # rows of a block
STRIPE = 64          # blocks that a task reads together
GROUP = 8            # stripes whose anchors are searched together
DIMS, BITS = 8, 7    # components of the Hilbert curve and bits of each
POSITIVES, NEGATIVES = 5, 10
BUCKET = 256         # zone maps of stripes or of anchor groups that are compared at once
ANCHORS = 64         # anchors multiplied at once
EXACT = float(1 << 53)
_LEAST = np.iinfo(np.int64).min


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each row of cell numbers (n, d; below ``2**bits``) on the d-dimensional Hilbert curve; d * bits <= 63."""
    x = cells.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations of each level, from the coarsest
        p = q - 1
        for i in range(d):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):  # Gray code
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[d - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    out = np.zeros(x.shape[1], np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(d):
            out = out << 1 | (x[i] >> bit & 1)
    return out


def _matrix(column, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def _integers(column, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows with a usable vector, and floor(256 x) of their components."""
    values = column.cast(pa.list_(pa.float64()))
    lengths = pc.list_value_length(values).fill_null(-1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(lengths == width)
    flat = values.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), width)
    with np.errstate(all="ignore"):
        flat = np.floor(256 * flat) + 0.0
    good = np.isfinite(flat).all(1)
    return rows[good], flat[good]


def _usable(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """``(id, label, vector)`` of rows with all three, with the labels that the mining uses."""
    moved = F.pmod(F.col(label_col).cast("long") + 1, F.lit(10))
    return vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (F.size(vec_col) > 0)).select(
        F.col(id_col).cast("long").alias("id"),
        F.when(F.pmod(id_col, F.lit(7)) == 0, moved).otherwise(F.col(label_col).cast("long")).alias("label"),
        F.col(vec_col).alias("vector"))


def _grid(rows: DataFrame) -> tuple[int, np.ndarray, np.ndarray, np.ndarray] | None:
    """Components (the most frequent number of them), and the ``DIMS`` of largest variance with their least and greatest value."""
    top = rows.groupBy(F.size("vector").alias("width")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    if top is None:
        return None
    width = top["width"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, square = 0, np.zeros(width), np.zeros(width)
        least, most = np.full(width, np.inf), np.full(width, -np.inf)
        for batch in batches:
            _, values = _integers(batch.column(0), width)
            if len(values):
                n, total, square = n + len(values), total + values.sum(0), square + (values ** 2).sum(0)
                least, most = np.minimum(least, values.min(0)), np.maximum(most, values.max(0))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n])] + [pa.array([x.tolist()]) for x in (total, square, least, most)],
                                             names=["n", "total", "square", "least", "most"])

    # One row per partition.
    found = rows.select("vector").mapInArrow(
        run, "n long, total array<double>, square array<double>, least array<double>, most array<double>").collect()
    if not found:
        return None
    n = sum(r["n"] for r in found)
    total, square = (np.sum([r[c] for r in found], 0) for c in ("total", "square"))
    dims = np.argsort(-(square / n - (total / n) ** 2), kind="stable")[:DIMS]
    return width, dims, np.min([r["least"] for r in found], 0)[dims], np.max([r["most"] for r in found], 0)[dims]


def ordered_rows(rows: DataFrame, grid: tuple) -> DataFrame:
    """``(id, label, v, place)``: integer vectors with their place on the Hilbert curve; equal rows once."""
    width, dims, least, most = grid
    scale = np.where(most > least, ((1 << BITS) - 1) / np.maximum(most - least, 1e-300), 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, values = _integers(batch.column(2), width)
            cells = np.clip(np.floor((values[:, dims] - least) * scale), 0, (1 << BITS) - 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(good)), batch.column(1).take(pa.array(good)), _lists(values),
                 pa.array(hilbert_index(cells, BITS))], names=["id", "label", "v", "place"])

    return rows.mapInArrow(run, "id long, label long, v array<double>, place long").dropDuplicates(["id", "label", "v"])


def _lists(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.reshape(-1)))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows of ``a`` with all rows of ``b`` (integer-valued doubles)."""
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1] < EXACT:
        return (a @ b.T).astype(np.int64)
    exact = [np.array([[int(x) for x in row] for row in m], object).reshape(m.shape) for m in (a, b)]
    return (exact[0] @ exact[1].T).astype(np.int64)  # raises where a score is beyond a long


def bounds(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each row of ``a`` with any vector between ``low`` and ``high`` (one row per block)."""
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    slack = 1e-12 * (np.abs(a) @ np.maximum(np.abs(low), np.abs(high)).T)
    return up @ low.T + down @ high.T - slack, up @ high.T + down @ low.T + slack


def interval_bounds(low: np.ndarray, high: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of any vector between ``low`` and ``high`` with any between the rows of ``lows`` and ``highs``."""
    corners = np.stack([low * lows, low * highs, high * lows, high * highs])
    slack = 1e-12 * np.abs(corners).max(0).sum(1)
    return corners.min(0).sum(1) - slack, corners.max(0).sum(1) + slack


_BLOCKS = ("stripe long, `group` long, label long, ids array<long>, v array<double>, low array<double>, high array<double>, "
           "keys array<long>, places array<int>, seeds array<long>, "
           "stripe_low array<double>, stripe_high array<double>, group_low array<double>, group_high array<double>, group_seed long")


def candidate_blocks(rows: DataFrame, width: int, every: int) -> DataFrame:
    """The rows as a table of blocks along the curve, with zone maps.

    ``keys, places, seeds`` tell the block's anchors (ids divisible by ``every``), where they stand in it, and the
    score of the ``POSITIVES``-th best row of the same block (the least long, if there are fewer). The last block of a
    stripe (of a group of stripes) carries the zone map of the stripe (of the group's anchors, with their least seed).
    """
    names = [x.split()[0].strip("`") for x in _BLOCKS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        state = {"stripe": 0, "group": 0, "blocks": 0, "stripes": 0, "anchors": 0}
        zone, asked, seed = None, None, None

        def block(label: int, ids: np.ndarray, v: np.ndarray, ends: bool) -> pa.RecordBatch:
            nonlocal zone, asked, seed
            low, high = v.min(0), v.max(0)
            zone = (low, high) if zone is None else (np.minimum(zone[0], low), np.maximum(zone[1], high))
            places = np.flatnonzero(ids % every == 0)
            score = products(v[places], v)
            score[ids[places][:, None] == ids[None]] = _LEAST
            seeds = np.full(len(places), _LEAST) if len(ids) < POSITIVES else np.partition(score, len(ids) - POSITIVES, 1)[:, len(ids) - POSITIVES]
            keys = (part << 40) + state["anchors"] + np.arange(len(places))
            state["anchors"] += len(places)
            if len(places):
                low_, high_ = v[places].min(0), v[places].max(0)
                asked = (low_, high_) if asked is None else (np.minimum(asked[0], low_), np.maximum(asked[1], high_))
                seed = int(seeds.min()) if seed is None else min(seed, int(seeds.min()))
            state["blocks"] += 1
            last = ends or state["blocks"] == STRIPE
            out = [(part << 32) + state["stripe"], (part << 32) + state["group"], label, ids.tolist(), v.reshape(-1).tolist(), low.tolist(),
                   high.tolist(), keys.tolist(), places.tolist(), seeds.tolist(), *([x.tolist() for x in zone] if last else [None, None])]
            if last:
                state["stripe"], state["stripes"], state["blocks"], zone = state["stripe"] + 1, state["stripes"] + 1, 0, None
            done = ends or state["stripes"] == GROUP
            out += [*[x.tolist() for x in asked], seed] if done and asked is not None else [None, None, None]
            if done:
                state["group"], state["stripes"], asked, seed = state["group"] + 1, 0, None, None
            return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(out, kinds)], names=names)

        long, doubles, longs = pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64())
        kinds = [long, long, long, longs, doubles, doubles, doubles, longs, pa.list_(pa.int32()), longs, doubles, doubles, doubles, doubles, long]
        label, ids, v = None, np.zeros(0, np.int64), np.zeros((0, width))
        for batch in batches:
            labels, more = batch.column(1).to_numpy(), batch.column(0).to_numpy()
            values = _matrix(batch.column(2), width)
            cuts = np.concatenate([[0], np.flatnonzero(labels[1:] != labels[:-1]) + 1, [len(labels)]]) if len(labels) else [0]
            for i, j in zip(cuts, cuts[1:]):
                if label is not None and labels[i] != label and len(ids):
                    yield block(label, ids, v, True)
                    ids, v = ids[:0], v[:0]
                label = int(labels[i])
                ids, v = np.concatenate([ids, more[i:j]]), np.concatenate([v, values[i:j]])
                while len(ids) > BLOCK:  # one row is kept back for the block that ends the label
                    yield block(label, ids[:BLOCK], v[:BLOCK], False)
                    ids, v = ids[BLOCK:], v[BLOCK:]
        if len(ids):
            yield block(label, ids, v, True)

    return ranged(rows, "label", "place", "id").select("id", "label", "v").mapInArrow(run, _BLOCKS)


def _apart(table: DataFrame) -> DataFrame:
    """The same columns under identities of their own: both sides of a cogroup may stem from one table."""
    return table.select(*[F.col(f"`{c}`").alias(c) for c in table.columns])


def cells(groups: DataFrame, stripes: DataFrame, same_label: bool) -> DataFrame:
    """``(group, stripe)`` pairs that can hold a wanted score: ``groups(group, label, low, high, least, most)``
    asks for scores from ``least`` to ``most`` in ``stripes(stripe, label, low, high)`` of the same or of other labels.

    Zone maps only; both sides are dealt out in buckets, each pair of buckets to one task."""
    n_stripes = max(1, -(-stripes.count() // BUCKET))
    n_groups = max(1, -(-groups.count() // BUCKET))

    def dealt(table: DataFrame, key: str, own: str, mine: int, other: str, others: int) -> DataFrame:
        return table.withColumn(own, F.pmod(F.xxhash64(key), F.lit(mine))).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            width = len(left["low"][0].as_py())
            low, high, lows, highs = (_matrix(x, width) for x in (left["low"], left["high"], right["low"], right["high"]))
            label, labels, stripe = left["label"].to_numpy(), right["label"].to_numpy(), right["stripe"].to_numpy()
            least, most, group = (left[c].to_numpy() for c in ("least", "most", "group"))
            for k in range(len(group)):
                under, over = interval_bounds(low[k], high[k], lows, highs)
                keep = ((labels == label[k]) == same_label) & (over >= least[k]) & (under <= most[k])
                found.append((np.full(keep.sum(), group[k]), stripe[keep]))
        group, stripe = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
        return pa.table({"group": group, "stripe": stripe})

    left = dealt(groups, "group", "gb", n_groups, "sb", n_stripes)
    right = _apart(dealt(stripes, "stripe", "sb", n_stripes, "gb", n_groups))
    return left.groupBy("gb", "sb").cogroup(right.groupBy("gb", "sb")).applyInArrow(run, "`group` long, stripe long")


def best_within(scores: np.ndarray, ids: np.ndarray, least: np.ndarray, most: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of each row's ``top`` scores from ``least`` to ``most``, best first, ties to smaller ids."""
    inside = (scores >= least[:, None]) & (scores <= most[:, None])
    if scores.shape[1] > top:
        kept = np.where(inside, scores, _LEAST)
        edge = np.partition(kept, scores.shape[1] - top, axis=1)[:, scores.shape[1] - top]
        inside &= scores >= edge[:, None]
    row, column = np.nonzero(inside)
    order = np.lexsort((ids[column], -scores[row, column].astype(np.float64), row)) if np.abs(scores).max(initial=0) < EXACT else \
        np.array(sorted(range(len(row)), key=lambda k: (row[k], -int(scores[row[k], column[k]]), ids[column[k]])), np.int64)
    row, column = row[order], column[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < top
    return row[keep], column[keep]


def search(anchors: DataFrame, blocks: DataFrame, chosen: DataFrame, width: int, top: int) -> DataFrame:
    """``(key, place, found, score)``: the best rows of the chosen stripes within each anchor's windows.

    ``anchors(key, group, anchor_id, v, windows)``; a window is a struct ``(place, least, most)``. A stripe gives at most ``top`` rows for
    each window. A row with the anchor's id is never found."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64),) * 4]
        if left.num_rows and right.num_rows:
            size = pc.list_value_length(right["ids"]).to_numpy()
            starts = np.concatenate([[0], np.cumsum(size)])
            ids = right["ids"].combine_chunks().flatten().to_numpy()
            v, lows, highs = (_matrix(right[c], width) for c in ("v", "low", "high"))
            a, own, keys = _matrix(left["v"], width), left["anchor_id"].to_numpy(), left["key"].to_numpy()
            windows = left["windows"].combine_chunks()
            first = np.concatenate([[0], np.cumsum(windows.value_lengths().to_numpy())])
            flat = windows.flatten()
            place, least, most = (flat.field(k).to_numpy() for k in range(3))
            times = np.diff(first)
            lowest, highest = np.minimum.reduceat(least, first[:-1]), np.maximum.reduceat(most, first[:-1])
            under, over = bounds(a, lows, highs)
            reach = (over >= lowest[:, None]) & (under <= highest[:, None])
            for i in range(0, len(a), ANCHORS):
                batch = np.arange(i, min(i + ANCHORS, len(a)))
                read = np.flatnonzero(reach[batch].any(0))
                if not len(read):
                    continue
                rows = np.concatenate([np.arange(starts[k], starts[k + 1]) for k in read])
                score = products(a[batch], v[rows])
                same = own[batch][:, None] == ids[rows][None]
                for k in range(int(times[batch].max())):
                    some = np.flatnonzero(times[batch] > k)
                    at = first[batch[some]] + k
                    row, column = best_within(np.where(same[some], _LEAST, score[some]), ids[rows], np.maximum(least[at], _LEAST + 1), most[at], top)
                    found.append((keys[batch[some[row]]], place[at[row]], ids[rows[column]], score[some[row], column]))
        key, place, near, score = (np.concatenate(x) for x in zip(*found))
        return pa.table({"key": key, "place": place, "found": near, "score": score})

    asked = anchors.select("group", "key", "anchor_id", "v", "windows").join(chosen, "group")
    read = _apart(blocks.select("stripe", "ids", "v", "low", "high").join(_apart(chosen), "stripe"))
    return asked.groupBy("group", "stripe").cogroup(read.groupBy("group", "stripe")).applyInArrow(
        run, "key long, place long, found long, score long")


def hard_negatives(vectors: DataFrame, every: int = 100, id_col: str = "vec_id", vec_col: str = "embedding",
                   label_col: str = "label") -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` for each anchor (id divisible by ``every``), each of
    its first ``POSITIVES`` rows of the same label, and the first ``NEGATIVES`` rows of other labels whose
    score is between 30 % and 90 % of the positive's. Higher scores come first, ties by smaller id.

    Labels of ids divisible by 7 are moved to ``(label + 1) % 10`` first; components are floor(256 x); scores are
    exact integers (one beyond a long raises an error). Rows with a null id, label or vector, with a null or non-finite component, or
    with another number of components than most (an empty vector has none) take no part; zero vectors do. Rows that
    are equal throughout count once; rows that share an id but differ count each, and never for one another. An
    empty table gives an empty result. Other columns are not read.
    """
    usable = _usable(vectors, id_col, vec_col, label_col)
    grid = _grid(usable)
    result = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    if grid is None:
        kinds = {"rank": "int"}
        return usable.where(F.lit(False)).select(*[F.lit(None).cast(kinds.get(c, "long")).alias(c) for c in result])
    width = grid[0]
    blocks = materialize(candidate_blocks(ordered_rows(usable, grid), width, every), "candidate-blocks")
    stripes = blocks.where("stripe_low IS NOT NULL").select("stripe", "label", F.col("stripe_low").alias("low"), F.col("stripe_high").alias("high"))
    zones = blocks.where("group_low IS NOT NULL").select("group", "label", F.col("group_low").alias("low"), F.col("group_high").alias("high"), "group_seed")
    anchors = (blocks.where(F.size("keys") > 0)
               .select("group", "ids", "v", F.inline(F.arrays_zip("keys", "places", "seeds")))
               .select("group", F.col("keys").alias("key"), F.element_at("ids", F.col("places") + 1).alias("anchor_id"),
                       F.slice("v", F.col("places") * width + 1, width).alias("v"), "seeds"))
    anchors = materialize(anchors, "anchors")
    most = F.lit((1 << 63) - 1)

    asking = anchors.withColumn("windows", F.array(F.struct(F.lit(0).cast("long").alias("place"), F.col("seeds").alias("least"), most.alias("most"))))
    chosen = materialize(cells(zones.select("group", "label", "low", "high", F.col("group_seed").alias("least"), most.alias("most")), stripes, True), "cells")
    order = Window.partitionBy("key").orderBy(F.desc("score"), "found")
    positives = (search(asking, blocks, chosen, width, POSITIVES).withColumn("place", F.row_number().over(order).cast("long"))
                 .where(F.col("place") <= POSITIVES))
    # 30 p <= 100 n <= 90 p in whole numbers; without a positive score of 0 or more there is none.
    positives = materialize(positives.where("score >= 0").select(
        "key", "place", F.col("found").alias("positive_id"), F.col("score").alias("positive_score"),
        F.expr("(score * 3 + 9) div 10").alias("least"), F.expr("score * 9 div 10").alias("most")), "positives")

    windows = positives.groupBy("key").agg(F.collect_list(F.struct("place", "least", "most")).alias("windows"))  # POSITIVES at most
    asking = materialize(anchors.join(windows, "key"), "windows")
    reach = asking.select("group", F.explode("windows").alias("w")).groupBy("group").agg(F.min("w.least").alias("least"), F.max("w.most").alias("most"))
    chosen = materialize(cells(zones.drop("group_seed").join(reach, "group"), stripes, False), "cells")
    order = Window.partitionBy("key", "place").orderBy(F.desc("score"), "found")
    negatives = (search(asking, blocks, chosen, width, NEGATIVES).withColumn("rank", F.row_number().over(order))
                 .where(F.col("rank") <= NEGATIVES))
    return (negatives.join(positives.select("key", "place", "positive_id", "positive_score"), ["key", "place"])
            .join(anchors.select("key", "anchor_id"), "key")
            .select("anchor_id", "positive_id", "rank", F.col("found").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
