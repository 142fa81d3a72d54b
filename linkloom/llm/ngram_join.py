"""N-gram Jaccard join: blocked sparse product of the document by n-gram incidence matrix.

Every pair of texts whose sets of word n-grams have Jaccard similarity >= ``threshold``
is linked, exactly (n-grams are compared by 64-bit hash). The product D * D^T is never
formed whole; bounds that follow from the set sizes discard its cells early:

1. *Rows*: each text becomes a set id (equal sets share it) and a set size. Only one
   row per set id enters the matrix, so exact copies cost one row.
2. *Columns*: the incidence entries are dealt by n-gram hash range as packed arrays. A
   column with a single entry cannot add to an overlap and is dropped. The others carry
   their document frequency.
3. *Row bound*: a set of n n-grams links only if ceil(t * n) of them occur elsewhere; rows
   with fewer shared n-grams are dropped with all their cells.
4. *Cell bound*: two linked rows share one of their first n - ceil(t * n) + 1 n-grams in
   rare-first order, so only rows that meet in such a column are multiplied.
5. *Blocks*: rows that meet go to blocks of about ``BLOCK_ROWS``; a large group of near
   copies fills many blocks. Each pair of blocks with a common column is one sparse
   product: overlap counts accumulate column by column, rare columns by counting, frequent
   ones as a dense strip. A cell needs size ratio >= t and overlap >= t / (1 + t) * (na + nb).
   Of the linked cells only a spanning forest leaves the task.

Links become components by distributed contraction. Every phase is a Spark stage over
tables in the shared checkpoint folder; no task holds more than one block of columns or
one pair of row blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm import text_arrays as ta
from linkloom.llm.components import components
from linkloom.plans.materialize import materialize

NGRAM = 5
THRESHOLD = (80, 100)          # numerator, denominator: compared in integers
ENTRIES_PER_BLOCK = 1_000_000  # incidence entries per column block (sizes the exchange)
BLOCK_ROWS = 512               # rows per row block of the product
FREQUENT = 24                  # entries from which a column is multiplied as dense strip
STRIP = 1024                   # dense columns multiplied at once
CELLS = 4_000_000              # cells counted at once
PACK_BYTES = 3 << 20           # text packed into one row per column block


def _sets(data: np.ndarray, offsets: np.ndarray, ngram: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted n-gram hashes of each text, concatenated, with n + 1 bounds."""
    lower = ta.ASCII_LOWER[data]
    starts, ends, first = ta.words(lower, offsets)
    hashes = ta.word_hashes(lower, starts, ends)
    windows = ta.window_hashes(hashes, ngram)
    counts = np.diff(first)
    size = np.where(counts >= ngram, counts - ngram + 1, (counts > 0).astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(bounds[-1], np.uint64)
    for k in np.flatnonzero(counts):
        part = out[bounds[k]:bounds[k + 1]]
        if counts[k] >= ngram:
            part[:] = windows[first[k]:first[k + 1] - ngram + 1]
            part.sort()
        else:
            part[:] = ta.window_hashes(hashes[first[k]:first[k + 1]], int(counts[k]))
    keep = np.ones(len(out), bool)
    keep[1:] = out[1:] != out[:-1]
    keep[bounds[:-1][size > 0]] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    return out[keep], kept[bounds]


def _set_ids(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """64-bit id of each set (0 for the empty set): two independent sums over its hashes."""
    def sums(values):
        run = np.concatenate([[np.uint64(0)], np.cumsum(values, dtype=np.uint64)])
        return run[bounds[1:]] - run[bounds[:-1]]
    size = np.diff(bounds).astype(np.uint64)
    ids = ta.mix(sums(ta.mix(hashes)) ^ ta.mix(sums(ta.mix(hashes ^ np.uint64(0x5BD1E995))) + size))
    return np.where(size > 0, np.where(ids == 0, np.uint64(1), ids), np.uint64(0))


def _batch_sets(column, ngram: int, limit: int = ta.CHUNK_BYTES) -> Iterator[tuple]:
    data, offsets = ta.flat_bytes(column)
    for i, j in ta.chunks(offsets, limit, give_back=True):
        yield i, j, *_sets(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], ngram)


def set_table(docs: DataFrame, id_col: str, text_col: str, ngram: int) -> DataFrame:
    """``(id, set_id, n_shingles)`` per row of ``docs``."""
    def run(batches):
        for batch in batches:
            ids, sizes = [], []
            for _, _, hashes, bounds in _batch_sets(batch.column(1), ngram):
                ids.append(_set_ids(hashes, bounds))
                sizes.append(np.diff(bounds))
            if ids:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(np.concatenate(ids).view(np.int64)),
                     pa.array(np.concatenate(sizes).astype(np.int64))],
                    names=[id_col, "set_id", "n_shingles"])
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(
        run, f"`{id_col}` {kind}, set_id long, n_shingles long")


def _packed(parts: dict[str, np.ndarray], keys: np.ndarray, n_keys: int) -> Iterator[pa.RecordBatch]:
    """One row per key holding its entries of each array as bytes (keys are sorted)."""
    cuts = np.searchsorted(keys, np.arange(n_keys + 1))
    full = np.flatnonzero(np.diff(cuts))
    if len(full):
        yield pa.RecordBatch.from_arrays(
            [pa.array(full.astype(np.int32))]
            + [pa.array([a[cuts[k]:cuts[k + 1]].tobytes() for k in full], pa.binary()) for a in parts.values()],
            names=["part", *parts])


def _unpacked(batches, names: list[tuple[str, type]]) -> list[np.ndarray]:
    """All rows' arrays of a partition, concatenated."""
    got = [[] for _ in names]
    for batch in batches:
        for k, (name, dtype) in enumerate(names):
            got[k] += [np.frombuffer(x.as_buffer(), dtype) for x in batch.column(batch.schema.get_field_index(name))]
    return [np.concatenate(x) if x else np.zeros(0, dtype) for x, (_, dtype) in zip(got, names)]


def _part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Range of the hash space: part k holds the k-th equal range of the upper 32 bits."""
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)


def _entries(docs: DataFrame, text_col: str, ngram: int, parts: int) -> DataFrame:
    """Incidence entries (n-gram, set id, set size), one packed row per text pack and column block."""
    def run(batches):
        seen = np.zeros(0, np.uint64)  # sets this task has sent: 8 bytes for each text of its split
        for batch in batches:
            for _, _, hashes, bounds in _batch_sets(batch.column(0), ngram, PACK_BYTES):
                ids, size = _set_ids(hashes, bounds), np.diff(bounds)
                first = np.zeros(len(ids), bool)
                first[np.unique(ids, return_index=True)[1]] = True
                first &= (size > 0) & ~np.isin(ids, seen)
                seen = np.concatenate([seen, ids[first]])
                entry = np.repeat(first, size)
                hashes, row = hashes[entry], np.repeat(np.flatnonzero(first), size[first])
                part = _part_of(hashes, parts)
                order = np.argsort(part, kind="stable")
                yield from _packed({"h": hashes[order], "s": ids[row[order]],
                                    "n": size[row[order]].astype(np.int32)}, part[order], parts)
    return docs.select(text_col).mapInArrow(run, "part int, h binary, s binary, n binary")


def _need(size: np.ndarray, num: int, den: int) -> np.ndarray:
    """Smallest overlap with which a set of this size can reach the threshold."""
    return -(-size * num // den)


def _shared_columns(entries: DataFrame, parts: int) -> DataFrame:
    """Columns with two rows or more: (set id, size, n-gram, frequency), packed by set id range."""
    def run(batches):
        h, s, n = _unpacked(batches, [("h", np.uint64), ("s", np.uint64), ("n", np.int32)])
        order = np.argsort(h, kind="stable")
        h = h[order]
        same = np.zeros(len(h) + 1, bool)
        same[1:-1] = h[1:] == h[:-1]
        multi = same[1:] | same[:-1]
        h, order = h[multi], order[multi]
        s, n = s[order], n[order]
        order = np.lexsort((s, h))       # only the shared columns: a row sent by two tasks counts once
        h, s, n = h[order], s[order], n[order]
        once = np.ones(len(h), bool)
        once[1:] = (h[1:] != h[:-1]) | (s[1:] != s[:-1])
        h, s, n = h[once], s[once], n[once]
        edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        df = np.diff(np.append(edge, len(h)))
        df = np.repeat(df, df).astype(np.int32)
        keep = df > 1
        h, s, n, df = h[keep], s[keep], n[keep], df[keep]
        part = _part_of(s, parts)
        order = np.argsort(part, kind="stable")
        yield from _packed({"s": s[order], "n": n[order], "h": h[order], "df": df[order]}, part[order], parts)
    return entries.repartitionById(parts, "part").mapInArrow(
        run, "part int, s binary, n binary, h binary, df binary")


def _rows_left(shared: DataFrame, parts: int, num: int, den: int) -> DataFrame:
    """Rows that pass the row bound: (set_id, n, grams, prefix), grams sorted, prefix rare first."""
    def run(batches):
        s, n, h, df = _unpacked(batches, [("s", np.uint64), ("n", np.int32), ("h", np.uint64), ("df", np.int32)])
        order = np.lexsort((h, df, s))
        s, n, h = s[order], n[order], h[order]
        edge = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
        stop = np.append(edge[1:], len(s))
        size, need = n[edge].astype(np.int64), _need(n[edge].astype(np.int64), num, den)
        left = np.flatnonzero(stop - edge >= need)
        # Unshared n-grams are the rarest and come first in the prefix; the rest of it is shared.
        shared_prefix = (size - need + 1) - (size - (stop - edge))
        for at in range(0, len(left), 256):
            some = left[at:at + 256]
            yield pa.RecordBatch.from_arrays(
                [pa.array(s[edge[some]].view(np.int64)), pa.array(size[some]),
                 pa.array([np.sort(h[edge[k]:stop[k]]).tobytes() for k in some], pa.binary()),
                 pa.array([h[edge[k]:edge[k] + shared_prefix[k]].view(np.int64) for k in some], pa.list_(pa.int64()))],
                names=["set_id", "n", "grams", "prefix"])
    return shared.repartitionById(parts, "part").mapInArrow(
        run, "set_id long, n long, grams binary, prefix array<long>")


def _product(grams: list[np.ndarray], size: np.ndarray, left: int, num: int, den: int) -> list[tuple[int, int]]:
    """Spanning links of one pair of row blocks.

    Rows below ``left`` belong to the first block, the others to the second; left == len(rows)
    means the product of one block with itself.
    """
    rows = len(grams)
    row = np.repeat(np.arange(rows), [len(g) for g in grams])
    gram = np.concatenate(grams)
    order = np.argsort(gram, kind="stable")  # rows stay ascending within a column
    gram, row = gram[order], row[order]
    edge = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
    df = np.diff(np.append(edge, len(gram)))
    overlap = np.zeros(rows * rows, np.int64)
    cells, held = [], 0
    for width in range(2, FREQUENT):         # rare columns: count their cells
        at = edge[df == width]
        for i in range(width - 1 if len(at) else 0):
            cells += [row[at + i] * rows + row[at + j] for j in range(i + 1, width)]
            held += len(at) * (width - 1 - i)
            if held > CELLS:
                overlap += np.bincount(np.concatenate(cells), minlength=rows * rows)
                cells, held = [], 0
    if cells:
        overlap += np.bincount(np.concatenate(cells), minlength=rows * rows)
    overlap = overlap.reshape(rows, rows)
    frequent = df >= FREQUENT
    column = np.repeat(np.cumsum(frequent) - 1, df)[np.repeat(frequent, df)]
    row = row[np.repeat(frequent, df)]
    for k in range(0, int(frequent.sum()), STRIP):  # frequent columns: dense strips
        some = slice(*np.searchsorted(column, [k, k + STRIP]))
        strip = np.zeros((rows, STRIP), np.float32)
        strip[row[some], column[some] - k] = 1
        overlap += (strip @ strip.T).astype(np.int64)
    total = size[:, None] + size[None, :]
    linked = np.triu(overlap * (num + den) >= num * total, 1)
    linked &= (np.minimum(size[:, None], size[None, :]) * den >= num * np.maximum(size[:, None], size[None, :]))
    if left < rows:
        linked[:left, :left] = False
        linked[left:, left:] = False
    parent = list(range(rows))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    forest = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(linked))):
        a, b = root(i), root(j)
        if a != b:
            parent[max(a, b)] = min(a, b)
            forest.append((i, j))
    return forest


def _links(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Spanning links ``(a, b)`` between set ids, by products of row blocks that share a column."""
    meets = rows.select("set_id", F.explode("prefix").alias("h"))
    near = meets.groupBy("h").agg(F.min("set_id").alias("key"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    meets = materialize(meets.join(near.select("h"), "h"), "ngram-meets")
    keys = near.select("h", "key")
    for _ in range(2):  # rows that meet, directly or over one other row, mostly get one key
        own = meets.join(keys, "h").groupBy("set_id").agg(F.min("key").alias("key"))
        keys = meets.join(own, "set_id").groupBy("h").agg(F.min("key").alias("key"))
    own = materialize(own, "ngram-keys")
    total = own.count()
    bins = max(1, total // BLOCK_ROWS)
    sizes = own.groupBy("key").agg(F.count(F.lit(1)).alias("rows"))
    # Rows of small keys share blocks, dealt by key; a key beyond BLOCK_ROWS gets blocks of its own.
    block = F.when(F.col("rows") <= BLOCK_ROWS, F.pmod(F.xxhash64("key"), F.lit(bins))).otherwise(
        F.xxhash64("key", F.pmod(F.xxhash64("set_id"), F.ceil(F.col("rows") / BLOCK_ROWS)))).alias("block")
    own = own.join(sizes, "key").select("set_id", block)
    placed = materialize(meets.join(own, "set_id").select("h", "set_id", "block"), "ngram-placed")
    touched = placed.groupBy("h", "block").agg(F.count(F.lit(1)).alias("rows"))
    other = touched.withColumnsRenamed({"block": "other", "rows": "others"})
    tasks = (placed.join(other, "h")
             .where("block != other OR others > 1")
             .select("set_id", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"),
                     (F.col("block") > F.col("other")).alias("second")).distinct())
    fed = tasks.join(rows.select("set_id", "n", "grams"), "set_id")

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("second", "ascending"), ("set_id", "ascending")])
        ids = table["set_id"].to_numpy()
        second = table["second"].to_numpy()
        grams = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["grams"]]
        forest = _product(grams, table["n"].to_numpy(), int(len(ids) - second.sum()), num, den) if len(ids) > 1 else []
        pairs = np.array(forest, np.int64).reshape(-1, 2)
        return pa.table({"a": ids[pairs[:, 0]], "b": ids[pairs[:, 1]]})

    return fed.groupBy("left", "right").applyInArrow(run, "a long, b long")


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = NGRAM,
                       threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """Link near-duplicate texts; one row per row of ``docs``: ``(id, n_shingles, component_id)``.

    ``n_shingles`` is the size of the text's set of distinct word n-grams (A-Z lower-cased,
    words split at ASCII white space; a text of fewer words has one n-gram, its whole
    sequence). ``component_id`` is the smallest id reachable over links, the row's own included.
    A null or blank text has the empty set and links with nothing, also not with another blank
    text. Rows that repeat an id are kept, each with its own text's component. A null id never
    becomes a component id (its own is null, if nothing else is linked). An empty table gives
    an empty result; other columns of ``docs`` are not read.
    """
    num, den = threshold
    sets = materialize(set_table(ta.small_batches(docs), id_col, text_col, ngram), "ngram-sets")
    entries = sets.agg(F.sum("n_shingles")).first()[0] or 0
    parts = int(max(8, -(-entries // ENTRIES_PER_BLOCK)))
    rows = materialize(_rows_left(_shared_columns(_entries(docs, text_col, ngram, parts), parts), parts, num, den),
                       "ngram-rows")
    roots = components(_links(rows, num, den), "a", "b")
    # Only linked sets meet the roots; the smallest id of each set, then of each component, are partial minima.
    smallest = sets.where("n_shingles > 0").groupBy("set_id").agg(F.min(id_col).alias("low"))
    linked = materialize(smallest.join(roots, smallest["set_id"] == roots["id"], "left")
                         .select("set_id", F.coalesce("root", "set_id").alias("root"), "low"), "ngram-roots")
    # Written apart from the join, which may then split a component that holds most sets.
    lows = materialize(linked.groupBy("root").agg(F.min("low").alias("component_id")), "ngram-components")
    members = linked.join(lows, "root").select("set_id", "component_id")
    return (sets.join(members, "set_id", "left")
            .select(id_col, "n_shingles", F.when(F.col("n_shingles") == 0, F.col(id_col))
                    .otherwise(F.col("component_id")).alias("component_id")))
