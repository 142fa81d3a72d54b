"""Approximate nearest neighbours with balanced posting lists.

* A bounded sample of the vectors (at most ``SAMPLE`` different rows, by a hash of id and vector) gives balanced cluster
  centroids: clusters well over the mean are split, small ones dropped, between k-means rounds.
* The centroids are linked to their nearest ones; that graph, held in each task, is searched
  best-first for every vector (its size is bounded by ``MAX_LISTS``).
* Every vector goes to the list of its nearest centroid; a boundary vector also to others
  about as near (within ``COPY_RATIO``, ``COPIES`` lists at most; the first is always there).
* A query searches the same graph, on and on until the next centroid lies beyond ``READ_RATIO`` times the nearest one's
  distance (or beyond the larger ratio at which the sample shows ``READ_SHARE`` of the neighbours to be read), and reads the lists within
  it, however many they are.

Largest inner product becomes smallest distance by one more component that gives all vectors the
length of the longest. Lists go to tasks in bundles, and a query once to each bundle that holds lists it
reads. A bundle that the sample shows to be large, by its vectors or by its queries, is dealt out in
parts, so that a very common vector fills many tasks, none of them with more than about ``PART_ROWS``
rows of either side. Scores are computed in double precision on the original vectors; each part
returns its best for each query and a last step ranks them.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.draw import draw

SAMPLE = 32_768
LIST_ROWS = 256        # vectors per list, before copies
MAX_LISTS = 2048
SINGLE = 2048          # tables up to this size have one list
ROUNDS = 8             # of k-means
NEIGHBOURS = 24        # nearest ones that a centroid is linked to
BACK = 8               # of them, those that are linked to it
BEAM = 256             # lists kept by a search of the graph unless told
COPIES = 2
COPY_RATIO = 1.02
READ_RATIO = 1.15
READ_SHARE = 0.95      # of the neighbours that the sample shows, to be in the lists that are read
PROBES = 512           # sampled vectors whose neighbours are looked up for that
READ_ROWS = 400        # expected rows that a query reads at least
BUNDLE = 32            # lists that one task holds
PART_ROWS = 16_384     # expected rows of a bundle (or of its queries) that one task takes
BATCH = 512


class Index(NamedTuple):
    width: int                # components of a vector
    longest: float            # length that all vectors are extended to
    centroids: np.ndarray
    links: np.ndarray         # neighbours of each centroid
    entries: np.ndarray       # where searches begin
    rows: np.ndarray          # expected rows of each list
    parts: np.ndarray         # parts of each bundle's vectors
    query_parts: np.ndarray   # parts of each bundle's queries
    ratio: float = 0.0        # distance ratio that the sample asks for, if above READ_RATIO


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T), 0)


def balanced_centroids(vectors: np.ndarray, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """About ``lists`` k-means centroids without very large or very small clusters."""
    rng = np.random.default_rng(11)
    distinct = np.unique(vectors, axis=0)
    centroids = distinct[rng.permutation(len(distinct))[:lists]]
    mean = len(vectors) / max(lists, 1)
    for _ in range(rounds):
        near = np.concatenate([_distances(vectors[i:i + 4096], centroids).argmin(1) for i in range(0, len(vectors), 4096)])
        size = np.bincount(near, minlength=len(centroids))
        order = np.argsort(near, kind="stable")
        groups = np.split(order, np.cumsum(size)[:-1])
        made = []
        for k in np.argsort(-size, kind="stable"):
            group = vectors[groups[k]]
            if size[k] < mean / 8:
                continue
            middle = group.mean(0)
            if size[k] > 2 * mean:
                axis = group[_distances(group, middle[None])[:, 0].argmax()] - middle
                side = (group - middle) @ axis > 0
                if side.any() and not side.all():
                    made += [group[side].mean(0), group[~side].mean(0)]
                    continue
            made.append(middle)
        centroids = np.array(made[:2 * lists], np.float32)
    return centroids


def _graph(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of each centroid, and entries spread by farthest-first choice.

    A centroid is linked to its nearest ones, and is itself linked from ``BACK`` of these, the ones with the fewest such links so
    far: none is out of reach, and no one has many more links than others. Short rows repeat the centroid itself."""
    between = _distances(centroids, centroids)
    np.fill_diagonal(between, np.inf)
    near = np.argsort(between, 1, kind="stable")[:, :NEIGHBOURS]
    back: list[list[int]] = [[] for _ in range(len(centroids))]
    for k, row in enumerate(near.tolist()):
        for other in sorted((x for x in row if x != k), key=lambda x: len(back[x]))[:BACK]:
            back[other].append(k)
    width = max(map(len, back), default=0)
    own = np.array([row + [k] * (width - len(row)) for k, row in enumerate(back)], np.int64).reshape(len(centroids), width)
    links = np.concatenate([near, own], 1)
    entries = [0]
    far = between[0].copy()
    far[0] = 0
    while len(entries) < min(16, len(centroids)):
        entries.append(int(far.argmax()))
        far = np.minimum(far, np.where(np.isinf(between[entries[-1]]), 0, between[entries[-1]]))
    return links, np.unique(entries)


def search(index: Index, vectors: np.ndarray, beam: int = BEAM, ratio: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of the centroid graph for each vector: list numbers and distances, nearest first (infinite: not reached).

    It goes on while the next centroid is among the ``beam`` nearest; with a ``ratio``, while it lies within
    that many times the nearest one's distance or the lists so far hold fewer than ``READ_ROWS`` expected rows."""
    n, k = len(vectors), len(index.centroids)
    beam = k if ratio else beam
    beam = min(beam, k)
    seen = np.full((n, k), np.inf, np.float32)
    seen[:, index.entries] = _distances(vectors, index.centroids[index.entries])
    closed = np.zeros((n, k), bool)
    rows = np.zeros(n)
    active = np.arange(n)
    while len(active):
        open_ = np.where(closed[active], np.inf, seen[active])
        best = open_.argmin(1)
        nearest = open_[np.arange(len(active)), best]
        if ratio:
            more = np.isfinite(nearest) & ((nearest <= ratio ** 2 * seen[active].min(1)) | (rows[active] < READ_ROWS))
        else:
            more = np.isfinite(nearest) & (nearest <= np.partition(seen[active], beam - 1, axis=1)[:, beam - 1])
        active, best = active[more], best[more]
        closed[active, best] = True
        rows[active] += index.rows[best]
        near = index.links[best]
        found = ((vectors[active][:, None, :] - index.centroids[near]) ** 2).sum(2)
        seen[active[:, None], near] = found
    order = np.argsort(seen, 1, kind="stable")[:, :beam]
    return order, np.sqrt(np.take_along_axis(seen, order, 1))


def copies(index: Index, vectors: np.ndarray) -> list[np.ndarray]:
    """Lists of each vector: the nearest, and others for boundary vectors."""
    lists, far = search(index, vectors, COPIES)
    return [places[distance <= COPY_RATIO * distance[0]] for places, distance in zip(lists, far)]


def reads(index: Index, vectors: np.ndarray) -> list[np.ndarray]:
    """Lists that each query reads, by a search of the graph: those within the distance ratio, and as many as hold
    ``READ_ROWS`` expected rows."""
    ratio = max(READ_RATIO, index.ratio)
    lists, far = search(index, vectors, ratio=ratio)
    rows = np.cumsum(index.rows[lists], 1) - index.rows[lists]
    keep = np.isfinite(far) & ((far <= ratio * far[:, :1]) | (rows < READ_ROWS))
    return [places[some] for places, some in zip(lists, keep)]


def needed_ratio(index: Index, points: np.ndarray, top: int, scale: float) -> float:
    """Distance ratio within which ``READ_SHARE`` of the neighbours of sampled vectors lie.

    A vector's ``top`` nearest are about its ``top / scale`` nearest in a sample of one in ``scale``.
    """
    probes = np.linspace(0, len(points) - 1, min(PROBES, len(points))).astype(int)
    near = min(max(1, round(top / scale)), len(points) - 1)
    if near < 1 or len(index.centroids) == 1:
        return 0.0
    needed = []
    for i in range(0, len(probes), 64):
        asked = _asked(points[probes[i:i + 64]])
        score = asked @ points.T
        score[np.arange(len(asked)), probes[i:i + 64]] = -np.inf
        best = np.argpartition(-score, near - 1, axis=1)[:, :near]
        far = np.sqrt(_distances(asked, index.centroids))
        for row, found in enumerate(best):
            # A neighbour is met in the nearest of its lists.
            met = np.array([far[row, lists].min() for lists in copies(index, points[found])])
            needed.append(met / max(far[row].min(), 1e-12))
    return float(np.quantile(np.concatenate(needed), READ_SHARE)) * (1 + 1e-6)


def _extended(vectors: np.ndarray, longest: float) -> np.ndarray:
    rest = np.maximum(longest ** 2 - (vectors.astype(np.float64) ** 2).sum(1), 0)
    return np.concatenate([vectors, np.sqrt(rest)[:, None]], 1).astype(np.float32)


def _valid(column, width: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Rows with a usable vector, and their vectors."""
    values = column.cast(pa.list_(pa.float64()))
    lengths = pc.list_value_length(values).fill_null(-1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(lengths == width)
    flat = values.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), width)
    good = np.isfinite(flat).all(1) & (flat != 0).any(1)
    return rows[good], flat[good]


def _stats(vectors: DataFrame, vec_col: str) -> tuple[int, int, float]:
    """Components (the most frequent number of them), usable vectors and the greatest length."""
    widths = vectors.where(F.size(vec_col) > 0).groupBy(F.size(vec_col).alias("width")).agg(F.count(F.lit(1)).alias("n"))
    top = widths.orderBy(F.desc("n"), F.desc("width")).first()
    if top is None:
        return 0, 0, 0.0
    width = top["width"]

    def run(batches):
        for batch in batches:
            _, rows = _valid(batch.column(0), width)
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.array([len(rows)]), pa.array([float((rows ** 2).sum(1).max())])],
                                                 names=["n", "square"])

    n, square = (vectors.select(vec_col).mapInArrow(run, "n long, square double")
                 .agg(F.sum("n"), F.max("square")).first())
    return width, n or 0, float(np.sqrt(square or 0))


def build_index(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding",
                sample: int = SAMPLE, list_rows: int = LIST_ROWS, top: int = 20) -> Index | None:
    """Fit centroids and their graph on a bounded sample; None without a usable vector."""
    width, n, longest = _stats(vectors, vec_col)
    if not n:
        return None
    content = [F.col(id_col), F.col(vec_col)]
    rows = vectors.select(id_col, vec_col, F.coalesce(is_query, F.lit(False)).alias("__asks"), F.xxhash64(*content).alias("__at"))
    drawn = draw(rows, content, sample, [vec_col, "__asks", "__at"]).toArrow().combine_chunks().sort_by("__at")
    rows, points = _valid(drawn[vec_col].combine_chunks(), width)
    asks = drawn["__asks"].to_numpy()[rows]
    points = _extended(points, longest)
    lists = 1 if n <= SINGLE or not len(points) else int(min(MAX_LISTS, max(2, n // list_rows)))
    centroids = balanced_centroids(points, lists) if lists > 1 else np.zeros((1, width + 1), np.float32)
    links, entries = _graph(centroids)
    bundles = -(-len(centroids) // BUNDLE)
    one = np.ones(bundles, np.int64)
    index = Index(width, longest, centroids, links, entries, np.ones(len(centroids)), one, one)
    scale = n / max(len(points), 1)
    held = np.zeros(len(centroids))
    for i in range(0, len(points), BATCH):
        np.add.at(held, np.concatenate(copies(index, points[i:i + BATCH])), scale)
    index = index._replace(rows=held, ratio=needed_ratio(index, points, top, scale))
    asked = np.zeros(bundles)
    asking = points[asks]
    for i in range(0, len(asking), BATCH):
        for lists in reads(index, _asked(asking[i:i + BATCH])):
            asked[np.unique(lists % bundles)] += scale
    kept = np.bincount(np.arange(len(centroids)) % bundles, held, bundles)
    return index._replace(parts=np.maximum(1, np.ceil(kept / PART_ROWS)).astype(np.int64),
                          query_parts=np.maximum(1, np.ceil(asked / PART_ROWS)).astype(np.int64))


def _asked(points: np.ndarray) -> np.ndarray:
    """Extended vectors as queries: the added component is zero."""
    out = points.copy()
    out[:, -1] = 0
    return out


def _spread(table: DataFrame, index: Index, id_col: str, vec_col: str, asking: bool) -> DataFrame:
    """Rows (bundle, part, query part, id, lists, vector): once for each task that needs the vector."""
    def run(batches):
        for batch in batches:
            rows, values = _valid(batch.column(1), index.width)
            ids = batch.column(0).to_numpy(zero_copy_only=False)[rows].astype(np.int64)
            for i in range(0, len(rows), BATCH):
                points = _extended(values[i:i + BATCH], index.longest)
                out = [(bundle, row, np.sort(lists[lists % len(index.parts) == bundle]))
                       for row, lists in enumerate(reads(index, _asked(points)) if asking else copies(index, points))
                       for bundle in np.unique(lists % len(index.parts)).tolist()]
                bundle = np.array([x[0] for x in out])
                row = np.array([x[1] for x in out])
                own, others = (index.query_parts, index.parts) if asking else (index.parts, index.query_parts)
                mine = ids[i:i + BATCH][row] % own[bundle]
                times = others[bundle]
                again = np.repeat(np.arange(len(out)), times)
                other = np.arange(len(again)) - np.repeat(np.cumsum(times) - times, times)
                part, query_part = (other, mine[again]) if asking else (mine[again], other)
                flat = values[i:i + BATCH][row[again]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bundle[again].astype(np.int32)), pa.array(part.astype(np.int32)),
                     pa.array(query_part.astype(np.int32)), pa.array(ids[i:i + BATCH][row[again]]),
                     pa.array([out[k][2].tolist() for k in again], pa.list_(pa.int32())),
                     pa.ListArray.from_arrays(pa.array(np.arange(len(again) + 1, dtype=np.int32) * index.width), pa.array(flat.reshape(-1)))],
                    names=["bundle", "part", "query_part", "id", "lists", "vector"])

    return table.select(F.col(id_col).cast("long").alias(id_col), vec_col).mapInArrow(
        run, "bundle int, part int, query_part int, id long, lists array<int>, vector array<double>")


def best_of(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, top: int
            ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exact best ``top`` of the vectors for each query (its own id left out): query ids, ids, scores.

    Candidates come from a matrix product; their scores are summed again in one fixed order, so that
    equal vectors have equal scores and ties go to the smaller id.
    """
    out = []
    for i in range(0, len(queries), 256):
        rough = queries[i:i + 256] @ vectors.T
        rough[query_ids[i:i + 256, None] == ids[None]] = -np.inf
        take = min(top, len(ids))
        edge = np.partition(rough, len(ids) - take, axis=1)[:, len(ids) - take]
        slack = 1e-9 * np.abs(queries[i:i + 256]).sum(1) * np.abs(vectors).max(initial=0)
        with np.errstate(invalid="ignore"):
            row, column = np.nonzero((rough >= (edge - slack)[:, None]) & np.isfinite(rough))
        exact = (queries[i + row] * vectors[column]).sum(1)
        order = np.lexsort((ids[column], -exact, row))
        row, column, exact = row[order], column[order], exact[order]
        first = np.searchsorted(row, row)
        keep = np.arange(len(row)) - first < top
        out.append((query_ids[i + row[keep]], ids[column[keep]], exact[keep]))
    return tuple(np.concatenate(x) if out else np.zeros(0) for x in zip(*out)) if out else (
        np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def nearest(vectors: DataFrame, is_query: Column, top: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
            index: Index | None = None) -> DataFrame:
    """``(query_id, rank, id, score)``: the ``top`` nearest rows found for each row where ``is_query``.

    Nearness is the inner product in double precision; rank 1 is the nearest, ties go to the smaller
    id; a query's own id is no candidate; with fewer candidates all are returned. Vectors
    that are null, all zero, hold null or non-finite components or have another number of
    components than most take no part, neither do null ids. Rows that repeat an id count once per
    query if their vectors are equal. An empty table gives an empty result. Other columns are not read.
    """
    vectors = vectors.where(F.col(id_col).isNotNull())
    index = index or build_index(vectors, is_query, id_col, vec_col, top=top)
    if index is None:
        return vectors.select(F.col(id_col).cast("long").alias("query_id"), F.lit(1).alias("rank"),
                              F.col(id_col).cast("long").alias(id_col), F.lit(0.0).alias("score")).where(F.lit(False))
    held = _spread(vectors, index, id_col, vec_col, False)
    asked = _spread(vectors.where(is_query), index, id_col, vec_col, True)
    keys = ["bundle", "part", "query_part"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        def arrays(table):
            lists = table["lists"].combine_chunks()
            row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            place = lists.flatten().to_numpy()
            order = np.argsort(place, kind="stable")
            flat = table["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
            return flat.reshape(-1, index.width), table["id"].to_numpy(), place[order], row[order]
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if left.num_rows and right.num_rows:
            vectors, ids, place, row = arrays(left)
            queries, query_ids, wanted, asker = arrays(right)
            for k in np.intersect1d(place, wanted):
                v, q = row[slice(*np.searchsorted(place, [k, k + 1]))], asker[slice(*np.searchsorted(wanted, [k, k + 1]))]
                found.append(best_of(queries[q], query_ids[q], vectors[v], ids[v], top))
        query, near, score = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((near, -score, query))  # the bundle's best; a vector may stand in two of its lists
        query, near, score = query[order], near[order], score[order]
        new = np.ones(len(query), bool)
        new[1:] = (query[1:] != query[:-1]) | (near[1:] != near[:-1]) | (score[1:] != score[:-1])
        query, near, score = query[new], near[new], score[new]
        keep = np.arange(len(query)) - np.searchsorted(query, query) < top
        return pa.table({"query_id": query[keep], id_col: near[keep], "score": score[keep]})

    local = held.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(
        run, f"query_id long, `{id_col}` long, score double")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    return (local.distinct().withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)
            .select("query_id", "rank", id_col, "score"))
