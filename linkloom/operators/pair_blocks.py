"""L5 for all pairs: which targets a source's phrases lead to, and by which phrase best, in arrays of one block of pages.

Pages, phrases and targets are numbers here: phrases by rank (length, rarity, words), pages by URL, so that those with one URL stand
side by side. The pages are cut into blocks of a bounded number of target phrases; a task holds one block, and of its sources one at a
time. A source's phrases write themselves into an array with a place for each page of the block, the best one last, so a match costs one
store, and neither matches nor pairs are sorted, spilled or moved: what is left in the array is the source's pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

OUT_ROWS = 1 << 16  # pairs in a batch that leaves the task, about

#: The columns that pairs can have, besides the ids and the phrase's words, which keep their types.
TYPES = {"source_no": T.LongType(), "target_no": T.LongType(), "s_silo": T.LongType(), "s_depth": T.IntegerType(), "t_silo": T.LongType(),
         "t_depth": T.IntegerType(), "n": T.IntegerType(), "df": T.LongType(), "pos": T.IntegerType(), "gram": T.StringType(),
         "origin": T.StringType()}


class Block(NamedTuple):
    first: int             # number of its first page
    phrases: np.ndarray    # phrases that its pages hold, ascending
    ends: np.ndarray       # where the pages of each phrase end in ``targets``; one more in front
    targets: np.ndarray    # pages, from 0
    origins: pa.Array | None
    ids: pa.Array          # of each page
    silo: np.ndarray
    depth: np.ndarray


class Tiers(NamedTuple):
    """Phrases of the same length and df follow each other."""
    starts: np.ndarray     # number of the first phrase
    n: np.ndarray
    df: np.ndarray


def block_of(pages: pa.Table, held: pa.Table) -> Block:
    """From the block's pages (``no``, ``page_id``, ``silo``, ``depth``) and target phrases (``phrase``, ``target_no``, perhaps ``origin``)."""
    pages = pages.sort_by("no").combine_chunks()
    first = int(pages["no"][0].as_py())
    phrase = held["phrase"].to_numpy()
    order = np.argsort(phrase, kind="stable")
    phrases, counts = np.unique(phrase, return_counts=True)
    origins = held["origin"].combine_chunks().dictionary_encode().take(pa.array(order)) if "origin" in held.column_names else None
    return Block(first, phrases, np.concatenate(([0], np.cumsum(counts))), held["target_no"].to_numpy()[order] - first,
                 origins.combine_chunks() if isinstance(origins, pa.ChunkedArray) else origins,
                 _one(pages["page_id"]), pages["silo"].to_numpy(), pages["depth"].to_numpy())


def _one(column) -> pa.Array:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column


def whole_sources(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows, sorted by ``source_no``, in tables that hold all rows of their sources."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        source = batch.column("source_no").to_numpy()
        cut = int(np.searchsorted(source, source[-1]))
        if kept and (cut or kept[-1].column("source_no")[-1].as_py() != source[0]):
            yield pa.Table.from_batches([*kept, batch.slice(0, cut)]).combine_chunks()
            kept = []
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
        kept.append(batch.slice(cut))
    if kept:
        yield pa.Table.from_batches(kept).combine_chunks()


def _found(table: pa.Table, block: Block, tiers: Tiers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows with each source's phrases once, at the first position, those that the block holds, the best of each source last;
    the phrases' places in the block, and their tiers."""
    source, phrase, pos = (table[c].to_numpy() for c in ("source_no", "phrase", "pos"))
    rows = np.lexsort((pos, phrase, source))
    once = np.ones(len(rows), bool)
    once[1:] = (np.diff(source[rows]) != 0) | (np.diff(phrase[rows]) != 0)
    rows = rows[once]
    at = np.searchsorted(block.phrases, phrase[rows])
    held = at < len(block.phrases)
    held[held] = block.phrases[at[held]] == phrase[rows[held]]
    rows, at = rows[held], at[held]
    tier = np.searchsorted(tiers.starts, phrase[rows], "right") - 1
    order = np.lexsort((-phrase[rows], -pos[rows], -tier, source[rows]))
    return rows[order], at[order], tier[order]


def pairs_in(shared, columns: list[str]):
    """A function for ``mapInArrow``: rows ``(source_id, source_no, low, high, s_silo, s_depth, phrase, pos[, gram])``, sorted by
    ``source_no``, to the pairs' ``columns``. ``low`` and ``high`` are the first and last page with the source's URL, no targets of it;
    ``shared`` is the broadcast ``(Block, Tiers)``."""

    def run(batches):
        block, tiers = shared.value
        best = np.full(len(block.ids), -1, np.int32)
        entry = np.zeros(len(block.ids) if "origin" in columns else 0, np.int64)
        for table in whole_sources(batches):
            rows, at, tier = _found(table, block, tiers)
            source = table["source_no"].to_numpy()[rows]
            begins, ends = block.ends[at].tolist(), block.ends[at + 1].tolist()
            cuts = [0, *(np.flatnonzero(np.diff(source)) + 1).tolist(), len(rows)] if len(rows) else [0]
            low, high = (np.clip(table[c].to_numpy() - block.first + k, 0, len(best)) for c, k in (("low", 0), ("high", 1)))
            made, ready = [], 0
            for x, y in zip(cuts, cuts[1:]):
                for i in range(x, y):
                    to = block.targets[begins[i]:ends[i]]
                    best[to] = i
                    if len(entry):
                        entry[to] = np.arange(begins[i], ends[i])
                best[low[rows[x]]:high[rows[x]]] = -1
                hit = np.flatnonzero(best >= 0)
                by = best[hit]
                best[hit] = -1
                for k in range(0, len(hit), OUT_ROWS):
                    made.append((hit[k:k + OUT_ROWS], by[k:k + OUT_ROWS], entry[hit[k:k + OUT_ROWS]] if len(entry) else None))
                    ready += len(made[-1][0])
                    if ready >= OUT_ROWS:
                        yield _batch(made, table, rows, tier, block, tiers, columns)
                        made, ready = [], 0
            if made:
                yield _batch(made, table, rows, tier, block, tiers, columns)
    return run


def _batch(made: list, table: pa.Table, rows: np.ndarray, tier: np.ndarray, block: Block, tiers: Tiers, columns: list[str]) -> pa.RecordBatch:
    hit, by = (np.concatenate([m[k] for m in made]) for k in (0, 1))
    row = pa.array(rows[by])
    of = {"source_id": lambda: table["source_id"].take(row), "target_id": lambda: block.ids.take(pa.array(hit)),
          "target_no": lambda: pa.array(hit + block.first), "t_silo": lambda: pa.array(block.silo[hit]),
          "t_depth": lambda: pa.array(block.depth[hit]), "n": lambda: pa.array(tiers.n[tier[by]]), "df": lambda: pa.array(tiers.df[tier[by]]),
          "origin": lambda: block.origins.take(pa.array(np.concatenate([m[2] for m in made]))).cast(pa.string())}
    return pa.RecordBatch.from_arrays([_one(of[c]() if c in of else table[c].take(row)) for c in columns], names=columns)
