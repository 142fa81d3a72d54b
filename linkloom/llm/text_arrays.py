"""Flat-array views of text batches for numpy operators.

The operators that need words, windows or n-grams work on whole Arrow batches: the
UTF-8 bytes (or code points) of many documents in one array, word boundaries as index
arrays, and 64-bit polynomial hashes taken from one running sum. No Python object is
made per word. Memory is bounded by ``CHUNK_BYTES`` (or by one document, if longer).
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

# Text handled at once: each byte costs about 30 bytes of temporary arrays.
CHUNK_BYTES = 1 << 20

_MULT = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finalizer (a bijection): spreads every input bit over the word."""
    x = x ^ (x >> _S30)
    x = x * _M1
    x = x ^ (x >> _S27)
    x = x * _M2
    return x ^ (x >> _S31)


# Symbol table of the running hash: unrelated 64-bit values for small symbols.
def symbol_values(symbols: np.ndarray) -> np.ndarray:
    return mix((symbols.astype(np.uint64) + np.uint64(1)) * _MULT)


_BYTE_VALUES = symbol_values(np.arange(256))
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the (odd) multiplier modulo 2**64 and their inverses, grown on demand."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        mult = int(_MULT) | 1
        inverse = pow(mult, -1, 1 << 64)
        _POWERS[:] = []
        for base in (mult, inverse):
            out = np.ones(size, np.uint64)
            done, step = 1, base
            while done < size:  # doubling: out[done:2*done] = out[:done] * base**done
                take = min(done, size - done)
                out[done:done + take] = out[:take] * np.uint64(step)
                step = step * step % (1 << 64)
                done += take
            _POWERS.append(out)
    return _POWERS[0], _POWERS[1]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of ``values[start:end]`` for each span (non-empty spans), independent of position."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(values))
    run = np.empty(len(values) + 1, np.uint64)
    run[0] = 0
    np.cumsum(values * up[:len(values)], out=run[1:])
    return mix((run[ends] - run[starts]) * down[starts] + (ends - starts).astype(np.uint64))


BATCH_BYTES = 8 << 20  # of an Arrow batch between the JVM and a Python worker


def small_batches(docs: DataFrame) -> DataFrame:
    """``docs``, after bounding the session's Arrow batches by bytes: with texts, Spark's default of 10,000 rows or 64 MB for each task in
    each direction would take much of an executor's memory outside its heap."""
    conf, key = docs.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(key).removesuffix("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return docs


def as_text(column) -> pa.Array:
    """A string column with 64-bit offsets and '' for null."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def flat_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in one array, and the n + 1 offsets of the texts."""
    column = as_text(column)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES, give_back: bool = False) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts together stay within ``limit`` bytes (one row at least). ``give_back`` returns freed memory to the
    system after the last, for operators that share their workers with others in a pipeline."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j
    if give_back:
        _give_back()


def _give_back() -> None:
    """Return freed memory to the system: a worker outlives its task, and what an earlier stage has used would stay with it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU C library
        pass


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+``: starts, ends (byte positions) and the words before each text (n + 1)."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~IS_SPACE[data]
    first = inside[1:-1] & ~inside[:-2]
    last = inside[1:-1] & ~inside[2:]
    edges = offsets[:-1][offsets[:-1] < offsets[1:]]  # non-empty texts begin a new word
    first[edges] = inside[1:-1][edges]
    edges = edges[edges > 0] - 1
    last[edges] |= inside[1:-1][edges]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hashes(_BYTE_VALUES[data], starts, ends)


def window_hashes(tokens: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` token hashes (n - width + 1 of them)."""
    n = len(tokens) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total = total * _MULT + tokens[k:k + n]
    return mix(total + np.uint64(width))


def row_ids(bounds: np.ndarray) -> np.ndarray:
    """For item counts given as n + 1 bounds: the row of each item."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
