"""Token id output: frequency-ranked ids in byte-aligned variable-length code, and its reader.

File format (a folder of Parquet tables, so writing is transactional on every store):

* ``ranks``: ``id, rank`` - token ids by descending corpus frequency (ties: smaller id).
* ``blocks``: rows of about ``BLOCK_IDS`` ids, whole documents each. ``control`` holds two bits
  per id (bytes used, less one; four ids per byte, lowest bits first), ``data`` the ranks in
  1 to 4 bytes, little-endian. ``doc_ids`` and ``lengths`` list the block's documents. ``part``
  and ``part_start`` (ids before the block in its part) give the place in the total order:
  parts, blocks and documents ascend by document id.

Writing: texts are encoded once and dealt by document id range (boundaries are quantiles of
the ids) as compressed packs; each part is put in order and stored; frequencies are summed
over all of it; then each stored block is recoded without another exchange.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from linkloom.llm import text_arrays as ta
from linkloom.llm.bpe import Vocabulary
from linkloom.plans.materialize import materialize

END_ID = 0
PART_BYTES = 16 << 20    # text bytes per part: one part is ordered in one task's memory
PACK_BYTES = 2 << 20     # text bytes encoded and packed at once
BLOCK_IDS = 1 << 16      # ids per block (one document, if longer)

# Decoding tables over the 256 control bytes: bytes of each of the four ids.
_SIZES = 1 + (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3)


class LibraryVocabulary(Vocabulary):
    """Words not seen before are encoded by the tokenizer library."""

    def __init__(self, path: str):
        super().__init__(path)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()

    def merge(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        words = [raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        ids = [e.ids for e in self.library.encode_batch_fast(words, add_special_tokens=False)]
        counts = np.array([len(x) for x in ids], np.int64)
        return np.fromiter((i for x in ids for i in x), np.int32, int(counts.sum())), counts


@lru_cache(maxsize=2)
def _vocabulary(path: str) -> LibraryVocabulary:
    return LibraryVocabulary(path)


def _pack(ids: np.ndarray) -> bytes:
    ids = ids.astype(np.uint32, copy=False)
    planes = np.empty((4, len(ids)), np.uint8)
    for k in range(4):  # casts keep the low byte; faster than a transposed copy
        planes[k] = (ids >> np.uint32(8 * k)).astype(np.uint8)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpack(packed, n: int) -> np.ndarray:
    """Ids are packed as four byte planes: the upper planes are nearly constant."""
    raw = pa.decompress(packed, decompressed_size=4 * n, codec="zstd", asbytes=True) if n else b""
    planes = np.frombuffer(raw, np.uint8).reshape(4, n)
    out = planes[0].astype(np.uint32)
    for k in range(1, 4):
        if planes[k].any():
            out |= planes[k].astype(np.uint32) << np.uint32(8 * k)
    return out


def code(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of ranks."""
    ranks = ranks.astype(np.uint32)
    size = 1 + (ranks > 0xFF) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    padded[:len(ranks)] = size - 1
    four = padded.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    width = 2 if size.max(initial=1) <= 2 else 4  # the upper bytes of small ranks are not looked at
    used = ranks.astype(np.uint16 if width == 2 else np.uint32).view(np.uint8).reshape(-1, width)
    return control.tobytes(), used[np.arange(width) < size[:, None]].tobytes()


def decode(control, data, n: int) -> np.ndarray:
    """The ``n`` ranks of a block, by table lookup of all control bytes at once."""
    size = _SIZES[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    ends = np.cumsum(size)
    padded = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)]).astype(np.uint32)
    out = np.zeros(n, np.uint32)
    for k in range(int(size.max(initial=0))):
        out |= np.where(size > k, padded[ends - size + k] << np.uint32(8 * k), np.uint32(0))
    return out


_PACKED = "part int, doc_ids array<long>, lengths array<int>, ids binary"


def _encoded(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, bounds: np.ndarray, end_id: int) -> DataFrame:
    """Packs of whole documents' ids, each for one part."""
    def run(batches):
        vocab = _vocabulary(tokenizer)
        for batch in batches:
            texts = ta.as_text(batch.column(1))
            _, offsets = ta.flat_bytes(texts)
            for i, j in ta.chunks(offsets, PACK_BYTES):
                ids, cuts = vocab.encode(texts[i:j].to_pylist())
                ids = np.insert(ids, cuts[1:], end_id)
                cuts = cuts + np.arange(j - i + 1)
                keys = batch.column(0)[i:j]
                known = keys.is_valid().to_numpy(zero_copy_only=False)
                value = keys.fill_null(0).to_numpy()
                part = np.where(known, np.searchsorted(bounds, value, "left"), 0)
                for p in np.unique(part):
                    rows = np.flatnonzero(part == p)
                    size = np.diff(cuts)[rows]
                    flat = np.concatenate([ids[cuts[r]:cuts[r + 1]] for r in rows])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([p], pa.int32()), pa.array([keys.take(pa.array(rows)).to_pylist()], pa.list_(pa.int64())),
                         pa.array([size.tolist()], pa.list_(pa.int32())), pa.array([_pack(flat)], pa.binary())],
                        names=["part", "doc_ids", "lengths", "ids"])
    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, _PACKED)


def _ordered(packs: DataFrame, parts: int) -> DataFrame:
    """Each part's documents in ascending order (null ids first; repeated ids by length and ids), in blocks."""
    def run(batches):
        docs = []
        part = 0
        for batch in batches:
            for row in batch.to_pylist():
                part = row["part"]
                lengths = np.array(row["lengths"], np.int64)
                flat = _unpack(row["ids"], int(lengths.sum()))
                ends = np.cumsum(lengths)
                docs += [(d is not None, d or 0, n, flat[e - n:e]) for d, n, e in
                         zip(row["doc_ids"], lengths.tolist(), ends.tolist())]
        docs.sort(key=lambda x: x[:3])
        for k in range(1, len(docs)):  # repeated ids of one length: by content, so that reruns agree
            if docs[k][:3] == docs[k - 1][:3]:
                docs.sort(key=lambda x: (*x[:3], x[3].tobytes()))
                break
        start, held, size = 0, [], 0
        for doc in [*docs, None]:
            if held and (doc is None or size + doc[2] > BLOCK_IDS):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([start], pa.int64()), pa.array([size], pa.int64()),
                     pa.array([[d if known else None for known, d, _, _ in held]], pa.list_(pa.int64())),
                     pa.array([[n for _, _, n, _ in held]], pa.list_(pa.int32())),
                     pa.array([_pack(np.concatenate([x for *_, x in held]))], pa.binary())],
                    names=["part", "part_start", "n_ids", "doc_ids", "lengths", "ids"])
                start, held, size = start + size, [], 0
            if doc is not None:
                held.append(doc)
                size += doc[2]
    return packs.repartitionById(parts, "part").mapInArrow(
        run, "part int, part_start long, n_ids long, doc_ids array<long>, lengths array<int>, ids binary")


def _frequencies(blocks: DataFrame) -> DataFrame:
    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for n, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                counts = np.bincount(_unpack(ids.as_buffer(), n))
                if len(counts) > len(total):
                    total = np.concatenate([total, np.zeros(len(counts) - len(total), np.int64)])
                total[:len(counts)] += counts
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["id", "n"])
    return (blocks.select("n_ids", "ids").mapInArrow(run, "id long, n long")
            .groupBy("id").agg(F.sum("n").alias("n")))


def write_token_files(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                      end_id: int = END_ID) -> None:
    """Encode every whole text with the tokenizer library, append ``end_id`` to each and write the files.

    A null or empty text has only the end id. Rows that repeat an id are all written. Null
    ids come first. An empty table gives empty tables. Other columns of ``docs`` are not read.
    """
    stats = docs.agg(F.sum(F.octet_length(text_col)).alias("size")).first()
    parts = int(max(1, -(-(stats["size"] or 0) // PART_BYTES)))
    cuts = docs.agg(F.percentile_approx(F.col(id_col).cast("long"), [k / parts for k in range(1, parts)] or [0.5],
                                        F.lit(max(1000, 20 * parts)))).first()[0]
    bounds = np.unique(np.array(cuts if cuts and parts > 1 else [], np.int64))
    packs = _encoded(docs, tokenizer, id_col, text_col, bounds, end_id)
    blocks = materialize(_ordered(packs, parts), "token-blocks")
    # The vocabulary bounds the frequency table; ranks travel with the recoding tasks.
    counts = _frequencies(blocks).orderBy(F.desc("n"), "id").select("id").toArrow()["id"].to_numpy()
    ranks = np.zeros(int(counts.max(initial=0)) + 1, np.uint32)
    ranks[counts] = np.arange(len(counts), dtype=np.uint32)

    def run(batches):
        for batch in batches:
            ids = batch.column(batch.num_columns - 1)
            sizes = batch.column(2).to_pylist()
            coded = [code(ranks[_unpack(x.as_buffer(), n)]) for x, n in zip(ids, sizes)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([c for c, _ in coded], pa.binary()), pa.array([d for _, d in coded], pa.binary())],
                names=[*batch.schema.names[:-1], "control", "data"])

    blocks.mapInArrow(run, "part int, part_start long, n_ids long, doc_ids array<long>, lengths array<int>, "
                           "control binary, data binary").write.option("compression", "zstd").parquet(f"{path}/blocks")
    spark = docs.sparkSession
    spark.createDataFrame(pa.table({"id": counts.astype(np.int64), "rank": np.arange(len(counts))}),
                          "id long, rank long").coalesce(1).write.parquet(f"{path}/ranks")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` of all documents; ``ids`` are little-endian unsigned 32-bit integers.

    ``start`` counts the ids of all documents before it in the files' order.
    """
    blocks = spark.read.parquet(f"{path}/blocks")
    table = spark.read.parquet(f"{path}/ranks").orderBy("rank").select("id").toArrow()["id"].to_numpy().astype(np.uint32)
    # One row per part: bounded by the number of parts written.
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("all"))
    before = totals.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("before"))

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                n = batch.column(2)[k].as_py()
                ids = table[decode(batch.column(5)[k].as_buffer(), batch.column(6)[k].as_buffer(), n)]
                lengths = np.array(batch.column(4)[k].as_py(), np.int64)
                ends = np.cumsum(lengths)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column(0)[k].as_py()] * len(ends), pa.int32()), batch.column(3)[k].values,
                     pa.array(batch.column(1)[k].as_py() + ends - lengths), pa.array(lengths),
                     pa.array([ids[e - m:e].astype("<u4").tobytes() for m, e in zip(lengths, ends)], pa.binary())],
                    names=["part", "doc_id", "local", "n_tokens", "ids"])

    docs = blocks.mapInArrow(run, "part int, doc_id long, local long, n_tokens long, ids binary")
    return docs.join(F.broadcast(before), "part").select(
        "doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids")
