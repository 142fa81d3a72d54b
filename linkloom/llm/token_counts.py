"""Token counts of whole texts; huge ones are counted in chunks that resynchronise in their overlaps.

Texts below ``2 * CHUNK`` characters are counted where they lie: whole by the library or, if words between ASCII white space are
independent under the file's split rule, by the counts of their words, each encoded by the library once (a bounded table
by the word's 64-bit hash remembers them). A longer one becomes chunks of ``CHUNK``
characters, each with the first ``OVERLAP`` characters of the next, which are dealt over all tasks and
encoded with offsets. Neighbours are spliced at a position of their overlap that is

* proven stable: what is left and right of it is tokenized independently, whatever stands farther away
  (:meth:`Counter.stable` says why);
* common: no token of either chunk crosses it, and both give the same ids up to the next such position.

Then the tokens of the text are those of all chunks without those that a chunk has beyond its splices.
Where an overlap has no such position (one word of a million letters), the document's chunks and overlaps are
widened fourfold, until it aligns or is one chunk.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm import text_arrays as ta
from linkloom.llm.sorted_scan import partitions
from linkloom.plans.materialize import materialize

CHUNK = 1 << 15      # characters
OVERLAP = 1 << 10    # a fixed share of CHUNK, also after widening
WIDEN = 4
PLACES = 16          # stable positions of an overlap that are compared
BATCH_CHARS = 1 << 19
LIMIT = 2048
MEMORY_WORDS = 1_000_000  # words a worker remembers before it starts anew (12 bytes each)

# The split rules under which :meth:`Counter.stable` knows independent positions.
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SPACE = r"(?<=[!-~])(?= [!-~])"
_WORD = r"(?<=[0-9])(?=[!-~])|(?<=[!-~])(?=[0-9])|(?<=[A-Za-z])(?=[!-/:-@\[-`{-~])"
_BYTE = r"(?<=[0-9])(?=[!-/:-@A-Z\[-`a-z{-~])|(?<=[A-Za-z])(?=[!-@\[-`{-~])"


class Counter:
    """One tokenizer file: ``.json`` by the tokenizers library, ``.model`` by sentencepiece."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        self.specials: list[str] = []
        self.by_word = False
        self.forget()
        if path.endswith(".model"):
            import sentencepiece
            self.pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            self.library = None
            names = (self.pieces.id_to_piece(i).lstrip("▁") for i in range(self.pieces.get_piece_size()))
            # No piece holds white space behind other characters, so none crosses a place before a space.
            self.rule = re.compile(_SPACE) if not any("▁" in x for x in names) else None
            return
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.rule = None
        if not any(t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            self.rule = self._rule(spec)

    def forget(self) -> None:
        self.known, self.known_n = np.zeros(0, np.uint64), np.zeros(0, np.int32)

    def _rule(self, spec: dict) -> re.Pattern | None:
        steps = spec["pre_tokenizer"] or {}
        steps = steps.get("pretokenizers", [steps])
        kinds = [n["type"] for n in (spec["normalizer"] or {"normalizers": []}).get("normalizers", [spec["normalizer"]])]
        if not set(kinds) <= {"NFC", "Lowercase", "Replace"}:
            return None
        split = steps[0].get("pattern", {}).get("Regex")
        if split == WORD_SPLIT and steps[0].get("behavior") == "Removed" and steps[0].get("invert"):
            # White space ends every match and is dropped; no special token may hold any.
            self.by_word = not any(re.search(r"\s", x) for x in self.specials)
            return re.compile(f"{_SPACE}|{_WORD}")
        if steps[0].get("type") == "ByteLevel" and steps[0].get("use_regex") and not kinds:
            return re.compile(f"{_SPACE}|{_BYTE}")
        return None

    def text_counts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text."""
        if not self.by_word:
            return np.array(self.counts(texts.to_pylist()), np.int64)
        data, offsets = ta.flat_bytes(texts)
        out = np.zeros(len(texts), np.int64)
        for i, j in ta.chunks(offsets):
            part = data[offsets[i]:offsets[j]]
            starts, ends, first = ta.words(part, offsets[i:j + 1] - offsets[i])
            run = np.concatenate([[0], np.cumsum(self._word_counts(part, starts, ends))])
            out[i:j] = run[first[1:]] - run[first[:-1]]
        return out

    def _word_counts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.zeros(0, np.int64)
        distinct, first, inverse = np.unique(ta.word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        place = np.searchsorted(self.known, distinct)
        new = np.flatnonzero(self.known[np.minimum(place, len(self.known) - 1)] != distinct) if len(self.known) else np.arange(len(distinct))
        if len(self.known) and len(self.known) + len(new) > MEMORY_WORDS:
            self.forget()
            new = np.arange(len(distinct))
        if len(new):
            raw = data.tobytes()
            made = self.counts([raw[a:b].decode() for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist())])
            place = np.searchsorted(self.known, distinct[new])
            self.known = np.insert(self.known, place, distinct[new])
            self.known_n = np.insert(self.known_n, place, made)
        return self.known_n[np.searchsorted(self.known, distinct)][inverse].astype(np.int64)

    def counts(self, texts: list[str]) -> list[int]:
        if self.library is None:
            return [len(x) for x in self.pieces.encode(texts, num_threads=1)]
        return [len(x) for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and the characters where each token starts and ends."""
        if self.library is None:
            rows = [(p.id, p.begin, p.end) for p in self.pieces.encode(text, return_type="proto").pieces]
            leading = (np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80
            chars = np.concatenate([[0], np.cumsum(leading)])  # of each byte offset
            rows = [(i, chars[s], chars[e]) for i, s, e in rows]
        else:
            found = self.library.encode(text, add_special_tokens=False)
            rows = [(i, s, e) for i, (s, e) in zip(found.ids, found.offsets)]
        return tuple(np.array(x, np.int64) for x in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 3

    def stable(self, region: str) -> np.ndarray:
        """Positions of ``region`` (some way from its ends) where the tokenization falls apart into independent halves.

        Both neighbours are ASCII, so no normalization step joins them. Before a single space: words end at
        white space, and no piece crosses it. Where the split rule is known, also next to digits and from a letter
        to a sign: any match that reaches the place ends there, and the next begins there (not from a sign to a letter, as in ``'s``).
        Special tokens are looked for first; a place inside one does not count.
        """
        if self.rule is None:
            return np.zeros(0, np.int64)
        margin = max([2, *map(len, self.specials)])
        places = np.array([m.start() for m in self.rule.finditer(region)], np.int64)
        places = places[(places >= margin) & (places <= len(region) - margin)]
        for special in self.specials:
            at = region.find(special)
            while at >= 0:
                places = places[(places <= at) | (places >= at + len(special))]
                at = region.find(special, at + 1)
        middle = int(np.searchsorted(places, len(region) // 2))
        return places[max(0, middle - PLACES // 2):middle + PLACES // 2 + 1]

    def edges(self, found: tuple[np.ndarray, np.ndarray, np.ndarray], region: str, at: int, head: bool) -> tuple[list, list]:
        """For each stable position of ``region`` (which begins at character ``at`` of the encoded chunk): how many of the chunk's tokens lie on the
        neighbour's side of it (-1: a token crosses it), and a checksum of the ids up to the next position."""
        ids, starts, ends = found
        places = self.stable(region) + at
        before, first = np.searchsorted(ends, places, "right"), np.searchsorted(starts, places, "left")
        beyond = np.where(before == first, before if head else len(ids) - first, -1)
        # A checksum needs the next position to be an edge as well; the last position has none.
        sums = [zlib.crc32(ids[i:j].astype("<i4").tobytes()) for i, j in zip(first, first[1:])]
        clean = (before == first)[1:]
        return beyond[:-1].tolist(), [int(s) if ok else -1 for s, ok in zip(sums, clean)]


@lru_cache(maxsize=4)
def counter(path: str) -> Counter:
    return Counter(path)


def _scan(docs: DataFrame, tokenizer: str, id_col: str, text_col: str) -> DataFrame:
    """``(key, id, n_bytes, n_tokens, no, text)``: counted texts (``no`` null), and chunks of huge ones (``n_tokens`` null)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer).text_counts
        for batch in batches:
            texts = pc.fill_null(batch.column(2), "")
            sizes, chars = (f(texts).to_numpy(zero_copy_only=False) for f in (pc.binary_length, pc.utf8_length))
            small = np.flatnonzero(chars < 2 * CHUNK)
            group = np.cumsum(chars[small]) // BATCH_CHARS
            found = np.zeros(len(chars), np.int64)
            for rows in np.split(small, np.flatnonzero(np.diff(group)) + 1):
                if len(rows):
                    found[rows] = count(texts.take(pa.array(rows)))
            take = pa.array(small)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(sizes[small].astype(np.int64)), pa.array(found[small]),
                 pa.nulls(len(small), pa.int32()), pa.nulls(len(small), pa.string())], names=names)
            for row in np.flatnonzero(chars >= 2 * CHUNK).tolist():
                text = texts[row].as_py()
                n = len(text) // CHUNK  # the last chunk takes the rest
                for no in range(n):
                    part = text[no * CHUNK:] if no == n - 1 else text[no * CHUNK:(no + 1) * CHUNK + OVERLAP]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0)[row:row + 1], batch.column(1)[row:row + 1], pa.array([int(sizes[row])], pa.int64()),
                         pa.nulls(1, pa.int64()), pa.array([no], pa.int32()), pa.array([part], pa.string())], names=names)

    names = ["key", "id", "n_bytes", "n_tokens", "no", "text"]
    kind = docs.schema[id_col].dataType.simpleString()
    return ta.small_batches(docs).select(F.monotonically_increasing_id().alias("key"), F.col(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, f"key long, id {kind}, n_bytes long, n_tokens long, no int, text string")


def _encoded(chunks: DataFrame, tokenizer: str, size: int) -> DataFrame:
    """``(key, no, last, n, head, head_sums, tail, tail_sums)`` of ``chunks(key, no, last, text)``: tokens of the chunk, and its edges in both overlaps."""
    overlap = size // CHUNK * OVERLAP

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(tokenizer)
        for batch in batches:
            for key, no, last, text in zip(*(batch.column(k).to_pylist() for k in range(4))):
                found = own.tokens(text)
                head = own.edges(found, text[:overlap], 0, True) if no else ([], [])
                tail = own.edges(found, text[size:size + overlap], size, False) if not last else ([], [])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x], kind) for x, kind in zip((key, no, last, len(found[0]), *head, *tail), kinds)], names=names)

    longs = pa.list_(pa.int64())
    kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.int64(), longs, longs, longs, longs]
    names = ["key", "no", "last", "n", "head", "head_sums", "tail", "tail_sums"]
    return chunks.repartition(partitions(chunks), "key", "no").select("key", "no", "last", "text").mapInArrow(
        run, "key long, no int, last boolean, n long, head array<long>, head_sums array<long>, tail array<long>, tail_sums array<long>")


def splices(encoded: DataFrame) -> DataFrame:
    """``(key, no, extra)`` for each chunk after the first: the tokens that it and the one before have beyond their common splice (null: none found)."""
    tails = encoded.where("NOT last").select("key", (F.col("no") + 1).alias("no"), "tail", "tail_sums")
    met = F.filter(F.arrays_zip("head", "head_sums", "tail", "tail_sums"),
                   lambda x: (x["head"] >= 0) & (x["tail"] >= 0) & (x["head_sums"] >= 0) & (x["head_sums"] == x["tail_sums"]))
    pair = F.get(met, F.floor(F.size(met) / 2).cast("int"))
    return encoded.where("no > 0").drop("tail", "tail_sums").join(tails, ["key", "no"]).select("key", "no", (pair["head"] + pair["tail"]).alias("extra"))


def widened(chunks: DataFrame, size: int) -> DataFrame:
    """Chunks of ``size`` characters as fewer of ``WIDEN * size``, each with the overlap that goes with it."""
    more = WIDEN * size // CHUNK * OVERLAP
    own = F.when(F.col("last"), F.col("text")).otherwise(F.substring("text", 1, size))
    parts = chunks.select("key", F.floor(F.col("no") / WIDEN).cast("int").alias("to"), "no", "last", own.alias("part"))
    after = chunks.where((F.col("no") > 0) & (F.col("no") % WIDEN == 0)).select(
        "key", (F.floor(F.col("no") / WIDEN) - 1).cast("int").alias("to"), "no", F.lit(False).alias("last"), F.substring("text", 1, more).alias("part"))
    return parts.unionByName(after).groupBy("key", F.col("to").alias("no")).agg(  # WIDEN + 1 parts at most
        F.max("last").alias("last"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "part"))), lambda x: x["part"]), "").alias("text"))


def token_counts(docs: DataFrame, tokenizer: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_bytes, n_tokens, over_limit)`` for each row: UTF-8 bytes and tokens of the whole text, as the tokenizer file's library counts
    them (no special tokens added; special strings in a text as its default has them; no truncation).

    A null text is empty: 0 and 0. Every row counts, also repeated ones and those without an id; other columns are not read.
    An empty table gives an empty result.
    """
    scanned = materialize(_scan(docs, tokenizer, id_col, text_col), "token-counts")
    huge = scanned.where("no IS NOT NULL")
    lasts = huge.groupBy("key").agg(F.max("no").alias("end"))
    chunks = huge.select("key", "no", "text").join(lasts, "key").select("key", "no", (F.col("no") == F.col("end")).alias("last"), "text")
    size, counted = CHUNK, None
    while not chunks.isEmpty():
        encoded = materialize(_encoded(chunks, tokenizer, size), "chunk-tokens")
        extra = materialize(splices(encoded), "splices")
        failed = extra.where("extra IS NULL").select("key").distinct()
        parts = encoded.select("key", "n").unionByName(extra.select("key", (-F.col("extra")).alias("n")))
        done = parts.join(failed, "key", "left_anti").groupBy("key").agg(F.sum("n").alias("n"))
        counted = done if counted is None else counted.unionByName(done)
        if extra.where("extra IS NULL").isEmpty():
            break
        chunks = materialize(widened(chunks.join(failed, "key", "left_semi"), size), "wider-chunks")
        size *= WIDEN
    out = scanned.where("no IS NULL").select("id", "n_bytes", "n_tokens")
    if counted is not None:
        firsts = huge.where("no = 0").select("key", "id", "n_bytes")
        out = out.unionByName(firsts.join(counted, "key").select("id", "n_bytes", F.col("n").alias("n_tokens")))
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
