"""BPE encoding and decoding by batched numpy merge rounds.

The vocabulary file (JSON of a public tokenizer; its path is a parameter) is read in each
Python worker. A pack of texts is split into words at once; the distinct new words of the
pack stand as symbols in one flat array. In each round every adjacent pair of symbols is
looked up by binary search over the sorted pair keys, and each word merges its pair of
lowest rank; words without a known pair are done. Token ids of words seen before come from
a bounded table keyed by the word's 64-bit hash. Texts never leave their task: no shuffle.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from linkloom.llm import text_arrays as ta
from linkloom.llm.pretokens import byte_offsets, code_points, lower, pretokens

MEMORY_WORDS = 800_000  # words a worker remembers before it starts anew (about 40 bytes each)
_NONE = np.int64(1) << 40


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 for
    itself, the others numbered from U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return [chr(b) if b in printable else chr(0x100 + others.index(b)) for b in range(256)]


class Vocabulary:
    """Merge tables of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        self.rule = "words" if suffix else "bytes"
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        # The leftmost special token first, of those the longest.
        self.special_re = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))))
        self.normalize = spec["normalizer"] is not None
        letters = byte_letters()
        self.inner = np.array([vocab[x] for x in letters], np.int64)
        self.last = np.array([vocab[x + suffix] for x in letters], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.made, self.ranks = keys[order], made[order], order.astype(np.int64)
        # Merging all places of a word's best pair at once equals merging them one by one if
        # nothing made by a merge takes part in an earlier one.
        born = np.full(max(vocab.values()) + 1, -1, np.int64)
        np.maximum.at(born, made, np.arange(len(made)))
        self.one_by_one = bool((np.maximum(born[left], born[right]) >= np.arange(len(made))).any())
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.names = [names.get(i) for i in range(max(names) + 1)]
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.known_at = np.zeros(0, np.int64)
        self.known_n = np.zeros(0, np.int64)
        self.known_ids = np.zeros(0, np.int32)

    def merge(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of words given as bytes with n + 1 bounds (no word empty): flat ids, counts."""
        symbols = self.inner[data]
        symbols[bounds[1:] - 1] = self.last[data[bounds[1:] - 1]]
        word = ta.row_ids(bounds)
        n = len(bounds) - 1
        done_words, done_ids = [], []
        while len(symbols):
            rank = np.full(len(symbols), _NONE)
            inner = np.flatnonzero(word[1:] == word[:-1])
            pair = symbols[inner] << 32 | symbols[inner + 1]
            place = np.searchsorted(self.keys, pair)
            place[place == len(self.keys)] = 0
            hit = self.keys[place] == pair
            rank[inner[hit]] = self.ranks[place[hit]]
            made = np.zeros(len(symbols), np.int64)
            made[inner[hit]] = self.made[place[hit]]
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            lowest = np.minimum.reduceat(rank, starts)
            size = np.diff(np.append(starts, len(symbols)))
            over = np.repeat(lowest == _NONE, size)
            if over.any():
                done_words.append(word[over])
                done_ids.append(symbols[over])
            merge = (rank == np.repeat(lowest, size)) & ~over
            at = np.flatnonzero(merge)
            if self.one_by_one:
                at = at[np.unique(word[at], return_index=True)[1]]
            elif len(at) > 1:  # aaa: of touching places take the first, third, ...
                run = np.concatenate([[True], np.diff(at) != 1])
                first = np.flatnonzero(run)
                inside = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
                at = at[inside % 2 == 0]
            symbols[at] = made[at]
            keep = ~over
            keep[at + 1] = False
            symbols, word = symbols[keep], word[keep]
        if not done_words:
            return np.zeros(0, np.int32), np.zeros(n, np.int64)
        word = np.concatenate(done_words)
        order = np.argsort(word, kind="stable")
        return np.concatenate(done_ids)[order].astype(np.int32), np.bincount(word, minlength=n)

    def look_up(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words ``data[start:end]``: flat ids in word order, and counts."""
        hashes = ta.word_hashes(data, starts, ends)
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        new = np.flatnonzero(~np.isin(distinct, self.known, assume_unique=True, kind="sort"))
        if len(self.known) and len(self.known) + len(new) > MEMORY_WORDS:
            self.forget()
            new = np.arange(len(distinct))
        if len(new):
            at, size = starts[first[new]], (ends - starts)[first[new]]
            bounds = np.concatenate([[0], np.cumsum(size)])
            flat = data[np.repeat(at - bounds[:-1], size) + np.arange(bounds[-1])]
            ids, counts = self.merge(flat, bounds)
            begin = len(self.known_ids) + np.cumsum(counts) - counts
            place = np.searchsorted(self.known, distinct[new])
            self.known = np.insert(self.known, place, distinct[new])
            self.known_at = np.insert(self.known_at, place, begin)
            self.known_n = np.insert(self.known_n, place, counts)
            self.known_ids = np.concatenate([self.known_ids, ids])
        where = np.searchsorted(self.known, distinct)[inverse]
        counts = self.known_n[where]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        return self.known_ids[np.repeat(self.known_at[where] - ends + counts, counts) + np.arange(total)], counts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and n + 1 bounds."""
        parts, owner, special = [], [], []
        for k, text in enumerate(texts):
            for part, mark in self._split(text):
                parts.append(part)
                owner.append(k)
                special.append(mark)
        joined = "".join(parts)
        points = code_points(joined)
        bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)])
        starts, ends = pretokens(points, bounds, self.rule)
        at = byte_offsets(points)
        data = np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8)
        if len(starts):
            ids, counts = self.look_up(data, at[starts], at[ends])
        else:
            ids, counts = np.zeros(0, np.int32), np.zeros(0, np.int64)
        tokens = np.concatenate([[0], np.cumsum(counts)])
        cuts = tokens[np.searchsorted(starts, bounds)]
        marked = [k for k, mark in enumerate(special) if mark is not None]
        if marked:  # a special token follows its part
            ids = np.insert(ids, cuts[1:][marked], [special[k] for k in marked]).astype(np.int32)
            extra = np.zeros(len(parts), np.int64)
            extra[marked] = 1
            cuts = cuts + np.concatenate([[0], np.cumsum(extra)])
        last = np.searchsorted(np.array(owner, np.int64), np.arange(len(texts) + 1))
        return ids, cuts[last]

    def _split(self, text: str) -> Iterator[tuple[str, int | None]]:
        """Parts of a text between special tokens, each with the id of the token after it: one pass, whatever their number."""
        at = 0
        for found in self.special_re.finditer(text) if self.special else ():
            yield self._normal(text[at:found.start()]), self.special[found.group()]
            at = found.end()
        yield self._normal(text[at:]), None

    def _normal(self, text: str) -> str:
        if not self.normalize:
            return text
        return lower(text if text.isascii() else unicodedata.normalize("NFC", text))

    def token_bytes(self) -> tuple[np.ndarray, np.ndarray]:
        """' name' of every id in one byte array, and n + 1 bounds (ids without a name are empty)."""
        if not hasattr(self, "_spelled"):
            spelled = [b" " + t.encode("utf-8") if t is not None else b"" for t in self.names]
            self._spelled = (np.frombuffer(b"".join(spelled), np.uint8),
                             np.concatenate([[0], np.cumsum([len(x) for x in spelled], dtype=np.int64)]))
        return self._spelled

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """Texts of flat ids with n + 1 bounds: token names joined by one space; unknown ids are left out."""
        spelled, at = self.token_bytes()
        ids = ids.astype(np.int64)
        known = (ids >= 0) & (ids < len(at) - 1)
        ids = np.where(known, ids, 0)
        size = np.where(known, at[ids + 1] - at[ids], 0)
        begin = at[ids]
        row = ta.row_ids(bounds)
        first = np.zeros(len(ids), bool)
        spoken = np.flatnonzero(size > 0)
        if len(spoken):
            first[spoken[np.concatenate([[True], row[spoken][1:] != row[spoken][:-1]])]] = True
        begin, size = begin + first, size - first
        stop = np.concatenate([[0], np.cumsum(size)])
        data = spelled[np.repeat(begin - stop[:-1], size) + np.arange(stop[-1])]
        return pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(stop[bounds].astype(np.int64).tobytes()),
                                                pa.py_buffer(data.tobytes()))


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def bpe_encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids array<int>)`` for each row: the whole text's token ids, no special tokens added.

    Strings of special tokens inside a text become their ids. A null or empty text has no
    ids (an empty array). Repeated rows and null ids are kept; other columns are not read.
    """
    def run(batches):
        vocab = vocabulary(tokenizer)
        for batch in batches:
            texts = ta.as_text(batch.column(1))
            _, offsets = ta.flat_bytes(texts)
            for i, j in ta.chunks(offsets):
                ids, bounds = vocab.encode(texts[i:j].to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i:j], pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))],
                    names=[id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return ta.small_batches(docs).select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def bpe_round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids, decoded)`` for each row: :func:`bpe_encode` and :func:`bpe_decode` in one pass, so that a task has one Python worker
    with the vocabulary, not two."""
    def run(batches):
        vocab = vocabulary(tokenizer)
        for batch in batches:
            texts = ta.as_text(batch.column(1))
            _, offsets = ta.flat_bytes(texts)
            for i, j in ta.chunks(offsets, give_back=True):
                ids, bounds = vocab.encode(texts[i:j].to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i:j], pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids)),
                     vocab.decode(ids, bounds).cast(pa.string())], names=[id_col, "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return ta.small_batches(docs).select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, decoded string")


def bpe_decode(encoded: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(id, ids, decoded string)``: the text of each row's ids, special tokens included.

    Null or empty ids give an empty text; null or unknown ids inside an array are left out.
    """
    def run(batches):
        vocab = vocabulary(tokenizer)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                ids = batch.column(1)[i:i + 512]
                bounds = np.concatenate([[0], np.cumsum([0 if n is None else n for n in
                                                         ids.value_lengths().to_pylist()], dtype=np.int64)])
                flat = ids.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i:i + 512], ids, vocab.decode(flat, bounds).cast(pa.string())],
                    names=[id_col, ids_col, "decoded"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return ta.small_batches(encoded).select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, `{ids_col}` array<int>, decoded string")
