"""Counts over a pack of texts, each computed when first asked for."""

from __future__ import annotations

from functools import cached_property

import numpy as np

from linkloom.llm import text_arrays as ta

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
WINDOW = 8  # words in a repeated passage


def _members(letters) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(letters)] = True
    return out


_UPPER = _members(range(0x41, 0x5B))
_LOWER = _members(range(0x61, 0x7B))
_LETTER = _UPPER | _LOWER | _members(range(0x80, 0x100))
_LEAD = ~_members(range(0x80, 0xC0))       # bytes that begin a code point
_STOP = _members(b".,;:!?")


class Texts:
    """``data``: UTF-8 bytes of all texts; ``offsets``: n + 1 byte offsets. Counts are int64, one per text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self.n = len(offsets) - 1

    def subset(self, rows: np.ndarray) -> Texts:
        size = np.diff(self.offsets)[rows]
        offsets = np.concatenate([[0], np.cumsum(size)])
        place = np.repeat(self.offsets[:-1][rows] - offsets[:-1], size) + np.arange(offsets[-1])
        return Texts(self.data[place], offsets)

    def _count(self, flags: np.ndarray) -> np.ndarray:
        """Flagged bytes per text."""
        run = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return run[self.offsets[1:]] - run[self.offsets[:-1]]

    def _count_words(self, flags: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return run[self.first[1:]] - run[self.first[:-1]]

    @cached_property
    def _words(self):
        return ta.words(self.data, self.offsets)

    @property
    def starts(self) -> np.ndarray:
        return self._words[0]

    @property
    def ends(self) -> np.ndarray:
        return self._words[1]

    @property
    def first(self) -> np.ndarray:
        return self._words[2]

    @cached_property
    def word_hashes(self) -> np.ndarray:
        return ta.word_hashes(self.data, self.starts, self.ends)

    @cached_property
    def n_words(self) -> np.ndarray:
        return np.diff(self.first)

    @cached_property
    def word_chars(self) -> np.ndarray:
        return self._count(_LEAD[self.data] & ~ta.IS_SPACE[self.data])

    @cached_property
    def n_symbols(self) -> np.ndarray:
        return self._count(SYMBOLS[self.data])

    @cached_property
    def n_letters(self) -> np.ndarray:
        return self._count(_LETTER[self.data] & _LEAD[self.data])

    @cached_property
    def n_upper(self) -> np.ndarray:
        return self._count(_UPPER[self.data])

    @cached_property
    def n_lower(self) -> np.ndarray:
        return self._count(_LOWER[self.data])

    @cached_property
    def n_bang_words(self) -> np.ndarray:
        return self._count_words(self.data[self.ends - 1] == 0x21)

    @cached_property
    def n_bare_words(self) -> np.ndarray:
        """Words without a letter."""
        run = np.concatenate([[0], np.cumsum(_LETTER[self.data], dtype=np.int64)])
        return self._count_words(run[self.ends] == run[self.starts])

    @cached_property
    def n_stops(self) -> np.ndarray:
        """Words that end in punctuation."""
        return self._count_words(_STOP[self.data[self.ends - 1]])

    @cached_property
    def n_same_words(self) -> np.ndarray:
        """Words equal to the one before in the text."""
        same = np.zeros(len(self.starts), bool)
        same[1:] = self.word_hashes[1:] == self.word_hashes[:-1]
        begins = self.first[:-1]
        same[begins[begins < len(same)]] = False
        return self._count_words(same)

    @cached_property
    def n_distinct_words(self) -> np.ndarray:
        row = ta.row_ids(self.first).astype(np.uint64)
        _, at = np.unique(self.word_hashes ^ ta.mix(row + np.uint64(7)), return_index=True)
        flags = np.zeros(len(self.starts), bool)
        flags[at] = True
        return self._count_words(flags)

    @cached_property
    def _lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lines with a word: starts, ends (without the line feed), text of each."""
        if not len(self.data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        feed = self.data == 0x0A
        begin = np.zeros(len(self.data) + 1, bool)
        begin[1:] = feed
        begin[self.offsets] = True
        starts = np.flatnonzero(begin[:-1])
        ends = np.append(starts[1:], len(self.data))
        ends = ends - np.where(ends > starts, feed[np.maximum(ends - 1, 0)], 0)
        run = np.concatenate([[0], np.cumsum(~ta.IS_SPACE[self.data], dtype=np.int64)])
        full = run[ends] > run[starts]
        starts, ends = starts[full], ends[full]
        return starts, ends, np.searchsorted(self.offsets, starts, "right") - 1

    @cached_property
    def n_lines(self) -> np.ndarray:
        return np.bincount(self._lines[2], minlength=self.n)

    @cached_property
    def n_dup_lines(self) -> np.ndarray:
        starts, ends, row = self._lines
        hashes = ta.word_hashes(self.data, starts, ends)
        order = np.lexsort((hashes, row))
        dup = np.zeros(len(order), bool)
        dup[1:] = (hashes[order][1:] == hashes[order][:-1]) & (row[order][1:] == row[order][:-1])
        return np.bincount(row[order][dup], minlength=self.n)

    @cached_property
    def n_repeat_words(self) -> np.ndarray:
        """Words inside a window of WINDOW words that occurs twice or more in the text."""
        n = len(self.starts) - WINDOW + 1
        if n <= 0:
            return np.zeros(self.n, np.int64)
        row = ta.row_ids(self.first)
        whole = np.flatnonzero(row[:n] == row[WINDOW - 1:])
        keys = ta.window_hashes(self.word_hashes, WINDOW)[whole] ^ ta.mix(row[whole].astype(np.uint64) + np.uint64(11))
        ordered = np.sort(keys)
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if not len(twice):
            return np.zeros(self.n, np.int64)
        place = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
        found = whole[twice[place] == keys]
        change = np.zeros(len(self.starts) + 1, np.int64)
        np.add.at(change, found, 1)
        np.add.at(change, found + WINDOW, -1)
        return self._count_words(np.cumsum(change[:-1]) > 0)
