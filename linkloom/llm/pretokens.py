"""Word splitting of public BPE tokenizers, on flat code point arrays.

Splits whole batches at once by character class runs instead of matching a pattern text by
text. Two rules:

* ``words``: ``'s 't 're 've 'm 'll 'd``, runs of letters, single digits, runs of other
  characters; white space separates and is dropped.
* ``bytes``: the same contractions, runs of letters, of digits, of other characters, each
  with one space (U+0020) before it if there is one; white space that is left stands alone.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

import numpy as np
from tokenizers import Regex, normalizers

SPACE, LETTER, DIGIT, OTHER = 0, 1, 2, 3
# The white space of the split patterns.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F,
               0x3000]


@lru_cache(maxsize=1)
def _unassigned() -> list[str]:
    """Characters that Python's Unicode version lacks; the tokenizer library's may have them."""
    return [chr(c) for c in range(0x40000) if unicodedata.category(chr(c)) == "Cn"]


def _by_library(normalizer) -> list[str]:
    """What a normalizer of the tokenizer library makes of each unassigned character."""
    return normalizer.normalize_str("\n".join(_unassigned())).split("\n")


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Character class of every code point."""
    kind = {"L": LETTER, "N": DIGIT}
    out = np.fromiter((kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)),
                      np.uint8, sys.maxunicode + 1)
    for name, of in kind.items():
        for char, made in zip(_unassigned(), _by_library(normalizers.Replace(Regex(rf"\p{{{name}}}"), ""))):
            if not made:
                out[ord(char)] = of
    out[WHITE_SPACE] = SPACE
    return out


@lru_cache(maxsize=1)
def _newer_capitals() -> tuple[re.Pattern, dict[int, str]]:
    table = {ord(c): low for c, low in zip(_unassigned(), _by_library(normalizers.Lowercase())) if low != c}
    return re.compile(f"[{''.join(map(chr, table)) or chr(0)}]"), table


def lower(text: str) -> str:
    """Lower case letter by letter, as the tokenizer library does: no final form of sigma."""
    if text.isascii():
        return text.lower()
    newer, table = _newer_capitals()
    if newer.search(text):
        text = text.translate(table)
    return text.replace("Σ", "σ").lower()


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def byte_offsets(points: np.ndarray) -> np.ndarray:
    """n + 1 offsets of the code points in UTF-8."""
    width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
    return np.concatenate([[0], np.cumsum(width, dtype=np.int64)])


def pretokens(points: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words; no word crosses one of ``bounds`` (n + 1 text offsets)."""
    n = len(points)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = classes()[points]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    begin = edge.copy()
    begin[1:n] |= kind[1:] != kind[:-1]
    attached = np.zeros(n, bool)
    if rule == "words":
        begin[:n] |= kind == DIGIT
    else:
        # A run after white space takes the last space; of that white space, the rest is a word.
        run = np.flatnonzero(begin[:n] & (kind != SPACE) & ~edge[:n])
        run = run[kind[run - 1] == SPACE]
        begin[run - 1] = True
        run = run[points[run - 1] == 0x20]
        begin[run] = False
        attached[run] = True
    quote = np.flatnonzero((points == 0x27) & begin[:n] & ~attached)
    quote = quote[(quote + 1 < n)]
    quote = quote[~edge[quote + 1] & (kind[quote + 1] == LETTER)]
    first = points[quote + 1]
    second = np.zeros_like(first)
    more = quote + 2 < n
    second[more] = np.where(edge[quote[more] + 2], 0, points[quote[more] + 2])
    size = np.zeros(len(quote), np.int64)
    for tail in ("s", "t", "m", "d", "re", "ve", "ll"):  # fixed values: contractions
        fits = first == ord(tail[0])
        if len(tail) == 2:
            fits &= second == ord(tail[1])
        size[fits] = len(tail)
    quote, size = quote[size > 0], size[size > 0]
    begin[quote + 1] = False
    begin[quote + 1 + size] = True
    starts = np.flatnonzero(begin[:n])
    ends = np.append(starts[1:], n)
    if rule == "words":
        keep = kind[starts] != SPACE
        starts, ends = starts[keep], ends[keep]
    return starts, ends
