"""Column-level text functions (all JVM-side built-ins, no Python UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkloom.functions import patterns as P


def py_strip(c: Column) -> Column:
    """Python ``str.strip()``: removes the full Unicode whitespace set at both
    ends (Spark's ``trim`` removes spaces only)."""
    return F.regexp_replace(c, P.PY_STRIP, "")


def collapse_ws(c: Column) -> Column:
    """Runs of ASCII whitespace -> one space."""
    return F.regexp_replace(c, P.ASCII_SPACE_RUN, " ")


def _reference_text(ref: Column) -> Column:
    """Text of a character reference without ``&`` and ``;`` (NULL if unknown)."""
    names = F.create_map(*[F.lit(x) for pair in P.NAMED_ENTITIES.items() for x in pair])
    hexa = F.when(ref.rlike("^#[xX]"), F.substring(ref, 3, 6)).when(
        F.startswith(ref, F.lit("#")), F.conv(F.substring(ref, 2, 7), 10, 16))
    point = F.conv(hexa, 16, 10).cast("int")
    text = F.decode(F.unhex(F.lpad(hexa, 8, "0")), "UTF-32")
    valid = (point > 0) & (point <= 0x10FFFF) & ~point.between(0xD800, 0xDFFF)
    return F.when(hexa.isNotNull(), F.when(valid, text)).otherwise(F.try_element_at(names, ref))


def decode_entities(c: Column) -> Column:
    """Named and numeric character references -> text; unknown ones stay. Texts without ``&`` skip it."""
    refs = F.array_distinct(F.regexp_extract_all(c, F.lit(P.ENTITY_RE), F.lit(1)))
    decoded = F.aggregate(refs, c, lambda acc, ref: F.replace(
        acc, F.concat(F.lit("&"), ref, F.lit(";")),
        F.coalesce(_reference_text(ref), F.concat(F.lit("&"), ref, F.lit(";")))))
    return F.when(F.instr(c, "&") > 0, F.replace(decoded, F.lit("&amp;"), F.lit("&"))).otherwise(c)


def empty_to_null(c: Column) -> Column:
    return F.when(c != F.lit(""), c)


def normalize_token(t: Column) -> Column:
    """Lower case, keep only letters and digits."""
    return F.regexp_replace(F.lower(t), P.NON_WORD, "")


def trim_outer_non_word(c: Column) -> Column:
    return F.regexp_replace(c, P.OUTER_NON_WORD, "")


def raw_tokens(text: Column) -> Column:
    """Whitespace tokens of a text (collapsed first, so no empty inner tokens)."""
    return F.split(py_strip(collapse_ws(text)), " ")


def word_count(text: Column) -> Column:
    """Number of whitespace-separated words of a stripped text ('' -> 0)."""
    t = py_strip(collapse_ws(text))
    return F.when(t == F.lit(""), F.lit(0)).otherwise(F.size(F.split(t, " ")))


def text_token_arrays(text: Column) -> tuple[Column, Column, Column]:
    """``(raw, norm, last)`` token arrays of a text without per-token lambdas.

    The text is collapsed to single spaces first, so normalizing the whole
    string (keeping the spaces) and splitting gives exactly one normalized
    word per raw token; likewise replacing every token by its last character.
    Whole-string regexes run in generated code; per-token lambdas do not."""
    t = py_strip(collapse_ws(text))
    raw = F.split(t, " ")
    norm = F.split(F.regexp_replace(F.lower(t), P.NON_WORD_OR_SPACE, ""), " ")
    last = F.split(F.regexp_replace(t, "[^ ]*([^ ])", "$1"), " ")
    return raw, norm, last


def _shifted(arr: Column, k: int, prefix: str) -> list[Column]:
    """``arr`` shifted left by 0..k-1 places, for ``arrays_zip``.

    Zipping shifted copies gives every window of ``k`` consecutive elements
    as one struct, so the lambdas below only read their own element: a
    lambda that indexes an outer array is re-evaluated per element and
    Catalyst may inline the array expression into it (quadratic work)."""
    size = F.size(arr)
    return [F.slice(arr, j + 1, size).alias(f"{prefix}{j}") for j in range(k)]


def shingle_words(text: Column) -> Column:
    """Non-empty normalized words of a text, the input of :func:`shingles`."""
    _, norm, _ = text_token_arrays(text)
    return F.array_remove(norm, "")


def shingles(words: Column, width: int = 5) -> Column:
    """Distinct ``width``-word shingles of a word array."""
    windows = F.filter(F.arrays_zip(*_shifted(words, width, "w")),
                       lambda e: e[f"w{width - 1}"].isNotNull())
    return F.array_distinct(F.transform(
        windows, lambda e: F.concat_ws(" ", *[e[f"w{j}"] for j in range(width)])))


def shingle_hashes(words: Column, width: int = 5) -> Column:
    """64-bit hashes of the distinct ``width``-word shingles of a word array."""
    windows = F.filter(F.arrays_zip(*_shifted(words, width, "w")),
                       lambda e: e[f"w{width - 1}"].isNotNull())
    return F.array_distinct(F.transform(windows, lambda e: F.xxhash64(*[e[f"w{j}"] for j in range(width)])))
