"""A fixed-size Bloom filter as a table: prunes rows in the scan stage, before any shuffle.

A key's two 64-bit hashes choose one 64-bit word and ``BITS`` bits in it. The filter is the table ``(word, bits)``, built by
partial ``bit_or`` aggregates; it never has more than ``words`` rows, whatever is put in, so it may always be
broadcast. A key that was put in is always found; another one is found by chance (about 1 % at 16 bits a key).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 4
MAX_WORDS = 1 << 21  # rows of the largest filter: 16 MB of bits


def words_for(keys: int, most: int = MAX_WORDS) -> int:
    """Words that give each key about 16 bits, within the fixed bound; a power of two."""
    return min(most, max(1 << 10, 1 << (max(keys, 1) // 4).bit_length()))


def _word(h: Column, words: int) -> Column:
    return F.pmod(h, F.lit(words)).cast("int")


def _mask(h2: Column) -> Column:
    """``BITS`` bits chosen by as many groups of six bits of the second hash."""
    out = F.lit(0).cast("long")
    for k in range(BITS):
        bit = F.shiftrightunsigned(h2, 6 * k).bitwiseAND(F.lit(63)).cast("int")
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return out


def bloom_table(keys: DataFrame, h: str, h2: str, words: int) -> DataFrame:
    """``(word, bits)`` of the hashes ``h`` and ``h2`` of ``keys``."""
    return keys.groupBy(_word(F.col(h), words).alias("word")).agg(F.bit_or(_mask(F.col(h2))).alias("bits"))


def might_hold(rows: DataFrame, bloom: DataFrame, words: int, h: Column, h2: Column) -> DataFrame:
    """``rows`` whose hashes the filter may hold (all that it holds, and a few more)."""
    found = rows.withColumn("_word", _word(h, words)).withColumn("_mask", _mask(h2))
    table = F.broadcast(bloom.select(F.col("word").alias("_word"), "bits"))
    return found.join(table, "_word").where(F.col("bits").bitwiseAND(F.col("_mask")) == F.col("_mask")).select(*rows.columns)
