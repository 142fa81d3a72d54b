"""Language identification with hyperdimensional profiles.

Every letter has a fixed pseudo-random vector of +1 and -1. A letter n-gram is the product
(binding) of its letters' vectors, each rotated (permuted) by its place; a text is the sum
(bundle) of its n-grams over the whole text, each weighted by the root of its count, so that a
word repeated without end doesn't drown the rest; a language prototype is the bundle of its
training texts, each scaled to length one. A text gets the language of the largest cosine.

Training reads a bounded sample: at most ``TRAIN_TEXTS`` different texts of each language, the first by a hash of
the text. Bundles are summed in the tasks; the model, one vector for each language, is what reaches the driver. Prediction
is one narrow stage.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.llm import text_arrays as ta
from linkloom.llm.pretokens import LETTER, classes, code_points, lower
from linkloom.plans.materialize import materialize

DIMENSIONS = 1024
TRAIN_TEXTS = 2000     # training texts of each language
MAX_BROADCAST = 4096   # languages whose sample thresholds are broadcast
UNKNOWN = "und"
GRAM_BLOCK = 4096      # n-gram vectors held at once
CELLS = 4_000_000      # text by n-gram counts held at once


class Model(NamedTuple):
    languages: list[str]
    prototypes: np.ndarray  # one row of length one for each language


@lru_cache(maxsize=20_000)
def letter_vector(point: int) -> np.ndarray:
    bits = ta.mix(np.arange(DIMENSIONS, dtype=np.uint64) + np.uint64((point + 1) * 0xD1342543DE82EF95 % (1 << 64)))
    return (((bits >> np.uint64(40)) & np.uint64(1)).astype(np.int8) * 2 - 1)


def bundles(texts: list[str]) -> np.ndarray:
    """One row per text: its weighted sum of n-gram vectors, scaled to length one (zero without letters)."""
    low = [lower(t) for t in texts]
    points = code_points("".join(low))
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in low], dtype=np.int64)])
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    is_letter = classes()[points] == LETTER
    alphabet, rank = np.unique(points[is_letter], return_inverse=True)
    symbol = np.zeros(len(points) + 2, np.int64)      # 0: no letter, and both ends
    symbol[1:-1][is_letter] = rank + 1
    base = len(alphabet) + 1
    at = np.flatnonzero(is_letter)
    edge = np.zeros(len(points) + 1, bool)
    edge[bounds] = True
    left = np.where(edge[at], 0, symbol[at])
    right = np.where(edge[at + 1], 0, symbol[at + 2])
    grams = (left * base + symbol[at + 1]) * base + right
    row = np.searchsorted(bounds, at, "right") - 1
    if base ** 3 <= CELLS:
        used = np.flatnonzero(np.bincount(grams, minlength=1))
        place = np.zeros(base ** 3, np.int64)
        place[used] = np.arange(len(used))
        column = place[grams]
    else:
        used, column = np.unique(grams, return_inverse=True)
    vectors = np.stack([letter_vector(0), *(letter_vector(int(p)) for p in alphabet)])
    for k in range(0, len(used), GRAM_BLOCK):
        some = used[k:k + GRAM_BLOCK]
        bound = (np.roll(vectors, 2, 1)[some // base ** 2] * np.roll(vectors, 1, 1)[some // base % base]
                 * vectors[some % base]).astype(np.float32)
        inside = np.flatnonzero((column >= k) & (column < k + len(some)))
        step = max(1, CELLS // len(some))
        for a in range(0, len(texts), step):
            b = min(a + step, len(texts))
            part = inside[slice(*np.searchsorted(row[inside], [a, b]))]
            counts = np.bincount((row[part] - a) * len(some) + column[part] - k, minlength=(b - a) * len(some))
            out[a:b] += np.sqrt(counts.reshape(b - a, len(some)), dtype=np.float32) @ bound
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


def _chunks(column):
    texts = ta.as_text(column)
    _, offsets = ta.flat_bytes(texts)
    for i, j in ta.chunks(offsets):
        yield i, j, texts[i:j].to_pylist()


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", train_texts: int = TRAIN_TEXTS) -> Model:
    """Prototypes of the non-null languages of ``docs``; texts without a letter add nothing.

    Each language learns from its first ``train_texts`` different texts by a hash of the text (all, if it has fewer); ids
    are not read. One row per language reaches the driver: the model."""
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"),
        F.xxhash64(F.lit(17), F.col(text_col).cast("string")).alias("draw"))
    first = Window.partitionBy("lang").orderBy("draw")
    lasts = (labelled.groupBy("lang", "draw").agg(F.count(F.lit(1)).alias("n")).withColumn("no", F.row_number().over(first))
             .where(F.col("no") <= train_texts).groupBy("lang").agg(F.max("draw").alias("last")))
    lasts = materialize(lasts, "language-samples")
    some = lasts.select(F.col("lang").alias("of"), "last")
    some = F.broadcast(some) if lasts.count() <= MAX_BROADCAST else some
    drawn = (labelled.join(some, (F.col("lang") == F.col("of")) & (F.col("draw") <= F.col("last")))
             .groupBy("lang", "draw").agg(F.first("text").alias("text")).select("text", "lang"))

    def run(batches):
        for batch in batches:
            for i, j, texts in _chunks(batch.column(0)):
                made, langs = bundles(texts), np.array(batch.column(1)[i:j].to_pylist(), object)
                names = sorted(set(langs))
                sums = [made[langs == name].astype(np.float64).sum(0).tolist() for name in names]
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(sums, pa.list_(pa.float64()))],
                                                 names=["lang", "bundle"])

    def add(rows: pa.Table) -> pa.Table:  # a language's train_texts rows at most
        sums = np.array(sorted(rows["bundle"].to_pylist()))
        return pa.table({"lang": rows["lang"][:1], "bundle": pa.array([sums.sum(0).tolist()], pa.list_(pa.float64()))})

    rows = (drawn.mapInArrow(run, "lang string, bundle array<double>").groupBy("lang")
            .applyInArrow(add, "lang string, bundle array<double>").collect())
    total = {r["lang"]: np.array(r["bundle"]) for r in sorted(rows, key=lambda r: r["lang"])}
    total = {lang: v / np.linalg.norm(v) for lang, v in total.items() if np.linalg.norm(v) > 0}
    return Model(list(total), np.array(list(total.values()), np.float32).reshape(-1, DIMENSIONS))


def identify(docs: DataFrame, model: Model, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``carry``) with ``lang_pred`` and ``score`` (cosine, 0 at least).

    A null text, one without a letter, and any text if the model has no language get ``und`` and
    0. Only the text is read for a prediction; equal texts get equal answers; ties go to the
    language first in code point order. Rows stay as they are; a column with the name of an
    added one is replaced.
    """
    carried = [c for c in (docs.columns if carry is None else carry) if c not in ("lang_pred", "score")]

    def run(batches):
        for batch in batches:
            for i, j, texts in _chunks(batch.column(batch.num_columns - 1)):
                made = bundles(texts)
                some = made.any(axis=1) & (len(model.languages) > 0)
                names, score = np.full(j - i, UNKNOWN, object), np.zeros(j - i)
                if some.any():
                    cosine = made[some] @ model.prototypes.T
                    best = cosine.argmax(1)
                    names[some] = np.array(model.languages, object)[best]
                    score[some] = np.clip(cosine[np.arange(len(best)), best], 0, 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(k)[i:j] for k in range(len(carried))] + [pa.array(names, pa.string()), pa.array(score)],
                    names=[*carried, "lang_pred", "score"])

    schema = T.StructType([docs.schema[c] for c in carried] + [T.StructField("lang_pred", T.StringType()),
                                                               T.StructField("score", T.DoubleType())])
    return ta.small_batches(docs).select(*(docs[f"`{c}`"] for c in carried), docs[f"`{text_col}`"].cast("string").alias("__text")
                       ).mapInArrow(run, schema)


def held_out(key: Column) -> Column:
    """The fold kept from training: crc32 of the id as text, modulo 4, is 2 (a null id is not held out)."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
