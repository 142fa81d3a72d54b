"""Quality classifier from weak labels.

1. Overlapping heuristic labellers vote on each whole text: 1 good, 0 bad, or abstain.
2. Expectation-maximisation over the vote patterns estimates how accurate each labeller is on
   good and on bad texts, without any label. The patterns are counted over all texts; there are
   at most 3 ** labellers of them, so the driver iterates over a bounded table.
3. The posterior of its pattern is each text's soft label. A linear scorer on hashed features
   (shapes of words, of neighbouring words, repetition) learns it on a bounded sample
   (at most ``TRAIN_TEXTS`` different texts, the first by a hash of the text).
4. All whole texts are scored in one narrow stage; the weights have a fixed size.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm import text_arrays as ta
from linkloom.llm.annotate import annotate
from linkloom.llm.draw import draw
from linkloom.llm.text_stats import Texts

TRAIN_TEXTS = 4096
BUCKETS = 1 << 15
ROUNDS = 50           # of expectation-maximisation
STEPS = 300           # of gradient descent
RIDGE = 1e-5
SMOOTH = 20           # words added to a text's length: little evidence moves a short text little
ABSTAIN = 2
START = ((0.4, 0.6, 1.0), (0.05, 0.95, 1.0))  # P(vote | bad text), P(vote | good text) before the first round
START_PRIOR = 0.8


class Labeller(NamedTuple):
    """Votes bad where ``bad`` holds, else good where ``good`` holds, else abstains."""
    name: str
    bad: Callable[[Texts], np.ndarray]
    good: Callable[[Texts], np.ndarray]


LABELLERS = (
    Labeller("symbols", lambda t: 5 * t.n_symbols > t.n_words, lambda t: 50 * t.n_symbols <= t.n_words),
    Labeller("letters", lambda t: (10 * t.n_letters < 8 * t.word_chars) & (t.n_words >= 20), lambda t: 10 * t.n_letters > 9 * t.word_chars),
    Labeller("capitals", lambda t: 2 * t.n_upper > t.n_letters, lambda t: 10 * t.n_upper < t.n_letters),
    Labeller("exclamations", lambda t: 5 * t.n_bang_words > t.n_words, lambda t: (t.n_bang_words == 0) & (t.n_stops > 0)),
    Labeller("bare_words", lambda t: (5 * t.n_bare_words > t.n_words) & (t.n_words >= 20), lambda t: 50 * t.n_bare_words <= t.n_words),
    Labeller("same_word", lambda t: 5 * t.n_same_words > t.n_words, lambda t: 50 * t.n_same_words <= t.n_words),
    Labeller("variety", lambda t: (5 * t.n_distinct_words < t.n_words) & (t.n_words > 50),
             lambda t: 3 * t.n_distinct_words > t.n_words),
    Labeller("sentences", lambda t: (t.n_words > 50) & ((100 * t.n_stops < t.n_words) | (2 * t.n_stops > t.n_words)),
             lambda t: (25 * t.n_stops > t.n_words) & (3 * t.n_stops < t.n_words)),
)


def votes(texts: Texts, labellers: tuple[Labeller, ...] = LABELLERS) -> np.ndarray:
    """One row per text, one column per labeller: 1, 0 or ABSTAIN (texts without words: all bad)."""
    cast = [np.where(f.bad(texts), 0, np.where(f.good(texts), 1, ABSTAIN)) for f in labellers]
    out = np.stack(cast, 1).astype(np.int64)
    out[texts.n_words == 0] = 0
    return out


def patterns(cast: np.ndarray) -> np.ndarray:
    """One number per row of votes."""
    return cast @ (3 ** np.arange(cast.shape[1], dtype=np.int64))


def count_patterns(docs: DataFrame, text_col: str = "text", labellers: tuple[Labeller, ...] = LABELLERS) -> dict[int, int]:
    """How many texts have each vote pattern, over the whole table."""
    def run(batches):
        total = np.zeros(3 ** len(labellers), np.int64)
        for batch in batches:
            data, offsets = ta.flat_bytes(batch.column(0))
            for i, j in ta.chunks(offsets, give_back=True):
                texts = Texts(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                total += np.bincount(patterns(votes(texts, labellers)), minlength=len(total))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["pattern", "n"])

    rows = (ta.small_batches(docs).select(F.col(text_col).cast("string")).mapInArrow(run, "pattern long, n long")
            .groupBy("pattern").agg(F.sum("n").alias("n")).collect())  # at most 3 ** labellers rows
    return {r["pattern"]: r["n"] for r in rows}


def fit_labellers(counts: dict[int, int], labellers: int = len(LABELLERS), rounds: int = ROUNDS
                  ) -> tuple[dict[int, float], np.ndarray]:
    """Posterior probability of good for each pattern, and P(vote | class, no abstention) as (class, labeller, vote).

    Starts from labellers that seldom call a good text bad (``START``); every estimate has one vote added to each cell, so an
    unseen vote is never impossible. An abstention says nothing. A labeller is assumed to be right
    more often than wrong.
    """
    seen = np.array(sorted(counts), np.int64)
    weight = np.array([counts[p] for p in seen.tolist()], float)
    cast = seen[:, None] // 3 ** np.arange(labellers) % 3
    table = np.array(START)[:, None, :].repeat(labellers, 1)
    prior = START_PRIOR

    def judge():
        odds = np.log(prior / (1 - prior)) + sum(
            np.log(table[1, k, cast[:, k]] / table[0, k, cast[:, k]]) for k in range(labellers))
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))

    posterior = judge()
    for _ in range(rounds if len(seen) else 0):
        for c, p in ((1, posterior), (0, 1 - posterior)):
            for v in range(2):
                table[c, :, v] = ((weight * p)[:, None] * (cast == v)).sum(0) + 1
            table[c, :, :2] /= table[c, :, :2].sum(1, keepdims=True)
        flipped = table[0, :, 0] * table[1, :, 1] < table[0, :, 1] * table[1, :, 0]
        table[:, flipped] = table[:, flipped].mean(0)
        prior = ((weight * posterior).sum() + 1) / (weight.sum() + 2)
        posterior = judge()
    return dict(zip(seen.tolist(), posterior.tolist())), table


_SHAPE = np.arange(256)
_SHAPE[0x41:0x5B] = ord("A")
_SHAPE[0x61:0x7B] = _SHAPE[0x80:] = ord("a")
_SHAPE[0x30:0x3A] = ord("0")
_SAME = 0  # bucket of 'equal to the word before'


def features(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Two hashed features of each word, as bucket numbers: its shape (runs of one kind of character
    count once), and its shape after the shape before it, or that it equals the word before."""
    starts, ends, first = texts.starts, texts.ends, texts.first
    shape = _SHAPE[texts.data]
    keep = np.ones(len(shape), bool)
    keep[1:] = shape[1:] != shape[:-1]
    keep[starts] = True
    keep &= ~ta.IS_SPACE[texts.data]
    run = np.concatenate([[0], np.cumsum(keep)])
    kind = ta.span_hashes(ta.symbol_values(shape[keep]), run[starts], run[ends])
    before = np.zeros_like(kind)
    before[1:] = kind[:-1]
    same = np.zeros(len(kind), bool)
    same[1:] = texts.word_hashes[1:] == texts.word_hashes[:-1]
    begins = first[:-1][first[:-1] < len(kind)]
    before[begins] = 0
    same[begins] = False
    pair = ta.mix(kind + before * np.uint64(0x9E3779B97F4A7C15))
    size = np.uint64(BUCKETS - 1)
    return ((kind % size).astype(np.int64) + 1, np.where(same, _SAME, (pair % size).astype(np.int64) + 1))


def _sample(docs: DataFrame, text_col: str, limit: int, labellers: tuple[Labeller, ...]) -> list:
    """(pattern, buckets, shares) of the sampled texts with words: ``limit`` different texts at most."""
    def run(batches):
        for batch in batches:
            data, offsets = ta.flat_bytes(batch.column(0))
            for i, j in ta.chunks(offsets, give_back=True):
                texts = Texts(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                one, two = features(texts)
                rows = []
                for k, pattern in enumerate(patterns(votes(texts, labellers)).tolist()):
                    a, b = texts.first[k], texts.first[k + 1]
                    if b > a:
                        bucket, n = np.unique(np.concatenate([one[a:b], two[a:b]]), return_counts=True)
                        rows.append((pattern, bucket.tolist(), (n / (b - a + SMOOTH)).tolist()))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.list_(pa.int64())),
                         pa.array([r[2] for r in rows], pa.list_(pa.float64()))], names=["pattern", "buckets", "shares"])

    texts = docs.select(F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    rows = draw(texts, [F.col("text")], limit, ["text"]).mapInArrow(run, "pattern long, buckets array<long>, shares array<double>").collect()
    return sorted((r["pattern"], r["buckets"], r["shares"]) for r in rows)


def fit_scorer(sample: list, posterior: dict[int, float], steps: int = STEPS) -> np.ndarray:
    """Logistic weights of the buckets (the last one is the constant), by accelerated gradient descent."""
    weights = np.zeros(BUCKETS + 1)
    if not sample:
        return weights
    target = np.array([posterior[p] for p, _, _ in sample])
    size = np.array([len(b) for _, b, _ in sample])
    row = np.repeat(np.arange(len(sample)), size)
    bucket = np.concatenate([b for _, b, _ in sample]).astype(np.int64)
    share = np.concatenate([s for _, _, s in sample])
    starts = np.cumsum(size) - size
    rate = 4 / (1 + np.add.reduceat(share ** 2, starts).max())
    ahead, speed = weights.copy(), 1.0
    for _ in range(steps):
        margin = np.add.reduceat(ahead[bucket] * share, starts) + ahead[-1]
        error = 1 / (1 + np.exp(-np.clip(margin, -50, 50))) - target
        slope = np.bincount(bucket, share * error[row], BUCKETS + 1)
        slope[-1] = error.sum()
        now = ahead - rate * (slope / len(sample) + RIDGE * ahead)
        faster = (1 + np.sqrt(1 + 4 * speed * speed)) / 2
        ahead = now + (speed - 1) / faster * (now - weights)
        weights, speed = now, faster
    return weights


def score(texts: Texts, weights: np.ndarray) -> np.ndarray:
    """Probability of good quality for each text (0 for texts without words)."""
    one, two = features(texts)
    run = np.concatenate([[0.0], np.cumsum(weights[one] + weights[two])])
    margin = (run[texts.first[1:]] - run[texts.first[:-1]]) / (texts.n_words + SMOOTH) + weights[-1]
    return np.where(texts.n_words > 0, 1 / (1 + np.exp(-np.clip(margin, -50, 50))), 0.0)


def quality_classifier(docs: DataFrame, text_col: str = "text",
                       labellers: tuple[Labeller, ...] = LABELLERS, train_texts: int = TRAIN_TEXTS,
                       carry: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``carry``) with ``posterior``, ``score`` and ``kept``.

    ``posterior`` is the weak labels' probability of good quality, ``score`` the linear scorer's;
    ``kept`` is score >= 0.5. A null text or one without words gets score 0 and is not kept.
    Ids are not read: equal texts are judged alike; an empty table gives an empty result; a
    column with the name of an added one is replaced. Only a table with clear junk teaches the
    scorer to reject: where the labellers agree that all is good, all texts with words are kept.
    """
    counts = count_patterns(docs, text_col, labellers)
    posterior, _ = fit_labellers(counts, len(labellers))
    weights = fit_scorer(_sample(docs, text_col, train_texts, labellers), posterior)
    table = np.zeros(3 ** len(labellers))
    table[list(posterior)] = list(posterior.values())

    def make(texts: Texts):
        value = score(texts, weights)
        return table[patterns(votes(texts, labellers))], value, (value >= 0.5) & (texts.n_words > 0)

    return annotate(docs, text_col, "posterior double, score double, kept boolean", make, carry)
