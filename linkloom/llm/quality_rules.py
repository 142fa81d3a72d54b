"""Quality rules as a short-circuit cascade.

Each rule rejects a text or lets it pass to the next; a text is kept if no rule rejects it, so
the order changes the cost and never the verdict. The order is chosen for the table at hand:
on a sample (``SAMPLE_ROWS`` rows by hash of the id) every rule is timed alone and its rejections
are counted, in the tasks; rules then run by rejections per second. After a rule that rejects
many texts of a pack, the later ones see only those that are left.

One narrow stage reads the whole texts; nothing is shuffled but the sample's few counters.
"""

from __future__ import annotations

import time
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

SAMPLE_ROWS = 1024
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30


class Rule(NamedTuple):
    """``rejects(texts)`` is a boolean per text; the thresholds are part of the rule."""
    name: str
    rejects: Callable[[Texts], np.ndarray]


RULES = (
    Rule("symbols", lambda t: 4 * t.n_symbols > t.n_words),
    Rule("capitals", lambda t: t.n_upper > t.n_lower + 20),
    Rule("exclamations", lambda t: 10 * t.n_bang_words > 3 * t.n_words),
    Rule("word_length", lambda t: (t.word_chars > 20 * t.n_words) | (2 * t.word_chars < 3 * t.n_words)),
    Rule("letters", lambda t: 2 * t.n_letters < t.word_chars),
    Rule("bare_words", lambda t: 10 * t.n_bare_words > 4 * t.n_words),
    Rule("same_word", lambda t: 10 * t.n_same_words > 3 * t.n_words),
    Rule("repeated_lines", lambda t: (2 * t.n_dup_lines > t.n_lines) & (t.n_lines > 3)),
)


def base_failed(t: Texts) -> np.ndarray:
    """The fixed first rule: too few words, or too many of them in repeated passages."""
    return (t.n_words < MIN_WORDS) | (100 * t.n_repeat_words > MAX_REPEAT_PERCENT * t.n_words)


def rejected(texts: Texts, rules: tuple[Rule, ...], alive: np.ndarray) -> np.ndarray:
    """The cascade over a pack: True for every text that is not alive or that some rule rejects."""
    alive = alive.copy()
    rows = np.flatnonzero(alive)
    left = texts if len(rows) == texts.n else texts.subset(rows)
    for rule in rules:
        if not len(rows):
            break
        out = rule.rejects(left)
        alive[rows[out]] = False
        if 10 * out.sum() > len(rows):
            rows, left = rows[~out], left.subset(np.flatnonzero(~out))
    return ~alive


def rule_profile(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES,
                 sample_rows: int = SAMPLE_ROWS) -> dict[str, tuple[float, int]]:
    """Seconds and rejections of each rule on ``sample_rows`` different texts (all, if the table has fewer)."""
    texts = ta.small_batches(docs).select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    sample = draw(texts, [F.col("text")], sample_rows, ["text"])

    def run(batches):
        seconds, found = np.zeros(len(rules)), np.zeros(len(rules), np.int64)
        for batch in batches:
            data, offsets = ta.flat_bytes(batch.column(0))
            for i, j in ta.chunks(offsets):
                for k, rule in enumerate(rules):  # fresh texts: no rule profits from another's counts
                    texts = Texts(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                    began = time.thread_time()
                    found[k] += int(rule.rejects(texts).sum())
                    seconds[k] += time.thread_time() - began
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rules), dtype=np.int32)), pa.array(seconds), pa.array(found)],
                                         names=["rule", "seconds", "found"])

    rows = (sample.mapInArrow(run, "rule int, seconds double, found long")
            .groupBy("rule").agg(F.sum("seconds"), F.sum("found")).collect())  # one row per rule
    return {rules[k].name: (s, n) for k, s, n in rows}


def order_rules(profile: dict[str, tuple[float, int]], rules: tuple[Rule, ...] = RULES) -> tuple[Rule, ...]:
    """Rules by rejections per second, highest first; rules that rejected nothing last, cheapest first."""
    def worth(rule):
        seconds, found = profile.get(rule.name, (0.0, 0))
        return (-found / max(seconds, 1e-9), seconds)
    return tuple(sorted(rules, key=worth))


def quality_rules(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES,
                  carry: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``carry``) with the base counts, ``base_failed`` and ``kept``.

    ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` count over the whole text
    (null as empty: all zero, ``base_failed``, not kept). Ids are not read: rows that repeat are judged alike; an empty table gives an empty result; a column with the name of an
    added one is replaced.
    """
    ordered = order_rules(rule_profile(docs, text_col, rules), rules)

    def make(texts: Texts):
        failed = base_failed(texts)
        kept = ~rejected(texts, ordered, ~failed)
        return (texts.n_words, texts.word_chars, texts.n_symbols, texts.n_dup_lines, texts.n_repeat_words, failed, kept)

    return annotate(docs, text_col, "n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                                    "n_repeat_words long, base_failed boolean, kept boolean", make, carry)
