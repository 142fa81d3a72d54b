"""Mix sources to target weights by hash-threshold histograms.

Every document has a fixed pseudo-random position (48 bits of a hash of its id and text). A source
that should give ``R`` words more than some whole number of passes over it takes the
documents below a threshold. The threshold comes from nested histograms: words are summed by
source and by the first 12 bits of the position, the bucket in which the budget ends is
found, and only that bucket is summed by the next 12 bits, until one position is left. The
documents are never sorted; a source's budget thresholds are nested, so a larger budget
takes a superset. Of rows that share the last position (repeated rows) as many are taken as come nearest to the budget.

Documents shrink to narrow rows first; each histogram is a partial aggregate, so a source
that holds most rows is summed where its rows lie. What is decided per source stays a table
that is joined back; the join's large side may be split at a hot source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.operators.ordinal import with_ordinal
from linkloom.plans.materialize import materialize

LEVEL_BITS = 12
LEVELS = 4
MAX_PASSES = 3
WEIGHTS = (1, 2, 3)
MAX_BROADCAST = 4096   # sources whose plan is broadcast


def word_count(text):
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text column, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def position(key, text):
    """48 pseudo-random bits of an id and a text column ('' for null)."""
    both = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(both.cast("binary")), 1, 12), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_passes: int = MAX_PASSES) -> DataFrame:
    """``(source, source_size)`` -> with ``target``: each source's share of all words.

    Sources in code point order (null last) have the weights in turn. A share stops at
    ``max_passes`` times the source's size; what is left over is shared again by weight among
    the others until none is above. Only sums over the sources reach the driver.
    """
    order = F.col("source").asc_nulls_last()
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("no") - 1, F.lit(len(weights))) + 1).cast("int"))
    table = materialize(with_ordinal(sizes, [order], "no").select(
        "source", "source_size", turn.cast("long").alias("weight")), "mix-sources")
    wide = "decimal(38,0)"
    most = F.col("source_size") * max_passes
    total, weight = table.agg(F.sum("source_size"), F.sum("weight")).first()
    left, weight, full = total or 0, weight or 0, F.lit(False)
    while left and weight:
        above = F.col("weight").cast(wide) * F.lit(left).cast(wide) > most.cast(wide) * F.lit(weight).cast(wide)
        now = full | above
        row = table.agg(F.sum(F.when(now, most)), F.sum(F.when(now, F.col("weight")))).first()
        rest, others = total - (row[0] or 0), table_weight(table) - (row[1] or 0)
        if (rest, others) == (left, weight):
            break
        left, weight, full = rest, others, now
    share = F.when(full, most.cast("double")).otherwise(
        (F.col("weight") * F.lit(left)).cast("double") / F.lit(float(weight or 1)))
    return table.select("source", "source_size", share.alias("target"))


def table_weight(table: DataFrame) -> int:
    return table.agg(F.sum("weight")).first()[0] or 0


def _thresholds(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """``(source, threshold, last)``: documents below the position ``threshold`` are taken once more, and ``last`` rows at it."""
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    state = targets.withColumn("passes", passes.cast("long")).select(
        "source", "passes", (F.col("target") - F.col("passes") * F.col("source_size")).alias("left"),
        F.lit(0).cast("long").alias("prefix"))
    state = materialize(state, "mix-state")
    # done: the sources of which a level has no bucket past the budget (nothing more is taken).
    for level in range(1, LEVELS + 1):
        shift = LEVEL_BITS * (LEVELS - level)
        bucket = F.shiftright("pos", shift)
        inside = docs.join(state.withColumnRenamed("source", "of").select("of", "prefix"),
                           docs["source"].eqNullSafe(F.col("of"))) if level > 1 else docs
        if level > 1:
            inside = inside.where(F.shiftright("pos", shift + LEVEL_BITS) == F.col("prefix"))
        sums = inside.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows"))
        # At most 2**12 buckets of a source.
        run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        sums = sums.withColumn("upto", F.sum("words").over(run))
        ends = (sums.withColumnRenamed("source", "of")
                .join(state.select("source", "passes", "left"), F.col("of").eqNullSafe(F.col("source")))
                .where(F.col("upto") > F.col("left"))
                .groupBy("source", "passes", "left")
                .agg(F.min(F.struct("bucket", "upto", "words", "rows")).alias("end")))
        state = materialize(ends.select(
            "source", "passes", (F.col("left") - (F.col("end.upto") - F.col("end.words"))).alias("left"),
            F.col("end.bucket").alias("prefix"), F.col("end.words").alias("words"), F.col("end.rows").alias("rows")), f"mix-level{level}")
    # One position is left, of one row or of equal ones: as many are taken as come nearest to the budget.
    return state.select("source", F.col("prefix").alias("threshold"), F.floor(
        (2 * F.col("left") * F.col("rows") + F.col("words")) / (2 * F.col("words"))).alias("last"))


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` at the thresholds with ``nth`` from 1 in each source: numbered inside each part of the table they lie in, behind the rows of the
    parts before (one row for each part and source)."""
    parts = rows.groupBy("source", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("source").alias("of"), F.col("part").alias("in"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source", "part").orderBy("size")
    nth = rows.withColumn("own", F.row_number().over(inside))
    return nth.join(parts, nth["source"].eqNullSafe(F.col("of")) & (nth["part"] == F.col("in"))).withColumn("nth", F.col("before") + F.col("own"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights: tuple[int, ...] = WEIGHTS, max_passes: int = MAX_PASSES, carry: list[str] | None = None) -> DataFrame:
    """``(id, size, source_size, target, taken)`` for each row: ``taken`` words, repeats counted; or the columns ``carry`` of
    ``docs`` and ``times``, how often the row is taken.

    ``size`` is the number of words (null text: 0), ``taken`` a whole multiple of it, at most
    ``max_passes`` times. A null source is a source of its own. A row's position is by its id and text, so rows of one id or
    without one are divided; of rows that are equal in both, some may be taken once more than others, and which of them is
    not told apart. An empty table gives an empty result. The same rows give the same result at every run and partitioning.
    """
    held = {f"c{k}": F.col(f"`{c}`") for k, c in enumerate(carry or [])}
    narrow = materialize(docs.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
        word_count(F.col(text_col)).alias("size"), position(F.col(id_col), F.col(text_col)).alias("pos"),
        F.spark_partition_id().alias("part"), *[c.alias(k) for k, c in held.items()]), "mix-docs")
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = materialize(source_targets(sizes, weights, max_passes), "mix-targets")
    marks = _thresholds(narrow.drop(*held), targets).withColumnRenamed("source", "marked")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    plan = materialize(targets.join(marks, targets["source"].eqNullSafe(F.col("marked")), "left").select(
        F.col("source").alias("of"), "source_size", "target", passes.cast("long").alias("passes"),
        F.coalesce("threshold", F.lit(0)).alias("threshold"), F.coalesce("last", F.lit(0)).alias("last")), "mix-plan")
    plan = F.broadcast(plan) if plan.count() <= MAX_BROADCAST else plan
    planned = narrow.join(plan, narrow["source"].eqNullSafe(F.col("of"))).drop("of")
    at_end = F.col("pos") == F.col("threshold")
    inner = planned.where(~at_end).withColumn("more", (F.col("pos") < F.col("threshold")).cast("int"))
    edge = _numbered(planned.where(at_end)).withColumn("more", (F.col("nth") <= F.col("last")).cast("int"))
    times = F.col("passes") + F.col("more")
    rows = inner.unionByName(edge.select(*inner.columns))
    if carry is not None:
        return rows.select(*[F.col(k).alias(c) for k, c in zip(held, carry)], F.when(F.col("size") > 0, times).otherwise(0).cast("int").alias("times"))
    return rows.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * times).cast("long").alias("taken"))
