"""L5 and L7 over every phrase-linked pair as a factorised result, linear in the pages.

All pairs of sources and targets grow with the square of the pages that share a phrase. Here a
phrase's targets that stand in the same relation to a source are one class: rows ``(source, phrase, priority)`` with the number of
links, at most three for a phrase in a text. The phrases' targets are the membership table,
one row for each page and phrase. Joining the two gives the pairs again (:func:`expand`).
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions.urls import url_depth, url_silo
from linkloom.operators.entities import blank_fill
from linkloom.operators.linking import LinkParams, PreparedTargets, best_per_pair, measure, prepare_targets, priority, wanted_phrases
from linkloom.plans.materialize import materialize

_KEY = ["h", "h2"]


def _prepared(corpus: DataFrame, p: LinkParams) -> PreparedTargets:
    return prepare_targets(corpus, replace(p, near_duplicates=False))


def class_members(prepared: PreparedTargets) -> DataFrame:
    """Membership: ``(gram, n, h, h2, target_id, target_url, t_silo, t_depth, origin)`` of every page with a URL."""
    return prepared.targets.where(F.col("target_url").isNotNull()).select(
        "gram", "n", *_KEY, "target_id", "target_url", "t_silo", "t_depth", "origin")


def _sources(corpus: DataFrame) -> DataFrame:
    """``(source_id, source_url, s_silo, s_depth, copies)`` of the pages with an id and a URL, one row for each such pair."""
    pages = corpus.select(F.col("page_id").alias("source_id"), F.col("url").alias("source_url")).dropna()
    pages = pages.groupBy("source_id", "source_url").agg(F.count(F.lit(1)).alias("copies"))
    return materialize(pages.select("source_id", "source_url", url_silo(F.col("source_url")).alias("s_silo"),
                                    url_depth(F.col("source_url")).alias("s_depth"), "copies"), "source-pages")


def _beside_members(corpus: DataFrame, prepared: PreparedTargets, members: DataFrame, p: LinkParams) -> DataFrame:
    """``(source_id, source_url, s_silo, s_depth, copies, pos, h, h2, silo, depth, url, c)``: the phrases of the texts and, with ``c`` = 1 and
    without a source, the members, dealt by phrase. Silo and URL are compared by their hashes.

    A phrase of a text crosses as four numbers, and meets what is known of its page behind the exchange; pages too many to broadcast
    are joined before it."""
    rows = wanted_phrases(blank_fill(corpus).where(F.col("page_id").isNotNull()), prepared, p)
    if prepared.stats["broadcast"]:
        rows = rows.join(prepared.phrases.where(F.col("n").between(p.min_words, p.max_words)).select(*_KEY), _KEY, "left_semi")
    pages = _sources(corpus)
    fits = measure(pages)["bytes"] <= p.broadcast_bytes
    pages = pages.select("*", F.xxhash64("s_silo").alias("of_silo"), F.xxhash64("source_url").alias("of_url"))
    held = members.select(*_KEY, F.xxhash64("t_silo").alias("silo"), F.col("t_depth").alias("depth"),
                          F.xxhash64("target_url").alias("url"), F.lit(1).alias("c"))
    both = (rows if fits else rows.join(pages, "source_id")).unionByName(held, allowMissingColumns=True).repartition(*_KEY)
    both = both.join(F.broadcast(pages), "source_id", "left") if fits else both
    return both.withColumns({x: F.coalesce(x, of) for x, of in (("silo", "of_silo"), ("depth", "s_depth"), ("url", "of_url"))})


def link_classes(corpus: DataFrame, p: LinkParams = LinkParams(), prepared: PreparedTargets | None = None) -> DataFrame:
    """``(source_id, source_url, s_silo, s_depth, gram, n, h, h2, df, pos, priority, links)``: for each phrase of a source's text how many
    targets it links to at each priority, without those that have the source's own URL.

    The phrases found cross one exchange, together with the members. Behind it the members of a phrase in the source's silo (above the
    source, and all) and those with its URL are counted by windows that one order serves; how many there are anywhere is the phrase's
    ``df`` less the pages that have no URL. Pages without a URL are neither source nor target.
    """
    prepared = prepared or _prepared(corpus, p)
    same_url = [*_KEY, "silo", "depth", "url"]
    both = _beside_members(corpus, prepared, class_members(prepared), p).sortWithinPartitions(*same_url, "source_id", "pos")
    in_silo = Window.partitionBy(*_KEY, "silo")
    count = lambda w: F.coalesce(F.sum("c").over(w), F.lit(0))
    near = both.withColumns({
        "own": count(Window.partitionBy(*same_url)),
        "up": count(in_silo.orderBy("depth").rangeBetween(Window.unboundedPreceding, -1)),
        "silo_all": count(in_silo),
        "place": F.row_number().over(Window.partitionBy(*same_url, "source_id").orderBy("pos"))})
    near = near.where(F.col("copies").isNotNull() & (F.col("place") == 1))
    nowhere = prepared.targets.where(F.col("target_url").isNull()).groupBy(*_KEY).agg(F.count(F.lit(1)).alias("nowhere"))
    # Rows and phrases are both dealt and sorted by phrase: the texts of the phrases need not be broadcast too.
    phrases = prepared.phrases.where(F.col("n").between(p.min_words, p.max_words)).hint("merge")
    near = near.join(phrases, _KEY).join(nowhere, _KEY, "left").withColumns({
        "every": F.col("df") - F.coalesce("nowhere", F.lit(0)),
        "up": F.col("copies") * F.col("up"), "beside": F.col("copies") * (F.col("silo_all") - F.col("up"))})
    # Pages with the source's URL have its silo and depth.
    row = lambda priority, n: F.struct(F.lit(priority).alias("priority"), n.alias("links"))
    links = F.array(row(2, F.col("up")), row(1, F.col("beside") - F.col("own")), row(0, F.col("every") - F.col("up") - F.col("beside")))
    return near.select("source_id", "source_url", "s_silo", "s_depth", "n", "gram", "df", "pos", *_KEY, F.inline(links)).where("links > 0")


def expand(classes: DataFrame, members: DataFrame) -> DataFrame:
    """The pairs that class rows stand for, as L5 lists them: one row for each (source, target), by its best phrase, with L7's priority."""
    pairs = (classes.drop("gram", "n").join(members, _KEY)
             .where((F.col("source_url") != F.col("target_url"))
                    & (F.col("priority") == priority(F.col("s_silo"), F.col("s_depth"), F.col("t_silo"), F.col("t_depth")))))
    best = best_per_pair(pairs)
    return best.withColumn("priority", priority(F.col("s_silo"), F.col("s_depth"), F.col("t_silo"), F.col("t_depth")))
