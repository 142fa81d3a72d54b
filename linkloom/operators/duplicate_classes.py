"""L6 for a whole corpus as classes: one row for each page, not one for each pair.

Pages whose shingle sets reach the Jaccard bound are linked, and linked pages are one class. Equal sets are one
representative from the start. Candidates come from lists of the representatives that share a shingle of their
prefixes. In each round a few members of a list (twice as many as in the round before) are compared with the
others that are not yet in their class; links contract the classes, and a list that lies in one class is
done. So n near copies cost about n comparisons, while pages that are not alike are all compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.operators.linking import FEW_PAGES, LinkParams, Sketches, near_duplicate_pairs, ordered_prefixes, page_sketches
from linkloom.plans.materialize import materialize


def contract(links: DataFrame) -> DataFrame:
    """``(id, root)`` of every id in ``links(u, v)``: the smallest id that it is connected with.

    Each round gives every node the smallest id that it or a neighbour knows, then that id's own (pointer doubling), by partial
    minima; a round is a table in the checkpoint folder. Ends when nothing changes."""
    both = materialize(links.union(links.select("v", "u")).where("u != v").distinct(), "class-links")
    roots = materialize(both.groupBy(F.col("u").alias("id")).agg(F.least(F.min("v"), F.first("u")).alias("root")), "class-roots")
    while True:
        around = both.join(roots.select(F.col("id").alias("v"), "root"), "v").groupBy(F.col("u").alias("id")).agg(F.min("root").alias("near"))
        low = roots.join(around, "id").select("id", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        low = materialize(low, "class-roots")
        further = low.select(F.col("id").alias("root"), F.col("root").alias("next"))
        new = materialize(low.join(further, "root").select("id", "old", F.least("root", "next").alias("root")), "class-roots")
        roots = new.drop("old")
        if new.where("root != old").isEmpty():
            return roots


def duplicate_classes(corpus: DataFrame, p: LinkParams = LinkParams()) -> DataFrame:
    """``(page_id, class_id)`` of every page: the smallest id of the pages that near-duplicate links (L6) connect it with.

    A page without a shingle (fewer than five words) is alone. Equal pages are one class however many they are."""
    sketches = materialize(page_sketches(corpus, p), "page-sketches")
    sets = sketches.where("nsh > 0").withColumn("k", F.xxhash64("sh")).withColumn("k2", F.xxhash64(F.lit(1), "sh"))
    copies = materialize(sets.groupBy("k", "k2").agg(F.min("page_id").alias("of")).join(
        sets.select("k", "k2", "page_id"), ["k", "k2"]).select("page_id", "of"), "equal-pages")
    # The sets of the representatives are read from the pages' table; they are written again only if there are too many to broadcast.
    ids = copies.where("page_id = of").select("page_id")
    one = (sketches.join(F.broadcast(ids), "page_id", "left_semi") if ids.count() <= FEW_PAGES
           else materialize(sketches.join(ids, "page_id", "left_semi"), "representatives"))
    whole = Sketches(one.select("page_id", "nsh", "prefix"), corpus.select("page_id", "content"))
    lists = ordered_prefixes(one, p).select("s", "page_id", "nsh")
    shared = lists.groupBy("s").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("s")
    lists = materialize(lists.join(shared, "s", "left_semi"), "shingle-lists")
    links, classes, round_ = None, None, 0
    while True:
        now = lists.withColumn("class", F.col("page_id")) if classes is None else (
            lists.join(classes.select(F.col("id").alias("page_id"), "root"), "page_id", "left")
            .withColumn("class", F.coalesce("root", "page_id")).drop("root"))
        open_ = now.groupBy("s").agg(F.min("class").alias("a"), F.max("class").alias("b")).where("a < b").select("s")
        now = materialize(now.join(open_, "s", "left_semi"), "shingle-lists")
        if now.isEmpty():
            break
        # Up to 2^round members of each list are compared with all others and then leave it.
        leads = materialize(now.groupBy("s", F.pmod(F.xxhash64("page_id", F.lit(round_)), F.lit(1 << min(round_, 20))).alias("_"))
                            .agg(F.min(F.struct("page_id", "nsh", "class")).alias("lead")).select("s", "lead.*"), "leads")
        other = leads.select("s", F.col("page_id").alias("source_id"), F.col("nsh").alias("nsh_lead"), F.col("class").alias("class_lead"))
        pairs = (now.join(other, "s").where(
            (F.col("class") != F.col("class_lead"))
            & (F.least("nsh", "nsh_lead") * p.dup_den >= F.greatest("nsh", "nsh_lead") * p.dup_num))
            .select("source_id", F.col("page_id").alias("target_id")).distinct())
        found = near_duplicate_pairs(pairs, whole, p).select(F.col("source_id").alias("u"), F.col("target_id").alias("v"))
        found = materialize(found, "near-links")
        lists = now.drop("class").join(leads.select("s", "page_id"), ["s", "page_id"], "left_anti")
        if not found.isEmpty():
            # Links of the rounds before, as one link of each node to its class.
            links = found if links is None else found.unionByName(links)
            classes = materialize(contract(links), "classes")
            links = classes.where("id != root").select(F.col("id").alias("u"), F.col("root").alias("v"))
        round_ += 1
    of = copies if classes is None else copies.join(classes.select(F.col("id").alias("of"), "root"), "of", "left").select(
        "page_id", F.coalesce("root", "of").alias("of"))
    return corpus.select("page_id").join(of, "page_id", "left").select("page_id", F.coalesce("of", "page_id").alias("class_id"))
