"""Reference-shaped tables derived from the driver tables with Spark.

Each has a twin CTE in ``sql_oracle`` built from the same rule. All are
deterministic functions of ``page_id`` / ``event_id``; nothing is sampled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions.text import normalize_token
from linkloom.operators.ordinal import with_ordinal
from linkloom.plans.materialize import materialize
from linkloom.sources.files import null_markers
from linkloom.sources.html import corpus_from_html, corpus_with_gaps
from linkloom.sources.tables import read_table


def pages_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages -> corpus, lazily: a query that reads headings never touches the text."""
    return corpus_from_html(read_table(spark, sf_dir, "pages"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus written to the checkpoint folder, for plans that read the text several times
    (the HTML regexes run once)."""
    return materialize(pages_corpus(spark, sf_dir), "corpus")


def page_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with hidden text, a second or nested article, another main element, character references, text
    between articles, a quoted ``>`` and an unclosed article, by ``page_id % 9``."""
    k, html = F.col("page_id") % 9, F.col("html")
    swap = lambda c, *pairs: swap(F.replace(c, F.lit(pairs[0]), F.lit(pairs[1])), *pairs[2:]) if pairs else c
    return read_table(spark, sf_dir, "pages").withColumn("html", (
        F.when(k == 1, swap(html, "</article>", "<script>var hidden = 1 < 2;</script><!-- note --></article>"))
         .when(k == 2, swap(html, "</article>", "</article><article><p>second &#8211; caf&eacute;</p></article>"))
         .when(k == 3, swap(html, "<article", "<main", "</article>", "</main>"))
         .when(k == 4, swap(html, "<article", "<div", "</article>", "</div>"))
         .when(k == 5, swap(html, "</article>", "<article>nested</article> tail &#x2013; &amp;lt; &nosuch;</article>"))
         .when(k == 6, swap(html, "</article>", "</article><nav>menu home login</nav><ARTICLE class='x > y'>two text</ARTICLE >"))
         .when(k == 7, swap(html, "</article>", '<b title="x > y <article>">bold</b> 1 < 2 <i lang="en>open</i></article>'))
         .when(k == 8, swap(html, "</article>", "", "</body>", "</article></article>after</body>"))
         .otherwise(html)))


def corpus_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_with_gaps(pages_corpus(spark, sf_dir))


def corpus_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gapped corpus as the reference's CSV reader would see it."""
    return null_markers(corpus_gaps(spark, sf_dir), ["h1", "meta_title", "content"])


def _words(text, start: int, count: int):
    return F.array_join(F.slice(F.split(text, " "), start, count), " ")


def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A suggestion table with planted rule violations, by ``page_id % 10``:
    1 unknown target, 2 self link, 3 second link to the same target,
    4 one-word anchor, 5 anchor absent from the source, 6 six extra links
    (over the cap of 5). Other pages: one clean link to the next page.
    Columns: ``source_id, source_url, anchor_text, target_url, entity_match,
    seq`` (``seq`` = position in the source's list)."""
    c = corpus(spark, sf_dir).select("page_id", "url", "h1", "content")
    t = c.select(F.col("page_id").alias("t_id"), F.col("url").alias("t_url"),
                 F.col("h1").alias("t_h1"))
    k = F.col("page_id") % 10
    # Each page links to the page with the next larger id (gaps allowed), the last one to the first.
    ordered = with_ordinal(c.select("page_id"), ["page_id"], "no")
    no = ordered.select(F.col("page_id").alias("next_id"), F.col("no").alias("next_no"))
    n = ordered.count()
    following = ordered.join(no, F.col("next_no") == F.col("no") % n + 1).select("page_id", "next_id")
    base = c.join(following, "page_id").join(t, F.col("t_id") == F.col("next_id"))
    first3 = _words(F.col("content"), 1, 3)
    main = base.select(
        F.col("page_id").alias("source_id"), F.col("url").alias("source_url"),
        F.when(k == 4, _words(F.col("content"), 1, 1))
         .when(k == 5, F.lit("zq absent words")).otherwise(first3).alias("anchor_text"),
        F.when(k == 1, F.concat(F.col("t_url"), F.lit("?unknown=1")))
         .when(k == 2, F.col("url")).otherwise(F.col("t_url")).alias("target_url"),
        F.concat(F.lit("h1: "), F.coalesce(F.col("t_h1"), F.lit(""))).alias("entity_match"),
        F.lit(1).alias("seq"))
    dup = base.where(k == 3).select(
        F.col("page_id").alias("source_id"), F.col("url").alias("source_url"),
        _words(F.col("content"), 4, 3).alias("anchor_text"), F.col("t_url").alias("target_url"),
        F.concat(F.lit("h1: "), F.coalesce(F.col("t_h1"), F.lit(""))).alias("entity_match"),
        F.lit(2).alias("seq"))
    extra = (c.where(k == 6)
              .select("page_id", "url", "content", F.explode(F.sequence(F.lit(2), F.lit(7))).alias("off"))
              .join(t, F.col("t_id") == F.col("page_id") + F.col("off"))
              .select(F.col("page_id").alias("source_id"), F.col("url").alias("source_url"),
                      first3.alias("anchor_text"), F.col("t_url").alias("target_url"),
                      F.concat(F.lit("h1: "), F.coalesce(F.col("t_h1"), F.lit(""))).alias("entity_match"),
                      F.col("off").alias("seq")))
    return main.unionByName(dup).unionByName(extra)


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One model-style response text per source page, built from
    :func:`suggestions` by string concatenation (only URLs and normalized
    words go inside the JSON, so no escaping is involved). By
    ``source_id % 5``: 0 plain array; 1 array fenced in prose; 2 array led by
    a scalar and an object without the keys; 3 top-level object; 4 truncated.
    Columns ``source_id, source_url, response_no, response_text``."""
    s = suggestions(spark, sf_dir)
    clean_anchor = F.array_join(
        F.filter(F.transform(F.split(F.col("anchor_text"), " "), normalize_token),
                 lambda w: w != F.lit("")), " ")
    item = F.concat(F.lit('{"anchor_text": "'), clean_anchor, F.lit('", "target_url": "'),
                    F.col("target_url"), F.lit('", "entity_match": "seq '),
                    F.col("seq").cast("string"), F.lit('", "relevance": "r"}'))
    # A source has at most 8 suggestions, so this collect is bounded.
    per_src = (s.select("source_id", "source_url",
                        F.struct("seq", "target_url", "anchor_text", item.alias("item")).alias("e"))
                .groupBy("source_id", "source_url")
                .agg(F.array_join(F.transform(F.array_sort(F.collect_list("e")),
                                              lambda e: e["item"]), ", ").alias("items")))
    k = F.col("source_id") % 5
    items = F.col("items")
    text = (F.when(k == 0, F.concat(F.lit("["), items, F.lit("]")))
             .when(k == 1, F.concat(F.lit("Here are the suggestions:\n```json\n["), items,
                                    F.lit("]\n```\nHope this helps.")))
             .when(k == 2, F.concat(F.lit('[1, {"note": "none"}, '), items, F.lit("]")))
             .when(k == 3, F.concat(F.lit('{"anchor_text": "x y", "target_url": "'),
                                    F.col("source_url"), F.lit('"}')))
             .otherwise(F.concat(F.lit("["), F.left(items, F.floor(F.length(items) / 2).cast("int")))))
    first = per_src.select("source_id", "source_url", F.lit(1).alias("response_no"), text.alias("response_text"))
    # Sources with many suggestions answer twice: the cap of R3 holds for each response.
    second = per_src.where(F.col("source_id") % 10 == 6).select(
        "source_id", "source_url", F.lit(2), F.concat(F.lit("["), items, F.lit("]")))
    return first.union(second)


# --- fixed values: event type -> ledger command ---
EVENT_COMMANDS = {"signup": "create", "view": "start", "click": "pause",
                  "purchase": "complete", "error": "stop"}


# The same by job_id % 5, so that jobs end in every status: 0 and 1 are never completed or stopped,
# 1 may fail, 2 is never started.
EVENT_COMMANDS_BY_JOB = {
    0: {**EVENT_COMMANDS, "purchase": "start", "error": "pause"},
    1: {**EVENT_COMMANDS, "purchase": "start", "error": "fail"},
    2: {"signup": "create", "view": "pause", "click": "pause", "purchase": "pause", "error": "pause"},
}


def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a job ledger: ``(job_id, ts, event_id, cmd)``; jobs with ``job_id % 4 = 1`` begin
    four weeks later than the others."""
    e = read_table(spark, sf_dir, "events")

    def mapped(table):
        cmd = F.lit(None).cast("string")
        for et, c in table.items():
            cmd = F.when(F.col("event_type") == et, F.lit(c)).otherwise(cmd)
        return cmd

    cmd = mapped(EVENT_COMMANDS)
    for k, table in EVENT_COMMANDS_BY_JOB.items():
        cmd = F.when(F.col("user_id") % 5 == k, mapped(table)).otherwise(cmd)
    ts = F.when(F.col("user_id") % 4 == 1, F.col("ts") + F.make_dt_interval(F.lit(28))).otherwise(F.col("ts"))
    return e.select(F.col("user_id").alias("job_id"), ts.alias("ts"), "event_id", cmd.alias("cmd"))


def late_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ``stop`` for every third job, a minute before the job's first event."""
    first = run_events(spark, sf_dir).where(F.col("job_id") % 3 == 0).groupBy("job_id").agg(F.min("ts").alias("first"))
    return first.select("job_id", (F.col("first") - F.make_dt_interval(mins=F.lit(1))).alias("ts"),
                        (F.col("job_id") + 1_000_000_000).alias("event_id"), F.lit("stop").alias("cmd"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


__all__ = ["pages_corpus", "page_variants", "corpus", "corpus_gaps", "corpus_read", "suggestions", "responses",
           "run_events", "late_events", "documents"]
