"""Every registered query: name -> (spark, sf_dir) -> DataFrame.

Each reads the driver tables (or tables Spark derives from them) in full.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions import patterns as P
from linkloom.functions.text import word_count
from linkloom.operators import audit as AU
from linkloom.operators import entities as E
from linkloom.operators import link_classes as LC
from linkloom.operators import linking as L
from linkloom.operators import responses as R
from linkloom.operators import runs as RU
from linkloom.operators import stats as ST
from linkloom.operators.duplicate_classes import duplicate_classes
from linkloom.operators.ordinal import with_ordinal
from linkloom.operators.relevance import suggestions_with_relevance
from linkloom.plans import fixtures as FX
from linkloom.plans.linking_run import link_requests, resume, run, run_totals, stored_suggestions
from linkloom.session import scratch
from linkloom.sources import files as FI
from linkloom.sources.html import corpus_from_html

AS_OF = "2024-01-31 00:00:00"   # F2 reference time (a parameter, never the clock)
TOP_K = 3                        # L10 demo cap (L11 uses the default 5)
REQUEST_CANDIDATES = 10          # P8 candidates per request


# ------------------------------------------------------------------ sources
def q_corpus_from_html(spark, sf):
    return corpus_from_html(FX.page_variants(spark, sf))


def q_corpus_scan(spark, sf):
    """One folder whose files order their columns differently, read in splits."""
    path = scratch(spark, "corpus-csv")
    pages = FX.corpus_gaps(spark, sf)
    FI.write_corpus(pages.where("page_id % 2 = 0"), f"{path}/a")
    FI.write_corpus(pages.where("page_id % 2 = 1"), f"{path}/b", headers=["Content", "Meta Title", "H1", "URL"])
    return FI.read_corpus(spark, path, splits=True).select("url", "h1", "meta_title", "content")


def q_null_markers(spark, sf):
    return FI.null_markers(FX.corpus_gaps(spark, sf), ["h1", "meta_title"]).select(
        "page_id", "h1", "meta_title")


def q_suggestions_reload(spark, sf):
    path = scratch(spark, "suggestions-csv")
    FI.write_suggestions(L.link_suggestions(FX.corpus(spark, sf)), path)
    return FI.read_suggestions(spark, path)


def _resumed_run(spark, sf):
    """The store of a run over the first half of the pages, resumed over all of them, and resumed again with nothing left."""
    corpus = FX.corpus(spark, sf)
    store = scratch(spark, "run")
    ordered = with_ordinal(corpus.select("page_id"), ["page_id"], "page_no")
    half = ordered.where(F.col("page_no") <= F.lit(corpus.count() // 2)).select("page_id")
    run(corpus.join(half, "page_id", "left_semi"), store, "run1", AS_OF, catalogue=corpus)
    resume(corpus, store, "run1", AS_OF, catalogue=corpus)
    resume(corpus, store, "run1", AS_OF, catalogue=corpus)
    return store


def q_resume_append(spark, sf):
    """K3 + U1/U2 + A8."""
    return stored_suggestions(spark, _resumed_run(spark, sf)).drop("run_id")


def q_run_totals(spark, sf):
    """A4-A6 from the mergeable sketches of the run's steps."""
    return run_totals(spark, _resumed_run(spark, sf))


def q_job_records(spark, sf):
    path = scratch(spark, "jobs")
    jobs = RU.jobs_table(FX.run_events(spark, sf)).select(
        "job_id", "status", "total_pages", "current_page",
        F.col("created_at").cast("string").alias("created_at"),
        F.col("updated_at").cast("string").alias("updated_at"),
        F.create_map(F.lit("max_suggestions_per_page"), F.lit("5"),
                     F.lit("api_key"), F.lit("secret")).alias("config"))
    FI.write_job_records(jobs, path)
    return FI.read_job_records(spark, path).select("job_id", "status", "total_pages",
                                                   "current_page")


# --------------------------------------------------------- projections (P)
def q_blank_fill(spark, sf):
    return E.blank_fill(FX.corpus_read(spark, sf)).select("page_id", "h1", "meta_title", "content")


def q_url_entity(spark, sf):
    c = FX.corpus_read(spark, sf)
    return c.select("page_id", E.url_entity(F.col("url")).alias("entity")).where("entity IS NOT NULL")


def q_h1_entity(spark, sf):
    c = E.blank_fill(FX.corpus_read(spark, sf))
    return c.select("page_id", E.h1_entity(F.col("h1")).alias("entity")).where("entity IS NOT NULL")


def q_title_entity(spark, sf):
    c = E.blank_fill(FX.corpus_read(spark, sf))
    return c.select("page_id", E.title_entity(F.col("meta_title")).alias("entity")) \
            .where("entity IS NOT NULL")


def q_entity_list(spark, sf):
    return E.entity_lists(FX.corpus_read(spark, sf))


def q_entity_rows(spark, sf):
    return E.entity_rows(FX.corpus_read(spark, sf)).select(
        "page_id", F.col("pos").cast("long").alias("pos"), "origin", "entity")


def _catalogue(spark, sf):
    c = E.blank_fill(FX.corpus_read(spark, sf), cols=("h1", "meta_title"))
    return with_ordinal(c.select("page_id", "url", "h1", "meta_title"), ["page_id"], "page_no")


def q_catalogue_rows(spark, sf):
    return _catalogue(spark, sf).select("page_no", "url", "h1", "meta_title")


def q_catalogue_blocks(spark, sf):
    return E.catalogue_blocks(_catalogue(spark, sf))


def q_link_requests(spark, sf):
    r = link_requests(FX.corpus(spark, sf), candidates=REQUEST_CANDIDATES)
    lines = F.transform("candidates", lambda c: F.concat_ws(" | ", c["target_url"], c["h1"], c["meta_title"]))
    return r.withColumn("candidates", F.array_join(lines, "\n"))


def q_content_head_words(spark, sf):
    d = FX.documents(spark, sf)
    return d.select("doc_id", E.content_head_words(F.col("text")).alias("head"))


def q_content_head_chars(spark, sf):
    d = FX.documents(spark, sf)
    return d.select("doc_id", E.content_head_chars(F.col("text")).alias("head"))


def _ordered_pages(spark, sf):
    c = FX.pages_corpus(spark, sf).select("page_id", "url")
    o = with_ordinal(c, ["page_id"], "page_no")
    return o.withColumn("total_pages", F.lit(c.count()).cast("long"))


def q_remaining_pages(spark, sf):
    """pages after a checkpoint at half of the run."""
    o = _ordered_pages(spark, sf)
    return o.where(F.col("page_no") > F.floor(F.col("total_pages") / 2)).select("page_no", "url")


def q_progress_series(spark, sf):
    """Progress reported while resuming from that checkpoint."""
    c = FX.pages_corpus(spark, sf).select("page_id")
    total = c.count()
    return ST.progress_series(with_ordinal(c, ["page_id"], "page_no"), total // 2, total)


def _jobs(spark, sf):
    return RU.jobs_table(FX.run_events(spark, sf))


def q_expired_jobs(spark, sf):
    return RU.expired_jobs(_jobs(spark, sf), AS_OF, 7)


def q_active_jobs(spark, sf):
    return RU.jobs_in(_jobs(spark, sf), P.ACTIVE_STATUSES)


def q_terminal_jobs(spark, sf):
    return RU.jobs_in(_jobs(spark, sf), P.TERMINAL_STATUSES)


# ------------------------------------------------------------ responses (R)
def _responses(spark, sf):
    return FX.responses(spark, sf)


def q_response_parse(spark, sf):
    p = R.parse_responses(_responses(spark, sf))
    return p.select("source_url", "response_no", "parse_status",
                    F.array_size(F.try_variant_get(F.col("root"), "$", "array<variant>"))
                     .cast("long").alias("n_items"))


def q_response_items(spark, sf):
    items = R.response_items(R.parse_responses(_responses(spark, sf)), ["source_url", "response_no"])
    return items.select("source_url", "response_no", F.col("pos").cast("long").alias("pos"))


def q_response_suggestions(spark, sf):
    return R.response_suggestions(_responses(spark, sf), keep=("response_no",))


def q_response_outcomes(spark, sf):
    return R.response_outcomes(_responses(spark, sf))


# -------------------------------------------------------------- linking (L)
def q_phrase_links(spark, sf):
    """L1: every topic phrase of every page's text, once per page."""
    corpus = FX.corpus(spark, sf)
    p = L.LinkParams(near_duplicates=False)
    m = L.source_phrases(corpus, L.prepare_targets(corpus, p), p)
    return m.select("source_id", F.col("n").cast("long").alias("n"), "gram",
                    F.col("df").cast("long").alias("df"), F.col("pos").cast("long").alias("start_pos"))


def q_one_link_per_target(spark, sf):
    p = L.all_pairs(FX.corpus(spark, sf), columns=["source_id", "target_id", "n", "df", "pos", "gram"])
    return p.select("source_id", "target_id", F.col("n").cast("long").alias("n"),
                    F.col("df").cast("long").alias("df"),
                    F.col("pos").cast("long").alias("start_pos"), "gram")


def q_near_duplicate_pairs(spark, sf):
    return L.all_near_duplicates(FX.corpus(spark, sf))


def q_link_priority(spark, sf):
    p = L.all_pairs(FX.corpus(spark, sf), columns=["source_id", "target_id", "s_silo", "s_depth", "t_silo", "t_depth"])
    return p.select("source_id", "target_id",
                    L.priority(F.col("s_silo"), F.col("s_depth"), F.col("t_silo"), F.col("t_depth"))
                     .cast("long").alias("priority"))


def q_link_classes(spark, sf):
    """L5/L7 factorised: links of each source by phrase and priority, linear in the pages."""
    c = LC.link_classes(FX.corpus(spark, sf))
    return c.select("source_id", "gram", *[F.col(x).cast("long").alias(y) for x, y in (
        ("n", "n"), ("df", "df"), ("pos", "start_pos"), ("priority", "priority"), ("links", "links"))])


def q_link_class_members(spark, sf):
    """The pages that the classes stand for."""
    m = LC.class_members(L.prepare_targets(FX.corpus(spark, sf), L.LinkParams(near_duplicates=False)))
    return m.select("gram", F.col("n").cast("long").alias("n"), "target_id", "t_silo",
                    F.col("t_depth").cast("long").alias("t_depth"), "origin")


def q_duplicate_classes(spark, sf):
    """L6 for all pages: the class of each page under near-duplicate links."""
    return duplicate_classes(FX.corpus(spark, sf))


def q_top_k_links(spark, sf):
    r = L.ranked_links(FX.corpus(spark, sf), L.LinkParams(k=TOP_K))
    return r.select("source_id", "target_id", F.col("rank").cast("long").alias("rank"))


def q_link_run_summary(spark, sf):
    return L.run_summary(FX.corpus(spark, sf))


def q_link_suggestions(spark, sf):
    return L.link_suggestions(FX.corpus(spark, sf))


def q_topic_relevance(spark, sf):
    return suggestions_with_relevance(FX.corpus(spark, sf))


def _fixture_sugg(spark, sf):
    return FX.suggestions(spark, sf)


def q_unknown_targets(spark, sf):
    return AU.unknown_targets(_fixture_sugg(spark, sf), FX.corpus(spark, sf)).select(
        "source_url", "anchor_text", "target_url", F.col("seq").cast("long").alias("seq"))


def q_self_links(spark, sf):
    return AU.self_links(_fixture_sugg(spark, sf)).select(
        "source_url", "anchor_text", "target_url", F.col("seq").cast("long").alias("seq"))


def q_anchor_verbatim(spark, sf):
    a = AU.suggestion_audit(_fixture_sugg(spark, sf), FX.corpus(spark, sf))
    return a.select("source_url", "anchor_text", "target_url", "seq",
                    (~F.col("not_verbatim")).alias("anchor_verbatim"))


def q_anchor_length(spark, sf):
    s = _fixture_sugg(spark, sf)
    return s.select("source_url", "anchor_text", F.col("seq").cast("long").alias("seq"),
                    word_count(F.col("anchor_text")).cast("long").alias("n_words"),
                    AU.anchor_length_ok(F.col("anchor_text")).alias("length_ok"))


def q_suggestion_audit(spark, sf):
    return AU.suggestion_audit(_fixture_sugg(spark, sf), FX.corpus(spark, sf))


def q_audit_totals(spark, sf):
    return AU.audit_totals(AU.suggestion_audit(_fixture_sugg(spark, sf), FX.corpus(spark, sf)))


def q_link_audit_totals(spark, sf):
    """Contract check on the flagship output: every rule total is zero."""
    corpus = FX.corpus(spark, sf)
    return AU.audit_totals(AU.suggestion_audit(L.link_suggestions(corpus), corpus, order_col="rank"))


# ---------------------------------------------------------- aggregates (A)
def q_corpus_stats(spark, sf):
    return ST.corpus_stats(FX.corpus_read(spark, sf))


def q_suggestion_stats(spark, sf):
    return ST.suggestion_stats(L.link_suggestions(FX.corpus(spark, sf)))


def q_job_progress(spark, sf):
    return _jobs(spark, sf).select("job_id", "current_page", "total_pages", "progress")


# ---------------------------------------------------- windows / sorts (W, O)
def q_page_ordinal(spark, sf):
    return with_ordinal(FX.pages_corpus(spark, sf).select("page_id"), ["page_id"], "page_no")


def q_job_latest(spark, sf):
    return RU.job_latest(FX.run_events(spark, sf))


def q_job_state_fold(spark, sf):
    return RU.job_state_fold(FX.run_events(spark, sf))


def q_job_status_spans(spark, sf):
    return RU.job_status_spans(FX.run_events(spark, sf))


def q_job_listing(spark, sf):
    return RU.job_listing(_jobs(spark, sf))


def q_corpus_preview(spark, sf):
    """O2: first 10 pages in page order (a top-k report: the limit is the
    feature; Spark plans it as TakeOrderedAndProject)."""
    c = E.blank_fill(FX.corpus_read(spark, sf), cols=("h1", "meta_title"))
    top = c.orderBy("page_id").limit(10)
    return with_ordinal(top.select("page_id", "url", "h1", "meta_title"), ["page_id"], "page_no") \
        .select("page_no", "url", "h1", "meta_title")


def q_suggestion_preview(spark, sf):
    s = L.link_suggestions(FX.corpus(spark, sf))
    top = s.orderBy("source_url", "rank").limit(20)
    return with_ordinal(top, ["source_url", "rank"], "preview_pos")


def _streaming():
    from linkloom.streaming import incremental as T
    return T


def q_stream_link_suggestions(spark, sf):
    return _streaming().stream_link_suggestions(spark, sf)


def q_stream_growing_links(spark, sf):
    return _streaming().stream_growing_links(spark, sf)


def q_stream_corpus_stats(spark, sf):
    return _streaming().stream_corpus_stats(spark, sf)


def q_stream_suggestion_stats(spark, sf):
    return _streaming().stream_suggestion_stats(spark, sf)


def q_stream_job_state(spark, sf):
    return _streaming().stream_job_state(spark, sf)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name[2:]: fn for name, fn in sorted(globals().items())
    if name.startswith("q_") and callable(fn)
}
