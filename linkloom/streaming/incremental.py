"""Pages and run events arriving over time, processed incrementally
with Structured Streaming (file source, ``availableNow`` trigger,
``foreachBatch`` sinks keyed by batch id so a replayed batch overwrites
itself). Stopping a query and starting it again on the same checkpoint is
the pause/resume of the reference: only files not yet committed are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.operators import runs as RU
from linkloom.operators.linking import (LinkParams, PreparedTargets, Sketches, link_suggestions, page_sketches, phrase_df,
                                        prepare_targets, prepared_targets, target_phrases)
from linkloom.operators.stats import corpus_stats
from linkloom.plans.materialize import materialize
from linkloom.session import scratch
from linkloom.sources.files import null_markers
from linkloom.sources.html import corpus_from_html, corpus_with_gaps
from linkloom.sources.tables import read_table


def _run_available(stream_df: DataFrame, fn, ckpt: str, output_mode: str = "append") -> None:
    q = (stream_df.writeStream.outputMode(output_mode).foreachBatch(fn)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()


def _fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


# ------------------------------------------------------------------ T1
def link_stream(spark: SparkSession, pages_dir: str, catalogue: DataFrame, out_dir: str,
                ckpt: str, schema) -> None:
    """Suggestions for newly arrived pages against the full catalogue (C4).
    The catalogue side (measured phrase table, prefixes, shingle sets) is
    built once here; each micro-batch only explodes its own pages. Arriving
    pages need not be in the catalogue: their own shingle sets are added."""
    prepared = prepare_targets(catalogue)

    def process(batch: DataFrame, batch_id: int) -> None:
        corpus = materialize(corpus_from_html(batch), "arrived-pages")  # read several times
        sugg = link_suggestions(corpus, prepared=prepared)
        sugg.write.mode("overwrite").parquet(f"{out_dir}/batch_id={batch_id}")
    stream = spark.readStream.schema(schema).parquet(pages_dir)
    _run_available(stream, process, ckpt)


def _grown(spark: SparkSession, store: str, batch_id: int, p: LinkParams) -> PreparedTargets:
    """The catalogue side as the store has it after ``batch_id``: phrase counts are the sum of the batches' signed deltas."""
    def read(table: str) -> DataFrame:
        return spark.read.parquet(f"{store}/{table}").where(F.col("batch_id") <= batch_id).drop("batch_id")

    counts = read("phrases").groupBy("n", "gram", "h", "h2").agg(F.sum("df").alias("df")).where("df > 0")
    return prepared_targets(read("targets"), materialize(counts, "phrases"), Sketches(read("sketches"), read("pages")), p)


def growing_link_stream(spark: SparkSession, pages_dir: str, store: str, out_dir: str, ckpt: str, schema,
                        p: LinkParams = LinkParams()) -> None:
    """Suggestions for arriving pages against all pages that have arrived so far, the batch's own among them.

    The catalogue is a store that every batch adds to: its pages' topic phrases, a delta of phrase counts, their shingle prefixes
    and texts, each in a folder named by the batch, so a replayed batch overwrites its own. Nothing of earlier batches is
    computed again but the sum of the counts."""
    def process(batch: DataFrame, batch_id: int) -> None:
        corpus = materialize(corpus_from_html(batch), "arrived-pages")
        targets = materialize(target_phrases(corpus, p), "arrived-phrases")
        parts = {"targets": targets, "phrases": phrase_df(targets), "sketches": page_sketches(corpus, p).drop("sh"),
                 "pages": corpus.select("page_id", "content")}
        for name, rows in parts.items():
            rows.write.mode("overwrite").parquet(f"{store}/{name}/batch_id={batch_id}")
        sugg = link_suggestions(corpus, p, prepared=_grown(spark, store, batch_id, p))
        sugg.write.mode("overwrite").parquet(f"{out_dir}/batch_id={batch_id}")
    stream = spark.readStream.schema(schema).parquet(pages_dir)
    _run_available(stream, process, ckpt)


def _two_step_pages(spark: SparkSession, sf_dir: str, run) -> None:
    """Deliver even pages, run; deliver odd pages, run again (a restart)."""
    pages = read_table(spark, sf_dir, "pages")
    in_dir = scratch(spark, "arriving-pages")
    pages.where(F.col("page_id") % 2 == 0).write.mode("append").parquet(in_dir)
    run(in_dir, pages.schema)
    pages.where(F.col("page_id") % 2 == 1).write.mode("append").parquet(in_dir)
    run(in_dir, pages.schema)


def stream_link_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalogue = materialize(corpus_from_html(read_table(spark, sf_dir, "pages")), "catalogue")
    out_dir, ckpt = scratch(spark, "stream-links"), scratch(spark, "stream-links-ckpt")
    _two_step_pages(spark, sf_dir,
                    lambda d, schema: link_stream(spark, d, catalogue, out_dir, ckpt, schema))
    return spark.read.parquet(out_dir).drop("batch_id")


def stream_growing_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1 with a catalogue that begins empty: the links of the second delivery, whose pages see all."""
    out_dir, store, ckpt = (scratch(spark, n) for n in ("grown-links", "grown-catalogue", "grown-ckpt"))
    seen: list[int] = []

    def run(in_dir, schema):
        seen.append(spark.read.parquet(out_dir).agg(F.max("batch_id")).first()[0] if _exists(spark, out_dir) else -1)
        growing_link_stream(spark, in_dir, store, out_dir, ckpt, schema)

    _two_step_pages(spark, sf_dir, run)
    return spark.read.parquet(out_dir).where(F.col("batch_id") > seen[-1]).drop("batch_id")


# ------------------------------------------------------------------ T2
def stream_corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running A1-A3 over arriving pages (streaming aggregate, complete mode)."""
    out_dir, ckpt = scratch(spark, "stream-stats"), scratch(spark, "stream-stats-ckpt")

    def run(in_dir, schema):
        corpus = null_markers(corpus_with_gaps(corpus_from_html(
            spark.readStream.schema(schema).parquet(in_dir))), ["h1", "meta_title", "content"])

        def sink(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(out_dir)
        _run_available(corpus_stats(corpus), sink, ckpt, output_mode="complete")

    _two_step_pages(spark, sf_dir, run)
    return spark.read.parquet(out_dir)


def suggestion_stats_stream(spark: SparkSession, links_dir: str, out_dir: str, ckpt: str, schema) -> None:
    """Running A4-A6 over arriving suggestions, by differences.

    The state is the set of source URLs seen (streaming ``dropDuplicates``); what leaves it in a batch are the batch's new
    sources. They and the number of links that arrived move the totals of the version before, one row; a replayed batch writes its own
    version again."""
    links = spark.readStream.schema(schema).parquet(links_dir)
    arrived = links.select(F.lit(1).alias("links"), F.lit(0).alias("pages"))
    firsts = links.where("source_url IS NOT NULL").select("source_url").dropDuplicates().select(F.lit(0).alias("links"), F.lit(1).alias("pages"))

    def sink(batch: DataFrame, batch_id: int) -> None:
        version = f"v={batch_id:012d}"
        moves = batch.agg(F.coalesce(F.sum("links"), F.lit(0)).alias("links"), F.coalesce(F.sum("pages"), F.lit(0)).alias("pages"))
        before = _latest_version(spark, out_dir, before=version)
        if before:
            moves = moves.unionByName(spark.read.parquet(before)).agg(F.sum("links").alias("links"), F.sum("pages").alias("pages"))
        moves.coalesce(1).write.mode("overwrite").parquet(f"{out_dir}/{version}")
    _run_available(arrived.unionByName(firsts), sink, ckpt)


def running_totals(spark: SparkSession, out_dir: str) -> DataFrame:
    """A4-A6 as of the last batch."""
    latest = _latest_version(spark, out_dir)
    totals = spark.read.parquet(latest) if latest else spark.createDataFrame([(0, 0)], "links long, pages long")
    return totals.select(F.col("links").alias("total_suggestions"), F.col("pages").alias("pages_with_suggestions"),
                         F.coalesce(F.try_divide(F.col("links").cast("double"), F.col("pages")), F.lit(0.0)).alias("avg_per_page"))


def stream_suggestion_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2 for A4-A6: statistics of the suggestions that :func:`stream_link_suggestions` writes."""
    links = stream_link_suggestions(spark, sf_dir)
    in_dir, out_dir, ckpt = (scratch(spark, n) for n in ("arriving-links", "stream-totals", "stream-totals-ckpt"))
    for half in (0, 1):
        links.where(F.pmod(F.xxhash64("source_url"), F.lit(2)) == half).write.mode("append").parquet(in_dir)
        suggestion_stats_stream(spark, in_dir, out_dir, ckpt, links.schema)
    return running_totals(spark, out_dir)


# ------------------------------------------------------------------ T3
KEEP_VERSIONS = 2   # committed versions that stay: the newest and the one a replay starts from
BUCKETS = 64        # of job states, by a hash of the job id; a state folder keeps the number it began with


def _versions(spark: SparkSession, folder: str) -> list[str]:
    """Committed versions, oldest first (a version without ``_SUCCESS`` was never finished)."""
    if not _exists(spark, folder):
        return []
    fs, p = _fs(spark, folder)
    names = sorted(s.getPath().getName() for s in fs.listStatus(p) if s.getPath().getName().startswith("v="))
    return [n for n in names if _exists(spark, f"{folder}/{n}/_SUCCESS")]


def _latest_version(spark: SparkSession, folder: str, before: str | None = None) -> str | None:
    """Newest committed version (optionally older than ``before``)."""
    names = [n for n in _versions(spark, folder) if before is None or n < before]
    return f"{folder}/{names[-1]}" if names else None


def _bucket(job_id, buckets: int):
    return F.pmod(F.xxhash64(job_id.cast("string")), F.lit(buckets)).cast("int")


def state_pointers(spark: SparkSession, state_dir: str, before: str | None = None) -> list[tuple[int, str, int]]:
    """``(bucket, version that holds it, number of buckets)`` of the newest committed state: ``BUCKETS`` rows at most."""
    latest = _latest_version(spark, f"{state_dir}/pointers", before)
    return sorted(map(tuple, spark.read.schema("bucket int, version string, buckets int").parquet(latest).collect())) if latest else []


def _states(spark: SparkSession, state_dir: str, pointers: list[tuple[int, str, int]]) -> DataFrame | None:
    paths = [f"{state_dir}/data/{version}/bucket={bucket}" for bucket, version, _ in pointers]
    return spark.read.parquet(*paths) if paths else None


def job_states(spark: SparkSession, state_dir: str) -> DataFrame | None:
    """The stored state of every job (None: no batch yet), as :func:`RU.present_states` reads it."""
    return _states(spark, state_dir, state_pointers(spark, state_dir))


def job_state_stream(spark: SparkSession, events_dir: str, state_dir: str, ckpt: str, schema) -> None:
    """Keyed upsert of job states over arriving ``(job_id, ts, event_id, cmd)`` rows.

    Each batch's events are folded into one transition map per job (W4's tree reduction) and applied
    to the stored state. The state keeps the last ``(ts, event_id)`` of each job: an event that
    arrives after a later one of its job was applied is late; it changes nothing and is counted.

    States lie in hash buckets. A batch reads and writes only the buckets of its jobs, as ``data/v=<batch>/bucket=<n>``, and then
    commits ``pointers/v=<batch>``: for every bucket the version that holds it."""
    def process(batch: DataFrame, batch_id: int) -> None:
        version = f"v={batch_id:012d}"
        # A replayed batch recomputes from the pointers before it and
        # overwrites its own version: idempotent.
        pointers = state_pointers(spark, state_dir, before=version)
        buckets = pointers[0][2] if pointers else BUCKETS
        events = materialize(batch, "state-events")
        touched = {r[0] for r in events.select(_bucket(F.col("job_id"), buckets)).distinct().collect()}  # BUCKETS rows at most
        if not touched and pointers:
            return
        new = RU.apply_events(events, _states(spark, state_dir, [p for p in pointers if p[0] in touched]))
        new.withColumn("bucket", _bucket(F.col("job_id"), buckets)).repartition("bucket").write.mode("overwrite").partitionBy(
            "bucket").parquet(f"{state_dir}/data/{version}")
        now = [p for p in pointers if p[0] not in touched] + [(b, version, buckets) for b in sorted(touched)]
        spark.createDataFrame(now, "bucket int, version string, buckets int").coalesce(1).write.mode("overwrite").parquet(
            f"{state_dir}/pointers/{version}")
        _expire(spark, state_dir, version)
    stream = spark.readStream.schema(schema).parquet(events_dir)
    _run_available(stream, process, ckpt)


def _expire(spark: SparkSession, state_dir: str, version: str) -> None:
    """Drop old pointers, and versions of the data that no kept pointer names."""
    names = [n for n in _versions(spark, f"{state_dir}/pointers") if n <= version]
    for old in names[:-KEEP_VERSIONS]:
        fs, p = _fs(spark, f"{state_dir}/pointers/{old}")
        fs.delete(p, True)
    used = {(b, v) for n in names[-KEEP_VERSIONS:] for b, v, _ in map(tuple, spark.read.parquet(f"{state_dir}/pointers/{n}").select(
        "bucket", "version", "buckets").collect())}
    fs, root = _fs(spark, f"{state_dir}/data")
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if name > version:
            continue
        held = [x.getPath() for x in fs.listStatus(status.getPath()) if x.getPath().getName().startswith("bucket=")]
        gone = [x for x in held if (int(x.getName().removeprefix("bucket=")), name) not in used]
        for path in [status.getPath()] if len(gone) == len(held) else gone:
            fs.delete(path, True)


def stream_job_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T3 over the derived ledger; its ``late`` commands arrive in the second delivery, too late."""
    from linkloom.plans.fixtures import late_events, run_events
    events, late = run_events(spark, sf_dir), late_events(spark, sf_dir)
    in_dir, state_dir, ckpt = (scratch(spark, n) for n in ("arriving-events", "job-state", "job-state-ckpt"))
    events.write.mode("append").parquet(in_dir)
    job_state_stream(spark, in_dir, state_dir, ckpt, events.schema)
    late.select(*events.columns).write.mode("append").parquet(in_dir)
    job_state_stream(spark, in_dir, state_dir, ckpt, events.schema)
    return RU.present_states(job_states(spark, state_dir), late=True)
