"""Linking runs that can be paused, resumed and stopped, and request rows for an external model.

A store is a folder. Each step of a run writes its three tables into a folder of its own: ``suggestions``;
``processed`` (URL of every page done, with links or without); ``events`` (the run's ledger rows ``job_id, ts, event_id,
cmd``). Then it is committed: the marker ``commits/run_id=<run>/step=<n>`` is created exclusively and names that folder.
Of two writers of one step the first to create the marker wins, the other gets :class:`StepTaken`; readers see the
folders that markers name, so a step whole or not at all. What a lost writer left is never read.
"""

from __future__ import annotations

import json
import re
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions.patterns import SUGGESTION_COLUMNS
from linkloom.operators.entities import blank_fill
from linkloom.operators.linking import LinkParams, link_suggestions, prepare_targets, ranked_links
from linkloom.operators.runs import job_state_fold
from linkloom.plans.materialize import materialize


def union_suggestions(*tables: DataFrame) -> DataFrame:
    """Tables with and without the optional ``entity_match`` as one, with the fixed columns."""
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    absent = [F.lit(None).cast("string").alias(c) for c in SUGGESTION_COLUMNS if c not in both.columns]
    return both.select("*", *absent).select(*SUGGESTION_COLUMNS, *[c for c in both.columns if c not in SUGGESTION_COLUMNS])


class StepTaken(RuntimeError):
    """Another writer has committed this step of the run."""


def _files(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def _create_exclusively(spark: SparkSession, path: str, text: str) -> None:
    """A file with this text, or :class:`StepTaken` if there is one of this name.

    On a local file system a finished file is hard-linked to the name, which fails if the name is taken; elsewhere the
    file system's exclusive create decides (an unfinished marker is not JSON, so readers pass over it)."""
    jvm, (fs, target) = spark._jvm, _files(spark, path)
    fs.mkdirs(target.getParent())
    local = fs.getScheme() == "file"
    place = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}") if local else target
    try:
        stream = fs.create(place, False)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()
        if local:
            name, finished = (jvm.java.io.File(x.toUri().getPath()).toPath() for x in (target, place))
            jvm.java.nio.file.Files.createLink(name, finished)
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getName():
            raise StepTaken(path) from e
        raise
    finally:
        if local:
            fs.delete(place, False)


def commits(spark: SparkSession, store: str, run_id: str | None = None) -> list[dict]:
    """Manifests of the committed steps (of one run): ``{"run_id", "step", "folder", "pages"}``, one small file each."""
    fs, root = _files(spark, f"{store}/commits")
    if not fs.exists(root):
        return []
    out = []
    for run in fs.listStatus(root):
        if run_id is not None and run.getPath().getName() != f"run_id={run_id}":
            continue
        for status in fs.listStatus(run.getPath()):
            if not re.fullmatch("step=[0-9]+", status.getPath().getName()):
                continue
            stream = fs.open(status.getPath())
            try:
                text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            try:
                out.append(json.loads(text))
            except ValueError:
                continue  # not finished
    return sorted(out, key=lambda m: (m["run_id"], m["step"]))


def _read(spark: SparkSession, store: str, table: str, schema: str, run_id: str | None = None) -> DataFrame:
    steps = [m for m in commits(spark, store, run_id) if table in m["tables"]]
    columns = f"{schema}, run_id string, step int"
    if not steps:
        return spark.createDataFrame([], columns)
    # The run and step are columns of the rows, so that steps are read as one table.
    return spark.read.schema(columns).parquet(*[f"{store}/{m['folder']}/{table}" for m in steps])


def processed_pages(spark: SparkSession, store: str, run_id: str | None = None) -> DataFrame:
    """``(source_url, run_id, step)`` of every page done (in one run)."""
    return _read(spark, store, "processed", "source_url string", run_id)


def stored_suggestions(spark: SparkSession, store: str, run_id: str | None = None) -> DataFrame:
    """Suggestions of all committed steps (of one run), with ``run_id``."""
    return _read(spark, store, "suggestions", ", ".join(f"{c} string" for c in SUGGESTION_COLUMNS) + ", rank long", run_id).drop("step")


def run_events_of(spark: SparkSession, store: str, run_id: str | None = None) -> DataFrame:
    """The runs' ledger, as W3-W5 read it."""
    return _read(spark, store, "events", "job_id string, ts timestamp_ntz, event_id long, cmd string", run_id).drop("run_id", "step")


SKETCH_BITS = 16  # of a distinct-count sketch: 64 KB at most, relative error about 0.4 %; exact while it holds few


def source_sketch(links: DataFrame) -> DataFrame:
    """One row ``(links, sources)``: the number of links and a mergeable sketch of their sources."""
    return links.agg(F.count(F.lit(1)).alias("links"), F.hll_sketch_agg("source_url", SKETCH_BITS).alias("sources"))


def run_totals(spark: SparkSession, store: str, run_id: str | None = None) -> DataFrame:
    """A4-A6 of the store's (or one run's) committed steps from their sketches, one row per step, without reading a suggestion:
    ``(total_suggestions, pages_with_suggestions, avg_per_page)``. The distinct count is an estimate; ``suggestion_stats`` over
    :func:`stored_suggestions` is the exact one."""
    rows = _read(spark, store, "sketch", "links long, sources binary", run_id)
    totals = rows.agg(F.coalesce(F.sum("links"), F.lit(0)).alias("links"), F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("sources")), F.lit(0)).alias("pages"))
    return totals.select(F.col("links").alias("total_suggestions"), F.col("pages").alias("pages_with_suggestions"),
                         F.coalesce(F.try_divide(F.col("links").cast("double"), F.col("pages")), F.lit(0.0)).alias("avg_per_page"))


def run_status(spark: SparkSession, store: str, run_id: str) -> str | None:
    """W4 over the run's ledger; None for a run that does not exist."""
    row = job_state_fold(run_events_of(spark, store, run_id)).first()
    return row["status"] if row else None


def _commit(spark: SparkSession, store: str, run_id: str, step: int, now: str, cmds: list[str], tables: dict[str, DataFrame], pages: int) -> None:
    """Write a step's tables and its ledger rows, then its marker."""
    folder = f"data/run_id={run_id}/step={step}-{uuid.uuid4().hex[:12]}"
    rows = [(run_id, 4 * step + i, cmd) for i, cmd in enumerate(cmds)]
    events = (spark.createDataFrame(rows, "job_id string, event_id long, cmd string").coalesce(1)
              .select("job_id", F.to_timestamp_ntz(F.lit(now)).alias("ts"), "event_id", "cmd"))
    for name, table in {**tables, "events": events}.items():
        table.select("*", F.lit(run_id).alias("run_id"), F.lit(step).alias("step")).write.parquet(f"{store}/{folder}/{name}")
    manifest = {"run_id": run_id, "step": step, "folder": folder, "pages": pages, "tables": [*tables, "events"]}
    _create_exclusively(spark, f"{store}/commits/run_id={run_id}/step={step}", json.dumps(manifest))


def _remaining(pages: DataFrame, done: DataFrame) -> DataFrame:
    """Pages whose URL is not done; null URLs are equal."""
    done = done.select(F.col("source_url").alias("_done")).distinct()
    return pages.join(done, pages["url"].eqNullSafe(done["_done"]), "left_anti")


def run(pages: DataFrame, store: str, run_id: str, now: str, catalogue: DataFrame | None = None,
        p: LinkParams = LinkParams()) -> int:
    """Link the pages that this run has not processed yet, store the result as its next step, and return how many pages that
    were. ``now`` is the caller's time; ``catalogue`` defaults to ``pages`` and is always whole (C4).

    Each URL is processed once per run, also if it has no links or is null. The run ends ``completed`` when no page of the
    catalogue is left, else ``paused``; an error in linking ends it as ``failed`` and is raised. A run that has completed,
    failed or been stopped does nothing (0 pages): a new ``run_id`` begins anew.
    """
    spark = pages.sparkSession
    status = run_status(spark, store, run_id)
    if status not in (None, "paused"):
        return 0
    catalogue = pages if catalogue is None else catalogue
    step = len(commits(spark, store, run_id))
    cmds = ["create", "start"] if status is None else ["start"]
    left = materialize(_remaining(pages, processed_pages(spark, store, run_id)), "remaining-pages")
    n = left.count()
    now_done = left.select(F.col("url").alias("source_url")).distinct()
    try:
        tables = {}
        if n:
            links = union_suggestions(link_suggestions(left, p, prepared=prepare_targets(catalogue, p)))
            links = materialize(links, "step-suggestions")
            tables = {"suggestions": links, "processed": now_done, "sketch": source_sketch(links)}
    except Exception:
        _commit(spark, store, run_id, step, now, [*cmds, "fail"], {}, 0)
        raise
    over = _remaining(catalogue, processed_pages(spark, store, run_id).select("source_url").unionByName(now_done)).isEmpty()
    if not n and not over and status is not None:
        return 0
    _commit(spark, store, run_id, step, now, [*cmds, "complete" if over else "pause"], tables, n)
    return n


def resume(pages: DataFrame, store: str, run_id: str, now: str, catalogue: DataFrame | None = None,
           p: LinkParams = LinkParams()) -> int:
    """Go on with a paused run. Any other run is left as it is (0 pages)."""
    if run_status(pages.sparkSession, store, run_id) != "paused":
        return 0
    return run(pages, store, run_id, now, catalogue, p)


def stop(spark: SparkSession, store: str, run_id: str, now: str) -> bool:
    """End a paused run for good; whether it was one."""
    if run_status(spark, store, run_id) not in ("running", "paused"):
        return False
    _commit(spark, store, run_id, len(commits(spark, store, run_id)), now, ["stop"], {}, 0)
    return True


def link_requests(corpus: DataFrame, k: int = 5, candidates: int = 10, p: LinkParams = LinkParams()) -> DataFrame:
    """One request row per page for an external model: its fields, its best ``candidates`` targets as
    structs ``(target_url, h1, meta_title, entity_match)`` in rank order, whether there were more, and ``k``.

    The reference repeats the whole catalogue in every request; here a request sees ``candidates`` targets
    (an argument), and ``more_candidates`` says where the list was cut."""
    ranked = ranked_links(corpus, LinkParams(**{**p.__dict__, "k": candidates + 1}))
    fields = blank_fill(corpus).select("page_id", "url", "h1", "meta_title", "content")
    target = fields.select(F.col("page_id").alias("target_id"), "h1", "meta_title")
    item = F.struct("rank", "target_url", "h1", "meta_title",
                    F.concat("origin", F.lit(": "), "gram").alias("entity_match"))
    # At most candidates + 1 rows per source: a bounded collect.
    per = (ranked.join(target, "target_id").groupBy("source_id").agg(F.array_sort(F.collect_list(item)).alias("found"))
           .select("source_id", F.transform(F.slice("found", 1, candidates), lambda x: x.dropFields("rank")).alias("candidates"),
                   (F.size("found") > candidates).alias("more_candidates")))
    out = fields.join(per, F.col("source_id") == F.col("page_id"), "left")
    return out.select(
        F.col("url").alias("source_url"), "h1", "meta_title", "content",
        F.coalesce(F.size("candidates"), F.lit(0)).cast("long").alias("n_candidates"),
        F.coalesce("candidates", F.expr("array()").cast(per.schema["candidates"].dataType)).alias("candidates"),
        F.coalesce("more_candidates", F.lit(False)).alias("more_candidates"), F.lit(k).cast("long").alias("k"))
