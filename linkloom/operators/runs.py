"""The job ledger as a run-event table.

The reference keeps one mutable JSON file per job. Here a job's history is
an append-only event table ``(job_id, ts, event_id, cmd)`` and every state is
derived from it.

W4 (the job state machine) is a fold: a rejected command leaves the state
unchanged, so it cannot be a ``lag``. A fold over an unbounded event list
would put a hot job into one task, so it is computed as a tree reduction
over *transition functions*: each event maps every state to a next state
(plus whether the command was accepted). Such maps compose associatively;
events are numbered by the scalable ordinal (W1), grouped into blocks of at
most ``block`` consecutive events of one job, each block composed in order,
and the blocks composed again level by level. No group ever holds more than
``block`` items, whatever the skew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.functions import patterns as P
from linkloom.operators.ordinal import with_ordinal
from linkloom.operators.stats import progress_ratio
from linkloom.plans.materialize import materialize

# --- fixed values: states (index 0 = job not created yet) ---
STATES = ["none"] + P.JOB_STATUSES      # none queued running paused completed failed stopped
_S = {s: i for i, s in enumerate(STATES)}
# --- fixed values: accepted transitions (from-state -> to-state per command) ---
TRANSITIONS = {
    "create": {"none": "queued"},
    "start": {"queued": "running", "paused": "running"},
    "pause": {"running": "paused"},
    "complete": {"running": "completed"},
    "stop": {"running": "stopped", "paused": "stopped"},
    "fail": {"queued": "failed", "running": "failed", "paused": "failed"},
}
N_STATES = len(STATES)


# Next state of each command (row) in each state (column); other commands change nothing.
COMMANDS = list(TRANSITIONS)
_NEXT = [[_S[TRANSITIONS[c].get(s, s)] for s in STATES] for c in COMMANDS]


def _code(cmd):
    """Row of the transition table for a command column (NULL for an unknown command)."""
    out = F.lit(None).cast("int")
    for i, c in enumerate(COMMANDS):
        out = F.when(cmd == F.lit(c), F.lit(i)).otherwise(out)
    return out


def _next(code, state):
    """State after the command ``code`` in ``state`` (both integer columns)."""
    table = F.array(*[F.array(*[F.lit(x) for x in row]) for row in _NEXT])
    return F.when(code.isNull(), state).otherwise(F.element_at(F.element_at(table, code + 1), state + 1))


def _identity():
    return F.struct(F.array(*[F.lit(i) for i in range(N_STATES)]).alias("nx"),
                    F.array(*[F.lit(0) for _ in range(N_STATES)]).alias("acc"))


def _then(f, g):
    """Apply ``f`` then ``g``."""
    idx = F.sequence(F.lit(0), F.lit(N_STATES - 1))
    mid = lambda s: F.element_at(f["nx"], s + 1)
    return F.struct(
        F.transform(idx, lambda s: F.element_at(g["nx"], mid(s) + 1)).alias("nx"),
        F.transform(idx, lambda s: F.element_at(f["acc"], s + 1)
                    + F.element_at(g["acc"], mid(s) + 1)).alias("acc"))


def _then_command(f, code):
    """Apply ``f`` then one command; every accepted command changes the state."""
    idx = F.sequence(F.lit(0), F.lit(N_STATES - 1))
    now = lambda s: F.element_at(f["nx"], s + 1)
    return F.struct(
        F.transform(idx, lambda s: _next(code, now(s))).alias("nx"),
        F.transform(idx, lambda s: F.element_at(f["acc"], s + 1)
                    + (_next(code, now(s)) != now(s)).cast("int")).alias("acc"))


def _blocks(items: DataFrame, block: int, first: bool) -> DataFrame:
    """Items ``(job_id, k, x)`` grouped into blocks of at most ``block`` consecutive ``k`` of a job, each
    composed in order: ``(job_id, b, items, f)``. ``x`` is a command code on the first level, a map above."""
    step = (lambda acc, e: _then_command(acc, e["x"])) if first else (lambda acc, e: _then(acc, e["x"]))
    grouped = (items.withColumn("b", F.floor(F.col("k") / F.lit(block)).cast("long"))
               .groupBy("job_id", "b").agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("items")))
    return grouped.withColumn("f", F.aggregate("items", _identity(), step))


def _commands(run_events: DataFrame) -> DataFrame:
    """Numbered events with the command as one small integer."""
    ev = with_ordinal(run_events.select("job_id", "ts", "event_id", "cmd"), ["job_id", "ts", "event_id"], "k")
    return ev.withColumn("x", _code(F.col("cmd")))


def job_functions(run_events: DataFrame, block: int = 4096) -> DataFrame:
    """Per job, the composed transition map of all its events in
    ``(ts, event_id)`` order: ``(job_id, f, n)``."""
    ev = _commands(run_events)
    n_total = run_events.count()
    counts = ev.groupBy("job_id").agg(F.count(F.lit(1)).alias("n"))
    level, span, first = ev.select("job_id", "k", "x"), 1, True
    while True:
        span *= block
        # Each group holds at most ``block`` consecutive items of one job.
        level = _blocks(level, block, first).select("job_id", F.col("b").alias("k"), F.col("f").alias("x"))
        first = False
        if span > n_total:
            break
    return level.select("job_id", F.col("x").alias("f")).join(counts, "job_id")


def _states_before(items: DataFrame, block: int, first: bool) -> DataFrame:
    """``(job_id, k, s, after)``: the state before and after each item, by scanning its block from the state
    before the block; that comes from the blocks' maps in the same way, one level up."""
    blocks = materialize(_blocks(items, block, first), "run-blocks")
    split = blocks.groupBy("job_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if split.isEmpty():
        start = blocks.withColumn("s0", F.lit(0))
    else:
        above = _states_before(blocks.select("job_id", F.col("b").alias("k"), F.col("f").alias("x")), block, False)
        start = blocks.join(above.select("job_id", F.col("k").alias("b"), F.col("s").alias("s0")), ["job_id", "b"])
    after = ((lambda s, e: _next(e["x"], s)) if first else (lambda s, e: F.element_at(e["x"]["nx"], s + 1)))
    empty = F.array().cast("array<struct<k:bigint,s:int,after:int>>")
    scan = F.aggregate(
        "items", F.struct(F.col("s0").cast("int").alias("s"), empty.alias("out")),
        lambda acc, e: F.struct(after(acc["s"], e).cast("int").alias("s"), F.concat(acc["out"], F.array(F.struct(
            e["k"].alias("k"), acc["s"].alias("s"), after(acc["s"], e).cast("int").alias("after")))).alias("out")),
        lambda acc: acc["out"])
    return start.select("job_id", F.inline(scan))


def status_name(idx):
    name = F.element_at(F.array(*[F.lit(s) for s in STATES]), idx + 1)
    return F.when(name != F.lit("none"), name)


def apply_functions(funcs: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """Run each job's map from its stored state (``job_id, state_idx,
    accepted, n_events``; new jobs start in ``none``)."""
    j = funcs
    if state is not None:
        j = funcs.join(state, "job_id", "full_outer")
    else:
        j = j.withColumn("state_idx", F.lit(0)).withColumn("accepted", F.lit(0).cast("long")) \
             .withColumn("n_events", F.lit(0).cast("long"))
    s0 = F.coalesce(F.col("state_idx"), F.lit(0))
    has_f = F.col("f").isNotNull()
    return j.select(
        "job_id",
        F.when(has_f, F.element_at(F.col("f.nx"), s0 + 1)).otherwise(s0).alias("state_idx"),
        (F.coalesce(F.col("accepted"), F.lit(0))
         + F.when(has_f, F.element_at(F.col("f.acc"), s0 + 1)).otherwise(F.lit(0))).cast("long")
        .alias("accepted"),
        (F.coalesce(F.col("n_events"), F.lit(0)) + F.coalesce(F.col("n"), F.lit(0))).cast("long")
        .alias("n_events"))


def apply_events(events: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """One delivery of events onto the stored state ``(job_id, state_idx, accepted, n_events, late, last)``.

    ``last`` is the greatest ``(ts, event_id)`` applied to the job. An event that is not greater came late:
    it is counted in ``late`` and changes nothing else."""
    order = F.struct("ts", "event_id")
    ev = events.select("job_id", "ts", "event_id", "cmd")
    if state is None:
        arrived = ev.withColumn("is_late", F.lit(False))
    else:
        arrived = ev.join(state.select("job_id", "last"), "job_id", "left").select(
            *ev.columns, F.coalesce(order <= F.col("last"), F.lit(False)).alias("is_late"))
    arrived = materialize(arrived, "arrived-events")
    marks = arrived.groupBy("job_id").agg(F.max(F.when(~F.col("is_late"), order)).alias("now"),
                                          F.sum(F.col("is_late").cast("long")).alias("came_late"))
    old = None if state is None else state.select("job_id", "state_idx", "accepted", "n_events")
    out = apply_functions(job_functions(arrived.where("NOT is_late")), old).join(marks, "job_id", "left")
    if state is None:
        return out.select("job_id", "state_idx", "accepted", "n_events", F.col("came_late").alias("late"),
                          F.col("now").alias("last"))
    kept = state.select("job_id", F.col("late").alias("was_late"), F.col("last").alias("was"))
    return out.join(kept, "job_id", "left").select(
        "job_id", "state_idx", "accepted", "n_events",
        (F.coalesce("was_late", F.lit(0)) + F.coalesce("came_late", F.lit(0))).cast("long").alias("late"),
        F.coalesce("now", "was").alias("last"))


def present_states(state: DataFrame, late: bool = False) -> DataFrame:
    return state.select("job_id", status_name(F.col("state_idx")).alias("status"), "accepted",
                        (F.col("n_events") - F.col("accepted")).alias("ignored"), "n_events", *(["late"] if late else []))


def job_state_fold(run_events: DataFrame, block: int = 4096) -> DataFrame:
    """``(job_id, status, accepted, ignored, n_events)``."""
    return present_states(apply_functions(job_functions(run_events, block)))


def job_latest(run_events: DataFrame) -> DataFrame:
    """Newest event per job by ``(ts, event_id)`` plus first/last times
    (``max_by`` is a partial aggregate: bounded state per job)."""
    order = F.struct("ts", "event_id")
    return run_events.groupBy("job_id").agg(
        F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"),
        F.max_by("event_id", order).alias("last_event_id"),
        F.max_by("cmd", order).alias("last_cmd"),
        F.count(F.lit(1)).alias("n_events"))


def job_status_spans(run_events: DataFrame, block: int = 64) -> DataFrame:
    """Every change of status with the status before it and the time until the next change:
    ``(job_id, event_id, prev_status, status, micros_in_status)``; a rejected command ends nothing.

    States come from a block scan (no group holds more than ``block`` items); the next change of the
    same job is the neighbour in an ordinal over the changes, met by an equi-join on a unique key."""
    ev = materialize(_commands(run_events), "run-commands")
    states = _states_before(ev.select("job_id", "k", "x"), block, True).where("s != after")
    changes = ev.select("k", "ts", "event_id").join(states, "k")
    ordered = with_ordinal(changes, ["job_id", "k"], "no")
    following = ordered.select((F.col("no") - 1).alias("no"), F.col("job_id").alias("next_job"), F.col("ts").alias("next_ts"))
    out = ordered.join(following, "no", "left")
    until = F.when(F.col("next_job") == F.col("job_id"), F.timestamp_diff("MICROSECOND", F.col("ts"), F.col("next_ts")))
    return out.select("job_id", "event_id", status_name(F.col("s")).alias("prev_status"),
                      status_name(F.col("after")).alias("status"), until.alias("micros_in_status"))


def jobs_table(run_events: DataFrame) -> DataFrame:
    """Job records: latest record (W3) + folded status (W4) + progress.
    ``total_pages`` = events of the job, ``current_page`` = accepted ones."""
    lat = job_latest(run_events)
    st = job_state_fold(run_events)
    j = lat.join(st.select("job_id", "status", "accepted"), "job_id")
    return j.select(F.col("job_id").cast("string").alias("job_id"), "status",
                    F.col("n_events").alias("total_pages"),
                    F.col("accepted").alias("current_page"),
                    "created_at", "updated_at",
                    progress_ratio(F.col("accepted"), F.col("n_events")).alias("progress"))


def expired_jobs(jobs: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """jobs created strictly before ``as_of - days`` (``as_of`` is a
    parameter, never the clock)."""
    cutoff = F.to_timestamp_ntz(F.lit(as_of)) - F.make_dt_interval(F.lit(days))
    return jobs.where(F.col("created_at") < cutoff).select("job_id", "created_at")


def jobs_in(jobs: DataFrame, statuses: list[str]) -> DataFrame:
    """jobs in a state group (``ACTIVE_STATUSES`` / ``TERMINAL_STATUSES``)."""
    return jobs.where(F.col("status").isin(statuses)).select("job_id", "status")


def job_listing(jobs: DataFrame) -> DataFrame:
    """O1: newest first with a display time; ``list_pos`` comes from the
    range-partitioned ordinal, not a single-task window."""
    shown = F.replace(F.left(F.col("created_at").cast("string"), F.lit(19)), F.lit("T"), F.lit(" "))
    ordered = with_ordinal(jobs.select("job_id", "status", "created_at"),
                           [F.col("created_at").desc(), F.col("job_id").asc()], "list_pos")
    return ordered.select("list_pos", "job_id", "status", shown.alias("created"))
