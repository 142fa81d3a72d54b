"""SparkSession construction shared by tests, bench and the driver entry."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every plan in this package assumes. AQE re-plans joins and
# coalesces/splits shuffle partitions at run time; ANSI stays on (the
# Spark 4 default), so the code uses try_* functions where a value may fail.
# Static size estimates do not grow through explode, so the planner never
# broadcasts on an estimate: broadcasts happen either on an explicit hint
# after measuring the table (linking.measure) or when AQE sees the
# real, materialized size of a shuffle below the runtime threshold.
_BASE_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 << 20),
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "linkloom", extra: dict | None = None) -> SparkSession:
    """Return the active session with the settings the plans rely on, or build one.

    A master or a number of shuffle partitions is set only if the caller (or ``BENCH_CPUS``) names
    it: a ``spark-submit`` session keeps its own. Settings that decide how a plan broadcasts are
    set on a given session too."""
    active = SparkSession.getActiveSession()
    if active is not None:
        require_settings(active)
        ensure_checkpoint_dir(active)
        return active
    cpus = os.environ.get("BENCH_CPUS")
    builder = SparkSession.builder.appName(app_name)
    conf = dict(_BASE_CONF)
    if master or cpus or "SPARK_ENV_LOADED" not in os.environ:
        builder = builder.master(master or f"local[{cpus or 8}]")
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or cpus or 8)
        conf["spark.driver.memory"] = os.environ.get("LINKLOOM_DRIVER_MEMORY", "16g")
    elif shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def require_settings(spark: SparkSession) -> None:
    """No broadcast on an estimate and no local time zone, whoever built the session."""
    for key in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold",
                "spark.sql.adaptive.enabled", "spark.sql.session.timeZone"):
        spark.conf.set(key, _BASE_CONF[key])


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared ``spark.checkpoint.dir``. Where it is unset, a local session gets a
    scratch folder; any other must name a folder that all executors share."""
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="linkloom-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(current)
    return current


def checkpoint_dir(spark: SparkSession) -> str:
    return ensure_checkpoint_dir(spark)


def scratch_root(spark: SparkSession) -> str:
    """This application's folder of intermediate tables, sinks and stream checkpoints."""
    return os.path.join(checkpoint_dir(spark), "tables", spark.sparkContext.applicationId)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under :func:`scratch_root`."""
    return os.path.join(scratch_root(spark), f"{name}-{uuid.uuid4().hex[:12]}")
