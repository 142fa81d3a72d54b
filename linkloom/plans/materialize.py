"""Materialize an intermediate table in the shared checkpoint folder.

Parquet under ``spark.checkpoint.dir`` (the cluster's shared folder; tests
get a scratch folder): the write is columnar and compressed, the read-back
has exact statistics for the planner, and the lineage is cut, so a lost
executor recomputes from the table instead of from the raw input. Tables of
one application, with all other scratch folders, live under
``tables/<application id>/``; :func:`cleanup` removes them once the results
have been consumed.
"""

from __future__ import annotations

import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession

from linkloom.session import scratch, scratch_root


def materialize(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = scratch(spark, name)
    t = time.time()
    df.write.mode("overwrite").parquet(path)
    if os.environ.get("LINKLOOM_TRACE"):
        print(f"[materialize] {name}: {time.time() - t:.2f}s", file=sys.stderr, flush=True)
    return spark.read.parquet(path)


def cleanup(spark: SparkSession) -> None:
    """Delete this application's intermediate tables (call after the
    results are written or collected)."""
    root = scratch_root(spark)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(jpath):
        fs.delete(jpath, True)
