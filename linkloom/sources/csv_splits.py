"""Quoted CSV with line feeds inside fields, read by many tasks.

A reader that starts in the middle of a file cannot tell whether a line feed ends a record. Quotes come in pairs, so
it is enough to know whether the number of quotes before a place is even. The file is read as lines, in splits; each split
reports the parity of its quotes and (once the parity where it begins is known) its last record start: one row per split.
The prefix XOR of the parities over a file's splits tells how each begins. Lines of one record then meet by
the place of the record's first line; records that are one line long (parity even before and after) stay where they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.plans.materialize import materialize


def record_texts(spark: SparkSession, files: list[str]) -> DataFrame:
    """``(file, block, row, record)``: the records of the files, headers included, with the place of each (``row`` orders a block's)."""
    lines = spark.read.option("lineSep", "\n").text(files).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"), "value")
    odd = (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2
    in_split = Window.partitionBy("file", "block").orderBy("row")
    lines = lines.withColumn("after", F.sum(odd.cast("int")).over(in_split) % 2).withColumn("odd", odd.cast("int"))
    lines = materialize(lines, "csv-lines")
    # One row per split.
    splits = lines.groupBy("file", "block").agg(
        F.max_by("after", "row").alias("parity"),
        F.max(F.when(F.col("after") == F.col("odd"), F.col("row"))).alias("start_even"),
        F.max(F.when(F.col("after") != F.col("odd"), F.col("row"))).alias("start_odd"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("open", F.coalesce(F.sum("parity").over(before) % 2, F.lit(0)))
    # A line begins a record if the quotes before it are even: those of its split (after - odd) and of the splits before.
    own = F.when(F.col("open") == 0, F.col("start_even")).otherwise(F.col("start_odd"))
    place = F.when(own.isNotNull(), F.struct("block", own.alias("row")))
    splits = splits.withColumn("carry", F.last(place, True).over(before)).select("file", "block", "open", "carry")
    rows = lines.join(F.broadcast(splits), ["file", "block"])
    begins = (F.col("after") + F.col("odd") + F.col("open")) % 2 == 0
    ends = (F.col("after") + F.col("open")) % 2 == 0
    whole = rows.where(begins & ends).select("file", "block", "row", F.col("value").alias("record"))
    parts = rows.where(~(begins & ends)).withColumn("start", F.coalesce(
        F.last(F.when(begins, F.struct("block", "row")), True).over(in_split), "carry"))
    joined = parts.groupBy("file", "start").agg(F.array_sort(F.collect_list(F.struct("block", "row", "value"))).alias("lines")).select(
        "file", "start.block", "start.row", F.array_join(F.transform("lines", lambda x: x["value"]), "\n").alias("record"))
    return whole.unionByName(joined)


def read_records(spark: SparkSession, files: list[str], header: list[str], options: dict) -> DataFrame:
    """The files' records as rows of text columns named by ``header``, with ``_file, _block, _row`` (their order). The first record of
    each file is its header; empty lines are no records, as in Spark's reader."""
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(header))])
    records = record_texts(spark, files)
    firsts = records.where("block = 0").groupBy("file").agg(F.min("row").alias("row"), F.lit(0).cast("long").alias("block"))
    body = records.join(F.broadcast(firsts), ["file", "block", "row"], "left_anti")  # one row per file
    text = F.regexp_replace("record", "\r\\z", "")
    body = body.withColumn("record", text).where(F.trim("record") != "")
    parsed = body.withColumn("f", F.from_csv("record", schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), options))
    return parsed.select(*[F.col(f"f.c{i}").alias(name) for i, name in enumerate(header)],
                         F.col("file").alias("_file"), F.col("block").alias("_block"), F.col("row").alias("_row"))
