"""CSV / JSON / Parquet readers and writers."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.functions import patterns as P
from linkloom.sources.csv_splits import read_records

SUGGESTION_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in P.SUGGESTION_COLUMNS])

JOB_SCHEMA = T.StructType([
    T.StructField("job_id", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("total_pages", T.LongType()),
    T.StructField("current_page", T.LongType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("updated_at", T.StringType()),
    T.StructField("config", T.MapType(T.StringType(), T.StringType())),
    T.StructField("error", T.StringType()),
    T.StructField("_corrupt_record", T.StringType()),
])

# CSV options that reproduce pandas' quoting: RFC-4180 doubled quotes, no
# whitespace trimming, '' written as an empty field.
_CSV_WRITE = {"header": "true", "quote": '"', "escape": '"', "quoteAll": "false",
              "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
              "emptyValue": "", "nullValue": "", "encoding": "UTF-8"}
_CSV_READ = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"',
             "inferSchema": "false", "ignoreLeadingWhiteSpace": "false",
             "ignoreTrailingWhiteSpace": "false", "mode": "PERMISSIVE"}


class MissingColumnsError(ValueError):
    def __init__(self, missing: list[str]):
        super().__init__("Missing required columns: " + ", ".join(missing))
        self.missing = missing


def missing_columns(df: DataFrame, required=P.CORPUS_HEADERS) -> list[str]:
    """Required columns absent from ``df``, in required order."""
    have = set(df.columns)
    return [c for c in required if c not in have]


def null_markers(df: DataFrame, cols: list[str]) -> DataFrame:
    """S3: pandas' default missing-value markers -> NULL (Spark's CSV reader
    takes a single ``nullValue``)."""
    return df.select(*[F.when(~F.col(c).isin(P.NULL_MARKERS), F.col(c)).alias(c) if c in cols
                       else F.col(c) for c in df.columns])


def _header_groups(spark: SparkSession, path: str) -> list[tuple[tuple[str, ...], list[str]]]:
    """The files under ``path`` (a file, folder or glob) by header line. Only first lines are read."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    groups: dict[tuple[str, ...], list[str]] = {}
    todo = list(fs.globStatus(root) or [])
    if not todo:
        raise FileNotFoundError(path)
    while todo:
        status = todo.pop()
        name = status.getPath().getName()
        if name.startswith(("_", ".")) and not status.getPath().equals(root):
            continue
        if status.isDirectory():
            todo += list(fs.listStatus(status.getPath()))
        elif status.getLen():
            stream = fs.open(status.getPath())
            try:
                line = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8")).readLine() or ""
            finally:
                stream.close()
            header = tuple(next(csv.reader([line.removeprefix("\ufeff")]), []))
            groups.setdefault(header, []).append(status.getPath().toString())
    return sorted((h, sorted(files)) for h, files in groups.items())


def read_corpus(spark: SparkSession, path: str, page_numbers: bool = False, multi_line: bool = True,
                splits: bool = False) -> DataFrame:
    """Read page CSVs (columns by name, any order, extra columns
    allowed, everything text), check the four required columns, map missing
    markers to NULL. Returns ``(url, h1, meta_title, content)`` plus the
    files' other columns.

    The files of a folder may order their columns differently: files with one
    header are read together, by that header, and the groups are united by name.
    ``multi_line=False`` reads files without line feeds inside a field in splits; ``splits=True`` reads files with them in
    splits too, if their quotes are paired (as every CSV writer here and the reference's writes them: a field
    that holds a quote is quoted, its quotes doubled). The default reads each file in one task and takes stray quotes as they are.

    ``page_numbers=True`` adds ``page_no``: 1-based position in input order
    (files by path, rows in file order): a per-partition row id orders the rows of one file (of one split); the W1
    ordinal then numbers them without a single-task window."""
    names = dict(zip(P.CORPUS_HEADERS, ["url", "h1", "meta_title", "content"]))
    options = _CSV_READ | {"multiLine": str(multi_line or page_numbers).lower()}
    out = None
    places = ["_file", "_block", "_row"] if page_numbers else []
    for header, files in _header_groups(spark, path):
        if splits:
            raw = read_records(spark, files, list(header), {k: v for k, v in options.items() if k not in ("header", "inferSchema", "multiLine")})
            raw = raw if page_numbers else raw.drop("_file", "_block", "_row")
        else:
            raw = spark.read.options(**options).csv(files)
            if page_numbers:
                raw = raw.select("*", F.col("_metadata.file_path").alias("_file"), F.lit(0).cast("long").alias("_block"),
                                 F.monotonically_increasing_id().alias("_row"))
        if "Content (First 500 chars)" in raw.columns and "Content" not in raw.columns:
            raw = raw.withColumnRenamed("Content (First 500 chars)", "Content")
        missing = missing_columns(raw)
        if missing:
            raise MissingColumnsError(missing)
        part = raw.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in raw.columns])
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise MissingColumnsError(list(P.CORPUS_HEADERS))
    out = null_markers(out, list(names.values()))
    if page_numbers:
        from linkloom.operators.ordinal import with_ordinal
        out = with_ordinal(out, places, "page_no").drop(*places)
    return out


def write_corpus(df: DataFrame, path: str, single_file: bool = False, headers: list[str] | None = None) -> None:
    """K2: corpus -> CSV with the reference's headers (``headers``: the same in another order)."""
    columns = dict(zip(P.CORPUS_HEADERS, ["url", "h1", "meta_title", "content"]))
    out = df.select(*[F.col(columns[h]).alias(h) for h in headers or P.CORPUS_HEADERS])
    if single_file:
        out = out.coalesce(1)
    out.write.mode("overwrite").options(**_CSV_WRITE).csv(path)


def write_suggestions(df: DataFrame, path: str, single_file: bool = False) -> None:
    """K1: suggestion table -> UTF-8 CSV with header; all four columns are
    always written (an empty table keeps its header on read-back)."""
    out = df.select(*[F.col(c).cast("string").alias(h)
                      for c, h in zip(P.SUGGESTION_COLUMNS, P.SUGGESTION_HEADERS)])
    if single_file:
        out = out.coalesce(1)
    out.write.mode("overwrite").options(**_CSV_WRITE).csv(path)


def read_suggestions(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Stored suggestions; a missing path gives an empty table with the
    fixed schema."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(jvm_path):
        return spark.createDataFrame([], SUGGESTION_SCHEMA)
    if fmt == "csv":
        schema = T.StructType([T.StructField(h, T.StringType()) for h in P.SUGGESTION_HEADERS])
        raw = spark.read.options(**_CSV_READ).schema(schema).option("enforceSchema", "false").csv(path)
        return raw.select(*[F.col(f"`{h}`").alias(c)
                            for c, h in zip(P.SUGGESTION_COLUMNS, P.SUGGESTION_HEADERS)])
    return spark.read.schema(SUGGESTION_SCHEMA).parquet(path)


def append_results(df: DataFrame, run_id: str, path: str) -> None:
    """K3: append one run's rows, partitioned by ``run_id`` (linear I/O;
    the reference rewrites the whole file after every page). Idempotent per
    ``(run_id, source_url)``: sources that the run has stored are left as they are."""
    spark = df.sparkSession
    own = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/run_id={run_id}")
    if own.getFileSystem(spark._jsc.hadoopConfiguration()).exists(own):
        stored = spark.read.parquet(own.toString()).select("source_url").distinct()
        df = df.join(stored, "source_url", "left_anti")
    df.write.mode("append").parquet(f"{path}/run_id={run_id}")


def write_job_records(jobs: DataFrame, path: str) -> None:
    """Job records as JSON lines (``config`` as a map; secrets are never
    written)."""
    cols = [f.name for f in JOB_SCHEMA.fields if f.name != "_corrupt_record"]
    out = jobs.select(*[F.col(c) if c in jobs.columns else F.lit(None).cast(
        JOB_SCHEMA[c].dataType).alias(c) for c in cols])
    if "config" in jobs.columns:
        out = out.withColumn("config", F.map_filter("config", lambda k, v: k != F.lit("api_key")))
    out.write.mode("overwrite").json(path)


def read_job_records(spark: SparkSession, path: str) -> DataFrame:
    """Job records from a folder of ``*.json`` files. Empty files give
    no rows, unreadable records are dropped, ``.tmp`` files are ignored and
    ``config.api_key`` is removed. Files may hold JSON lines (as
    :func:`write_job_records` writes them) or one indented document each (the
    reference's own layout): a file without a readable line is read whole."""
    def read(multi_line: bool) -> DataFrame:
        df = (spark.read.schema(JOB_SCHEMA).option("mode", "PERMISSIVE").option("multiLine", str(multi_line).lower())
              .option("columnNameOfCorruptRecord", "_corrupt_record").option("pathGlobFilter", "*.json").json(path))
        df = df.select("*", F.col("_metadata.file_path").alias("_file"))
        return df.where(F.col("_corrupt_record").isNull() & F.col("job_id").isNotNull()).drop("_corrupt_record")

    lines = read(False)
    whole = read(True).join(lines.select("_file").distinct(), "_file", "left_anti")
    return lines.unionByName(whole).drop("_file").withColumn(
        "config", F.map_filter("config", lambda k, v: k != F.lit("api_key")))
