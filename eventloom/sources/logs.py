"""Event-log sources and sinks."""

from __future__ import annotations

import csv
import io
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import is_boundary
from .models import csv_records

_PATTERN = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", ".%f": "[.SSSSSS][.SSS]", "T": "'T'"}


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder path on the storage that spark.checkpoint.dir names.

    On a local master, where all work is done in one process, a folder is made where none is named.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="eventloom-")
        sc.setCheckpointDir(root)
    return f"{root.rstrip('/')}/files/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a small table once and read it back, so that what uses it several times does not derive it again."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _files(spark: SparkSession):
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{csv,csv.gz}")


def headers(spark: SparkSession, path: str) -> DataFrame:
    """``file, head``: cells of the header of every CSV file below ``path``; written.

    The first lines come from one job, of the files' first splits.  Where one of them ends inside a quoted
    cell, the first records are read as whole records, a file per task, as such files cannot be split anyway.
    """
    at = F.struct("_metadata.file_block_start", F.monotonically_increasing_id())
    lines = _files(spark).text(path).select("value", F.col("_metadata.file_path").alias("file"), at.alias("at"))
    lines = lines.where((F.col("at.file_block_start") == 0) & (F.length(F.trim("value")) > 0))
    firsts = stored(lines.groupBy("file").agg(F.min_by("value", "at").alias("line")), "first-lines")
    if firsts.where(F.length(F.regexp_replace("line", '[^"]', "")) % 2 == 1).isEmpty():
        return firsts.select("file", F.get(csv_records(F.col("line")), F.lit(0)).alias("head"))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, text in zip(batch["file"].to_pylist(), batch["value"].to_pylist(), strict=True):
                if head := next((r for r in csv.reader(io.StringIO(text, newline="")) if r), None):
                    yield pa.RecordBatch.from_pydict({"file": [file], "head": [head]})

    whole = _files(spark).text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    return stored(whole.mapInArrow(first, "file string, head array<string>"), "headers")


def scan_logs(spark: SparkSession, path: str, header: tuple[str, ...] | None = None) -> DataFrame:
    """All rows of the CSV files below ``path`` (plain or gzip), with ``file_path``; files may differ in columns.

    One job reads the headers and one read all rows, by position; where headers differ, a row gets its columns' names
    by its file.  Only the different headers come to the driver.  Names that differ in case alone are one column;
    files without any line have no rows.  With ``header``, the header of all files, nothing is read twice, and
    reading a file that has another one fails.
    """
    if header is not None:
        named_ = _files(spark).option("header", True).option("enforceSchema", False).schema(", ".join(f"`{c.replace('`', '``')}` string" for c in header))
        return named_.csv(path).select("*", F.col("_metadata.file_path").alias("file_path"))
    heads = headers(spark, path)
    kinds = sorted(tuple(r.head) for r in heads.select("head").distinct().collect())
    if not kinds:
        return spark.createDataFrame([], "file_path string")
    at = F.col("_metadata.file_path")
    cells = [f"c{i}" for i in range(max(map(len, kinds)))]
    reader = _files(spark).option("header", True).option("multiLine", any("\n" in name for kind in kinds for name in kind))
    rows = reader.schema(", ".join(f"{c} string" for c in cells)).csv(path).select(*cells, at.alias("file_path"))
    if len(kinds) > 1:
        number = F.array_position(F.array(*(F.array(*map(F.lit, k)) for k in kinds)), F.col("head")).cast("int") - 1
        rows = rows.join(heads.select(F.col("file").alias("file_path"), number.alias("kind")), "file_path")
    named: dict[str, tuple[str, list]] = {}
    for k, kind in enumerate(kinds):
        for cell, name in zip(cells, kind):
            named.setdefault(name.lower(), (name, []))[1].append((k, cell))
    one = lambda k, cell: F.col(cell) if len(kinds) == 1 else F.when(F.col("kind") == k, F.col(cell))
    return rows.select(*(F.coalesce(*(one(*w) for w in where)).alias(name) for name, where in named.values()), "file_path")


def spark_pattern(timeformat: str) -> str:
    for a, b in (("T", "'T'"), *((k, v) for k, v in _PATTERN.items() if k != "T")):
        timeformat = timeformat.replace(a, b)
    return timeformat


def normalize_log(df: DataFrame, column_names: dict[str, str], timeformat: str, one_timestamp: bool = False) -> DataFrame:
    """Rename configured columns and parse the timestamps; a log with one timestamp ends when it starts."""
    out = df.withColumnsRenamed(column_names)
    pattern = F.lit(spark_pattern(timeformat))
    out = out.withColumn("end_timestamp", F.try_to_timestamp("end_timestamp", pattern))
    if one_timestamp:
        return out.withColumn("start_timestamp", F.col("end_timestamp"))
    return out.withColumn("start_timestamp", F.try_to_timestamp("start_timestamp", pattern))


def split_rejects(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that can be ranked, and those without a case or start time."""
    bad = F.col("caseid").isNull() | F.col("start_timestamp").isNull()
    return log.where(~bad), log.where(bad)


def drop_boundary_tasks(log: DataFrame) -> DataFrame:
    return log.where(~is_boundary(F.col("task")))


def write_log(log: DataFrame, path: str, *, gzip: bool = False) -> str:
    """Write a log as CSV to a new folder."""
    writer = log.write.mode("errorifexists").option("header", True)
    (writer.option("compression", "gzip") if gzip else writer).csv(path)
    return path


def gzip_log(spark: SparkSession, source: str, target: str) -> str:
    """Copy a CSV log to gzip; the source must be an existing .csv file or a folder of them."""
    if not source.rstrip("/").lower().endswith(".csv"):
        raise ValueError(f"not a .csv log: {source}")
    return write_log(spark.read.option("header", True).csv(source), target, gzip=True)


def latest_run(spark: SparkSession, path: str) -> DataFrame:
    """``log_name, run_id``: the run folder with the most recently changed file, for files at log/run/file.

    A folder may be named ``key=name``, as writers by partition do.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "modificationTime")
    parts = F.split("path", "/")
    name = lambda i: F.regexp_replace(F.element_at(parts, i), "^[^=]*=", "")
    named = files.select(name(-3).alias("log_name"), name(-2).alias("run_id"), "modificationTime")
    return named.groupBy("log_name").agg(F.max_by("run_id", F.struct("modificationTime", "run_id")).alias("run_id"))


def list_logs(log: DataFrame) -> DataFrame:
    return log.select("log_name").distinct().orderBy("log_name")
