"""Lifecycle events of a log and trace documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.logs import stored
from .graph import CASE, trace_order

#: Events of one file of traces, on average.
FILE_EVENTS = 100_000


def lifecycle_rows(log: DataFrame, one_timestamp: bool = False, extra: tuple[str, ...] = ()) -> DataFrame:
    """A start and a complete event for each row, or the latter alone for logs with one timestamp.

    ``extra``: columns carried as whole numbers (null where they are none).
    """
    kinds = F.array(F.lit("complete")) if one_timestamp else F.array(F.lit("start"), F.lit("complete"))
    rows = trace_order(log, one_timestamp).select("*", F.posexplode(kinds).alias("half", "transition"))
    number = (F.col("pos") - 1) * (1 if one_timestamp else 2) + F.col("half") + 1
    return rows.select(
        *CASE, number.cast("int").alias("event_no"), F.col("task").alias("concept_name"), F.col("user").alias("org_resource"), F.col("transition").alias("lifecycle_transition"),
        F.when(F.col("transition") == "start", F.col("start_timestamp")).otherwise(F.col("end_timestamp")).alias("time_timestamp"),
        *(F.col(c).try_cast("long").alias(c) for c in extra),
    )


def trace_docs(events: DataFrame, numbers: dict[str, str] | None = None) -> DataFrame:
    """``string, event``: traces in the shape of an XML document, one row each.

    An event has string, date and, for the columns named in ``numbers`` (each with its key), int tags; an
    attribute without a value has no tag.
    """
    tag = lambda key, value, kind="string": F.struct(F.lit(key).alias("_key"), value.cast(kind).alias("_value"))
    tags = lambda *all_: F.filter(F.array(*all_), lambda x: x["_value"].isNotNull())
    strings = tags(tag("concept:name", F.col("concept_name")), tag("org:resource", F.col("org_resource")), tag("lifecycle:transition", F.col("lifecycle_transition")))
    date = tag("time:timestamp", F.date_format("time_timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSS'+00:00'"))
    parts = [strings.alias("string"), F.array(date).alias("date")]
    if numbers:
        parts.append(tags(*(tag(key, F.col(c), "long") for c, key in numbers.items())).alias("int"))
    events_ = F.transform(F.array_sort(F.collect_list(F.struct("event_no", F.struct(*parts).alias("tags")))), lambda e: e["tags"])
    grouped = events.groupBy(*CASE).agg(events_.alias("event"))
    return grouped.select(F.array(tag("concept:name", F.col("caseid"))).alias("string"), "event")


def write_traces(docs: DataFrame, path: str) -> str:
    """Write trace documents as XML, in the order of their case ids as text.

    A file is read by one task, so there are as many as the events ask for; the documents are made once.
    """
    made = stored(docs, "traces")
    files = max(1, -(-(made.agg(F.sum(F.size("event"))).first()[0] or 0) // FILE_EVENTS))
    case = F.get("string", F.lit(0))["_value"]
    made.repartitionByRange(files, case).sortWithinPartitions(case).write.format("xml").option("rootTag", "log").option("rowTag", "trace").save(path)
    return path


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """Trace documents from XML, as ``trace_docs`` makes them."""
    tags = lambda kind: f"array<struct<_key:string,_value:{kind}>>"
    schema = f"string {tags('string')}, event array<struct<string:{tags('string')},date:{tags('string')},int:{tags('bigint')}>>"
    return spark.read.format("xml").option("rowTag", "trace").schema(schema).load(path)
