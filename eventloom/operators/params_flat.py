"""Nested simulation parameters as flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import default_text

# Fixed values.
DEFAULT_COST, DEFAULT_AMOUNT = "20", "1"
FIXED_MEAN = "60"
CALENDAR = "default_calendar"


def flat_arrival(params: DataFrame) -> DataFrame:
    p = F.col("arrival_time_distribution.distribution_params")
    text = lambda i: F.get(p, F.lit(i))["value"].cast("string")
    return params.where("arrival_time_distribution is not null").select(
        "model_id", F.upper("arrival_time_distribution.distribution_name").alias("type"), text(0).alias("arg1"), text(1).alias("arg2"), F.coalesce(text(3), F.lit("0")).alias("mean"), F.lit("seconds").alias("time_unit")
    )


def flat_calendar(params: DataFrame) -> DataFrame:
    rows = params.select("model_id", F.posexplode("arrival_time_calendar").alias("ordinal", "c"))
    return rows.select("model_id", F.lit(CALENDAR).alias("calendar_id"), "ordinal", F.col("c.beginTime").alias("from_time"), F.col("c.from").alias("from_week_day"), F.col("c.endTime").alias("to_time"), F.col("c.to").alias("to_week_day"))


def _resources(params: DataFrame) -> DataFrame:
    profiles = params.select("model_id", F.posexplode("resource_profiles").alias("profile_no", "p"))
    return profiles.select("model_id", "profile_no", F.posexplode("p.resource_list").alias("resource_no", "r"))


def flat_resources(params: DataFrame) -> DataFrame:
    return _resources(params).select(
        "model_id", "profile_no", "resource_no", F.col("r.id").alias("resource_id"), F.col("r.name").alias("name"),
        default_text(F.col("r.cost_per_hour"), DEFAULT_COST).alias("cost_per_hour"), default_text(F.col("r.amount"), DEFAULT_AMOUNT).alias("amount"), F.lit(CALENDAR).alias("calendar_id"),
    )


def _assigned(params: DataFrame) -> DataFrame:
    return _resources(params).select("model_id", F.posexplode("r.assignedTasks").alias("task_no", "task_id"), F.struct("profile_no", "resource_no").alias("place"), F.col("r.id").alias("resource_id"))


def task_resources(params: DataFrame) -> DataFrame:
    """``model_id, task_id, resources``: in order over profiles, duplicates kept."""
    listed = F.array_sort(F.collect_list(F.struct("place", "task_no", "resource_id")))
    return _assigned(params).groupBy("model_id", "task_id").agg(F.transform(listed, lambda x: x["resource_id"]).alias("resources"))


def exclusive_resource(params: DataFrame) -> DataFrame:
    """``model_id, task_id, resource_id``: the first resource alone."""
    return _assigned(params).groupBy("model_id", "task_id").agg(F.min_by("resource_id", F.struct("place", "task_no")).alias("resource_id"))


def flat_elements(params: DataFrame, exclusive: bool = False) -> DataFrame:
    rows = exclusive_resource(params).select("model_id", "task_id", F.array("resource_id").alias("resources")) if exclusive else task_resources(params)
    return rows.select(
        "model_id", F.md5(F.concat_ws("|", "model_id", "task_id").cast("binary")).alias("row_id"), F.col("task_id").alias("element_id"), F.lit("FIXED").alias("type"),
        F.lit("0").alias("arg1"), F.lit("0").alias("arg2"), F.lit(FIXED_MEAN).alias("mean"), F.lit("seconds").alias("time_unit"), "resources",
    )


def flat_branching(params: DataFrame) -> DataFrame:
    gates = params.select("model_id", F.explode("gateway_branching_probabilities").alias("g"))
    return gates.select("model_id", F.explode("g.probabilities").alias("p")).where("p.path_id is not null and p.value is not null").select("model_id", F.col("p.path_id").alias("flow_id"), F.col("p.value").alias("probability"))


def sim_header(params: DataFrame, run_time: str) -> DataFrame:
    """Header of a simulation: ``run_time`` is the start as text, labelled with a zero offset."""
    return params.select("model_id", F.md5(F.col("model_id").cast("binary")).alias("sim_id"), F.lit("EUR").alias("currency"), F.lit(0).alias("process_instances"), F.lit(f"{run_time}+00:00").alias("start_time"))
