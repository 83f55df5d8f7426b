"""As-is and to-be models: matching tasks by name, carrying parameters over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _one_per_key(elements: DataFrame) -> DataFrame:
    """Per lower-cased name: exact names keep their last id; of several spellings the one first seen latest stays."""
    named = elements.where("name is not null and name <> ''")
    exact = named.groupBy("model_id", "name").agg(F.max_by("element_id", "ordinal").alias("element_id"), F.min("ordinal").alias("seen"))
    w = Window.partitionBy("model_id", F.lower("name")).orderBy(F.desc("seen"))
    return exact.withColumn("nth", F.row_number().over(w)).where("nth = 1").select("model_id", F.lower("name").alias("key"), "name", "element_id")


def match_tasks(asis: DataFrame, tobe: DataFrame) -> DataFrame:
    """``model_id, key, name, asis_id, tobe_id``: full outer match on lower-cased names; the as-is spelling comes first."""
    a = _one_per_key(asis).select("model_id", "key", F.col("name").alias("asis_name"), F.col("element_id").alias("asis_id"))
    b = _one_per_key(tobe).select("model_id", "key", F.col("name").alias("tobe_name"), F.col("element_id").alias("tobe_id"))
    return a.join(b, ["model_id", "key"], "full_outer").select("model_id", "key", F.coalesce("asis_name", "tobe_name").alias("name"), "asis_id", "tobe_id")


def id_maps(matches: DataFrame) -> DataFrame:
    """``model_id, ids``: as-is id to to-be id, a map per model."""
    pairs = F.array_sort(F.collect_set(F.struct("asis_id", "tobe_id")))
    return matches.where("asis_id is not null and tobe_id is not null").groupBy("model_id").agg(F.map_from_entries(pairs).alias("ids"))


def _mapped(ids: Column, tasks: Column) -> Column:
    known = F.transform(F.coalesce(tasks, F.array().cast("array<string>")), lambda t: F.try_element_at(ids, t))
    return F.filter(known, lambda t: t.isNotNull())


def remap_assigned(params: DataFrame, maps: DataFrame) -> DataFrame:
    """Assigned tasks by to-be ids, in order; unmatched ones go, resources stay even if empty."""
    ids = F.coalesce("ids", F.create_map().cast("map<string,string>"))
    resource = lambda r: r.withField("assignedTasks", _mapped(F.col("ids"), r["assignedTasks"]))
    profiles = F.transform("resource_profiles", lambda p: p.withField("resource_list", F.transform(p["resource_list"], resource)))
    return params.join(maps, "model_id", "left").withColumn("ids", ids).withColumn("resource_profiles", profiles).drop("ids")


def remap_task_dist(params: DataFrame, maps: DataFrame) -> DataFrame:
    """Task distributions by to-be ids; unmatched entries go, other fields stay."""
    ids = F.coalesce("ids", F.create_map().cast("map<string,string>"))
    known = F.filter(F.coalesce("task_resource_distribution", F.array().cast(params.schema["task_resource_distribution"].dataType)), lambda d: F.try_element_at(F.col("ids"), d["task_id"]).isNotNull())
    moved = F.transform(known, lambda d: d.withField("task_id", F.try_element_at(F.col("ids"), d["task_id"])))
    return params.join(maps, "model_id", "left").withColumn("ids", ids).withColumn("task_resource_distribution", moved).drop("ids")


TRANSFERRED = ("arrival_time_calendar", "arrival_time_distribution", "resource_calendars")


def transfer_fields(asis: DataFrame, tobe: DataFrame, fields: tuple[str, ...] = TRANSFERRED) -> DataFrame:
    """To-be parameters with the as-is values of ``fields``; lists default to empty, others to null."""
    there = [f for f in fields if f in asis.columns and f in tobe.columns]
    src = asis.select("model_id", *(F.col(f).alias(f"asis_{f}") for f in there))
    kind = lambda f: tobe.schema[f].dataType.typeName()
    empty = lambda f: F.parse_json(F.lit("[]")) if kind(f) == "variant" else F.array().cast(tobe.schema[f].dataType)
    value = lambda f: F.coalesce(f"asis_{f}", empty(f)) if kind(f) in ("array", "variant") else F.col(f"asis_{f}")
    return tobe.join(src, "model_id", "left").withColumns({f: value(f) for f in there}).drop(*(f"asis_{f}" for f in there))


def merge_params(asis: DataFrame, tobe: DataFrame, asis_elements: DataFrame, tobe_elements: DataFrame) -> DataFrame:
    """To-be parameters with the as-is calendars, arrival, resources and task distributions, by to-be ids."""
    maps = id_maps(match_tasks(asis_elements, tobe_elements))
    moved = remap_task_dist(remap_assigned(asis, maps), maps)
    return transfer_fields(moved, tobe, (*TRANSFERRED, "resource_profiles", "task_resource_distribution"))


def remap_elements(simulated: DataFrame, asis_tasks: DataFrame, tobe_tasks: DataFrame) -> DataFrame:
    """Element ids to to-be ids by exact task name; an id whose name to-be lacks stays; ``known``: as-is has the id."""
    names = asis_tasks.groupBy("model_id", "element_id").agg(F.max_by("name", "ordinal").alias("name"))
    ids = tobe_tasks.where("name is not null").groupBy("model_id", "name").agg(F.max_by("element_id", "ordinal").alias("tobe_id"))
    told = simulated.join(names, ["model_id", "element_id"], "left").join(ids, ["model_id", "name"], "left")
    known = simulated.select("model_id", "element_id").distinct().join(names.select("model_id", "element_id", F.lit(True).alias("known")), ["model_id", "element_id"])
    return told.join(known, ["model_id", "element_id"], "left").select("model_id", "element_id", F.coalesce("tobe_id", "element_id").alias("new_id"), F.coalesce("known", F.lit(False)).alias("known"))
