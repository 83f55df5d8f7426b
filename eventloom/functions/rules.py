"""Declarative rules as columns: path, type, variation and label of a rule's text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_EDGES = r"^\s+|\s+$"


def elements(raw: Column) -> Column:
    return F.transform(F.split(raw, ">>", -1), lambda x: F.regexp_replace(x, _EDGES, ""))


def path(raw: Column) -> Column:
    """Task names of a path: parts between ``>>`` without ``*`` parts and ``^`` signs."""
    return F.transform(F.filter(elements(raw), lambda x: x != "*"), lambda x: F.replace(x, F.lit("^"), F.lit("")))


def rule_type(raw: Column) -> Column:
    return (
        F.when(F.array_contains(elements(raw), "*"), "eventually")
        .when(F.contains(raw, F.lit("^")), "not_allowed")
        .when(F.contains(raw, F.lit(">>")), "directly")
        .when(raw.isNotNull(), "required")
    )


def variation_op(raw: Column) -> Column:
    return F.when(F.length(raw) > 0, F.substring(raw, 1, 1))


def variation_value(raw: Column) -> Column:
    return F.substr(raw, F.lit(2)).try_cast("double")


def label(kind: Column, tasks: Column) -> Column:
    return F.concat_ws("__", kind, F.transform(tasks, lambda x: F.replace(x, F.lit(" "), F.lit("_"))))


def read_ini(files: DataFrame) -> DataFrame:
    """``file, raw_path, raw_variation`` of rule files ``files(file, value)``, whole texts: the keys of their section RULES.

    Keys compare without case and are set off by ``=`` or ``:``; lines that begin with ``#`` or
    ``;`` are comments.  A file without the section or without a path gives no row.
    """
    lines = F.transform(F.split(F.regexp_replace("value", "\r", ""), "\n", -1), lambda x: F.regexp_replace(x, _EDGES, ""))
    used = files.select("file", F.posexplode(F.filter(lines, lambda x: (F.length(x) > 0) & ~F.substring(x, 1, 1).isin("#", ";"))).alias("no", "line"))
    heads = used.where(F.col("line").startswith("[")).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("no", "line"))).alias("heads"))
    section = F.element_at(F.filter("heads", lambda h: h["no"] < F.col("no")), -1)["line"]
    key = lambda name: F.max_by(F.regexp_extract("line", r"^[^=:]*[=:]\s*(.*)$", 1), F.when(F.lower(F.regexp_extract("line", r"^([^=:]*?)\s*[=:]", 1)) == name, F.col("no")))
    inside = used.join(heads, "file").where(F.size(F.filter("heads", lambda h: h["no"] < F.col("no"))) > 0).where(section == "[RULES]")
    return inside.groupBy("file").agg(key("path").alias("raw_path"), key("variation").alias("raw_variation")).where("raw_path is not null")


def parse(rules: DataFrame) -> DataFrame:
    """``rules(raw_path, raw_variation, ...)`` with type, path, variation and label; thousands of rules are one table."""
    raw = F.col("raw_path")
    named = rules.withColumns({"rule_type": rule_type(raw), "path": path(raw), "variation_op": variation_op(F.col("raw_variation")), "variation_value": variation_value(F.col("raw_variation"))})
    return named.withColumn("label", label(F.col("rule_type"), F.col("path")))
