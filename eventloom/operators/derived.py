"""Durations, sub-logs by rule, edge frequencies and comparisons of logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.logs import stored
from .graph import CASE, case_counts, case_graph, conform, dfg, log_stats


def task_durations(log: DataFrame) -> DataFrame:
    rows = log.where("end_timestamp is not null").withColumn("s", (F.unix_micros("end_timestamp") - F.unix_micros("start_timestamp")))
    return rows.groupBy("log_name", "task").agg(F.count("*").alias("n"), (F.sum("s") / F.count("*") / 1e6).alias("avg_s"), (F.min("s") / 1e6).alias("min_s"), (F.max("s") / 1e6).alias("max_s"), (F.sum("s") / 1e6).alias("total_s"))


def split_by_rule(log: DataFrame, rule: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conforming and other cases of a log under one rule per log; a null verdict does not conform."""
    good = conform(case_graph(log), rule).where("ok").select(*CASE)
    return log.join(good, [*CASE], "left_semi"), log.join(good, [*CASE], "left_anti")


def sample_to_share(checked: DataFrame, rules: DataFrame) -> DataFrame:
    """Cases of a sub-log whose conforming share is a rule's target: ``log_name, rule_id, caseid, ok``.

    ``=p`` is the target p, ``+p`` the observed share plus p (an assumption), at most 1.  As many
    cases as can be are kept: of the conforming or of the other cases the first ones in
    hash order, by bucket of the hash.  Counts per bucket tell at which one a rule's limit falls: those
    before it are kept whole, and only its own cases are ordered, so the rows are neither sorted nor shuffled.
    """
    buckets = 4096
    h = F.xxhash64("caseid")
    rows = checked.withColumn("ok", F.coalesce("ok", F.lit(False))).withColumn("h", h).withColumn("bucket", F.pmod(h, F.lit(buckets)))
    sizes = stored(rows.groupBy("log_name", "rule_id", "ok", "bucket").agg(F.count("*").alias("n")), "sizes")
    before = F.sum("n").over(Window.partitionBy("log_name", "rule_id", "ok").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.withColumn("before", F.coalesce(before, F.lit(0)))
    totals = sizes.groupBy("log_name", "rule_id").agg(F.sum(F.when(F.col("ok"), F.col("n")).otherwise(0)).alias("good"), F.sum("n").alias("total"))
    p = F.when(F.col("variation_op") == "=", F.col("variation_value")).when(F.col("variation_op") == "+", F.least(F.lit(1.0), F.col("good") / F.col("total") + F.col("variation_value")))
    bad = F.col("total") - F.col("good")
    aimed = totals.join(rules.select("log_name", "rule_id", "variation_op", "variation_value"), ["log_name", "rule_id"]).withColumn("p", p).where("p between 0 and 1")
    limits = aimed.select(
        "log_name", "rule_id",
        F.when(F.col("p") >= 1, F.col("good")).otherwise(F.least(F.col("good"), F.floor(bad * F.col("p") / (1 - F.col("p")) + 1e-9))).alias("keep_good"),
        F.when(F.col("p") <= 0, bad).otherwise(F.least(bad, F.floor(F.col("good") * (1 - F.col("p")) / F.col("p") + 1e-9))).alias("keep_bad"),
    )
    keep = F.when(F.col("ok"), F.col("keep_good")).otherwise(F.col("keep_bad"))
    passed = F.when(F.col("before") + F.col("n") > keep, F.struct(F.col("bucket").alias("cut"), (keep - F.col("before")).alias("rest")))
    cuts = starts.join(limits, ["log_name", "rule_id"]).groupBy("log_name", "rule_id", "ok").agg(F.min(passed).alias("at"))
    cuts = stored(cuts.select("log_name", "rule_id", "ok", "at.cut", "at.rest"), "cuts")
    key = ["log_name", "rule_id", "ok"]
    whole = rows.join(cuts, key).where("cut is null or bucket < cut")
    # Cases of other buckets are left out before anything is asked about them.
    open_ = cuts.where("rest > 0")
    near = checked.join(open_.select(F.col("cut").alias("open")).distinct(), F.pmod(h, F.lit(buckets)) == F.col("open"), "left_semi")
    edge = near.withColumn("ok", F.coalesce("ok", F.lit(False))).withColumn("h", h).join(open_, key).where(F.pmod("h", F.lit(buckets)) == F.col("cut"))
    place = F.row_number().over(Window.partitionBy(*key).orderBy("h", "caseid"))
    edge = edge.withColumn("place", place).where("place <= rest")
    out = ["log_name", "rule_id", "caseid", "ok"]
    return whole.select(*out).union(edge.select(*out))


def dfg_frequency(log: DataFrame) -> DataFrame:
    """Edges over a log: cases that have them, and occurrences."""
    per_case = dfg(log).groupBy(*CASE, "src", "dst").agg(F.count("*").alias("n"))
    return per_case.groupBy("log_name", "src", "dst").agg(F.count("*").alias("cases"), F.sum("n").alias("occurrences"))


def rule_screen(log: DataFrame, rules: DataFrame) -> DataFrame:
    """Observed share of every rule on its log, its target and the gap."""
    stats = log_stats(log, rules, case_counts(log))
    share = F.col("positive") / F.col("total")
    target = F.when(F.col("variation_op") == "=", F.col("variation_value")).when(F.col("variation_op") == "+", F.least(F.lit(1.0), share + F.col("variation_value")))
    return stats.join(rules.select("log_name", "rule_id", "variation_op", "variation_value"), ["log_name", "rule_id"]).select("log_name", "rule_id", "positive", "total", share.alias("share"), target.alias("target"), (target - share).alias("gap"))


def share_compare(asis: DataFrame, tobe: DataFrame, rules: DataFrame) -> DataFrame:
    """``rule_id`` and each log's conforming cases, all cases and share, side by side; ``rules`` hold for both logs, by any log_name."""

    def one(log: DataFrame, name: str) -> DataFrame:
        asked = rules.select("rule_id", "rule_type", "path").dropDuplicates(["rule_id"]).withColumn("log_name", F.lit(name))
        named = log.withColumn("log_name", F.lit(name))
        stats = log_stats(named, asked, case_counts(named))
        return stats.select("rule_id", F.col("positive").alias(f"{name}_cases"), F.col("total").alias(f"{name}_total"), (F.col("positive") / F.col("total")).alias(f"{name}_share"))

    return one(asis, "asis").join(one(tobe, "tobe"), "rule_id", "full_outer")


def log_compare(asis: DataFrame, tobe: DataFrame) -> DataFrame:
    """Edge frequencies of two logs side by side."""
    a = dfg_frequency(asis).select("src", "dst", F.col("cases").alias("asis_cases"), F.col("occurrences").alias("asis_occurrences"))
    b = dfg_frequency(tobe).select("src", "dst", F.col("cases").alias("tobe_cases"), F.col("occurrences").alias("tobe_occurrences"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return a.join(b, ["src", "dst"], "full_outer").select("src", "dst", *(zero(c) for c in ("asis_cases", "asis_occurrences", "tobe_cases", "tobe_occurrences")))
