"""Gateway branches of process models and their probabilities from logs.

All tables carry ``model_id``; the log of a model has it as ``log_name``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.values import round2
from ..sources.logs import split_rejects
from ..sources.models import last_named
from .graph import order_case


def flow_predecessors(flows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``model_id, node, neighbour``: sources of the flows into each node; duplicates stay."""
    return nodes.select("model_id", "node").join(flows.select("model_id", F.col("target_ref").alias("node"), F.col("source_ref").alias("neighbour")), ["model_id", "node"])


def flow_successors(flows: DataFrame, nodes: DataFrame) -> DataFrame:
    return nodes.select("model_id", "node").join(flows.select("model_id", F.col("source_ref").alias("node"), F.col("target_ref").alias("neighbour")), ["model_id", "node"])


def look_through(near: DataFrame, flows: DataFrame, elements: DataFrame, forward: bool) -> DataFrame:
    """Names for the neighbours of nodes: a nameless neighbour is replaced by those one hop further, whatever their names."""
    names = elements.where("name is not null and name <> ''").groupBy("model_id", F.col("element_id").alias("neighbour")).agg(F.max_by("name", "ordinal").alias("name"))
    told = near.join(names, ["model_id", "neighbour"], "left")
    a, b = ("source_ref", "target_ref") if forward else ("target_ref", "source_ref")
    hop = flows.select("model_id", F.col(a).alias("neighbour"), F.col(b).alias("next"))
    further = told.where("name is null").join(hop, ["model_id", "neighbour"]).select("model_id", "node", F.col("next").alias("neighbour")).join(names, ["model_id", "neighbour"], "left")
    return told.where("name is not null").select("model_id", "node", "name").unionByName(further.select("model_id", "node", "name"))


def gateway_branches(flows: DataFrame, elements: DataFrame, gateways: DataFrame) -> DataFrame:
    """``model_id, gateway_id, start_task, end_task``: every way through a diverging gateway; duplicates stay."""
    nodes = gateways.where("direction = 'Diverging'").select("model_id", F.col("gateway_id").alias("node"))
    starts = look_through(flow_predecessors(flows, nodes), flows, elements, False).select("model_id", F.col("node").alias("gateway_id"), F.col("name").alias("start_task"))
    ends = look_through(flow_successors(flows, nodes), flows, elements, True).select("model_id", F.col("node").alias("gateway_id"), F.col("name").alias("end_task"))
    return starts.join(ends, ["model_id", "gateway_id"])


def task_places(log: DataFrame) -> DataFrame:
    """First and last position of each task of a case, of rows that can be ranked."""
    return order_case(split_rejects(log)[0].where("task is not null")).groupBy(F.col("log_name").alias("model_id"), "caseid", "task").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


def branch_match(branches: DataFrame, log: DataFrame) -> DataFrame:
    """Cases in which a branch's first task comes before its second: ``model_id, gateway_id, start_task, end_task, caseid``."""
    ways = branches.groupBy("model_id", "gateway_id", "start_task", "end_task").agg(F.count("*").alias("times"))
    # A case's places stay with it, so only its first tasks are joined.
    places = task_places(log).groupBy("model_id", "caseid").agg(F.collect_list(F.struct("task", "first_pos", "last_pos")).alias("places"))
    begun = places.select("model_id", "caseid", F.col("places.task").alias("tasks"), F.col("places.last_pos").alias("lasts"), F.inline(F.transform("places", lambda p: F.struct(p["task"].alias("start_task"), p["first_pos"]))))
    last = F.get("lasts", F.array_position("tasks", F.col("end_task")).cast("int") - 1)
    return begun.join(ways, ["model_id", "start_task"]).where(last > F.col("first_pos")).select("model_id", "gateway_id", "start_task", "end_task", "caseid", "times")


def branch_counts(branches: DataFrame, log: DataFrame) -> DataFrame:
    """``cases`` that match each branch; branches without any stay with 0, duplicate branches add up."""
    ways = branches.select("model_id", "gateway_id", "start_task", "end_task").distinct()
    counted = branch_match(branches, log).groupBy("model_id", "gateway_id", "start_task", "end_task").agg(F.sum("times").alias("cases"))
    return ways.join(counted, ["model_id", "gateway_id", "start_task", "end_task"], "left").withColumn("cases", F.coalesce("cases", F.lit(0)))


def first_out_gateway(flows: DataFrame, elements: DataFrame) -> DataFrame:
    """``model_id, start_task, gateway_id, task_ordinal``: where the first flow out of each named element leads."""
    first = flows.groupBy("model_id", F.col("source_ref").alias("element_id")).agg(F.min_by("target_ref", "ordinal").alias("gateway_id"))
    return last_named(elements).join(first, ["model_id", "element_id"]).select("model_id", F.col("name").alias("start_task"), "gateway_id", F.col("ordinal").alias("task_ordinal"))


def flows_by_target(flows: DataFrame, elements: DataFrame) -> DataFrame:
    """``model_id, end_task, flow_id, ordinal``: any flow that leads to a named element, from wherever."""
    return flows.join(last_named(elements).select("model_id", F.col("element_id").alias("target_ref"), F.col("name").alias("end_task")), ["model_id", "target_ref"]).select("model_id", "end_task", "flow_id", "ordinal")


def branch_ratio(counts: DataFrame, flows: DataFrame, elements: DataFrame) -> DataFrame:
    """``model_id, gateway_id, flow_id, ordinal, probability``: shares of a gateway's cases, two decimals.

    Of several source tasks of one gateway the last by ordinal counts.  A gateway
    without any case has null probabilities.
    """
    total = F.sum("cases").over(Window.partitionBy("model_id", "gateway_id", "start_task"))
    by_task = counts.drop("gateway_id").join(first_out_gateway(flows, elements), ["model_id", "start_task"])
    last = F.max("task_ordinal").over(Window.partitionBy("model_id", "gateway_id"))
    share = F.when(F.col("total") > 0, round2(F.col("cases") / F.col("total")))
    rated = by_task.withColumn("last", last).where("task_ordinal = last").withColumn("total", total)
    return rated.select("model_id", "gateway_id", "end_task", share.alias("probability")).join(flows_by_target(flows, elements), ["model_id", "end_task"]).select("model_id", "gateway_id", "flow_id", "ordinal", "probability")


def first_max(ratios: DataFrame) -> DataFrame:
    """The flow of each gateway with the largest probability; document order wins ties."""
    w = Window.partitionBy("model_id", "gateway_id").orderBy(F.desc("probability"), "ordinal")
    return ratios.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def branch_residual(ratios: DataFrame) -> DataFrame:
    """Adds what is missing from 1 to the largest probability of each gateway."""
    gateway = Window.partitionBy("model_id", "gateway_id")
    exact = F.col("probability").cast("decimal(10,2)")
    nth = F.row_number().over(gateway.orderBy(F.desc("probability"), "ordinal"))
    fixed = F.when(F.col("nth") == 1, F.col("exact") + (1 - F.col("total"))).otherwise(F.col("exact"))
    rows = ratios.withColumn("exact", exact).withColumn("total", F.sum("exact").over(gateway)).withColumn("nth", nth)
    return rows.select("model_id", "gateway_id", "flow_id", "ordinal", fixed.cast("double").alias("probability"))


def distinct_cases(log: DataFrame) -> DataFrame:
    return log.groupBy("log_name").agg(F.count_distinct("caseid").alias("cases"))


def resolve_branch_flow(probabilities: DataFrame, flows: DataFrame, strict: bool = False) -> DataFrame:
    """Where a flow leads from the gateway to the source of a branch's flow, the first such flow; else the branch's own.

    ``strict``: null where there is none, so that the caller can report those rows.
    """
    own = flows.select("model_id", "flow_id", F.col("source_ref").alias("middle"))
    there = flows.select("model_id", F.col("source_ref").alias("gateway_id"), F.col("target_ref").alias("middle"), F.struct("ordinal", F.col("flow_id").alias("to_flow")).alias("way"))
    first = probabilities.join(own, ["model_id", "flow_id"]).join(there, ["model_id", "gateway_id", "middle"]).groupBy("model_id", "gateway_id", "flow_id").agg(F.min("way").alias("way"))
    told = probabilities.join(first, ["model_id", "gateway_id", "flow_id"], "left")
    to = F.col("way.to_flow")
    return told.select("model_id", "gateway_id", "flow_id", "probability", (to if strict else F.coalesce(to, F.col("flow_id"))).alias("resolved_flow"))
