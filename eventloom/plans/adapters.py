"""The provided tables as event logs, process models and simulation parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.derived import dfg_frequency
from ..sources.logs import stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _log(df: DataFrame, log, case, task, start, ordinal, user=None, end=None) -> DataFrame:
    return df.select(
        log.alias("log_name"), case.cast("string").alias("caseid"), task.cast("string").alias("task"), (F.lit(None).cast("string") if user is None else user.cast("string")).alias("user"),
        start.cast("timestamp").alias("start_timestamp"), (start if end is None else end).cast("timestamp").alias("end_timestamp"), ordinal.alias("input_ordinal"),
    )


def _user_day():
    return F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd"))


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's day is a case."""
    return _log(table(spark, sf_dir, "events"), F.lit("events"), _user_day(), F.col("event_type"), F.col("ts"), F.col("event_id"), F.col("user_id"))


def fleet_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log per user; an event ends when the user's next one starts."""
    nxt = F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = table(spark, sf_dir, "events").withColumn("next_ts", nxt)
    return _log(rows, F.concat(F.lit("u"), F.col("user_id").cast("string")), _user_day(), F.col("event_type"), F.col("ts"), F.col("event_id"), F.col("user_id"), F.col("next_ts"))


def lineitem_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return _log(table(spark, sf_dir, "lineitem"), F.lit("lineitem"), F.col("l_orderkey"), F.concat("l_returnflag", "l_linestatus"), F.col("l_shipdate"), order)


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(table(spark, sf_dir, "orders"), F.lit("orders"), F.col("o_custkey"), F.col("o_orderpriority"), F.col("o_orderdate"), F.col("o_orderkey"))


def ragged_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders, some without a case and some without a start time."""
    log = orders_log(spark, sf_dir)
    some = lambda c, n: F.when(F.col("input_ordinal") % n > 0, F.col(c))
    return log.withColumns({"caseid": some("caseid", 11), "start_timestamp": some("start_timestamp", 7)})


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return table(spark, sf_dir, "conversations").groupBy(F.lit("conversations").alias("log_name"), F.col("conv_id").cast("string").alias("caseid")).agg(F.transform(steps, lambda s: s["role"]).alias("trace"))


def raw_rules(log: DataFrame) -> DataFrame:
    """Rules of every kind over the tasks of each log: ``log_name, rule_id, raw_path, raw_variation``."""
    tasks = log.groupBy("log_name").agg(F.array_sort(F.collect_set("task")).alias("all"))
    pairs = tasks.select("log_name", "all", F.explode("all").alias("a")).select("log_name", "a", F.explode("all").alias("b"))
    rule = lambda path, variation: F.struct(path.alias("raw_path"), variation.alias("raw_variation"))
    none = F.lit(None).cast("string")
    a, b = F.col("a"), F.col("b")
    two = pairs.select("log_name", F.inline(F.array(rule(F.concat(a, F.lit(" >> "), b), F.lit("=0.25")), rule(F.concat(a, F.lit(" >> * >> "), b), F.lit("+0.1")))))
    one = tasks.select("log_name", F.explode("all").alias("a")).select("log_name", F.inline(F.array(rule(a, F.lit("=0.5")), rule(F.concat(F.lit("^"), a), none))))
    return two.union(one).select("log_name", F.col("raw_path").alias("rule_id"), "raw_path", "raw_variation")


def model_parts(log: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Flows, elements and gateways of the model that a log implies.

    The log is read once, for its edges; they and the tasks are written, small as a model is, and all else comes from them.
    """
    edges = stored(dfg_frequency(log).select("log_name", "src", "dst"), "edges")
    made = stored(elements(log), "elements")
    return flows(made, edges), made, gateways(made)


def elements(log: DataFrame) -> DataFrame:
    rows = log.select(F.col("log_name").alias("model_id"), "task").distinct()
    place = F.row_number().over(Window.partitionBy("model_id").orderBy("task")) - 1
    return rows.select("model_id", place.alias("ordinal"), F.when(F.col("task") == "signup", "userTask").otherwise("task").alias("tag"), F.concat(F.lit("n_"), "task").alias("element_id"), F.col("task").alias("name"))


def gateways(elements_: DataFrame) -> DataFrame:
    return elements_.select("model_id", "ordinal", F.concat(F.lit("g_"), "name").alias("gateway_id"), F.lit("Diverging").alias("direction"))


def flows(elements_: DataFrame, edge: DataFrame) -> DataFrame:
    """Each task leads to its gateway, and that to every task that directly follows in the log."""
    into = elements_.select("model_id", F.concat(F.lit("f_"), "name").alias("flow_id"), F.col("element_id").alias("source_ref"), F.concat(F.lit("g_"), "name").alias("target_ref"))
    out = edge.select(F.col("log_name").alias("model_id"), F.concat(F.lit("f_"), "src", F.lit("_"), "dst").alias("flow_id"), F.concat(F.lit("g_"), "src").alias("source_ref"), F.concat(F.lit("n_"), "dst").alias("target_ref"))
    place = F.row_number().over(Window.partitionBy("model_id").orderBy("flow_id")) - 1
    return into.union(out).select("model_id", place.alias("ordinal"), "flow_id", "source_ref", "target_ref")


def _nation_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").withColumn("model_id", F.concat(F.lit("m"), F.col("c_nationkey").cast("string")))
    return table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))


def nation_elements(spark: SparkSession, sf_dir: str, tobe: bool) -> DataFrame:
    """As-is tasks of a nation's customers, and to-be tasks (finished orders alone) by other ids and spellings."""
    rows = _nation_orders(spark, sf_dir)
    rows = (rows.where("o_orderstatus = 'F'") if tobe else rows).select("model_id", "o_orderpriority").distinct()
    place = F.row_number().over(Window.partitionBy("model_id").orderBy("o_orderpriority")) - 1
    name = F.upper("o_orderpriority") if tobe else F.lower("o_orderpriority")
    return rows.select("model_id", place.alias("ordinal"), F.lit("task").alias("tag"), F.concat(F.lit("x_" if tobe else "t_"), "o_orderpriority").alias("element_id"), name.alias("name"))


def nation_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simulation parameters per nation: customers are resources, order priorities tasks."""
    rows = _nation_orders(spark, sf_dir)
    tasks = rows.groupBy("model_id", "c_mktsegment", "c_custkey", "c_name", "c_acctbal").agg(
        F.array_sort(F.collect_set(F.concat(F.lit("t_"), "o_orderpriority"))).alias("tasks"), F.any_value("c_acctbal").alias("balance")
    )  # a key of a group has lost the sign of a zero
    one = F.struct(F.col("c_custkey").alias("k"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("name"), F.when(F.col("balance") >= 0, F.col("balance")).alias("cost_per_hour"), F.lit(None).cast("bigint").alias("amount"), F.col("tasks").alias("assignedTasks"))
    listed = F.transform(F.array_sort(F.collect_list(one)), lambda r: F.struct(*(r[c].alias(c) for c in ("id", "name", "cost_per_hour", "amount", "assignedTasks"))))
    profiles = tasks.groupBy("model_id", F.col("c_mktsegment").alias("id")).agg(listed.alias("resource_list"))
    profiles = profiles.groupBy("model_id").agg(F.array_sort(F.collect_list(F.struct("id", "resource_list"))).alias("resource_profiles"))
    means = rows.groupBy("model_id", "o_orderpriority").agg(F.count("*").cast("double").alias("mean"))
    dist = means.groupBy("model_id").agg(F.array_sort(F.collect_list(F.struct(F.concat(F.lit("t_"), "o_orderpriority").alias("task_id"), "mean"))).alias("d"))
    carried = F.transform("d", lambda x: F.struct(x["task_id"].alias("task_id"), x["mean"].alias("mean"), F.parse_json(F.to_json(F.array(F.struct(x["mean"].alias("of"))))).alias("resources")))
    dist = dist.select("model_id", carried.alias("task_resource_distribution"))
    shares = rows.groupBy("model_id", "o_orderstatus").agg(F.count("*").cast("double").alias("value"))
    gates = shares.groupBy("model_id").agg(F.array(F.struct(F.lit("g").alias("gateway_id"), F.array_sort(F.collect_list(F.struct(F.concat(F.lit("f_"), "o_orderstatus").alias("path_id"), "value"))).alias("probabilities"))).alias("gateway_branching_probabilities"))
    arrival = rows.groupBy("model_id").agg(F.count("*").cast("double").alias("n"), F.count_distinct("c_custkey").cast("double").alias("c"))
    value = lambda c: F.struct(F.col(c).alias("value"))
    timed = arrival.select(
        "model_id", F.array(*(F.struct(F.lit(a).alias("from"), F.lit(b).alias("to"), F.lit("09:00:00").alias("beginTime"), F.lit("17:00:00").alias("endTime")) for a, b in (("MONDAY", "FRIDAY"), ("SATURDAY", "SATURDAY")))).alias("arrival_time_calendar"),
        F.struct(F.lit("norm").alias("distribution_name"), F.array(value("n"), value("c")).alias("distribution_params")).alias("arrival_time_distribution"),
        F.parse_json(F.to_json(F.array(F.struct(F.lit("default").alias("id"), F.col("n").cast("long").alias("slots"))))).alias("resource_calendars"),
    )
    return timed.join(profiles, "model_id").join(dist, "model_id").join(gates, "model_id")


def bpmn_processes(flows_: DataFrame, elements_: DataFrame, gateways_: DataFrame) -> DataFrame:
    """One process per row, in the shape of its XML; parts are in document order."""
    steps = lambda rows, part, **named: rows.select("model_id", F.struct("ordinal", F.struct(*(F.col(c).alias(f"_{a}") for a, c in named.items())).alias("x")).alias("l"), part.alias("part"))
    listed = lambda part: F.transform(F.array_sort(F.collect_list(F.when(F.col("part") == part, F.col("l")))), lambda s: s["x"])
    tags = ("task", "userTask")
    e = steps(elements_, F.col("tag"), id="element_id", name="name").groupBy("model_id").agg(*(listed(t).alias(t) for t in tags))
    g = steps(gateways_, F.lit("g"), id="gateway_id", gatewayDirection="direction").groupBy("model_id").agg(listed("g").alias("exclusiveGateway"))
    f = steps(flows_, F.lit("f"), id="flow_id", sourceRef="source_ref", targetRef="target_ref").groupBy("model_id").agg(listed("f").alias("sequenceFlow"))
    return e.join(g, "model_id").join(f, "model_id").select(F.col("model_id").alias("_id"), *tags, "exclusiveGateway", "sequenceFlow")


def stats_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statistics report per ship year of lineitem: ``file, value``; names have commas and quotes."""
    from ..operators.report import MEASURES

    rows = table(spark, sf_dir, "lineitem").groupBy(F.year("l_shipdate").cast("string").alias("file"), F.concat("l_returnflag", F.lit(', "'), "l_linestatus", F.lit('"')).alias("name")).agg(
        F.count("*").alias("n"), F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"), F.sum("l_quantity").alias("sum")
    )
    figures = F.concat_ws(",", F.format_string("%.2f", F.col("sum") / F.col("n")), F.format_string("%.2f", "lo"), F.format_string("%.2f", "hi"), F.format_string("%.2f", "sum"))
    quoted = F.concat(F.lit('"'), F.replace("name", F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.struct(F.col("name").alias("name"), F.concat_ws(",", quoted, "n", *[figures] * 6).alias("line"))
    head = "Process statistics\n1,2,3\nIndividual task statistics\n" + ",".join(("Name", "Count", *MEASURES)) + "\n"
    return rows.groupBy("file").agg(F.concat(F.lit(head), F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n")).alias("value"))
