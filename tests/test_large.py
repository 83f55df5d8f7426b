"""Tables with what only large ones have: a zero with a sign, many models, many rows a task."""

import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from eventloom.functions import rules
from eventloom.operators import derived, export, graph
from eventloom.plans import adapters, queries
from eventloom.sources import models

from .test_queries import SF


@pytest.fixture(scope="module")
def signed(tmp_path_factory):
    """The smallest tables, with a balance of minus zero among the customers' that have orders."""
    folder = tmp_path_factory.mktemp("signed")
    con = duckdb.connect()
    for name in ("customer", "orders"):
        rows = f"SELECT * FROM '{SF}/{name}.parquet'"
        if name == "customer":
            first = f"(SELECT min(o_custkey) FROM '{SF}/orders.parquet')"
            rows = f"SELECT * REPLACE (CASE WHEN c_custkey = {first} THEN '-0.0'::DOUBLE ELSE c_acctbal END AS c_acctbal) FROM '{SF}/{name}.parquet'"
        con.execute(f"COPY ({rows}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return os.fspath(folder), con


@pytest.mark.parametrize("name", ["E3_flat_resources", "S13_write_params", "S9_scan_params"])
def test_sign_of_zero_is_kept(spark, signed, name):
    folder, con = signed
    df = entry.queries()[name](spark, folder)
    cur = con.execute(entry.oracle_sql()[name])
    there = [d[0] for d in cur.description]
    want = sorted(tuple(str(r[there.index(c)]) for c in sorted(there)) for r in cur.fetchall())
    assert any("-0.0" in text for row in want for text in row)
    assert sorted(tuple(str(r[c]) for c in sorted(there)) for r in df.collect()) == want


def test_tasks_of_a_log_grow_with_its_rows(spark, monkeypatch):
    """A task of a graph has so many rows at most, on average, at every size of the log, and sorts them once for its layers."""
    rows = spark.range(4000).select(F.lit("l").alias("log_name"), (F.col("id") / 4).cast("int").cast("string").alias("caseid"), (F.col("id") % 3).cast("string").alias("task"), F.timestamp_seconds(F.col("id") % 5).alias("start_timestamp"))
    monkeypatch.setattr(graph, "TASK_ROWS", 100, raising=False)
    for made in (graph.avg_rank(rows), graph.dfg(rows), graph.case_graph(rows)):
        assert made.rdd.getNumPartitions() == 40
    plan = graph.layers(rows)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bSort \[", plan)) == 1


@pytest.mark.parametrize("name", ["G6_rule_not_allowed", "G7_rule_directly"])
def test_rules_of_a_large_log(spark, monkeypatch, name):
    """Tasks grow with the log; more than a task writes without a sort are dealt in two steps, with the same counts."""
    query, rows = entry.queries()[name], spark.read.parquet(f"{SF}/lineitem.parquet").count()
    parts = lambda df: [int(n) for n in re.findall(r"RepartitionByExpression \[.*\], (\d+)", df._jdf.queryExecution().optimizedPlan().toString())]
    want = query(spark, SF).collect()
    monkeypatch.setattr(graph, "TASK_ROWS", 100, raising=False)
    assert parts(query(spark, SF)) == [-(-rows // 100)]
    monkeypatch.setattr(graph, "TASK_ROWS", 20, raising=False)
    told = query(spark, SF)
    last, first = parts(told)
    assert first == 200 and last >= rows / 20 > 200 and last % first == 0
    assert sorted(told.collect()) == sorted(want)


def test_rows_of_a_task_at_eight_times(spark, monkeypatch, tmp_path):
    """A log of eight copies, dealt in two steps, has no more rows a task than one copy, and G7 counts eight times as many."""
    copies = "SELECT l.* REPLACE (l_orderkey + k * 1000000 AS l_orderkey) FROM '{}/lineitem.parquet' l, range({}) t(k)"
    for n in (1, 8):
        (tmp_path / f"x{n}").mkdir()
        duckdb.execute(f"COPY ({copies.format(SF, n)}) TO '{tmp_path}/x{n}/lineitem.parquet' (FORMAT parquet)")
    monkeypatch.setattr(graph, "TASK_ROWS", 200, raising=False)
    most, told = {}, {}
    for n in (1, 8):
        folder = os.fspath(tmp_path / f"x{n}")
        layers = graph.layers(adapters.lineitem_log(spark, folder))
        most[n] = layers.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        told[n] = sorted((r.rule_id, r.positive, r.total) for r in entry.queries()["G7_rule_directly"](spark, folder).collect())
    assert most[8] <= 1.5 * most[1]
    assert told[8] == [(rule, 8 * positive, 8 * total) for rule, positive, total in told[1]] and any(r[1] for r in told[1])


def test_layers_of_tied_rows(spark):
    """Tied rows of one task, rows without a task, and a layer that has none are as before."""
    made = [("l", "c", "A", 1), ("l", "c", "A", 1), ("l", "c", "B", 2), ("l", "c", None, 3), ("l", "c", "C", 4), ("l", "c", None, 4), ("l", "d", "A", 1), ("l", "d", "C", 1), ("l", "d", "B", 1), ("l", "d", "A", 4), ("l", "e", "A", None), ("l", None, "A", 1)]
    log = spark.createDataFrame(made, "log_name string, caseid string, task string, at int").withColumn("start_timestamp", F.timestamp_seconds("at"))
    got = sorted((r.caseid, r.rk, r.t, r.after) for r in graph.layers(log).collect())
    assert got == [("c", 1, ["A"], []), ("c", 3, ["B"], []), ("c", 5, ["C"], []), ("d", 2, ["A", "B", "C"], []), ("d", 4, ["A"], [])]


def _tied_log(spark):
    """Cases with and without ties, some with gaps, and some rows without a task."""
    h = lambda n: F.xxhash64("id", F.lit(n))
    task = F.when(F.pmod(h(1), F.lit(9)) > 0, F.pmod(h(2), F.lit(5)).cast("string"))
    return spark.range(3000).select(F.lit("l").alias("log_name"), (F.col("id") / 6).cast("int").cast("string").alias("caseid"), task.alias("task"), F.timestamp_seconds(F.pmod(h(3), F.lit(30))).alias("start_timestamp"))


_PATHS = {"eventually": "{} >> * >> {}", "directly": "{} >> {}", "required": "{}", "not_allowed": "^{}", "long": "{} >> {} >> 3"}


def _rules_of(spark, *kinds):
    paths = sorted({_PATHS[kind].format(a, b) for kind in kinds for a in range(6) for b in range(6)})
    return rules.parse(spark.createDataFrame([("l", p, p, None) for p in paths], "log_name string, rule_id string, raw_path string, raw_variation string"))


@pytest.mark.parametrize("kinds", [*((k,) for k in _PATHS), tuple(_PATHS)], ids="-".join)
def test_graphs_are_made_once(spark, kinds):
    """Counts of cases come from the graphs that rules are counted on, not from a second making of these."""
    log, table = _tied_log(spark), _rules_of(spark, *kinds)
    told = graph.conform_stats(graph.case_graph(log), table)
    assert told._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 1
    checked = graph.conform(graph.case_graph(log), table).groupBy("rule_id").agg(F.count_if("ok").alias("positive"), F.count("*").alias("total"))
    want = sorted(map(tuple, checked.collect()))
    rows = lambda df: sorted(map(tuple, df.select("rule_id", "positive", "total").collect()))
    assert rows(told) == want and any(r[1] for r in want)
    assert rows(graph.log_stats(log, table)) == rows(graph.log_stats(log, table, graph.case_counts(log).where("total > 0"))) == want


def test_parts_of_graphs(spark):
    """Nodes alone ask for no ranks, edges alone for one sort, and each part is that of the whole graph."""
    log = _tied_log(spark)
    whole = {r.caseid: r for r in graph.case_graph(log).collect()}
    assert {r.place is None for r in whole.values()} == {True, False}
    for parts, nulls in (((), ()), (("edges",), ()), (("succ", "place"), ("succ",))):
        got = {r.caseid: r for r in graph.case_graph(log, parts).collect()}
        assert got.keys() == whole.keys()
        for case, r in got.items():
            assert all(r[p] == whole[case][p] for p in ("nodes", *parts) if not (p in nulls and r.place is not None))
    plan = lambda *parts: graph.case_graph(log, parts)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan() and len(re.findall(r"\bSort \[", plan("edges"))) == 1


def _files(df):
    return len(df.inputFiles())


def test_models_share_files(spark, monkeypatch):
    """There are not as many files as models, and none with more models than fit one."""
    monkeypatch.setattr(models, "FILE_MODELS", 4, raising=False)
    processes = queries._models(spark, SF)
    many = processes.count()
    assert many > 8 and many / 4 <= _files(processes) < many / 2


def test_files_of_traces_grow_with_events(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(export, "FILE_EVENTS", 100, raising=False)
    docs = queries._traces(spark, SF)
    events = docs.selectExpr("sum(size(event))").first()[0]
    back = export.read_traces(spark, export.write_traces(docs, f"file://{tmp_path}/xes"))
    assert _files(back) >= events / 200 > 8
    assert back.selectExpr("sum(size(event))").first()[0] == events
    names = [r.name for r in back.select("_metadata.file_path", F.col("string")[0]["_value"].alias("name")).orderBy("file_path", F.monotonically_increasing_id()).collect()]
    assert names == sorted(names)


def test_sample_at_the_limit(spark):
    """Kept are the first cases by bucket and hash, and the rows are not sorted to find them."""
    checked = spark.range(20000).select(F.lit("l").alias("log_name"), F.lit("r").alias("rule_id"), F.col("id").cast("string").alias("caseid"), F.when(F.col("id") % 7 > 0, F.col("id") % 3 == 0).alias("ok"))
    rules = spark.createDataFrame([("l", "r", "=", 0.6)], "log_name string, rule_id string, variation_op string, variation_value double")
    made = derived.sample_to_share(checked, rules)
    got = {(r.caseid, r.ok) for r in made.collect()}
    h = F.xxhash64("caseid")
    order = lambda ok: [r.caseid for r in checked.where(F.coalesce("ok", F.lit(False)) == ok).orderBy(F.pmod(h, F.lit(4096)), h, "caseid").collect()]
    good, bad = order(True), order(False)
    n = int(len(good) * 0.4 / 0.6 + 1e-9)
    assert got == {(c, True) for c in good} | {(c, False) for c in bad[:n]}
    assert "Union" in made._jdf.queryExecution().optimizedPlan().toString()
