"""Reachability within cases: islands, closures, starts asked for; and rows that cannot be ranked."""

import bisect
import random
import time

import pytest
from pyspark.sql import functions as F

from eventloom.functions import rules
from eventloom.operators import branching, graph
from tests.test_rules_and_graph import LOG, T0, log_of, model, rule_table


def walk(rnd, tasks, n, near):
    """A walk that mostly goes on to near tasks, so that it has parts it does not come back to."""
    at, out = 0, []
    for k in range(n):
        at = min(max(at + rnd.randint(-near, near + 1), 0), tasks - 1)
        out.append((f"t{at:03}", k))
    return out


def tied(rnd, tasks, n):
    times = sorted(rnd.randint(0, n * 3) for _ in range(n))
    return [(f"t{min(int(at / (n * 3) * tasks) + rnd.randint(0, 9), tasks - 1):03}", at) for at in times]


def paths(rnd, tasks, n):
    pick = lambda: f"t{rnd.randrange(tasks):03}"
    return sorted({f"{pick()} >> * >> {pick()}" for _ in range(n)})


def met(steps, asked):
    """Which of the `eventually` rules ``{name: (kind, path)}`` a case meets; its edges are made once."""
    times = sorted(at for _, at in steps)
    rank = {at: int(bisect.bisect_left(times, at) + (times.count(at) + 1) / 2) for at in set(times)}
    at_rank, after = {}, {}
    for t, at in steps:
        at_rank.setdefault(rank[at], set()).add(t)
    for r, tasks in at_rank.items():
        for t in tasks:
            after.setdefault(t, set()).update(at_rank.get(r + 1, ()))
    out = set()
    for name, (_, (a, b)) in asked.items():
        seen, left = {a}, [a]
        while left:
            new = after.get(left.pop(), set()) - seen
            seen |= new
            left += new
        if a in after and b in after and b in seen:
            out.add(name)
    return out


@pytest.mark.parametrize("kind", ["walk", "tied"])
def test_wide_cases(spark, kind):
    rnd = random.Random(8)
    cases = {f"c{i}": walk(rnd, 200, 400, 3) if kind == "walk" else tied(rnd, 200, 500) for i in range(8)}
    table = rule_table(spark, paths(rnd, 200, 60))
    asked = {r.rule_id: (r.rule_type, r.path) for r in table.collect()}
    graphs = graph.case_graph(log_of(spark, cases))
    assert [r.plain for r in graphs.select(F.col("place").isNotNull().alias("plain")).collect()] == [kind == "walk"] * 8
    began = time.time()
    got = {r.rule_id: r.positive for r in graph.conform_stats(graphs, table).collect()}
    assert time.time() - began < 60
    meets = {c: met(steps, asked) for c, steps in cases.items()}
    assert meets["c0"] == {name for name, rule in asked.items() if model(cases["c0"], *rule)}
    want = {name: sum(name in m for m in meets.values()) for name in asked}
    assert got == want and 0 < sum(want.values()) < 8 * len(want)
    told = {(r.caseid, r.rule_id): r.ok for r in graph.conform(graphs, table).collect()}
    assert told == {(c, name): name in m for c, m in meets.items() for name in asked}


def test_no_closure_without_rules_that_ask(spark):
    log = log_of(spark, {"c": tied(random.Random(1), 50, 100)})
    plan = lambda *raw: graph.conform_stats(graph.case_graph(log), rule_table(spark, raw))._jdf.queryExecution().optimizedPlan().toString()
    assert "getbit" in plan("t001 >> * >> t002", "t003") and "getbit" not in plan("t001 >> t002", "t003", "^t004", "t005 >> *")


def test_islands_equal_the_closure_on_random_walks(spark):
    rnd = random.Random(12)
    cases = {f"c{i}": [(rnd.choice("ABCDEFG"), k) for k in range(rnd.randint(1, 12))] for i in range(200)}
    table = rule_table(spark, [f"{a} >> * >> {b}" for a in "ABCDEFG" for b in "ABCDEFG"])
    asked = {r.rule_id: (r.rule_type, r.path) for r in table.collect()}
    log = log_of(spark, cases)
    traces = graph.sequences(log)
    for graphs in (graph.case_graph(log), graph.list_graph(traces)):
        for r in graph.conform(graphs, table).collect():
            assert r.ok == model(cases[r.caseid], *asked[r.rule_id]), (cases[r.caseid], r)


def test_a_long_case(spark):
    """One case of 300,000 rows and no tie: its arrays hold tasks and edges, not rows."""
    at = F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, id)")
    task = F.concat(F.lit("t"), (F.floor(F.col("id") / 10_000) + F.pmod(F.xxhash64("id"), F.lit(3))).cast("string"))
    log = spark.range(300_000).select(F.lit("L").alias("log_name"), F.lit("c").alias("caseid"), task.alias("task"), F.lit(None).cast("string").alias("user"), at.alias("start_timestamp"), at.alias("end_timestamp"), F.col("id").alias("input_ordinal"))
    got = graph.conform(graph.case_graph(log), rule_table(spark, ["t0 >> * >> t31", "t31 >> * >> t0", "t5 >> * >> t4", "t9 >> * >> t5"])).collect()
    assert {r.rule_id: r.ok for r in got} == {"t0 >> * >> t31": True, "t31 >> * >> t0": True, "t5 >> * >> t4": True, "t9 >> * >> t5": True}
    back = log.where("task <> 't5' and task <> 't6'")
    got = graph.conform(graph.case_graph(back), rule_table(spark, ["t0 >> * >> t31", "t31 >> * >> t0", "t9 >> * >> t4"])).collect()
    assert {r.rule_id: r.ok for r in got} == {"t0 >> * >> t31": True, "t31 >> * >> t0": False, "t9 >> * >> t4": False}


def test_rows_that_cannot_be_ranked(spark):
    """They count as rejects, and the others' results are those of a log without them."""
    good = log_of(spark, {"c1": [("A", 1), ("B", 2), ("C", 2)], "c2": [("B", 1)]})
    bad = spark.createDataFrame([("L", None, "A", None, T0, None, 90), ("L", "c1", "Z", None, None, None, 91), ("L", "c3", "A", None, None, None, 92), ("M", None, None, None, None, None, 93)], LOG)
    log = good.union(bad)
    assert sorted(map(tuple, graph.rejects(log).collect())) == [("L", 7, 1, 2), ("M", 1, 1, 1)]
    ranks = lambda x: sorted((r.input_ordinal, r.rk) for r in graph.avg_rank(x).where("rk is not null").collect())
    assert ranks(log) == ranks(good)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(graph.dfg(log)) == rows(graph.dfg(good)) and rows(graph.case_graph(log)) == rows(graph.case_graph(good))
    assert rows(graph.case_counts(log)) == rows(graph.case_counts(good)) and rows(graph.sequences(log)) == rows(graph.sequences(good))
    assert rows(graph.order_case(log).where("pos is not null")) == rows(graph.order_case(good)) and graph.order_case(log).count() == log.count()
    known = [r.input_ordinal for r in good.collect()]
    assert rows(graph.next_task(log).where(F.col("input_ordinal").isin(known))) == rows(graph.next_task(good)) and graph.next_task(log).where("next_task is not null").count() == 2
    ways = spark.createDataFrame([("L", "g", "A", "B"), ("L", "g", "A", "Z"), ("L", "g", "Z", "B")], "model_id string, gateway_id string, start_task string, end_task string")
    assert rows(branching.branch_counts(ways, log)) == rows(branching.branch_counts(ways, good))
    table = rules.parse(spark.createDataFrame([("L", p, p, None) for p in ("A >> B", "^Z", "A >> * >> C")], "log_name string, rule_id string, raw_path string, raw_variation string"))
    assert rows(graph.conform_stats(graph.case_graph(log), table, graph.case_counts(log))) == rows(graph.conform_stats(graph.case_graph(good), table, graph.case_counts(good)))


def test_a_large_log_is_split(spark):
    """Where rules are too many to broadcast, the cases of one log go to several tasks by their size."""
    settings = {"autoBroadcastJoinThreshold": "-1", "adaptive.coalescePartitions.enabled": "false", "adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "adaptive.advisoryPartitionSizeInBytes": "16k", "adaptive.skewJoin.skewedPartitionFactor": "1.5", "shuffle.partitions": "8"}
    was = {k: spark.conf.get(f"spark.sql.{k}") for k in settings}
    name = F.when(F.col("id") % 20 > 0, "large").otherwise(F.concat(F.lit("small"), (F.col("id") % 7).cast("string")))
    at = F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, id)")
    log = spark.range(60_000).repartition(8).select(name.alias("log_name"), (F.col("id") % 20_000).cast("string").alias("caseid"), F.concat(F.lit("t"), F.pmod(F.xxhash64("id"), F.lit(9)).cast("string")).alias("task"), F.lit(None).cast("string").alias("user"), at.alias("start_timestamp"), at.alias("end_timestamp"), F.col("id").alias("input_ordinal"))
    table = rules.parse(log.select("log_name").distinct().select("log_name", F.explode(F.array(*map(F.lit, ("t1 >> t2", "t0 >> * >> t8", "^t5")))).alias("raw_path")).select("log_name", F.col("raw_path").alias("rule_id"), "raw_path", F.lit(None).cast("string").alias("raw_variation")))
    try:
        for k, v in settings.items():
            spark.conf.set(f"spark.sql.{k}", v)
        told = graph.conform(graph.case_graph(log), table)
        told.write.format("noop").mode("overwrite").save()
        rows = told.count()
        told.collect()
        assert "skew=true" in told._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in was.items():
            spark.conf.set(f"spark.sql.{k}", v)
    assert rows == 3 * graph.case_graph(log).count()
