import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from eventloom.functions import rules, values
from eventloom.operators import branching, derived, graph
from eventloom.sources import logs

LOG = "log_name string, caseid string, task string, user string, start_timestamp timestamp, end_timestamp timestamp, input_ordinal long"
T0 = datetime(2024, 1, 1)


def log_of(spark, cases):
    rows, n = [], 0
    for case, steps in cases.items():
        for task, at in steps:
            n += 1
            rows.append(("L", case, task, None, T0 + timedelta(seconds=at), None, n))
    return spark.createDataFrame(rows, LOG)


def rule_table(spark, paths):
    return rules.parse(spark.createDataFrame([("L", p, p, None) for p in paths], "log_name string, rule_id string, raw_path string, raw_variation string"))


@pytest.mark.parametrize(
    ("raw", "kind", "path", "label"),
    [
        ("Task A >> Task C", "directly", ["Task A", "Task C"], "directly__Task_A__Task_C"),
        ("Task A >> * >> Task D", "eventually", ["Task A", "Task D"], "eventually__Task_A__Task_D"),
        ("^Task C", "not_allowed", ["Task C"], "not_allowed__Task_C"),
        ("Task C", "required", ["Task C"], "required__Task_C"),
        ("^A >> * >> B", "eventually", ["A", "B"], "eventually__A__B"),
    ],
)
def test_rule_goldens(spark, raw, kind, path, label):
    row = rule_table(spark, [raw]).first()
    assert (row.rule_type, row.path, row.label) == (kind, path, label)


def test_variation(spark):
    df = spark.createDataFrame([("=1",), ("+0.1",), (None,)], "v string")
    got = df.select(rules.variation_op(F.col("v")), rules.variation_value(F.col("v"))).collect()
    assert [tuple(r) for r in got] == [("=", 1.0), ("+", 0.1), (None, None)]


CASES = {
    "loop": [("X", 1), ("B", 2), ("A", 3), ("X", 4)],
    "order": [("B", 1), ("A", 2)],
    "self": [("A", 1)],
    "split": [("A", 1), ("B", 2), ("X", 3), ("B", 4), ("C", 5)],
    "repeat": [("A", 1), ("A", 2)],
    "tie": [("A", 1), ("B", 2), ("C", 2), ("D", 3)],
}


@pytest.mark.parametrize(
    ("case", "rule", "ok"),
    [
        ("loop", "A >> * >> B", True), ("order", "A >> * >> B", False), ("self", "A >> * >> A", True), ("split", "A >> B >> C", True),
        ("repeat", "A >> A", False), ("tie", "B >> D", False), ("tie", "A >> C", True), ("self", "^Z", True), ("self", "A >> *", None),
    ],
)
def test_hand_traces(spark, case, rule, ok):
    got = graph.conform(graph.case_graph(log_of(spark, {case: CASES[case]})), rule_table(spark, [rule])).first()
    assert got.ok is ok


def model(steps, kind, path):
    """A case by itself: ranks, edges, then the rule."""
    times = [at for _, at in steps]
    ranks = [int(sum(t < at for t in times) + (sum(t == at for t in times) + 1) / 2) for at in times]
    nodes = {t for t, _ in steps}
    edges = {(a, b) for (a, _), i in zip(steps, ranks, strict=True) for (b, _), j in zip(steps, ranks, strict=True) if j == i + 1}
    if kind == "required":
        return path[0] in nodes
    if kind == "not_allowed":
        return path[0] not in nodes
    if kind == "directly":
        return len(set(path)) == len(path) and set(path) <= nodes and all(e in edges for e in zip(path, path[1:], strict=False))
    seen = {path[0]}
    while more := {b for a, b in edges if a in seen} - seen:
        seen |= more
    return path[0] in nodes and path[1] in nodes and path[1] in seen


def test_random_cases_with_ties(spark):
    rnd = random.Random(5)
    cases = {f"c{i}": [(rnd.choice("ABCD"), rnd.randint(0, 6)) for _ in range(rnd.randint(1, 8))] for i in range(150)}
    table = rule_table(spark, ["A >> * >> B", "A >> B", "A >> B >> C", "^D", "C", "B >> * >> B"])
    kinds = {r.rule_id: (r.rule_type, r.path) for r in table.collect()}
    for r in graph.conform(graph.case_graph(log_of(spark, cases)), table).collect():
        assert r.ok == model(cases[r.caseid], *kinds[r.rule_id]), (cases[r.caseid], r)


def test_case_graph_has_one_exchange(spark):
    plan = graph.case_graph(log_of(spark, CASES))._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning", plan)) <= 2
    assert "Python" not in plan


def test_round2_is_pythons(spark):
    pairs = [(k, m) for m in range(1, 120) for k in range(m + 1)]
    for r in spark.createDataFrame(pairs, "k int, m int").select("k", "m", values.round2(F.col("k") / F.col("m")).alias("r")).collect():
        assert r.r == round(r.k / r.m, 2)


def test_null_tasks_survive_the_boundary_filter(spark):
    df = spark.createDataFrame([("Start",), (None,), ("x",), ("END",)], "task string")
    assert df.where(~values.is_boundary(F.col("task"))).count() == 3


FLOWS = [("f0", "s", "t1"), ("f1", "t1", "g1"), ("f2", "g1", "t2"), ("f3", "g1", "t3"), ("f4", "g1", "t4")]


def small_model(spark, ends):
    flows = spark.createDataFrame([("L", i, *f) for i, f in enumerate(FLOWS[: 2 + ends])], "model_id string, ordinal int, flow_id string, source_ref string, target_ref string")
    elements = spark.createDataFrame([("L", i, "task", f"t{i + 1}", n) for i, n in enumerate("ABCD"[: ends + 1])], "model_id string, ordinal int, tag string, element_id string, name string")
    gateways = spark.createDataFrame([("L", 0, "g1", "Diverging")], "model_id string, ordinal int, gateway_id string, direction string")
    return flows, elements, gateways


@pytest.mark.parametrize(("traces", "want"), [(["AB", "AC", "AC"], {"f2": 0.33, "f3": 0.67}), (["AB", "AC", "AD"], {"f2": 0.34, "f3": 0.33, "f4": 0.33})])
def test_branch_probabilities(spark, traces, want):
    flows, elements, gateways = small_model(spark, len(want))
    log = log_of(spark, {f"c{i}": [(t, k) for k, t in enumerate(x)] for i, x in enumerate(traces)})
    counts = branching.branch_counts(branching.gateway_branches(flows, elements, gateways), log)
    got = branching.branch_residual(branching.branch_ratio(counts, flows, elements)).collect()
    assert {r.flow_id: r.probability for r in got} == want


def test_gateway_without_cases_has_null_probabilities(spark):
    flows, elements, gateways = small_model(spark, 2)
    counts = branching.branch_counts(branching.gateway_branches(flows, elements, gateways), log_of(spark, {"c": [("Z", 1)]}))
    assert [r.probability for r in branching.branch_residual(branching.branch_ratio(counts, flows, elements)).collect()] == [None, None]


def test_sample_to_share(spark):
    checked = spark.createDataFrame([("L", f"c{i}", "r", i < 30) for i in range(100)], "log_name string, caseid string, rule_id string, ok boolean")
    table = spark.createDataFrame([("L", "r", "=", 0.5)], "log_name string, rule_id string, variation_op string, variation_value double")
    got = derived.sample_to_share(checked, table)
    assert (got.where("ok").count(), got.where("not ok").count()) == (30, 30)

def test_counted_conformance_equals_the_cases(spark):
    """Rules counted without a row per case, long and short paths, unknown tasks, and a case without tasks."""
    rnd = random.Random(6)
    cases = {f"c{i}": [(rnd.choice("ABCD"), rnd.randint(0, 6)) for _ in range(rnd.randint(1, 8))] for i in range(120)}
    table = rule_table(spark, ["A >> * >> B", "A >> B", "A >> B >> C", "D >> C >> B >> A", "A >> A", "A >> B >> A", "^D", "C", "B >> * >> B", "Z", "^Z", "A >> * >> Z", "A >> *"])
    kinds = {r.rule_id: (r.rule_type, r.path) for r in table.collect()}
    log = log_of(spark, {**cases, "empty": [(None, 1)]})
    got = {r.rule_id: (r.positive, r.total) for r in graph.conform_stats(graph.case_graph(log), table, graph.case_counts(log)).collect()}
    for rule, (kind, path) in kinds.items():
        want = 0 if rule == "A >> *" else sum(model(c, kind, path) for c in cases.values()) + (kind == "not_allowed")
        assert got[rule] == (want, 121), rule


def test_rules_from_ini_files(spark):
    text = "# c\n[OTHER]\npath = X\n[RULES]\r\n  Path : Task A >> * >> Task D \n;path = Y\nvariation=+0.1\n"
    files = spark.createDataFrame([("a", text), ("b", "[RULES]\nvariation = =1\n"), ("c", "path = X\n"), ("d", "[RULES]\npath=^Task C\n"), ("e", "")], "file string, value string")
    got = {r.file: (r.rule_type, r.path, r.variation_op, r.variation_value) for r in rules.parse(rules.read_ini(files)).collect()}
    assert got == {"a": ("eventually", ["Task A", "Task D"], "+", 0.1), "d": ("not_allowed", ["Task C"], None, None)}


def test_logs_with_different_headers(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "a.csv").write_text('"id,no",b\n1,2\n')
    (tmp_path / "x" / "b.csv").write_text("b,c\n3,4\n5,6\n")
    (tmp_path / "c.csv").write_text('"id,no",b\n7,8\n')
    (tmp_path / "none.csv").write_text("")
    (tmp_path / "d.txt").write_text("b\n9\n")
    got = logs.scan_logs(spark, str(tmp_path))
    assert sorted((r["id,no"] or "", r.b, r.c or "") for r in got.collect()) == [("", "3", "4"), ("", "5", "6"), ("1", "2", ""), ("7", "8", "")]
    assert logs.scan_logs(spark, str(tmp_path / "x" / "..") + "/x").count() == 2


def test_headers_with_quoted_line_ends(spark, tmp_path):
    (tmp_path / "a.csv").write_text('\n"case\nid",task\n1,"x\ny"\n2,z\n')
    (tmp_path / "b.csv").write_text("TASK,extra\nq,r\ns\n")
    (tmp_path / "only.csv").write_text("task\n")
    got = logs.scan_logs(spark, str(tmp_path)).drop("file_path")
    assert sorted(c.lower() for c in got.columns) == ["case\nid", "extra", "task"]
    assert sorted((r["case\nid"] or "", r["task"], r["extra"] or "") for r in got.select("`case\nid`", "task", "extra").collect()) == [("", "q", "r"), ("", "s", ""), ("1", "x\ny", ""), ("2", "z", "")]


def test_a_given_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,2\n")
    assert [tuple(r)[:2] for r in logs.scan_logs(spark, str(tmp_path), ("a", "b")).collect()] == [("1", "2")]
    (tmp_path / "b.csv").write_text("b,a\n3,4\n")
    with pytest.raises(Exception, match="header"):
        logs.scan_logs(spark, str(tmp_path), ("a", "b")).collect()
