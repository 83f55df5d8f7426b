"""One query per operator, by its identifier, over the provided tables; and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import values as V
from ..operators import branching as B
from ..operators import derived as D
from ..operators import export as X
from ..operators import graph as G
from ..operators import matching as M
from ..operators import params_flat as E
from ..operators import report as T
from ..sources import logs as L
from ..sources import models as S
from . import adapters as A

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# Tables of the adapters, in SQL.
_EV = """ev AS (SELECT 'events' AS log_name, user_id::VARCHAR || '-' || strftime(ts, '%Y-%m-%d') AS caseid, event_type AS task, ts AS st, event_id AS ord FROM events)"""
_FL = """fl AS (SELECT 'u' || user_id AS log_name, user_id::VARCHAR || '-' || strftime(ts, '%Y-%m-%d') AS caseid, event_type AS task, ts AS st, event_id AS ord,
  lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS en FROM events)"""
_LI = """li AS (SELECT 'lineitem' AS log_name, l_orderkey::VARCHAR AS caseid, l_returnflag || l_linestatus AS task, l_shipdate AS st FROM lineitem)"""
_OR = """od AS (SELECT 'orders' AS log_name, o_custkey::VARCHAR AS caseid, o_orderpriority AS task, o_orderdate AS st, o_orderkey AS ord FROM orders)"""

_RG = """rg AS (SELECT 'orders' AS log_name, CASE WHEN o_orderkey % 11 > 0 THEN o_custkey::VARCHAR END AS caseid, o_orderpriority AS task, CASE WHEN o_orderkey % 7 > 0 THEN o_orderdate END AS st FROM orders),
ok AS (SELECT * FROM rg WHERE caseid IS NOT NULL AND st IS NOT NULL)"""


def _graph(t: str) -> str:
    """CTEs rk, edge and node of a log table."""
    return f"""rk AS (SELECT *, floor(rank() OVER (PARTITION BY log_name, caseid ORDER BY st) + (count(*) OVER (PARTITION BY log_name, caseid, st) - 1) / 2)::BIGINT AS rk FROM {t}),
lay AS (SELECT DISTINCT log_name, caseid, rk, task FROM rk),
edge AS (SELECT a.log_name, a.caseid, a.rk, a.task AS src, b.task AS dst FROM lay a JOIN lay b ON a.log_name = b.log_name AND a.caseid = b.caseid AND b.rk = a.rk + 1),
node AS (SELECT DISTINCT log_name, caseid, task FROM {t} WHERE task IS NOT NULL)"""


def _rules(t: str) -> str:
    return f"""tk AS (SELECT DISTINCT log_name, task FROM {t}),
raw AS (
  SELECT a.log_name, a.task || ' >> ' || b.task AS rule_id, '=0.25' AS raw_variation, 'directly' AS kind, a.task AS a, b.task AS b FROM tk a JOIN tk b ON a.log_name = b.log_name
  UNION ALL SELECT a.log_name, a.task || ' >> * >> ' || b.task, '+0.1', 'eventually', a.task, b.task FROM tk a JOIN tk b ON a.log_name = b.log_name
  UNION ALL SELECT log_name, task, '=0.5', 'required', task, NULL FROM tk
  UNION ALL SELECT log_name, '^' || task, NULL, 'not_allowed', task, NULL FROM tk)"""


#: Verdict of every rule on every case, after _graph and _rules; the closure by recursion over distinct edges.
_CHECKED = """e2 AS (SELECT DISTINCT log_name, caseid, src, dst FROM edge),
reach AS (SELECT log_name, caseid, task AS a, task AS b FROM node UNION SELECT r.log_name, r.caseid, r.a, e.dst FROM reach r JOIN e2 e ON r.log_name = e.log_name AND r.caseid = e.caseid AND r.b = e.src),
cs AS (SELECT DISTINCT log_name, caseid FROM node),
checked AS (
  SELECT c.log_name, c.caseid, w.rule_id, w.raw_variation, CASE w.kind
    WHEN 'eventually' THEN r.a IS NOT NULL WHEN 'directly' THEN e.src IS NOT NULL AND w.a <> w.b
    WHEN 'required' THEN n.task IS NOT NULL ELSE n.task IS NULL END AS ok
  FROM cs c JOIN raw w ON c.log_name = w.log_name
  LEFT JOIN node n ON n.log_name = c.log_name AND n.caseid = c.caseid AND n.task = w.a
  LEFT JOIN e2 e ON w.kind = 'directly' AND e.log_name = c.log_name AND e.caseid = c.caseid AND e.src = w.a AND e.dst = w.b
  LEFT JOIN reach r ON w.kind = 'eventually' AND r.log_name = c.log_name AND r.caseid = c.caseid AND r.a = w.a AND r.b = w.b)"""
_VAR = "CASE WHEN raw_variation IS NOT NULL THEN substr(raw_variation, 1, 1) END AS variation_op, try_cast(substr(raw_variation, 2) AS DOUBLE) AS variation_value"
_FREQ = "freq AS (SELECT log_name, src, dst, count(DISTINCT caseid) AS cases, count(*) AS occurrences FROM edge GROUP BY ALL)"
_MODEL = f"""{_FL}, {_graph("fl")}, {_FREQ},
el AS (SELECT log_name AS model_id, row_number() OVER (PARTITION BY log_name ORDER BY task) - 1 AS ordinal, CASE WHEN task = 'signup' THEN 'userTask' ELSE 'task' END AS tag, 'n_' || task AS element_id, task AS name FROM (SELECT DISTINCT log_name, task FROM fl)),
flows AS (SELECT model_id, row_number() OVER (PARTITION BY model_id ORDER BY flow_id) - 1 AS ordinal, flow_id, source_ref, target_ref FROM (
  SELECT model_id, 'f_' || name AS flow_id, element_id AS source_ref, 'g_' || name AS target_ref FROM el
  UNION ALL SELECT log_name, 'f_' || src || '_' || dst, 'g_' || src, 'n_' || dst FROM freq)),
br AS (SELECT log_name AS model_id, 'g_' || src AS gateway_id, src AS start_task, dst AS end_task FROM freq),
seq AS (SELECT *, row_number() OVER (PARTITION BY log_name, caseid ORDER BY st, ord) AS pos FROM fl),
place AS (SELECT log_name, caseid, task, min(pos) AS lo, max(pos) AS hi FROM seq GROUP BY ALL),
hit AS (SELECT b.*, x.caseid FROM br b JOIN place x ON x.log_name = b.model_id AND x.task = b.start_task JOIN place y ON y.log_name = b.model_id AND y.caseid = x.caseid AND y.task = b.end_task AND x.lo < y.hi),
cnt AS (SELECT b.model_id, b.gateway_id, b.start_task, b.end_task, count(h.caseid) AS cases FROM br b LEFT JOIN hit h ON b.model_id = h.model_id AND b.gateway_id = h.gateway_id AND b.end_task = h.end_task GROUP BY ALL),
ratio AS (SELECT c.model_id, c.gateway_id, f.flow_id, f.ordinal,
  CASE WHEN c.total > 0 THEN format('{{:.2f}}', c.cases / c.total)::DOUBLE END AS probability
  FROM (SELECT *, sum(cases) OVER (PARTITION BY model_id, gateway_id) AS total FROM cnt) c JOIN flows f ON f.model_id = c.model_id AND f.target_ref = 'n_' || c.end_task)"""
_NAT = """nat AS (SELECT 'm' || c_nationkey AS model_id, o.*, c.* FROM orders o JOIN customer c ON o_custkey = c_custkey),
asis AS (SELECT DISTINCT model_id, lower(o_orderpriority) AS name, 't_' || o_orderpriority AS id FROM nat),
tobe AS (SELECT DISTINCT model_id, upper(o_orderpriority) AS name, 'x_' || o_orderpriority AS id FROM nat WHERE o_orderstatus = 'F'),
res AS (SELECT DISTINCT model_id, c_mktsegment AS profile, c_custkey AS k, 'c' || c_custkey AS rid, c_name, c_acctbal, 't_' || o_orderpriority AS task_id FROM nat),
matched AS (SELECT coalesce(a.model_id, b.model_id) AS model_id, lower(coalesce(a.name, b.name)) AS key, coalesce(a.name, b.name) AS name, a.id AS asis_id, b.id AS tobe_id FROM asis a FULL JOIN tobe b ON a.model_id = b.model_id AND a.name = lower(b.name))"""


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _text(array) -> F.Column:
    return F.array_join(array, "|")


def _parsed(log: DataFrame) -> DataFrame:
    return R.parse(A.raw_rules(log))


# ---- sources and sinks


def _csv(s: SparkSession, d: str, gzip: bool = False) -> str:
    events = A.table(s, d, "events").select(F.col("event_id").alias("Event"), F.col("user_id").alias("Case ID"), F.col("event_type").alias("Activity"), *(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias(c) for c, at in (("Time", F.col("ts")), ("Done", F.col("ts") + F.expr("interval 90 seconds")))))
    return L.write_log(events, L.scratch(s, "events"), gzip=gzip)


@query("S1_scan_logs", """SELECT event_id::VARCHAR AS event, user_id::VARCHAR AS caseid, event_type AS task FROM events""")
def s1(s, d):
    return L.scan_logs(s, _csv(s, d)).select(F.col("Event").alias("event"), F.col("Case ID").alias("caseid"), F.col("Activity").alias("task"))


@query("S2_normalize_log", """SELECT 1 AS stamps, event_id::VARCHAR AS event, user_id::VARCHAR AS caseid, event_type AS task, epoch_us(ts)::BIGINT AS start_us, epoch_us(ts)::BIGINT AS end_us FROM events
UNION ALL SELECT 2, event_id::VARCHAR, user_id::VARCHAR, event_type, epoch_us(ts)::BIGINT, epoch_us(ts)::BIGINT + 90000000 FROM events""")
def s2(s, d):
    raw = L.scan_logs(s, _csv(s, d), ("Event", "Case ID", "Activity", "Time", "Done"))
    names = {"Case ID": "caseid", "Activity": "task", "Event": "event"}
    one = L.normalize_log(raw, names | {"Time": "end_timestamp"}, "%Y-%m-%dT%H:%M:%S.%f", one_timestamp=True)
    two = L.normalize_log(raw, names | {"Time": "start_timestamp", "Done": "end_timestamp"}, "%Y-%m-%dT%H:%M:%S.%f")
    told = lambda log, n: log.select(F.lit(n).alias("stamps"), "event", "caseid", "task", F.unix_micros("start_timestamp").alias("start_us"), F.unix_micros("end_timestamp").alias("end_us"))
    return told(one, 1).union(told(two, 2))


@query("S3_write_log", """SELECT log_name, caseid, task, ord::VARCHAR AS ord FROM (WITH """ + _EV + """ SELECT * FROM ev)""")
def s3(s, d):
    path = L.write_log(L.drop_boundary_tasks(A.events_log(s, d)).select("log_name", "caseid", "task", F.col("input_ordinal").alias("ord")), L.scratch(s, "log"))
    return s.read.option("header", True).csv(path)


@query("S4_gzip_log", """SELECT event_id::VARCHAR AS event, event_type AS task FROM events""")
def s4(s, d):
    source = L.write_log(A.table(s, d, "events").select(F.col("event_id").alias("event"), F.col("event_type").alias("task")), L.scratch(s, "log") + ".csv")
    target = L.scratch(s, "log-gz")
    L.gzip_log(s, source, target)
    return s.read.option("header", True).csv(target)


def _models(s, d) -> DataFrame:
    log = A.fleet_log(s, d)
    return S.read_models(s, S.write_models(A.bpmn_processes(*A.model_parts(log)), L.scratch(s, "models")))


@query("S5_scan_flows", f"WITH RECURSIVE {_MODEL} SELECT model_id, ordinal::INT AS ordinal, flow_id, source_ref, target_ref FROM flows")
def s5(s, d):
    return S.scan_flows(_models(s, d))


@query("S6_scan_gateways", f"WITH {_MODEL} SELECT model_id, ordinal::INT AS ordinal, 'g_' || name AS gateway_id, 'Diverging' AS direction FROM el")
def s6(s, d):
    return S.scan_gateways(_models(s, d))


@query("S7_scan_elements", f"WITH {_MODEL} SELECT model_id, tag, element_id, name FROM el")
def s7(s, d):
    return S.last_named(S.all_elements(_models(s, d))).drop("ordinal")


@query("S8_scan_tasks", f"WITH {_MODEL} SELECT model_id, element_id, name FROM el WHERE tag = 'task'")
def s8(s, d):
    return S.scan_tasks(S.all_elements(_models(s, d))).select("model_id", "element_id", "name")


_PARAMS = f"""WITH {_NAT}, t AS (SELECT model_id, profile, k, rid, c_name, c_acctbal, string_agg(task_id, '+' ORDER BY task_id) AS tasks FROM res GROUP BY ALL)
SELECT n.model_id, n.arrival, n.calendars, r.resources, p.dist, g.gates FROM
 (SELECT model_id, 'norm:' || count(*)::DOUBLE || ',' || count(DISTINCT c_custkey)::DOUBLE AS arrival, '[{{"id":"default","slots":' || count(*) || '}}]' AS calendars FROM nat GROUP BY 1) n
 JOIN (SELECT model_id, string_agg(profile || '/' || rid || '/' || c_name || '/' || CASE WHEN c_acctbal >= 0 THEN c_acctbal::VARCHAR ELSE '' END || '/' || tasks, '|' ORDER BY profile, k) AS resources FROM t GROUP BY 1) r USING (model_id)
 JOIN (SELECT model_id, string_agg('t_' || o_orderpriority || ':' || m || ':' || '[{{"of":' || m::BIGINT || '}}]', '|' ORDER BY o_orderpriority) AS dist FROM (SELECT model_id, o_orderpriority, count(*)::DOUBLE AS m FROM nat GROUP BY ALL) GROUP BY 1) p USING (model_id)
 JOIN (SELECT model_id, string_agg('g/f_' || o_orderstatus || ':' || m, '|' ORDER BY o_orderstatus) AS gates FROM (SELECT model_id, o_orderstatus, count(*)::DOUBLE AS m FROM nat GROUP BY ALL) GROUP BY 1) g USING (model_id)"""


def _params_text(params: DataFrame) -> DataFrame:
    """Every nested field of simulation parameters as text, a column each."""
    blank = lambda x: F.coalesce(x.cast("string"), F.lit(""))
    listed = lambda col, item: _text(F.flatten(F.transform(col, item)))
    resource = lambda p: F.transform(p["resource_list"], lambda r: F.concat_ws("/", p["id"], r["id"], r["name"], blank(r["cost_per_hour"]), F.array_join(r["assignedTasks"], "+")))
    gate = lambda g: F.transform(g["probabilities"], lambda x: F.concat(g["gateway_id"], F.lit("/"), x["path_id"], F.lit(":"), x["value"].cast("string")))
    values = F.array_join(F.transform("arrival_time_distribution.distribution_params", lambda v: v["value"].cast("string")), ",")
    return params.select(
        "model_id", F.concat_ws(":", "arrival_time_distribution.distribution_name", values).alias("arrival"), F.to_json("resource_calendars").alias("calendars"),
        listed("resource_profiles", resource).alias("resources"), _text(F.transform("task_resource_distribution", lambda x: F.concat_ws(":", x["task_id"], x["mean"].cast("string"), F.to_json(x["resources"])))).alias("dist"),
        listed("gateway_branching_probabilities", gate).alias("gates"),
    )


@query("S9_scan_params", _PARAMS)
def s9(s, d):
    """Parameters of one model a file, over any number of lines."""
    path = L.scratch(s, "params")
    params = A.nation_params(s, d)
    params.select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("value"), F.col("model_id").alias("m")).write.partitionBy("m").option("lineSep", "\n").text(path)
    return _params_text(S.scan_params(s, path, per_file=True))


_STATS = """st AS (SELECT year(l_shipdate)::VARCHAR AS file, l_returnflag || ', "' || l_linestatus || '"' AS name, count(*) AS n, sum(l_quantity) / count(*) AS a, min(l_quantity) AS lo, max(l_quantity) AS hi, sum(l_quantity) AS s FROM lineitem GROUP BY ALL),
sr AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY name) - 1 AS row FROM st)"""


def _stats(s, d) -> DataFrame:
    path = L.scratch(s, "stats")
    A.stats_text(s, d).write.partitionBy("file").text(path)
    files = s.read.text(path, wholetext=True)
    return S.stats_section(files.select(F.col("file").cast("string").alias("file"), "value"))


@query("S10_scan_stats_section", f"WITH {_STATS} SELECT file, row::INT AS row, name, n::VARCHAR AS n FROM sr")
def s10(s, d):
    return _stats(s, d).select("file", "row", F.get("cells", F.lit(0)).alias("name"), F.get("cells", F.lit(1)).alias("n"))


@query("S11_latest_run", "SELECT event_type AS log_name, 'run2' AS run_id FROM events GROUP BY 1")
def s11(s, d):
    root = L.scratch(s, "runs")
    counts = A.table(s, d, "events").groupBy("event_type").count()
    for run in ("run1", "run2"):  # the second write is the later one
        counts.select(F.col("event_type").alias("log"), F.lit(run).alias("run"), "count").write.mode("append").partitionBy("log", "run").csv(root)
    return L.latest_run(s, root)


@query("S12_list_logs", f"WITH {_FL} SELECT DISTINCT log_name FROM fl")
def s12(s, d):
    return L.list_logs(A.fleet_log(s, d))


@query("S13_write_params", _PARAMS)
def s13(s, d):
    return _params_text(S.scan_params(s, S.write_params(A.nation_params(s, d), L.scratch(s, "params"))))


@query("S14_write_report")
def s14(s, d):
    stats = _stats(s, d)
    lines = T.report_header(stats).unionByName(T.task_report(stats))
    return s.read.text(S.write_report(lines, L.scratch(s, "report"))).select(F.col("value").alias("line"))


_TRACES = f"""WITH {_EV}, seq AS (SELECT *, row_number() OVER (PARTITION BY caseid ORDER BY st, ord) AS pos FROM ev)
SELECT caseid, count(*)::INT * 2 AS events, string_agg(task || ',' || split_part(caseid, '-', 1) || ',' || tr || ',' || strftime(st, '%Y-%m-%dT%H:%M:%S.%g+00:00') || ',Ordinal=' || ord, '|' ORDER BY pos, h) AS said FROM seq, (VALUES (0, 'start'), (1, 'complete')) v(h, tr) GROUP BY 1"""
_TRACES = _TRACES.replace("count(*)::INT * 2", "count(*)::INT")


def _traces_text(docs: DataFrame) -> DataFrame:
    """Case, number of events, and every attribute of each event in order, whole numbers with their keys."""
    values = lambda tags: F.array_join(F.transform(tags, lambda t: t["_value"]), ",")
    numbers = lambda tags: F.array_join(F.transform(tags, lambda t: F.concat_ws("=", t["_key"], t["_value"])), ",")
    said = F.transform("event", lambda e: F.concat_ws(",", values(e["string"]), values(e["date"]), numbers(e["int"])))
    return docs.select(F.get("string", F.lit(0))["_value"].alias("caseid"), F.size("event").alias("events"), _text(said).alias("said"))


def _traces(s, d) -> DataFrame:
    return X.trace_docs(X.lifecycle_rows(A.events_log(s, d), extra=("input_ordinal",)), {"input_ordinal": "Ordinal"})


@query("S15_export_lifecycle", _TRACES)
def s15(s, d):
    return _traces_text(X.read_traces(s, X.write_traces(_traces(s, d), L.scratch(s, "xes"))))


_RULE_SQL = f"""SELECT rule_id, kind AS rule_type, concat_ws('|', a, b) AS path, {_VAR}, concat_ws('__', kind, replace(a, ' ', '_'), replace(b, ' ', '_')) AS label FROM raw"""
_EV_RULES = f"WITH {_EV}, {_rules('ev')} "


@query("S16_load_rules", _EV_RULES + _RULE_SQL)
def s16(s, d):
    return _parsed(A.events_log(s, d)).select("rule_id", "rule_type", _text("path").alias("path"), "variation_op", "variation_value", "label")


@query("S16_read_ini", _EV_RULES + _RULE_SQL)
def s16_ini(s, d):
    """Rules written as INI files, one each, and read back."""
    raw = A.raw_rules(A.events_log(s, d))
    path = L.scratch(s, "rules")
    line = F.concat(F.lit("# rule\n[OTHER]\npath = none\n[RULES]\npath = "), "raw_path", F.lit("\n"), F.coalesce(F.concat(F.lit("Variation: "), "raw_variation"), F.lit("; no target")))
    raw.select(line.alias("value"), F.md5(F.col("rule_id").cast("binary")).alias("rule")).write.partitionBy("rule").text(path)
    files = s.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return R.parse(R.read_ini(files)).select(F.col("raw_path").alias("rule_id"), "rule_type", _text("path").alias("path"), "variation_op", "variation_value", "label")


# ---- projections and expressions


@query("P1_rule_path", _EV_RULES + "SELECT rule_id, concat_ws('|', a, b) AS path FROM raw")
def p1(s, d):
    return A.raw_rules(A.events_log(s, d)).select("rule_id", _text(R.path(F.col("raw_path"))).alias("path"))


@query("P2_rule_type", _EV_RULES + "SELECT rule_id, kind AS rule_type FROM raw")
def p2(s, d):
    return A.raw_rules(A.events_log(s, d)).select("rule_id", R.rule_type(F.col("raw_path")).alias("rule_type"))


@query("P3_rule_variation", _EV_RULES + f"SELECT rule_id, {_VAR} FROM raw")
def p3(s, d):
    v = F.col("raw_variation")
    return A.raw_rules(A.events_log(s, d)).select("rule_id", R.variation_op(v).alias("variation_op"), R.variation_value(v).alias("variation_value"))


@query("P4_rule_label", _EV_RULES + "SELECT rule_id, concat_ws('__', kind, replace(a, ' ', '_'), replace(b, ' ', '_')) AS label FROM raw")
def p4(s, d):
    return _parsed(A.events_log(s, d)).select("rule_id", "label")


@query("P5_drop_boundary_tasks", """SELECT event_id, CASE event_type WHEN 'signup' THEN 'Start' ELSE event_type END AS task FROM events WHERE event_type <> 'signup'""")
def p5(s, d):
    task = F.when(F.col("event_type") == "signup", "Start").otherwise(F.col("event_type")).alias("task")
    return L.drop_boundary_tasks(A.table(s, d, "events").select("event_id", task))


@query("P6_lower_key", "SELECT c_custkey, lower(c_name) AS key FROM customer")
def p6(s, d):
    return A.table(s, d, "customer").select("c_custkey", F.lower("c_name").alias("key"))


@query("P7_timestamps", "SELECT event_id, epoch_us(ts)::BIGINT AS us FROM events")
def p7(s, d):
    return A.table(s, d, "events").select("event_id", F.unix_micros(F.col("ts").cast("string").cast("timestamp")).alias("us"))


@query("P8_default_attrs", "SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal::VARCHAR ELSE '20' END AS cost FROM customer")
def p8(s, d):
    return A.table(s, d, "customer").select("c_custkey", V.default_text(F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")), E.DEFAULT_COST).alias("cost"))


@query("P9_drop_null_attrs", "SELECT c_custkey, c_name || CASE WHEN c_acctbal >= 0 THEN '|' || c_acctbal::VARCHAR ELSE '' END AS attrs FROM customer")
def p9(s, d):
    attrs = F.filter(F.array(F.col("c_name"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal").cast("string"))), lambda x: x.isNotNull())
    return A.table(s, d, "customer").select("c_custkey", _text(attrs).alias("attrs"))


@query("P10_upper_dist", "SELECT c_custkey, upper(c_mktsegment) AS dist FROM customer")
def p10(s, d):
    return A.table(s, d, "customer").select("c_custkey", F.upper("c_mktsegment").alias("dist"))


@query("P11_py_round2", "SELECT l_orderkey, l_linenumber, l_partkey, format('{:.2f}', l_quantity / 7 + l_linenumber / 8)::DOUBLE AS r FROM lineitem")
def p11(s, d):
    return A.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", V.round2(F.col("l_quantity") / 7 + F.col("l_linenumber") / 8).alias("r"))


@query("P12_fmt2", "SELECT o_orderkey, format('{:,.2f}', o_totalprice) AS t FROM orders")
def p12(s, d):
    return A.table(s, d, "orders").select("o_orderkey", V.fmt2(F.col("o_totalprice")).alias("t"))


@query("P13_int_trunc", "SELECT c_custkey, trunc(c_acctbal)::BIGINT AS n FROM customer")
def p13(s, d):
    return A.table(s, d, "customer").select("c_custkey", V.int_trunc(F.col("c_acctbal").cast("string")).alias("n"))


# ---- ordering and windows


@query("W1_avg_rank", f"WITH {_LI}, {_graph('li')} SELECT caseid, task, epoch_us(st)::BIGINT AS us, rk FROM rk")
def w1(s, d):
    return G.avg_rank(A.lineitem_log(s, d)).select("caseid", "task", F.unix_micros("start_timestamp").alias("us"), "rk")


@query("W1_rejects", f"WITH {_RG} SELECT log_name, count(*) AS rows, count(*) FILTER (WHERE caseid IS NULL) AS no_case, count(*) FILTER (WHERE st IS NULL) AS no_start FROM rg GROUP BY 1")
def w1_rejects(s, d):
    return G.rejects(A.ragged_log(s, d))


@query("W2_order_case", f"WITH {_OR} SELECT caseid, ord, row_number() OVER (PARTITION BY caseid ORDER BY st, ord)::INT AS pos FROM od")
def w2(s, d):
    return G.order_case(A.orders_log(s, d)).select("caseid", F.col("input_ordinal").alias("ord"), "pos")


@query("W3_sequence", f"WITH {_EV} SELECT caseid, string_agg(task, '|' ORDER BY st, ord) AS trace FROM ev GROUP BY 1")
def w3(s, d):
    return G.sequences(A.events_log(s, d)).select("caseid", _text("trace").alias("trace"))


@query("W4_next_task", f"WITH {_OR} SELECT caseid, ord, lead(task) OVER (PARTITION BY caseid ORDER BY st, ord) AS next_task FROM od")
def w4(s, d):
    return G.next_task(A.orders_log(s, d)).select("caseid", F.col("input_ordinal").alias("ord"), "next_task")


@query("W5_trace_order", f"WITH {_EV} SELECT caseid, ord, row_number() OVER (PARTITION BY caseid ORDER BY st, ord)::INT AS pos FROM ev")
def w5(s, d):
    return G.trace_order(A.events_log(s, d), True).select("caseid", F.col("input_ordinal").alias("ord"), "pos")


# ---- directly-follows graphs and conformance


@query("G1_dfg_untied", f"WITH {_EV}, {_graph('ev')} SELECT caseid, rk, src, dst FROM edge")
def g1(s, d):
    return G.dfg(A.events_log(s, d)).drop("log_name")


@query("G2_dfg_tied", f"WITH {_LI}, {_graph('li')}, ties AS (SELECT caseid FROM li GROUP BY 1 HAVING count(*) > count(DISTINCT st)) SELECT caseid, rk, src, dst FROM edge SEMI JOIN ties USING (caseid)")
def g2(s, d):
    log = A.lineitem_log(s, d)
    tied = G.has_ties(log).where("tied").select("log_name", "caseid")
    return G.dfg(log.join(tied, ["log_name", "caseid"], "left_semi")).drop("log_name")


@query("G3_case_nodes", f"WITH {_LI}, {_graph('li')} SELECT caseid, string_agg(task, '|' ORDER BY task) AS nodes FROM node GROUP BY 1")
def g3(s, d):
    return G.case_graph(A.lineitem_log(s, d), ()).select("caseid", _text("nodes").alias("nodes"))


@query("G4_case_edges", f"WITH {_LI}, {_graph('li')} SELECT caseid, string_agg(src || '>' || dst, '|' ORDER BY src, dst) AS edges FROM (SELECT DISTINCT caseid, src, dst FROM edge) GROUP BY 1")
def g4(s, d):
    return G.case_graph(A.lineitem_log(s, d), ("edges",)).where(F.size("edges") > 0).select("caseid", _text(F.transform("edges", lambda e: F.concat_ws(">", e["src"], e["dst"]))).alias("edges"))


def _conform(name: str, kind: str) -> None:
    sql = f"WITH RECURSIVE {_LI}, {_graph('li')}, {_rules('li')}, {_CHECKED} SELECT rule_id, count(*) FILTER (WHERE ok) AS positive, count(*) AS total FROM checked JOIN (SELECT DISTINCT rule_id, kind FROM raw) USING (rule_id) WHERE kind = '{kind}' GROUP BY 1"

    def run(s, d):
        log = A.lineitem_log(s, d)
        rules = _parsed(log).where(F.col("rule_type") == kind)
        return G.log_stats(log, rules).drop("log_name")

    query(name, sql)(run)


for _name, _kind in (("G5_rule_eventually", "eventually"), ("G6_rule_not_allowed", "not_allowed"), ("G7_rule_directly", "directly"), ("G8_rule_required", "required")):
    _conform(_name, _kind)

_CV = """cv AS (SELECT 'conversations' AS log_name, conv_id::VARCHAR AS caseid, role AS task, to_timestamp(turn) AS st FROM conversations)"""


@query("G9_conform_list", f"WITH RECURSIVE {_CV}, {_graph('cv')}, {_rules('cv')}, {_CHECKED} SELECT caseid, rule_id, ok FROM checked")
def g9(s, d):
    traces = A.conversations(s, d)
    rules = _parsed(traces.select("log_name", F.explode("trace").alias("task")))
    return G.conform(G.list_graph(traces), rules).drop("log_name")


@query("G10_conform_case", f"WITH RECURSIVE {_EV}, {_graph('ev')}, {_rules('ev')}, {_CHECKED} SELECT caseid, rule_id, ok FROM checked")
def g10(s, d):
    log = A.events_log(s, d)
    return G.conform(G.case_graph(log), _parsed(log)).drop("log_name")


@query("G11_conform_stats", f"WITH RECURSIVE {_EV}, {_graph('ev')}, {_rules('ev')}, {_CHECKED} SELECT log_name, rule_id, count(*) FILTER (WHERE ok) AS positive, count(*) AS total FROM checked GROUP BY ALL")
def g11(s, d):
    log = A.events_log(s, d)
    return G.log_stats(log, _parsed(log), G.case_counts(log))


@query("G11_conform_ragged", f"WITH RECURSIVE {_RG}, {_graph('ok')}, {_rules('ok')}, {_CHECKED} SELECT rule_id, count(*) FILTER (WHERE ok) AS positive, count(*) AS total FROM checked GROUP BY ALL")
def g11_ragged(s, d):
    """Rules over a log that has rows without a case or a start time."""
    log = A.ragged_log(s, d)
    return G.log_stats(log, _parsed(log), G.case_counts(log)).drop("log_name")


# ---- models and branches


def _parts(s, d) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    log = A.fleet_log(s, d)
    return log, *A.model_parts(log)


def _nodes(gates: DataFrame) -> DataFrame:
    return gates.select("model_id", F.col("gateway_id").alias("node"))


@query("J1_flow_predecessors", f"WITH {_MODEL} SELECT model_id, target_ref AS node, source_ref AS neighbour FROM flows WHERE target_ref LIKE 'g\\_%' ESCAPE '\\'")
def j1(s, d):
    _, flows, _, gates = _parts(s, d)
    return B.flow_predecessors(flows, _nodes(gates))


@query("J2_flow_successors", f"WITH {_MODEL} SELECT model_id, source_ref AS node, target_ref AS neighbour FROM flows WHERE source_ref LIKE 'g\\_%' ESCAPE '\\'")
def j2(s, d):
    _, flows, _, gates = _parts(s, d)
    return B.flow_successors(flows, _nodes(gates))


@query("J3_look_through", f"WITH {_MODEL} SELECT a.model_id, a.source_ref AS node, e.name FROM flows a JOIN flows b ON a.model_id = b.model_id AND a.target_ref = b.source_ref JOIN el e ON e.model_id = b.model_id AND e.element_id = b.target_ref WHERE a.source_ref LIKE 'n%'")
def j3(s, d):
    _, flows, elements, _ = _parts(s, d)
    nodes = elements.select("model_id", F.col("element_id").alias("node"))
    return B.look_through(B.flow_successors(flows, nodes), flows, elements, True)


@query("J4_gateway_branches", f"WITH {_MODEL} SELECT * FROM br")
def j4(s, d):
    _, flows, elements, gates = _parts(s, d)
    return B.gateway_branches(flows, elements, gates)


@query("A1_branch_match", f"WITH {_MODEL} SELECT model_id, gateway_id, start_task, end_task, caseid FROM hit")
def a1(s, d):
    log, flows, elements, gates = _parts(s, d)
    return B.branch_match(B.gateway_branches(flows, elements, gates), log).drop("times")


def _counts(s, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    log, flows, elements, gates = _parts(s, d)
    return L.stored(B.branch_counts(L.stored(B.gateway_branches(flows, elements, gates), "branches"), log), "branch-counts"), flows, elements


@query("A2_branch_counts", f"WITH {_MODEL} SELECT * FROM cnt")
def a2(s, d):
    return _counts(s, d)[0]


@query("A3_branch_ratio", f"WITH {_MODEL} SELECT model_id, gateway_id, flow_id, probability FROM ratio")
def a3(s, d):
    return B.branch_ratio(*_counts(s, d)).drop("ordinal")


@query("A4_branch_residual", f"""WITH {_MODEL}, fx AS (SELECT *, probability::DECIMAL(10,2) AS p, row_number() OVER (PARTITION BY model_id, gateway_id ORDER BY probability DESC NULLS LAST, ordinal) AS nth,
  sum(probability::DECIMAL(10,2)) OVER (PARTITION BY model_id, gateway_id) AS total FROM ratio)
SELECT model_id, gateway_id, flow_id, (CASE WHEN nth = 1 THEN p + (1 - total) ELSE p END)::DOUBLE AS probability FROM fx""")
def a4(s, d):
    return B.branch_residual(B.branch_ratio(*_counts(s, d))).drop("ordinal")


@query("W6_first_max", f"WITH {_MODEL} SELECT model_id, gateway_id, arg_min(flow_id, (-probability, ordinal)) AS flow_id FROM ratio WHERE probability IS NOT NULL GROUP BY ALL")
def w6(s, d):
    return B.first_max(B.branch_ratio(*_counts(s, d))).where("probability is not null").select("model_id", "gateway_id", "flow_id")


@query("A5_distinct_cases", f"WITH {_FL} SELECT log_name, count(DISTINCT caseid) AS cases FROM fl GROUP BY 1")
def a5(s, d):
    return B.distinct_cases(A.fleet_log(s, d))


_RESOLVED = """SELECT r.model_id, r.gateway_id, r.flow_id, r.probability, {to} AS resolved_flow FROM ratio r LEFT JOIN (
  SELECT f.model_id, f.flow_id, g.source_ref AS gateway_id, arg_min(g.flow_id, g.ordinal) AS to_flow FROM flows f JOIN flows g ON f.model_id = g.model_id AND f.source_ref = g.target_ref GROUP BY ALL
) x ON x.model_id = r.model_id AND x.flow_id = r.flow_id AND x.gateway_id = {gate}"""


def _by_task(ratios: DataFrame) -> DataFrame:
    """The gateway's task stands for it, so that some branches resolve through the task's flow."""
    return ratios.withColumn("gateway_id", F.regexp_replace("gateway_id", "^g_", "n_"))


@query("J11_resolve_branch_flow", f"WITH {_MODEL} " + _RESOLVED.format(to="coalesce(to_flow, r.flow_id)", gate="'n' || substr(r.gateway_id, 2)").replace("r.gateway_id, r.flow_id, r.prob", "'n' || substr(r.gateway_id, 2) AS gateway_id, r.flow_id, r.prob"))
def j11(s, d):
    counts, flows, elements = _counts(s, d)
    return B.resolve_branch_flow(_by_task(B.branch_ratio(counts, flows, elements)).drop("ordinal"), flows)


@query("J12_resolve_branch_flow_strict", f"WITH {_MODEL} " + _RESOLVED.format(to="to_flow", gate="'n' || substr(r.gateway_id, 2)").replace("r.gateway_id, r.flow_id, r.prob", "'n' || substr(r.gateway_id, 2) AS gateway_id, r.flow_id, r.prob"))
def j12(s, d):
    counts, flows, elements = _counts(s, d)
    return B.resolve_branch_flow(_by_task(B.branch_ratio(counts, flows, elements)).drop("ordinal"), flows, strict=True)


@query("J13_first_out_gateway", f"WITH {_MODEL} SELECT e.model_id, e.name AS start_task, arg_min(f.target_ref, f.ordinal) AS gateway_id FROM el e JOIN flows f ON f.model_id = e.model_id AND f.source_ref = e.element_id GROUP BY ALL")
def j13(s, d):
    _, flows, elements, _ = _parts(s, d)
    return B.first_out_gateway(flows, elements).drop("task_ordinal")


@query("J14_flows_by_target", f"WITH {_MODEL} SELECT f.model_id, e.name AS end_task, f.flow_id FROM flows f JOIN el e ON e.model_id = f.model_id AND e.element_id = f.target_ref")
def j14(s, d):
    _, flows, elements, _ = _parts(s, d)
    return B.flows_by_target(flows, elements).drop("ordinal")


# ---- matching and parameters


def _pair(s, d) -> tuple[DataFrame, DataFrame]:
    return A.nation_elements(s, d, False), A.nation_elements(s, d, True)


@query("J5_match_tasks", f"WITH {_NAT} SELECT * FROM matched")
def j5(s, d):
    return M.match_tasks(*_pair(s, d))


@query("U2_union_names", f"WITH {_NAT} SELECT model_id, key FROM matched")
def u2(s, d):
    return M.match_tasks(*_pair(s, d)).select("model_id", "key")


def _tasks_of(params: DataFrame) -> DataFrame:
    return E.task_resources(params).select("model_id", "task_id", _text("resources").alias("resources"))


_MAPPED = "mapped AS (SELECT r.*, m.tobe_id FROM res r JOIN matched m ON m.model_id = r.model_id AND m.asis_id = r.task_id WHERE m.tobe_id IS NOT NULL)"
_LISTED = "SELECT model_id, {t} AS task_id, string_agg(rid, '|' ORDER BY profile, k) AS resources FROM {f} GROUP BY ALL"


@query("J6_remap_assigned", f"WITH {_NAT}, {_MAPPED} " + _LISTED.format(t="tobe_id", f="mapped"))
def j6(s, d):
    return _tasks_of(M.remap_assigned(A.nation_params(s, d), M.id_maps(M.match_tasks(*_pair(s, d)))))


_DIST = """SELECT n.model_id, m.tobe_id AS task_id, count(*)::DOUBLE AS mean, '[{"of":' || count(*) || '}]' AS resources FROM nat n JOIN matched m ON m.model_id = n.model_id AND m.asis_id = 't_' || n.o_orderpriority WHERE m.tobe_id IS NOT NULL GROUP BY ALL"""


@query("J7_remap_task_dist", f"WITH {_NAT} {_DIST}")
def j7(s, d):
    moved = M.remap_task_dist(A.nation_params(s, d), M.id_maps(M.match_tasks(*_pair(s, d))))
    return moved.select("model_id", F.inline("task_resource_distribution")).withColumn("resources", F.to_json("resources"))


@query("J8_transfer_fields", f"""WITH {_NAT} SELECT model_id, 'norm:' || count(*)::DOUBLE || ',' || count(DISTINCT c_custkey)::DOUBLE AS arrival,
  'MONDAY-FRIDAY 09:00:00-17:00:00|SATURDAY-SATURDAY 09:00:00-17:00:00' AS calendar, '[{{"id":"default","slots":' || count(*) || '}}]' AS calendars FROM nat GROUP BY 1""")
def j8(s, d):
    params = A.nation_params(s, d)
    none = {"arrival_time_calendar": F.filter("arrival_time_calendar", lambda _: F.lit(False)), "arrival_time_distribution": F.lit(None).cast(params.schema["arrival_time_distribution"].dataType), "resource_calendars": F.parse_json(F.lit("[]"))}
    out = M.transfer_fields(params, params.withColumns(none))
    hours = F.transform("arrival_time_calendar", lambda c: F.concat(c["from"], F.lit("-"), c["to"], F.lit(" "), c["beginTime"], F.lit("-"), c["endTime"]))
    return out.select("model_id", F.concat_ws(":", "arrival_time_distribution.distribution_name", F.array_join(F.transform("arrival_time_distribution.distribution_params", lambda v: v["value"].cast("string")), ",")).alias("arrival"), _text(hours).alias("calendar"), F.to_json("resource_calendars").alias("calendars"))


@query("J9_merge_params", f"WITH {_NAT}, {_MAPPED} " + _LISTED.format(t="tobe_id", f="mapped"))
def j9(s, d):
    params = A.nation_params(s, d)
    tobe = params.withColumn("resource_profiles", F.filter("resource_profiles", lambda _: F.lit(False)))
    return _tasks_of(M.merge_params(params, tobe, *_pair(s, d)))


@query("J10_remap_elements", f"""WITH {_NAT} SELECT a.model_id, a.id AS element_id, CASE WHEN b.id IS NOT NULL AND a.name < '3' THEN b.id ELSE a.id END AS new_id, true AS known FROM asis a LEFT JOIN tobe b ON a.model_id = b.model_id AND a.name = lower(b.name)
UNION ALL SELECT DISTINCT model_id, 'none', 'none', false FROM asis""")
def j10(s, d):
    """To-be names before 3 are spelled as the as-is ones, the others in upper case; one id is unknown."""
    asis, tobe = _pair(s, d)
    spelled = F.when(F.col("name") < "3", F.lower("name")).otherwise(F.col("name"))
    asked = asis.select("model_id", "element_id").union(asis.select("model_id", F.lit("none")).distinct())
    return M.remap_elements(asked, asis, tobe.withColumn("name", spelled))


@query("A6_task_resources", f"WITH {_NAT} " + _LISTED.format(t="task_id", f="res"))
def a6(s, d):
    return _tasks_of(A.nation_params(s, d))


@query("A7_exclusive_resource", f"WITH {_NAT} SELECT model_id, task_id, arg_min(rid, (profile, k)) AS resource_id FROM res GROUP BY ALL")
def a7(s, d):
    return E.exclusive_resource(A.nation_params(s, d))


@query("U1_union_logs", f"WITH {_EV}, {_OR} SELECT log_name, caseid, task, ord FROM ev UNION ALL SELECT log_name, caseid, task, ord FROM od")
def u1(s, d):
    return A.events_log(s, d).unionByName(A.orders_log(s, d).drop("user"), allowMissingColumns=True).select("log_name", "caseid", "task", F.col("input_ordinal").alias("ord"))


@query("U3_distinct_values", f"WITH {_FL} SELECT DISTINCT log_name, task FROM fl")
def u3(s, d):
    return A.fleet_log(s, d).select("log_name", "task").distinct()


# ---- flat parameters, export, reports


@query("E1_flat_arrival", f"WITH {_NAT} SELECT model_id, 'NORM' AS type, count(*)::DOUBLE::VARCHAR AS arg1, count(DISTINCT c_custkey)::DOUBLE::VARCHAR AS arg2, '0' AS mean, 'seconds' AS time_unit FROM nat GROUP BY 1")
def e1(s, d):
    return E.flat_arrival(A.nation_params(s, d))


@query("E2_flat_calendar", f"WITH {_NAT} SELECT DISTINCT model_id, 'default_calendar' AS calendar_id, o AS ordinal, '09:00:00' AS from_time, a AS from_week_day, '17:00:00' AS to_time, b AS to_week_day FROM nat, (VALUES (0, 'MONDAY', 'FRIDAY'), (1, 'SATURDAY', 'SATURDAY')) t(o, a, b)")
def e2(s, d):
    return E.flat_calendar(A.nation_params(s, d))


@query("E3_flat_resources", f"WITH {_NAT} SELECT DISTINCT model_id, rid AS resource_id, c_name AS name, CASE WHEN c_acctbal >= 0 THEN c_acctbal::VARCHAR ELSE '20' END AS cost_per_hour, '1' AS amount, 'default_calendar' AS calendar_id FROM res")
def e3(s, d):
    return E.flat_resources(A.nation_params(s, d)).drop("profile_no", "resource_no")


@query("E4_flat_elements", f"WITH {_NAT} SELECT model_id, md5(model_id || '|' || task_id) AS row_id, task_id AS element_id, 'FIXED' AS type, '0' AS arg1, '0' AS arg2, '60' AS mean, 'seconds' AS time_unit, string_agg(rid, '|' ORDER BY profile, k) AS resources FROM res GROUP BY ALL")
def e4(s, d):
    return E.flat_elements(A.nation_params(s, d)).withColumn("resources", _text("resources"))


@query("E5_flat_branching", f"WITH {_NAT} SELECT model_id, 'f_' || o_orderstatus AS flow_id, count(*)::DOUBLE AS probability FROM nat GROUP BY ALL")
def e5(s, d):
    return E.flat_branching(A.nation_params(s, d))


@query("E6_sim_header", f"WITH {_NAT} SELECT DISTINCT model_id, md5(model_id) AS sim_id, 'EUR' AS currency, 0 AS process_instances, '2024-01-01T00:00:00+00:00' AS start_time FROM nat")
def e6(s, d):
    return E.sim_header(A.nation_params(s, d), "2024-01-01T00:00:00")


_LIFE = f"""WITH {_FL}, seq AS (SELECT *, row_number() OVER (PARTITION BY caseid ORDER BY st, ord) AS pos FROM fl), life AS (
  SELECT log_name, caseid, (2 * pos - 1 + h)::INT AS event_no, task, split_part(caseid, '-', 1) AS usr, CASE h WHEN 0 THEN 'start' ELSE 'complete' END AS tr, CASE h WHEN 0 THEN st ELSE en END AS t FROM seq, (VALUES (0), (1)) v(h))"""


def _life(s, d) -> DataFrame:
    return X.lifecycle_rows(A.fleet_log(s, d), extra=("input_ordinal",))


@query("X1_lifecycle_rows", _LIFE + " SELECT caseid, event_no, tr AS lifecycle_transition FROM life")
def x1(s, d):
    return _life(s, d).select("caseid", "event_no", "lifecycle_transition")


@query("X2_event_attrs", _LIFE + " SELECT caseid, event_no, task AS concept_name, usr AS org_resource FROM life")
def x2(s, d):
    return _life(s, d).select("caseid", "event_no", "concept_name", "org_resource")


@query("X3_event_time", _LIFE + " SELECT caseid, event_no, epoch_us(t)::BIGINT AS us FROM life")
def x3(s, d):
    return _life(s, d).select("caseid", "event_no", F.unix_micros("time_timestamp").alias("us"))


@query("X4_extra_attrs", f"WITH {_EV}, seq AS (SELECT *, row_number() OVER (PARTITION BY caseid ORDER BY st, ord) AS pos FROM ev) SELECT caseid, pos::INT AS event_no, ord AS input_ordinal FROM seq")
def x4(s, d):
    return X.lifecycle_rows(A.events_log(s, d), True, ("input_ordinal",)).select("caseid", "event_no", "input_ordinal")


@query("X5_trace_docs", _TRACES)
def x5(s, d):
    return _traces_text(_traces(s, d))


_LINES = f"""WITH {_STATS}, ln AS (
  SELECT file, row, 0 AS i, 'Task: ' || name AS line FROM sr
  UNION ALL SELECT file, row, 1 + 4 * k + f, '- ' || ['Avg', 'Min', 'Max', 'Total'][f + 1] || ' ' || ['duration', 'waiting time', 'idle time', 'cost', 'cost over thresh', 'duration over thresh'][k + 1] || ': ' || format('{{:,.2f}}', format('{{:.2f}}', [a, lo, hi, s][f + 1])::DOUBLE) FROM sr, range(6) t(k), range(4) u(f)
  UNION ALL SELECT file, row, 25, '- Count: ' || n FROM sr UNION ALL SELECT file, row, 26, '' FROM sr)"""
ORACLE_SQL["S14_write_report"] = _LINES + """ SELECT line FROM ln UNION ALL
SELECT line FROM (SELECT DISTINCT file FROM sr), (VALUES ('Individual Task Statistics'), ('--------------------------')) t(line)"""


@query("T1_task_report", _LINES + " SELECT file, row::INT AS row, i::INT AS line_no, line FROM ln")
def t1(s, d):
    return T.task_report(_stats(s, d))


@query("T2_task_report_errors", f"""WITH {_STATS} SELECT file, row::INT AS row, [3, 27, 26][row % 3 + 1] AS lines,
  CASE row % 3 WHEN 1 THEN '- Min duration: nan' WHEN 2 THEN '- Min duration: ' || format('{{:,.2f}}', lo) END AS second,
  CASE row % 3 WHEN 0 THEN 'Error processing row ' || row || ': could not convert string to float: ''x y''' WHEN 1 THEN '' ELSE 'Error processing row ' || row || ': cannot convert float NaN to integer' END AS last FROM sr""")
def t2(s, d):
    """Of each three rows one has text for a figure, one has it missing, and one has no count."""
    kind = F.col("row") % 3
    cells = F.transform("cells", lambda c, i: F.when((i == 3) & (kind == 0), "x y").when((i == 3) & (kind == 1), "n/a").when((i == 1) & (kind == 2), "").otherwise(c))
    lines = T.task_report(_stats(s, d).withColumn("cells", cells))
    second = F.max(F.when((F.col("line_no") == 2) & (F.col("row") % 3 != 0), F.col("line")))
    return lines.groupBy("file", "row").agg(F.count("*").cast("int").alias("lines"), second.alias("second"), F.max_by("line", "line_no").alias("last"))


@query("T3_report_header", f"""WITH {_STATS} SELECT DISTINCT file, -1 AS row, i AS line_no, line FROM sr, (VALUES (0, 'Individual Task Statistics'), (1, '--------------------------')) t(i, line)""")
def t3(s, d):
    return T.report_header(_stats(s, d))


# ---- derived


@query("R1_task_durations", f"WITH {_FL}, du AS (SELECT log_name, task, (epoch_us(en) - epoch_us(st)) AS s FROM fl WHERE en IS NOT NULL) SELECT log_name, task, count(*) AS n, sum(s) / count(*) / 1e6 AS avg_s, min(s) / 1e6 AS min_s, max(s) / 1e6 AS max_s, sum(s)::DOUBLE / 1e6 AS total_s FROM du GROUP BY ALL")
def r1(s, d):
    return D.task_durations(A.fleet_log(s, d))


@query("R2_split_by_rule", f"WITH RECURSIVE {_EV}, {_graph('ev')}, {_rules('ev')}, {_CHECKED} SELECT ev.caseid, ord, ok FROM ev JOIN checked c ON c.caseid = ev.caseid WHERE rule_id = 'view >> purchase'")
def r2(s, d):
    log = A.events_log(s, d)
    good, bad = D.split_by_rule(log, _parsed(log).where("rule_id = 'view >> purchase'"))
    rows = lambda x, ok: x.select("caseid", F.col("input_ordinal").alias("ord"), F.lit(ok).alias("ok"))
    return rows(good, True).union(rows(bad, False))


@query("R3_sample_to_share", f"""WITH RECURSIVE {_EV}, {_graph('ev')}, {_rules('ev')}, {_CHECKED},
 t AS (SELECT rule_id, raw_variation, count(*) FILTER (WHERE ok) AS good, count(*) FILTER (WHERE NOT ok) AS bad FROM checked WHERE raw_variation IS NOT NULL GROUP BY ALL),
 a AS (SELECT *, CASE WHEN raw_variation[1] = '=' THEN raw_variation[2:]::DOUBLE ELSE least(1.0, good / (good + bad) + raw_variation[2:]::DOUBLE) END AS p FROM t)
 SELECT rule_id, n_good, n_bad FROM (SELECT rule_id, CASE WHEN p >= 1 THEN good ELSE least(good, floor(bad * p / (1 - p) + 1e-9)::BIGINT) END AS n_good,
  CASE WHEN p <= 0 THEN bad ELSE least(bad, floor(good * (1 - p) / p + 1e-9)::BIGINT) END AS n_bad FROM a) WHERE n_good + n_bad > 0""")
def r3(s, d):
    log = A.events_log(s, d)
    rules = _parsed(log)
    kept = D.sample_to_share(G.conform(L.stored(G.case_graph(log), "graphs"), rules), rules)
    return kept.groupBy("rule_id").agg(F.count_if("ok").alias("n_good"), F.count_if(~F.col("ok")).alias("n_bad"))


@query("R4_dfg_frequency", f"WITH {_LI}, {_graph('li')}, {_FREQ} SELECT * FROM freq")
def r4(s, d):
    return D.dfg_frequency(A.lineitem_log(s, d))


@query("R5_rule_screen", f"""WITH RECURSIVE {_FL}, {_graph('fl')}, {_rules('fl')}, {_CHECKED},
 t AS (SELECT log_name, rule_id, raw_variation, count(*) FILTER (WHERE ok) AS positive, count(*) AS total FROM checked GROUP BY ALL),
 a AS (SELECT *, positive / total AS share, CASE WHEN raw_variation[1] = '=' THEN raw_variation[2:]::DOUBLE WHEN raw_variation[1] = '+' THEN least(1.0, positive / total + raw_variation[2:]::DOUBLE) END AS target FROM t)
 SELECT log_name, rule_id, positive, total, share, target, target - share AS gap FROM a""")
def r5(s, d):
    log = A.fleet_log(s, d)
    return D.rule_screen(log, _parsed(log))


@query("R6_log_compare", f"""WITH {_EV}, {_graph('ev')}, half AS (SELECT src, dst, (split_part(caseid, '-', 1)::BIGINT % 2) AS h, count(DISTINCT caseid) AS c, count(*) AS o FROM edge GROUP BY ALL)
 SELECT src, dst, coalesce(sum(c) FILTER (WHERE h = 0), 0)::BIGINT AS asis_cases, coalesce(sum(o) FILTER (WHERE h = 0), 0)::BIGINT AS asis_occurrences, coalesce(sum(c) FILTER (WHERE h = 1), 0)::BIGINT AS tobe_cases, coalesce(sum(o) FILTER (WHERE h = 1), 0)::BIGINT AS tobe_occurrences FROM half GROUP BY ALL""")
def r6(s, d):
    log = A.events_log(s, d)
    half = lambda h: log.where(F.col("user").cast("long") % 2 == h)
    return D.log_compare(half(0), half(1))


@query("R6_share_compare", f"""WITH RECURSIVE {_EV}, {_graph('ev')}, {_rules('ev')}, {_CHECKED},
 half AS (SELECT rule_id, split_part(caseid, '-', 1)::BIGINT % 2 AS h, count(*) FILTER (WHERE ok) AS c, count(*) AS n FROM checked GROUP BY ALL)
 SELECT a.rule_id, a.c AS asis_cases, a.n AS asis_total, a.c / a.n AS asis_share, b.c AS tobe_cases, b.n AS tobe_total, b.c / b.n AS tobe_share FROM half a JOIN half b ON a.rule_id = b.rule_id AND a.h = 0 AND b.h = 1""")
def r6_share(s, d):
    log = A.events_log(s, d)
    half = lambda h: log.where(F.col("user").cast("long") % 2 == h)
    return D.share_compare(half(0), half(1), _parsed(log))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of conforming cases of every rule over the events."""
    log = A.events_log(spark, sf_dir)
    return D.rule_screen(log, _parsed(log))
