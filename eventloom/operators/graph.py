"""Ranks, directly-follows graphs and rule conformance of cases.

One exchange on the case builds everything up to ``case_graph``: rows of a case are
grouped into layers of equal average rank, and a layer's edges go to the next layer
if its rank is the next whole number (ranks leave gaps where start times are tied).
The exchange has as many tasks as the log's rows ask for, and layers need one sort.

Rows without a case or a start time have no rank; they are in no graph and no count, and
``rejects`` counts them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.values import let
from ..sources.logs import split_rejects, stored

CASE = ("log_name", "caseid")
#: The same, in the order in which rows are told apart soonest.
_KEYS = ("caseid", "log_name")
_EDGES = "array<struct<src:string,dst:string>>"
#: What a case's graph has beside its nodes.
PARTS = ("edges", "succ", "place")
#: Bits of a word.
_WORD = 64
#: Rows of a log that one task sorts, on average.
TASK_ROWS = 200_000


def rejects(log: DataFrame) -> DataFrame:
    """``log_name, rows, no_case, no_start``: rows of each log, and those that cannot be ranked."""
    one = lambda c: F.count_if(F.col(c).isNull()).alias("no_case" if c == "caseid" else "no_start")
    return log.groupBy("log_name").agg(F.count("*").alias("rows"), one("caseid"), one("start_timestamp"))


def dealt(log: DataFrame) -> DataFrame:
    """Rows of a log by case, in as many tasks as its rows ask for, so that a task's memory does not grow with the log.

    Up to ``direct`` parts are written row by row. For more, a task that reads the log would hold all its rows to sort them
    by part, so these are first dealt to ``direct`` parts, each of which is then dealt to its own share of the tasks.
    """
    sc = log.sparkSession.sparkContext
    tasks = max(sc.defaultParallelism, -(-log.count() // TASK_ROWS))
    direct = int(sc.getConf().get("spark.shuffle.sort.bypassMergeThreshold", "200"))
    if tasks > direct > 0:
        tasks = -(-tasks // direct) * direct
        log = log.repartition(direct, *CASE)
    # A constant name would be left out of the keys of windows and groups, and these would deal the rows again.
    name = F.coalesce(F.when(F.length("caseid") >= 0, F.col("log_name")), F.col("log_name"))
    return log.withColumn("log_name", name).repartition(tasks, *CASE)


def _by_time():
    return Window.partitionBy(*_KEYS).orderBy(F.col("start_timestamp").asc_nulls_last())


def _tied():
    """Rows of a case of one time; a frame, not a partition, so that ranks need one sort."""
    return _by_time().rangeBetween(Window.currentRow, Window.currentRow)


def _rank() -> Column:
    return F.floor(F.rank().over(_by_time()) + (F.count("*").over(_tied()) - 1) / 2)


def avg_rank(log: DataFrame) -> DataFrame:
    """Adds ``rk``: the average rank of the start time in its case, cut to a whole number; null where either is missing."""
    return dealt(log).withColumn("rk", F.when(F.col("caseid").isNotNull() & F.col("start_timestamp").isNotNull(), _rank()))


def order_case(log: DataFrame) -> DataFrame:
    """Adds ``pos``: the place of a row in its case, by rank, then input order; null where the row has no rank."""
    in_order = Window.partitionBy(*CASE).orderBy(F.col("start_timestamp").asc_nulls_last(), "input_ordinal")
    return log.withColumn("pos", F.when(F.col("caseid").isNotNull() & F.col("start_timestamp").isNotNull(), F.row_number().over(in_order)))


def sequences(log: DataFrame) -> DataFrame:
    """``trace``: tasks of each case in order; rows without a case or a start time are left out."""
    steps = F.array_sort(F.collect_list(F.struct("start_timestamp", "input_ordinal", "task")))
    return split_rejects(log)[0].groupBy(*CASE).agg(F.transform(steps, lambda s: s["task"]).alias("trace"))


def next_task(log: DataFrame) -> DataFrame:
    """Adds ``next_task``, the task of the following row of the case; rows without a case or a start time follow none."""
    in_order = Window.partitionBy(*CASE).orderBy(F.col("start_timestamp").asc_nulls_last(), "input_ordinal")
    after = F.lead(F.struct("start_timestamp", "task")).over(in_order)
    told = log.withColumn("next_task", after)
    there = F.col("caseid").isNotNull() & F.col("next_task.start_timestamp").isNotNull()
    return told.withColumn("next_task", F.when(there, F.col("next_task.task")))


def trace_order(log: DataFrame, one_timestamp: bool = False) -> DataFrame:
    """Adds ``pos``, the place of a row in its case by start, or by end with one timestamp.

    Cases come in no order; a sink that needs one sorts by the case id as text and ``pos``.
    """
    key = "end_timestamp" if one_timestamp else "start_timestamp"
    return log.withColumn("pos", F.row_number().over(Window.partitionBy(*CASE).orderBy(key, "input_ordinal")))


def layers(log: DataFrame) -> DataFrame:
    """Rows of one rank of a case with the distinct tasks ``t``, and those ``after`` it if the next layer's rank follows.

    ``plain`` tells whether every layer of the case has one task and follows the one before without a gap.
    """
    rows = dealt(split_rejects(log)[0].select(*CASE, "start_timestamp", "task"))
    ranked = rows.select(*CASE, "start_timestamp", _rank().alias("rk"), F.collect_set("task").over(_tied()).alias("tasks"), (F.row_number().over(_by_time()) == F.rank().over(_by_time())).alias("first"))
    by_rank = ranked.where(F.col("first") & (F.size("tasks") > 0)).select(*CASE, "start_timestamp", "rk", F.array_sort("tasks").alias("t"))
    whole = _by_time().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    plain = (F.max("rk").over(whole) - F.min("rk").over(whole) + 1 == F.count("*").over(whole)) & (F.max(F.size("t")).over(whole) == 1)
    placed = by_rank.select("*", F.lead(F.struct("rk", "t")).over(_by_time()).alias("nx"), plain.alias("plain"))
    return placed.select(*CASE, "rk", "plain", "t", F.when(F.col("nx.rk") == F.col("rk") + 1, F.col("nx.t")).otherwise(F.array().cast("array<string>")).alias("after"))


def edges_of(t: Column, after: Column) -> Column:
    return F.flatten(F.transform(t, lambda a: F.transform(after, lambda b: F.struct(a.alias("src"), b.alias("dst")))))


def dfg(log: DataFrame) -> DataFrame:
    """Edges of the cases, once for each pair of neighbouring layers: ``log_name, caseid, rk, src, dst``."""
    return layers(log).select(*CASE, "rk", F.inline(edges_of(F.col("t"), F.col("after"))))


def has_ties(log: DataFrame) -> DataFrame:
    """``log_name, caseid, tied``."""
    return log.groupBy(*CASE).agg((F.count("*") > F.count_distinct("start_timestamp")).alias("tied"))


def case_counts(log: DataFrame) -> DataFrame:
    """``log_name, total``: the cases of each log, those without any task included."""
    return split_rejects(log)[0].groupBy("log_name").agg(F.count_distinct("caseid").alias("total"))


def islands(spans: DataFrame) -> DataFrame:
    """Adds ``place`` to ``spans(log_name, caseid, task, lo, hi, ...)``, the first and last layer of each task.

    Where every layer of a case has one task and follows the one before, spans that overlap are one
    strongly connected part, and parts come one after another: a task can be reached from
    another if its place is no smaller.  A running maximum finds the parts, without a closure.
    """
    by_lo = Window.partitionBy(*_KEYS).orderBy("lo")
    before = F.max("hi").over(by_lo.rowsBetween(Window.unboundedPreceding, -1))
    new = spans.withColumn("new", F.when(F.col("lo") <= before, 0).otherwise(1))
    return new.withColumn("place", F.sum("new").over(by_lo.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("new")


def case_graph(log: DataFrame, parts: Sequence[str] = PARTS) -> DataFrame:
    """``nodes``, and of ``edges``, ``succ`` and ``place`` those that ``parts`` names, of every case.

    Nodes and edges are distinct and sorted; ``succ`` has the successors of each node, and ``place`` the number of
    its island (see ``islands``), null for a case that is not plain (see ``layers``).  Nodes alone ask for no layers, and
    edges alone for no spans of tasks.  Without edges, ``succ`` is null where there is a place, which says all it would.
    """
    given = [*CASE, "nodes", *(p for p in PARTS if p in parts)]
    if not parts:
        cases = dealt(split_rejects(log)[0].select(*CASE, "task")).groupBy(*_KEYS).agg(F.array_sort(F.collect_set("task")).alias("nodes"))
        return cases.where(F.size("nodes") > 0).select(given)
    if set(parts) == {"edges"}:
        pairs = layers(log).select(*CASE, "t", F.inline_outer(edges_of(F.col("t"), F.col("after"))))
        nodes = F.array_sort(F.array_distinct(F.flatten(F.collect_set("t"))))
        edges = F.array_sort(F.collect_set(F.when(F.col("src").isNotNull(), F.struct("src", "dst"))))
        return pairs.groupBy(*_KEYS).agg(nodes.alias("nodes"), edges.alias("edges")).select(given)
    made = layers(log).select(*CASE, "rk", "plain", F.explode("t").alias("task"), "after")
    span = [F.min("rk").alias("lo"), F.max("rk").alias("hi"), F.max("plain").alias("plain")]
    l, plain = F.col("l"), F.col("plain")
    if "edges" not in parts:
        # What a plain case needs has a fixed width. Other cases have a row for a task and what is after it; their spans are not used.
        spans = made.withColumn("after", F.when(~plain, F.col("after"))).groupBy(*_KEYS, "task", "after").agg(*span)
        cases = islands(spans).groupBy(*_KEYS).agg(F.sort_array(F.collect_list(F.struct("task", "after", "place"))).alias("l"), F.max("plain").alias("plain"))
        of = lambda x: F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter(l, lambda y: y["task"] == x), lambda y: y["after"]))))
        nodes = F.when(plain, l["task"]).otherwise(F.array_distinct(l["task"])).alias("nodes")
        succ = F.when(~plain, F.transform(F.array_distinct(l["task"]), of)).alias("succ")
        return cases.select(*CASE, nodes, succ, F.when(plain, l["place"]).alias("place")).select(given)
    spans = made.groupBy(*_KEYS, "task").agg(*span, F.array_sort(F.array_distinct(F.flatten(F.collect_set("after")))).alias("succ"))
    listed = F.array_sort(F.collect_list(F.struct("task", "succ", "place")))
    cases = islands(spans).groupBy(*_KEYS).agg(listed.alias("l"), F.max("plain").alias("plain"))
    pairs = lambda x: F.transform(x["succ"], lambda b: F.struct(x["task"].alias("src"), b.alias("dst")))
    return cases.select(*CASE, l["task"].alias("nodes"), F.flatten(F.transform(l, pairs)).alias("edges"), l["succ"].alias("succ"), F.when(plain, l["place"]).alias("place")).select(given)


def closure(nodes: Column, succ: Column) -> Column:
    """For each node the set of nodes that can be reached over one edge or more, as bits packed in longs.

    Every node in turn passes its bits on to all that have its own.
    """
    count = F.size(nodes)
    none = F.array_repeat(F.lit(0).cast("long"), F.ceil(count / _WORD).cast("int"))
    mark = lambda row, at: F.transform(row, lambda word, w: F.when(w == F.floor(at / _WORD), word.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), at % _WORD))).otherwise(word))
    own = F.transform(succ, lambda after: F.aggregate(after, none, lambda row, b: mark(row, F.array_position(nodes, b).cast("int") - 1)))
    join = lambda row, other: F.zip_with(row, other, lambda x, y: x.bitwiseOR(y))
    step = lambda rows, k: let(F.get(rows, k), lambda through: F.transform(rows, lambda row: F.when(_has(row, k), join(row, through)).otherwise(row)))
    return F.when(count > 0, F.aggregate(F.sequence(F.lit(0), count - 1), own, step))


def _has(row: Column, at: Column) -> Column:
    """Whether a set of packed bits has the one at a place."""
    return F.getbit(F.get(row, F.floor(at / _WORD).cast("int")), (at % _WORD).cast("int")) == 1


def _reaches(place: Column, closed: Column, i: Column, j: Column) -> Column:
    """Whether the node at ``j`` can be reached from that at ``i``, itself included."""
    return F.when(place.isNotNull(), F.get(place, j) >= F.get(place, i)).otherwise((i == j) | _has(F.get(closed, i), j))


def _at(nodes: Column, task: Column) -> Column:
    return F.array_position(nodes, task).cast("int") - 1


def eventually(nodes: Column, place: Column, closed: Column, path: Column) -> Column:
    """Null for a path of fewer than two tasks."""
    i, j = (_at(nodes, F.get(path, F.lit(k))) for k in (0, 1))
    return F.when(F.size(path) >= 2, F.coalesce(F.when((i >= 0) & (j >= 0), _reaches(place, closed, i, j)), F.lit(False)))


def required(nodes: Column, path: Column) -> Column:
    return F.coalesce(F.array_contains(nodes, F.get(path, F.lit(0))), F.lit(False))


def not_allowed(nodes: Column, path: Column) -> Column:
    return ~required(nodes, path)


def directly(nodes: Column, edges: Column, path: Column) -> Column:
    there = (F.size(F.array_distinct(path)) == F.size(path)) & F.forall(path, lambda p: F.array_contains(nodes, p)) & (F.size(path) > 0)
    steps = F.transform(F.slice(path, F.lit(1), F.greatest(F.size(path) - 1, F.lit(0))), lambda a, i: F.struct(a.alias("src"), F.get(path, i + 1).alias("dst")))
    return there & F.forall(steps, lambda s: F.exists(edges, lambda e: (e["src"] == s["src"]) & (e["dst"] == s["dst"])))


def list_graph(traces: DataFrame) -> DataFrame:
    """What ``case_graph`` gives, of cases that are already ordered arrays ``trace``."""
    rows = traces.select(*CASE, F.filter("trace", lambda x: x.isNotNull()).alias("t"))
    pairs = F.when(F.size("t") >= 2, F.transform(F.slice("t", F.lit(1), F.greatest(F.size("t") - 1, F.lit(0))), lambda a, i: F.struct(a.alias("src"), F.get("t", i + 1).alias("dst")))).otherwise(F.array().cast(_EDGES))
    named = rows.select(*CASE, "t", F.array_sort(F.array_distinct("t")).alias("nodes"), F.array_sort(F.array_distinct(pairs)).alias("edges"))
    backward = F.reverse("t")
    span = lambda x: F.struct(F.array_position("t", x).alias("lo"), (F.size("t") - F.array_position(backward, x)).alias("before_hi"))
    # A span starts an island if none that starts before it ends after its start; its place is the last such start.
    spans = F.transform("nodes", span)
    starts = let(spans, lambda all_: F.transform(F.filter(all_, lambda x: ~F.exists(all_, lambda y: (y["lo"] < x["lo"]) & (y["before_hi"] + 1 > x["lo"]))), lambda x: x["lo"]))
    place = let(starts, lambda s: F.transform(spans, lambda x: F.array_max(F.filter(s, lambda a: a <= x["lo"])).cast("int")))
    return named.select(*CASE, "nodes", "edges", F.lit(None).cast("array<array<string>>").alias("succ"), place.alias("place"))


def conform(graphs: DataFrame, rules: DataFrame) -> DataFrame:
    """Every rule of a log on every case of it: ``log_name, caseid, rule_id, ok``.

    The rows are as many as cases times rules; ``conform_stats`` counts without making them.  The rules of a log
    are one row of a written table: it is broadcast where its measured size allows, and else the join splits a log by
    the size of its cases.  A case's closure is made once, where some rule asks for it.
    """
    listed = stored(rules.groupBy("log_name").agg(F.collect_list(F.struct("rule_id", "rule_type", "path")).alias("rules")), "rules")
    nodes, edges, place = F.col("nodes"), F.col("edges"), F.col("place")
    asks = F.exists("rules", lambda r: (r["rule_type"] == "eventually") & F.array_contains(nodes, F.get(r["path"], F.lit(0))) & F.array_contains(nodes, F.get(r["path"], F.lit(1))))

    def verdict(r: Column, closed: Column) -> Column:
        kind, path = r["rule_type"], r["path"]
        ok = (
            F.when(kind == "eventually", eventually(nodes, place, closed, path))
            .when(kind == "not_allowed", not_allowed(nodes, path))
            .when(kind == "directly", directly(nodes, edges, path))
            .when(kind == "required", required(nodes, path))
        )
        return F.struct(r["rule_id"].alias("rule_id"), ok.alias("ok"))

    verdicts = let(F.when(place.isNull() & asks, closure(nodes, F.col("succ"))), lambda closed: F.transform("rules", lambda r: verdict(r, closed)))
    return graphs.join(listed, "log_name").select(*CASE, F.inline(verdicts))


def _asked(rules: DataFrame) -> DataFrame | None:
    """``log_name, pairs, long``: first tasks of a log's `eventually` rules with what is asked of them, and its paths of three or more tasks; None without either."""
    path = F.array_distinct("path")
    two = rules.where("rule_type = 'eventually' and size(path) >= 2").groupBy("log_name", F.get("path", F.lit(0)).alias("a")).agg(F.collect_set(F.get("path", F.lit(1))).alias("ends"))
    pairs = two.groupBy("log_name").agg(F.collect_list(F.struct("a", "ends")).alias("pairs"))
    many = rules.where((F.col("rule_type") == "directly") & (F.size("path") > 2) & (F.size(path) == F.size("path")))
    long = many.groupBy("log_name").agg(F.collect_list(F.struct("rule_id", "path")).alias("long"))
    asked = stored(pairs.join(long, "log_name", "full_outer").select("log_name", "pairs", "long"), "asked")
    return None if asked.isEmpty() else asked


def _looked(rules: DataFrame) -> DataFrame:
    """The rules with what each one counts: ``kind``, ``a`` and ``b`` of a case's node, edge, reachable pair or long path."""
    a, b, n = F.get("path", F.lit(0)), F.get("path", F.lit(1)), F.size("path")
    kind = F.when(F.col("rule_type") == "eventually", F.when(n >= 2, F.lit("reach"))).when(F.col("rule_type") == "directly", F.when(n == 1, F.lit("node")).when(n == 2, F.lit("edge")).otherwise("long")).otherwise("node")
    of = F.when(kind == "long", F.col("rule_id")).otherwise(a)
    return rules.select("log_name", "rule_id", "rule_type", n.alias("n"), (F.size(F.array_distinct("path")) < n).alias("twice"), kind.alias("kind"), of.alias("a"), F.when(kind.isin("edge", "reach"), b).alias("b"))


def _stored_rules(rules: DataFrame) -> tuple[DataFrame, set[str]]:
    """The rules as a written table, and the kinds of what they count."""
    rules = stored(rules.select("log_name", "rule_id", "rule_type", "path"), "rules")
    return rules, {r.kind for r in _looked(rules).select("kind").distinct().collect()}


def conform_stats(graphs: DataFrame, rules: DataFrame, cases: DataFrame | None = None) -> DataFrame:
    """``log_name, rule_id, positive, total``: conforming and all cases of each rule.

    Cases are counted by what they have (a task, an edge, a reachable pair, a long path), and rules look
    their count up, so no row is made for a case and a rule.  Only what some rule asks for is counted, and what can be
    reached is looked for from first tasks of `eventually` rules alone.
    ``cases(log_name, total)`` has the cases of each log where some have no task at all and so no graph.
    """
    return _stats(graphs, *_stored_rules(rules), cases)


def log_stats(log: DataFrame, rules: DataFrame, cases: DataFrame | None = None) -> DataFrame:
    """``conform_stats`` of a log's own graphs, of which only those parts are made that its rules ask for."""
    rules, kinds = _stored_rules(rules)
    parts = [*(["edges"] if kinds & {"edge", "long"} else []), *(["succ", "place"] if "reach" in kinds else [])]
    return _stats(case_graph(log, parts), rules, kinds, cases)


def _stats(graphs: DataFrame, rules: DataFrame, kinds: set[str], cases: DataFrame | None) -> DataFrame:
    asked = _asked(rules) if kinds & {"reach", "long"} else None
    nodes, edges, place = F.col("nodes"), F.col("edges"), F.col("place")
    one = lambda kind, a, b=None: F.struct(F.lit(kind).alias("kind"), a.alias("a"), (F.lit(None).cast("string") if b is None else b).alias("b"))
    # Cases of one graph are judged together, and their number is counted with what they have, so that no graph is made twice.
    alike = [c for c, asking in (("nodes", {"node", "reach", "long"}), ("edges", {"edge", "long"}), ("place", {"reach"})) if kinds & asking]
    keys = [*alike, *([F.when(place.isNull(), F.col("succ")).alias("succ")] if "reach" in kinds else [])]
    graphs = graphs.groupBy("log_name", *keys).agg(F.count("*").alias("alike"))
    has = [F.array(one("case", F.lit("")))]
    if "node" in kinds:
        has.append(F.transform(nodes, lambda t: one("node", t)))
    if "edge" in kinds:
        has.append(F.transform(edges, lambda e: one("edge", e["src"], e["dst"])))
    known = graphs
    if asked is not None:
        known = graphs.join(asked, "log_name", "left")
        starts = F.filter("pairs", lambda p: F.array_contains(nodes, p["a"]))

        def found(p: Column, closed: Column) -> Column:
            i = _at(nodes, p["a"])
            by_place = let(F.get(place, i), lambda own: F.filter(nodes, lambda _, j: F.get(place, j) >= own))
            by_bits = let(F.get(closed, i), lambda row: F.filter(nodes, lambda b, j: (b == p["a"]) | _has(row, j)))
            there = F.when(place.isNotNull(), by_place).otherwise(by_bits)
            return F.transform(F.array_intersect(p["ends"], there), lambda b: one("reach", p["a"], b))

        told = []
        if "reach" in kinds:
            told.append(let(F.when(place.isNull() & (F.size(starts) > 0), closure(nodes, F.col("succ"))), lambda closed: F.flatten(F.transform(starts, lambda p: found(p, closed)))))
        if "long" in kinds:
            told.append(F.transform(F.filter("long", lambda x: directly(nodes, edges, x["path"])), lambda x: one("long", x["rule_id"])))
        has += [F.coalesce(x, F.array().cast("array<struct<kind:string,a:string,b:string>>")) for x in told]
    counts = known.select("log_name", "alike", F.inline(F.concat(*has))).groupBy("log_name", "kind", "a", "b").agg(F.sum("alike").alias("hits"))
    looked = _looked(rules)
    if cases is None:
        looked = looked.unionByName(rules.select("log_name", F.lit("case").alias("kind"), F.lit("").alias("a")).distinct(), allowMissingColumns=True)
    same = (looked["log_name"] == counts["log_name"]) & (looked["kind"] == counts["kind"]) & (looked["a"] == counts["a"]) & looked["b"].eqNullSafe(counts["b"])
    told = looked.join(counts, same, "left").select(looked["*"], counts["hits"])
    if cases is None:
        total = F.max(F.when(F.col("kind") == "case", F.col("hits"))).over(Window.partitionBy("log_name"))
        told = told.withColumn("total", total).where(~F.col("kind").eqNullSafe("case") & F.col("total").isNotNull())
    else:
        told = told.join(cases, "log_name")
    hits = F.when((F.col("rule_type") == "directly") & F.col("twice"), F.lit(0)).otherwise(F.coalesce("hits", F.lit(0)))
    # A path too short for its kind is never met; as a verdict on a case it is null.
    positive = F.when(F.col("rule_type") == "not_allowed", F.col("total") - hits).otherwise(hits)
    return told.select("log_name", "rule_id", positive.cast("long").alias("positive"), "total")
