"""Quality rules: fixed limits, then robust multivariate outliers, in DataFrame operations alone.

Each document has a vector of transformed statistics.  Per language and source,
centre and covariance are the minimum-covariance-determinant estimates: from two
deterministic starts, concentration steps keep the three quarters of the rows that
are nearest by Mahalanobis distance and estimate again; the start that ends with the
smaller determinant wins.  Groups are drawn towards their language and languages
towards all rows, the more so the fewer rows they have.  Few texts repeat lines or
words, so the nearest rows show no spread of these; it comes from the texts that do
repeat and have no more symbols than half of their group.  Rows too far from their
group's centre are rejected.
"""

from __future__ import annotations

from math import exp, lgamma, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Share of a group's rows that an estimate rests on.
SUPPORT = 0.75
STEPS = 3
#: A group of so many rows has half the weight, the other half is its language's; a language's likewise, with all rows.
SHRINK = 30
#: A row with a regular vector is rejected with this probability.
ERROR = 1e-3
#: Groups up to which their estimates are broadcast.
BROADCAST_GROUPS = 20_000

VECTOR = ("z1", "z2", "z3", "z4", "z5")
#: Keeps covariances regular; for the last two, the spread where no text repeats anything.
_FLOOR = (0.1, 0.03, 0.2, 0.5, 0.1)
#: Statistics that are zero in most texts, regular ones with repeats included.
_RARE = (3, 4)
_P = len(VECTOR)


def _chi2_cdf(x: float, k: int) -> float:
    a, x = k / 2, x / 2
    term = total = exp(a * log(x) - x - lgamma(a + 1)) if x > 0 else 0.0
    i = 1
    while term > total * 1e-17:
        term *= x / (a + i)
        total += term
        i += 1
    return min(1.0, total)


def _chi2_quantile(q: float, k: int) -> float:
    lo, hi = 0.0, 400.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _chi2_cdf(mid, k) < q else (lo, mid)
    return lo


#: Makes the covariance of the nearest rows that of all, for normal vectors.
CONSISTENCY = SUPPORT / _chi2_cdf(_chi2_quantile(SUPPORT, _P), _P + 2)


def cutoff(error: float = ERROR) -> float:
    return _chi2_quantile(1 - error, _P)


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, source`` and the counts ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words``, a row per input row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), text.alias("text"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    first = rows.select(
        "doc_id", "lang", "source", common.words_of(F.col("text")).alias("w"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
    )
    n = F.size("w")

    def pairs(col: str, step: int, least: int) -> Column:
        return F.when(n >= least, F.transform(F.sequence(F.lit(1), n - least + 1), lambda i: F.xxhash64(F.element_at(col, i), F.element_at(col, i + step)))).otherwise(F.array().cast("array<bigint>"))

    two = first.select("*", pairs("w", 1, 2).alias("h2"))
    four = two.select("*", pairs("h2", 2, 4).alias("h4"))
    eight = four.select("*", pairs("h4", 4, 8).alias("h8"))

    def covered(places: Column) -> Column:
        """Words in windows of eight at ``places``, ascending."""
        return F.aggregate(places, F.struct(F.lit(0).alias("n"), F.lit(-8).alias("last")), lambda acc, p: F.struct((acc["n"] + F.least(F.lit(8), p - acc["last"])).alias("n"), p.alias("last")), lambda acc: acc["n"])

    def twice(order: Column) -> Column:
        same = lambda i, j: (j >= 1) & (j <= F.size(order)) & (F.get(order, j - 1)["h"] == F.get(order, i - 1)["h"])
        there = F.filter(F.sequence(F.lit(1), F.size(order)), lambda i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)))
        return covered(F.array_sort(F.transform(there, lambda i: F.get(order, i - 1)["at"])))

    placed = F.array_sort(F.transform("h8", lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
    repeats = F.when(F.size(F.array_distinct("h8")) < F.size("h8"), common.bound(placed, twice)).otherwise(0)
    chars = F.aggregate("w", F.lit(0), lambda acc, x: acc + F.length(x))
    return eight.select(
        "doc_id", "lang", "source", n.cast("long").alias("n_words"), chars.cast("long").alias("word_chars"), "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), repeats.cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
    )


def _failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _vector() -> list[Column]:
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    return [
        F.log1p(words).alias("z1"),
        F.log(chars / words).alias("z2"),
        F.log1p(100 * F.col("n_symbols") / chars).alias("z3"),
        F.log1p(100 * F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))).alias("z4"),
        (F.col("n_repeat_words") / words).alias("z5"),
    ]


def _named_moments() -> list[tuple[Column, str]]:
    out = [(F.avg(z), f"m{i}") for i, z in enumerate(VECTOR)]
    return out + [(F.avg(F.col(VECTOR[i]) * F.col(VECTOR[j])), f"q{i}{j}") for i, j in _PAIRS]


def _moments() -> list[Column]:
    return [m.alias(name) for m, name in _named_moments()]


_PAIRS = [(i, j) for i in range(_P) for j in range(i + 1)]


def _covariances(moments: DataFrame, keys: list[str], scale: float) -> DataFrame:
    cov = [((F.col(f"q{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}")) * scale).alias(f"c{i}{j}") for i, j in _PAIRS]
    return moments.select(*keys, *(f"m{i}" for i in range(_P)), *cov)


def _whitened(frame: DataFrame, keys: list[str], more: list[Column]) -> DataFrame:
    """Centre, covariance, inverse Cholesky factor and log-determinant of each row's covariance with ``more`` on its diagonal."""
    kept = [c for c in frame.columns if c[0] in "mc" and c[1:].isdigit()]
    plain = [F.col(f"c{i}{i}").alias(f"p{i}{i}") for i in range(_P)]
    frame = frame.select("*", *plain)
    for i in range(_P):
        frame = frame.withColumn(f"c{i}{i}", F.col(f"c{i}{i}") + more[i])
    for j in range(_P):  # Cholesky, by columns
        frame = frame.withColumn(f"l{j}{j}", F.sqrt(F.greatest(F.col(f"c{j}{j}") - sum((F.col(f"l{j}{k}") ** 2 for k in range(j)), F.lit(0.0)), F.lit(1e-9))))
        for i in range(j + 1, _P):
            frame = frame.withColumn(f"l{i}{j}", (F.col(f"c{i}{j}") - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))) / F.col(f"l{j}{j}"))
    for j in range(_P):  # its inverse
        frame = frame.withColumn(f"w{j}{j}", 1 / F.col(f"l{j}{j}"))
        for i in range(j + 1, _P):
            frame = frame.withColumn(f"w{i}{j}", -sum((F.col(f"l{i}{k}") * F.col(f"w{k}{j}") for k in range(j, i)), F.lit(0.0)) / F.col(f"l{i}{i}"))
    det = 2 * sum((F.log(F.col(f"l{i}{i}")) for i in range(_P)), F.lit(0.0))
    out = [F.col(f"p{c[1:]}").alias(c) if c[0] == "c" and c[1] == c[2] else F.col(c) for c in kept]
    return frame.select(*keys, *out, *(f"w{i}{j}" for i, j in _PAIRS), det.alias("log_det"))


def _distance() -> Column:
    d = [F.col(z) - F.col(f"m{i}") for i, z in enumerate(VECTOR)]
    return sum((sum((F.col(f"w{i}{j}") * d[j] for j in range(i + 1)), F.lit(0.0)) ** 2 for i in range(_P)), F.lit(0.0))


def estimates(rows: DataFrame, *, steps: int = STEPS, small: bool = True) -> DataFrame:
    """MCD centres ``m`` and covariances ``c`` per ``grp`` of ``rows(grp, z1..z5)``, its rows ``n``, and of each rare statistic the count ``rn`` and sum of squares ``rq`` where it occurs.

    ``small``: there are few enough groups to broadcast.
    """
    side = F.broadcast if small else (lambda x: x)
    more = [F.lit(f**2) for f in _FLOOR]
    halves = common.written(rows.groupBy("grp").agg(*(F.percentile_approx(z, 0.5, 1000).alias(f"m{i}") for i, z in enumerate(VECTOR)), F.count("*").alias("n"), *(m.alias(f"a{name}") for m, name in _named_moments())), "mcd-halves")
    centre = [f"m{i}" for i in range(_P)]
    there = {i: (F.col("z3") <= F.col("m2")) & (F.col(VECTOR[i]) > 0) for i in _RARE}
    spread = rows.join(side(halves.select("grp", *centre)), "grp").groupBy("grp").agg(
        *(F.percentile_approx(F.abs(F.col(z) - F.col(f"m{i}")), 0.5, 1000).alias(f"d{i}") for i, z in enumerate(VECTOR)),
        *(F.count(F.when(there[i], 1)).alias(f"rn{i}") for i in _RARE),
        *(F.coalesce(F.sum(F.when(there[i], F.col(VECTOR[i]) ** 2)), F.lit(0.0)).alias(f"rq{i}") for i in _RARE),
    )
    known = common.written(halves.join(side(spread), "grp"), "mcd-spread")
    start = known.select("grp", F.lit(0).alias("start"), *centre, *(((1.4826 * F.col(f"d{i}")) ** 2 if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in _PAIRS))
    plain = _covariances(known.select("grp", F.lit(1).alias("start"), *(F.col(f"a{m}").alias(m) for _, m in _named_moments())), ["grp", "start"], 1.0)
    now = common.written(_whitened(start.union(plain), ["grp", "start"], more), "mcd")
    for _ in range(steps):
        far = rows.join(side(now), "grp").withColumn("d2", _distance()).select("grp", "start", *VECTOR, "d2")
        limit = far.groupBy("grp", "start").agg(F.percentile_approx("d2", SUPPORT, 1000).alias("limit"))
        near = far.join(side(limit), ["grp", "start"]).where("d2 <= limit")
        now = common.written(_whitened(_covariances(near.groupBy("grp", "start").agg(*_moments()), ["grp", "start"], CONSISTENCY), ["grp", "start"], more), "mcd")
    best = now.groupBy("grp").agg(F.min(F.struct("log_det", "start")).alias("b")).select("grp", F.col("b.start").alias("start"))
    counts = known.select("grp", "n", *(f"{r}{i}" for r in ("rn", "rq") for i in _RARE))
    return now.join(best, ["grp", "start"]).select("grp", *centre, *(f"c{i}{j}" for i, j in _PAIRS)).join(counts, "grp")


def _pooled(groups: DataFrame, known: DataFrame) -> DataFrame:
    """Per ``g1, g2`` the estimates of the group drawn towards its language's, and these towards those of all rows."""
    names = [f"m{i}" for i in range(_P)] + [f"c{i}{j}" for i, j in _PAIRS]

    def level(no: int) -> DataFrame:
        return known.where(F.col("grp").startswith(str(no))).select(*(F.col(c).alias(f"{c}_{no}") for c in known.columns))

    frame = groups.select("g1", "g2", *(k.alias(f"k{no}") for no, k in enumerate(_keys())))
    for no in range(3):
        frame = frame.join(level(no), F.col(f"k{no}") == F.col(f"grp_{no}"))
    values = {c: F.col(f"{c}_0") for c in names} | {f"s{i}": (F.col(f"rq{i}_0") + SHRINK * _FLOOR[i] ** 2) / (F.col(f"rn{i}_0") + SHRINK) for i in _RARE}
    for no in (1, 2):
        weight = F.col(f"n_{no}") / (F.col(f"n_{no}") + SHRINK)
        frame = frame.select("*", *(v.alias(f"{c}_far{no}") for c, v in values.items()))
        values = {c: weight * F.col(f"{c}_{no}") + (1 - weight) * F.col(f"{c}_far{no}") for c in names}
        values |= {f"s{i}": (F.col(f"rq{i}_{no}") + SHRINK * F.col(f"s{i}_far{no}")) / (F.col(f"rn{i}_{no}") + SHRINK) for i in _RARE}
    pooled = common.written(frame.select("g1", "g2", *(v.alias(c) for c, v in values.items())), "drawn")
    return _whitened(pooled, ["g1", "g2"], [F.col(f"s{i}") if i in _RARE else F.lit(_FLOOR[i] ** 2) for i in range(_P)])


def _keys() -> list[Column]:
    """Keys of all rows, of a row's language, and of its language and source."""
    return [F.lit("0"), F.concat(F.lit("1"), "g1"), F.concat(F.lit("2"), "g1", F.lit("\u0002"), "g2")]


def judge(docs: DataFrame, *, error: float = ERROR) -> DataFrame:
    """Statistics and verdicts for every row of ``docs(doc_id, text, lang, source)``.

    Returns ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, distance2, kept``.  ``base_failed``: fewer than 20 words, or over 30
    in 100 of the words in windows of eight that occur twice.  Estimates rest on the
    rows that did not fail; a row is kept if it did not fail and its squared distance is
    at most the chi-square quantile of ``1 - error``.  Null text counts as empty; null lang and
    source are groups of their own; repeated rows count and stay, as do null ids; texts of
    any length are read whole; an empty table gives an empty result.  ``distance2`` is null where
    the row failed.
    """
    table = common.written(statistics(docs).select("*", *_vector()), "statistics")
    rows = table.where(~_failed()).select(F.coalesce("lang", F.lit("\u0001")).alias("g1"), F.coalesce("source", F.lit("\u0001")).alias("g2"), *VECTOR)
    groups = common.written(rows.select("g1", "g2").distinct(), "groups")
    n_groups, n_langs = groups.agg(F.count("*"), F.count_distinct("g1")).first()

    def level(*keys: Column) -> DataFrame:
        return rows.select(F.explode(F.array(*keys)).alias("grp"), *VECTOR)

    small = n_groups + n_langs < BROADCAST_GROUPS
    if small:
        known = estimates(level(*_keys()))
    else:  # the large groups of all rows and of a language are not shuffled to one place
        every, lang, own = _keys()
        known = estimates(level(every)).union(estimates(level(lang), small=n_langs <= BROADCAST_GROUPS)).union(estimates(level(own), small=False))
    pooled = common.written(_pooled(groups, common.written(known, "estimates")), "pooled")
    side = F.broadcast if small else (lambda x: x)
    keyed = table.withColumn("g1", F.coalesce("lang", F.lit("\u0001"))).withColumn("g2", F.coalesce("source", F.lit("\u0001")))
    told = keyed.join(side(pooled), ["g1", "g2"], "left")
    d2 = F.when(~_failed(), _distance())
    return told.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", _failed().alias("base_failed"), d2.alias("distance2"),
        (~_failed() & F.coalesce(d2 <= cutoff(error), F.lit(True))).alias("kept"),
    )
