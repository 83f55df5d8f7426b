"""Secret scans, in DataFrame operations alone.

Fixed patterns give the base spans.  Two character Markov models, of random strings
and of ordinary identifiers, add further spans: tokens whose log-likelihood ratio
is above one threshold per character and another in all.  Both are trained on a labelled sample: the
strings that the patterns found, and the ordinary tokens beside them.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

# Fixed values.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.=-"
TOKEN = r"[A-Za-z0-9+/_.=-]+"
#: Tokens shorter than this are not scored, as for the patterns.
LEAST_TOKEN = 12
#: Documents in the training sample.
SAMPLE_DOCS = 4_000
#: Pairs that the characters' own frequencies count for.
BACKOFF = 20.0
#: What each character counts for before any is seen, in the ordinary and the random model: few ordinary tokens do not make a rare letter a sign of chance, and few secrets, mostly of one alphabet, leave any character possible in a random string.
UNSEEN = (50.0, 30.0)
#: Natural logarithms above which a token is taken for random: per character, and in all, so that a short one needs stronger evidence.
THRESHOLD, TOTAL = 0.4, 10.0
#: Matches placed at a time.
_BLOCK = 256


def _spans(text: Column, pattern: str, kind: int) -> Column:
    """Structs (start, kind, end, match) of a pattern's matches, in code points; [] where there is none.

    Matches are placed in blocks, so that no long array is copied for each of them.
    """
    kept = "array<struct<start:int,kind:int,end:int,match:string>>"

    def walk(parts: Column) -> Column:
        # Each match starts behind all that went before it.
        def step(acc: Column, i: Column) -> Column:
            begin = acc["at"] + F.length(F.get(parts["between"], i))
            match = F.get(parts["found"], i)
            end = begin + F.length(match)
            one = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), match.alias("match"))
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

        def block(acc: Column, first: Column) -> Column:
            inside = F.sequence(first, F.least(first + _BLOCK, F.size(parts["found"])) - 1)
            made = F.aggregate(inside, F.struct(acc["at"].alias("at"), F.array().cast(kept).alias("out")), step)
            return common.bound(made, lambda x: F.struct(x["at"].alias("at"), F.concat(acc["out"], F.array(x["out"])).alias("out")))

        empty = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kept}>").alias("out"))
        return F.flatten(F.aggregate(F.sequence(F.lit(0), F.size(parts["found"]) - 1, F.lit(_BLOCK)), empty, block, lambda acc: acc["out"]))

    parts = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("between"))
    return F.when(F.regexp_like(text, F.lit(pattern)), common.bound(parts, walk)).otherwise(F.array().cast(kept))


def base_spans(text: Column) -> Column:
    value = lambda m: F.regexp_extract(m, ASSIGN, 2)
    assign = F.filter(_spans(text, ASSIGN, 0), lambda s: F.length(value(s["match"])) >= 12)
    return F.array_sort(F.concat(assign, _spans(text, ACCESS, 1), _spans(text, HEX, 2)))


def train(docs: DataFrame, *, sample_docs: int = SAMPLE_DOCS) -> list[float]:
    """Log-likelihood ratio of each pair of neighbouring characters, random over ordinary, row by row.

    The sample is the ``sample_docs`` documents with the least hash of doc_id, a
    documented bound; the counts of character pairs, 2 * 68 * 68 at most, come to the driver.
    """
    ids = [r.doc_id for r in docs.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs).collect()]
    rows = docs.where(F.col("doc_id").isin(ids)).select(F.coalesce("text", F.lit("")).alias("text")) if ids else docs.limit(0).select(F.coalesce("text", F.lit("")).alias("text"))
    spans = rows.select("text", base_spans(F.col("text")).alias("spans"))
    value = lambda s: F.when(s["kind"] == 0, F.regexp_extract(s["match"], ASSIGN, 2)).otherwise(s["match"])
    # Tokens without a letter are not scored, so card numbers and the like are no sample for them.
    random = spans.select(F.explode(F.array_distinct(F.transform("spans", value))).alias("s"), F.lit(1).alias("random")).where(F.regexp_like("s", F.lit("[A-Za-z]")))
    words = lambda text: F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    inside = F.flatten(F.transform("spans", lambda s: words(s["match"])))
    plain = spans.select(F.explode(F.filter(F.array_except(words(F.col("text")), inside), lambda t: F.length(t) >= 4)).alias("s"))
    # Random strings hardly occur in two documents, so those that no pattern knows do not count as ordinary.
    plain = plain.groupBy("s").count().where("count > 1").select("s")
    # Words are as ordinary in capitals, however seldom the sample has them so.
    cased = F.array_distinct(F.array("s", F.upper("s"), F.concat(F.upper(F.substring("s", 1, 1)), F.col("s").substr(F.lit(2), F.length("s")))))
    plain = plain.select(F.explode(cased).alias("s"), F.lit(0).alias("random"))
    # A string counts for a pair once, so that one long run of the same pairs is no model of its own.
    chars = random.union(plain).select("random", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("s") - 1, F.lit(1))), lambda i: F.substring("s", i, F.lit(2))))).alias("pair")).where(F.length("pair") == 2)
    counts: dict[tuple[int, str], int] = {(r.random, r.pair): r["count"] for r in chars.groupBy("random", "pair").count().collect()}
    n = len(ALPHABET)
    logs = []
    for kind in (1, 0):
        # A pair never seen falls back on how often its second character occurs at all.
        single = [sum(counts.get((kind, a + b), 0) for a in ALPHABET) + UNSEEN[kind] for b in ALPHABET]
        alone = [x / sum(single) for x in single]
        table = []
        for a in ALPHABET:
            seen = [counts.get((kind, a + b), 0) for b in ALPHABET]
            table += [log((x + BACKOFF * p) / (sum(seen) + BACKOFF)) for x, p in zip(seen, alone, strict=True)]
        logs.append(table)
    assert len(logs[0]) == n * n
    return [round(a - b, 6) for a, b in zip(*logs, strict=True)]


def log_ratio(token: Column, model: Column) -> Column:
    """Log-likelihood ratio of a token's transitions, in all."""
    n = len(ALPHABET)
    known = F.array(*[F.lit(ALPHABET.find(chr(c))) for c in range(128)])
    codes = F.transform(F.filter(F.split(token, ""), lambda c: F.length(c) > 0), lambda c: F.get(known, F.ascii(c)))
    steps = F.sequence(F.lit(1), F.length(token) - 1)
    return common.bound(codes, lambda c: F.aggregate(steps, F.lit(0.0), lambda acc, i: acc + F.get(model, F.get(c, i - 1) * n + F.get(c, i))))


def _overlaps(spans: Column, token: Column) -> Column:
    """Whether one of ``spans``, in order and apart from one another, overlaps ``token``: the last that starts before its end, by halving."""

    def halve(at: Column, _: Column) -> Column:
        middle = F.floor((at["low"] + at["high"]) / 2).cast("int")
        before = (at["low"] < at["high"]) & (F.get(spans, middle)["start"] < token["end"])
        return F.struct(F.when(before, middle + 1).otherwise(at["low"]).alias("low"), F.when(before | (at["low"] >= at["high"]), at["high"]).otherwise(middle).alias("high"))

    all_ = F.struct(F.lit(0).alias("low"), F.size(spans).alias("high"))
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(spans) + 1)).cast("int"))
    last = F.aggregate(steps, all_, halve, lambda at: at["low"] - 1)
    return F.coalesce(F.get(spans, last)["end"] > token["start"], F.lit(False))


def scan(docs: DataFrame, *, least: int = LEAST_TOKEN, threshold: float = THRESHOLD, total: float = TOTAL, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """Spans of secrets in every whole text of ``docs(doc_id, text)``, a row per input row.

    Returns ``doc_id, base, spans``: arrays of structs (start, kind, end, match) sorted
    by start and kind; kind indexes ``KINDS``; positions are code points, ends
    exclusive.  ``base`` has the pattern matches alone; ``spans`` adds tokens of
    ``least`` or more characters that the models take for random and that no base
    span overlaps; those without a letter are left out, since keys of digits alone cannot be
    told from numbers, dates and addresses.  Null and empty texts have none; repeated rows and null ids stay; an
    empty table gives an empty result; other columns are not read.  The work grows with the length
    of a text and of a token, not with its square; whether a base span overlaps a token is found by halving.
    """
    model = F.array(*[F.lit(x) for x in train(docs, sample_docs=sample_docs)])
    rows = common.identified(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    based = rows.select("doc_id", "text", base_spans(F.col("text")).alias("base"))
    # Matches of one kind do not overlap each other, so each kind is in order of its ends too.
    of_kind = lambda k: F.filter("base", lambda b: b["kind"] == k).alias(f"kind{k}")
    tokens = based.select("doc_id", "base", *map(of_kind, range(3)), _spans(F.col("text"), TOKEN[:-1] + f"{{{least},}}", 3).alias("tokens"))
    taken = lambda t: _overlaps(F.col("kind0"), t) | _overlaps(F.col("kind1"), t) | _overlaps(F.col("kind2"), t)
    needed = lambda t: F.greatest(F.lit(total), threshold * (F.length(t["match"]) - 1))
    lettered = lambda t: F.regexp_like(t["match"], F.lit("[A-Za-z]"))
    added = F.filter("tokens", lambda t: lettered(t) & (log_ratio(t["match"], model) > needed(t)) & ~taken(t))
    return tokens.select("doc_id", "base", F.array_sort(F.concat("base", added)).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """``doc_id``, counts by kind, a hash of the base spans and all spans as text."""
    kind = F.array(*[F.lit(k) for k in KINDS])
    said = lambda col: F.array_join(F.transform(col, lambda s: F.concat_ws(":", F.element_at(kind, s["kind"] + 1), s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(said("base").cast("binary"), 256).alias("base_sha256"), said("spans").alias("spans"),
    )
