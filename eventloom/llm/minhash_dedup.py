"""MinHash near-dedup with sequential Bayesian verification.

Documents with equal shingle sets form one class.  Classes that share a band of
their signatures are candidates.  A candidate pair is compared a batch of
signature values at a time; it is given up once the posterior probability that its
similarity reaches the threshold falls below ``miss``; survivors are verified on
their full shingle sets.

A band's bucket of m classes is not expanded into m * m pairs.  Classes with too many
shingles that no other candidate has cannot reach the threshold and go first.  Then
each class meets the bucket's head, the one with the most shared shingles; in a second pass, buckets that are not yet one
component compare each class with the smallest of another order.  What then still
lies in different components of one bucket goes to a prefix join: two sets that reach
the threshold share one of their first shingles in an order that is the same for all,
and those that only one component has come first in it.  So pairs arise from shingles
that different components share, not from buckets, and no link that matters to the
components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .wordhash import Words, mix, small_batches

SHINGLE = 5
BANDS, ROWS = 24, 4
#: Signature values: those of the bands, and as many for the comparison as fill whole batches.
BATCH, VALUES = 32, 128
MISS = 1e-7
#: Sets that share a prefix shingle are dealt to slices of about this many.
SLICE = 256
#: Slices of each bucket where its rows meet one row of theirs.
SLICES = 32

_rng = np.random.default_rng(20240517)
_MULTIPLY = _rng.integers(1, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(words: Words, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted within each, and their offsets."""
    counts = words.counts()
    full = words.windows(shingle)
    at = np.flatnonzero(words.valid(shingle))
    owner = np.repeat(np.arange(len(counts)), counts)
    text, value = owner[: len(full)][at], full[at]
    short = np.flatnonzero((counts > 0) & (counts < shingle))
    if len(short):
        one = [int(mix(np.bitwise_xor.reduce(mix(words.hashes[words.first[i] : words.first[i + 1]] + np.arange(counts[i], dtype=np.uint64)))[None] + np.uint64(counts[i]))[0]) for i in short.tolist()]
        text, value = np.concatenate((text, short)), np.concatenate((value, np.array(one, np.uint64)))
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    text, value = text[new], value[new]
    return value, np.searchsorted(text, np.arange(len(counts) + 1))


def set_names(value: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of each whole set, from two independent sums over it and its size."""
    sums = np.add.reduceat(value, begins)
    mixed = np.add.reduceat(mix(value ^ np.uint64(0xA5A5A5A5A5A5A5A5)), begins)
    return mix(mix(sums + sizes.astype(np.uint64)) * np.uint64(3) + mixed).view(np.int64)


def signatures(value: np.ndarray, at: np.ndarray, values: int = VALUES) -> np.ndarray:
    """Least values under ``values`` hash functions for each non-empty set, a row each."""
    full = np.flatnonzero(np.diff(at) > 0)
    out = np.empty((len(full), values), np.uint32)
    if len(full):
        for i in range(values):
            out[:, i] = np.minimum.reduceat(((value * _MULTIPLY[i]) >> np.uint64(32)).astype(np.uint32), at[full])
    return out


def set_table(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, body, n_shingles, node, sig``: body is a hash of the text, node is a hash of the whole set (null if empty), sig its signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in small_batches(batch, "text"):
                value, at = shingle_sets(Words(texts, lower=True), shingle)
                n = np.diff(at)
                full = np.flatnonzero(n > 0)
                node, sig = np.zeros(len(n), np.int64), [None] * len(n)
                if len(full):
                    node[full] = set_names(value, at[full], n[full])
                    for i, row in zip(full.tolist(), signatures(value, at), strict=True):
                        sig[i] = row.astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], part["body"], pa.array(n, pa.int64()), pa.array(node, pa.int64(), mask=n == 0), pa.array(sig, pa.binary())],
                    names=["doc_id", "body", "n_shingles", "node", "sig"],
                )

    return common.identified(docs).withColumn("body", F.xxhash64("text")).mapInArrow(run, "doc_id long, body long, n_shingles long, node long, sig binary")


@lru_cache(8)
def least_matches(threshold: float, miss: float, batch: int, values: int) -> tuple[int, ...]:
    """After each batch, how many equal values keep P(similarity >= threshold) at ``miss`` or more (uniform prior)."""

    def tail(m: int, n: int) -> float:
        # P(Beta(m+1, n-m+1) >= t) = P(Binomial(n+1, t) <= m)
        t, total = threshold, 0.0
        for k in range(m + 1):
            total += np.exp(lgamma(n + 2) - lgamma(k + 1) - lgamma(n - k + 2) + k * np.log(t) + (n + 1 - k) * np.log1p(-t))
        return total

    return tuple(next(m for m in range(n + 1) if m == n or tail(m, n) >= miss) for n in range(batch, values + 1, batch))


def verified(pairs: DataFrame, signed: DataFrame, sets: DataFrame, percent: int, miss: float) -> DataFrame:
    """The pairs ``(a, b)`` of nodes with 100 * intersection >= percent * union."""
    need = least_matches(percent / 100, miss, BATCH, VALUES)
    side = lambda c: signed.select(F.col("node").alias(c), F.col("sig").alias(f"sig_{c}"), F.col("n_shingles").alias(f"n_{c}"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch[c].to_pylist()), "<u4").reshape(-1, VALUES) for c in ("sig_a", "sig_b"))
            left, equal = np.arange(len(x)), np.zeros(len(x), np.int64)
            for i, least in enumerate(need):
                cols = slice(i * BATCH, (i + 1) * BATCH)
                equal[left] += (x[left, cols] == y[left, cols]).sum(1)
                left = left[equal[left] >= least]
            take = pa.array(left)
            yield pa.RecordBatch.from_arrays([batch["a"].take(take), batch["b"].take(take)], names=["a", "b"])

    # The sizes alone bound the similarity from above.
    possible = (pairs.join(side("a"), "a").join(side("b"), "b")).where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    survivors = common.written(possible.mapInArrow(compare, "a long, b long"), "survivors")
    full = lambda c: sets.select(F.col("node").alias(c), F.col("hashes").alias(f"set_{c}"))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch["set_a"].to_pylist(), batch["set_b"].to_pylist(), strict=True)):
                both = np.concatenate((np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")))
                both.sort()
                common_ = int((both[1:] == both[:-1]).sum())
                if 100 * common_ >= percent * (len(both) - common_):
                    keep.append(i)
            take = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch["a"].take(take), batch["b"].take(take)], names=["a", "b"])

    return survivors.join(full("a"), "a").join(full("b"), "b").mapInArrow(exact, "a long, b long")


def _shingle_rows(sets: DataFrame, *columns: str) -> DataFrame:
    """A row ``columns, h`` for each shingle of ``sets(columns, hashes)``, the columns longs."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                raw = part["hashes"].to_pylist()
                sizes = [len(r) // 8 for r in raw]
                yield pa.RecordBatch.from_arrays([*(pa.array(np.repeat(part[c].to_numpy(), sizes)) for c in columns), pa.array(np.frombuffer(b"".join(raw), "<i8"))], names=[*columns, "h"])

    return sets.select(*columns, "hashes").mapInArrow(split, ", ".join(f"{c} long" for c in (*columns, "h")))


def _linkable(sets: DataFrame, percent: int, peels: int = 2) -> DataFrame:
    """``node, n, common``: the sets that can still reach the threshold with another, their sizes and how much others have.

    A set of n shingles of which u occur in no other candidate has at most n - u in
    common with any, out of n or more; if that is too few, it has no links and goes.
    What it alone shared with one other set is then unshared there, so this is done
    again.  Nothing that has a link is ever dropped.
    """
    size = F.octet_length("hashes") / 8
    left, found = sets, None
    for i in range(peels):
        alone = _shingle_rows(left, "node").groupBy("h").agg(F.min("node").alias("node"), F.count("*").alias("n")).where("n = 1")
        unshared = alone.groupBy("node").agg(F.count("*").alias("unshared"))
        told = left.join(unshared, "node", "left").select("node", "hashes", F.coalesce("unshared", F.lit(0)).alias("unshared"))
        found = told.where(100 * (size - F.col("unshared")) >= percent * size)
        if i + 1 < peels:
            left = common.written(found.select("node", "hashes"), "linkable")
    return found.select("node", size.cast("long").alias("n"), (size - F.col("unshared")).cast("long").alias("common"))


def _possible(percent: int, n_a: str, common_a: str, n_b: str, common_b: str) -> Column:
    """Whether two sets can reach the threshold, given their sizes and what of them others have."""
    most = F.least(common_a, common_b)
    return 100 * most >= percent * (F.col(n_a) + F.greatest(F.col(n_b), most) - most)


def _sliced(members: DataFrame, one: DataFrame) -> DataFrame:
    """``members`` joined with ``one``, which has a row per band; a band's rows go to ``SLICES`` tasks."""
    dealt = members.withColumn("slice", F.pmod(F.xxhash64("node"), F.lit(SLICES)).cast("int"))
    return dealt.join(one.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1)))), ["band", "slice"]).drop("slice")


def prefix_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` of nodes of ``sets(node, root, hashes)`` with different roots, all that reach the threshold among them; some occur more than once.

    A set of n shingles has at least percent * n / 100 of them in common with any set it
    is linked to, so the first shared one is among its first n - that + 1.  Shingles that
    only one root has come first, then rare ones: a set with enough of its own makes no pair.
    A shingle of many sets is dealt to slices, each of which meets all of its sets.
    """
    size = (F.octet_length("hashes") / 8).cast("long")
    rows = _shingle_rows(sets.select("node", "root", size.alias("n"), "hashes"), "node", "root", "n")
    held = rows.groupBy("h").agg((F.min("root") < F.max("root")).alias("across"), F.count("*").alias("holders"))
    order = F.row_number().over(Window.partitionBy("node").orderBy("across", "holders", "h")) - 1
    needed = F.ceil(F.lit(percent) * F.col("n") / 100)
    placed = rows.join(held, "h").withColumn("pos", order.cast("long"))
    first = common.written(placed.where(F.col("across") & (F.col("pos") <= F.col("n") - needed)).select("h", "node", "root", "n", "pos"), "prefixes")
    met = first.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("members")).where("lo < hi").select("h", F.ceil(F.col("members") / SLICE).cast("int").alias("slices"))
    dealt = common.written(first.join(met, "h"), "dealt")
    one = dealt.select("h", F.pmod(F.xxhash64("node"), "slices").cast("int").alias("slice"), "node", "root", "n", "pos")
    other = dealt.select("h", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), *(F.col(c).alias(f"{c}_a") for c in ("node", "root", "n", "pos")))
    # Before the first shared shingle nothing is shared.
    most = F.least(F.col("n") - F.col("pos"), F.col("n_a") - F.col("pos_a"))
    pairs = one.join(other, ["h", "slice"]).where("root_a < root").where(100 * F.least("n", "n_a") >= percent * F.greatest("n", "n_a")).where(100 * most >= percent * (F.col("n") + F.col("n_a") - most))
    return pairs.select(F.col("node").alias("a"), F.col("node_a").alias("b"))


def near_duplicates(docs: DataFrame, *, percent: int = 85, shingle: int = SHINGLE, miss: float = MISS, with_body: bool = False) -> DataFrame:
    """Near-duplicate components of ``docs(doc_id, text)``.

    Letters A-Z are lower-cased, words are ``[^\\x20\\x09-\\x0D]+``; a document's set
    has its distinct shingles of ``shingle`` words, or all its words as one if they
    are fewer.  Documents are linked if 100 * intersection >= percent * union.
    Returns per input row ``doc_id, n_shingles, component_id, kept``: the smallest
    doc_id reachable, and whether it is the row's own.  Null, empty and wordless
    texts have n_shingles 0 and no links.  Repeated rows give repeated rows, kept
    alike.  A null doc_id links as any other but never becomes a component_id
    unless nothing else is reachable.  Texts of any length are read whole, an empty table gives
    an empty result, and other columns are not read.  ``with_body`` adds ``body``, the xxhash64 of the text.
    """
    table = common.written(set_table(docs, shingle), "sets")
    classes = table.where("node is not null").groupBy("node", "n_shingles").agg(F.min("doc_id").alias("least"), F.first("sig").alias("sig"))
    signed = common.written(classes, "classes")
    band = [F.xxhash64(F.lit(i), F.substring("sig", 4 * ROWS * i + 1, 4 * ROWS)).alias("band") for i in range(BANDS)]
    banded = signed.select("node", F.explode(F.array(*band)).alias("band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("members")).where("members > 1")
    candidates_in = common.written(banded.join(shared, "band").select("band", "node"), "buckets")

    # Full sets of the classes that have a candidate, made from the texts of their least documents.
    wanted = candidates_in.select("node").distinct()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in small_batches(batch, "text"):
                value, at = shingle_sets(Words(texts, lower=True), shingle)
                yield pa.RecordBatch.from_arrays(
                    [part["node"], pa.array([value[i:j].astype("<u8").tobytes() for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())],
                    names=["node", "hashes"],
                )

    holders = signed.join(wanted, "node", "left_semi").select("node", F.col("least").alias("holder"))
    texts = common.identified(docs)
    candidates = texts.join(holders, F.col("doc_id").eqNullSafe(F.col("holder"))).select("node", "text")

    def right_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Where several texts have one doc_id, the one that has the node's set."""
        for batch in hashed(batches):
            keep = []
            for i, (node, raw) in enumerate(zip(batch["node"].to_pylist(), batch["hashes"].to_pylist(), strict=True)):
                value = np.frombuffer(raw, "<u8")
                if len(value):
                    if set_names(value, np.zeros(1, np.int64), np.array([len(value)]))[0] == node:
                        keep.append(i)
            yield batch.take(pa.array(keep, pa.int64()))

    sets = common.written(candidates.mapInArrow(right_text, "node long, hashes binary").dropDuplicates(["node"]), "full-sets")

    linkable = common.written(_linkable(sets, percent), "linkable")
    member = candidates_in.join(linkable, "node")
    # What the smallest set and the largest common part of a bucket leave possible for each member.
    ends = member.groupBy("band").agg(F.min("n").alias("least_n"), F.max("common").alias("most_common"))
    member = member.join(ends, "band").where(_possible(percent, "n", "common", "least_n", "most_common")).drop("least_n", "most_common")
    member = common.written(member, "members")
    common.dropped(candidates_in, linkable)
    heads = member.groupBy("band").agg(F.max(F.struct("common", "node")).alias("m"), F.count("*").alias("members")).where("members > 1").select("band", F.col("m.node").alias("head"), "members")
    buckets = common.written(member.join(heads, "band").select("band", "node", "n", "common", "head", "members"), "buckets")
    first = buckets.where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
    links = common.written(verified(first, signed, sets, percent, miss), "links")
    roots = common.components(links)

    def unsettled() -> DataFrame:
        """Members of buckets of three or more that are not one component."""
        member = buckets.where("members > 2").join(roots, "node", "left").select("band", "node", "n", "common", F.coalesce("root", "node").alias("root"))
        split = member.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("band")
        return common.written(_sliced(member, split), "unsettled")

    def further(pairs: DataFrame) -> DataFrame:
        return common.written(links.union(verified(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), signed, sets, percent, miss)), "links")

    left = unsettled()
    if not left.isEmpty():
        head = left.groupBy("band").agg(F.min(F.struct(F.xxhash64("node").alias("h"), "node", "root")).alias("m")).select("band", F.col("m.node").alias("a"), F.col("m.root").alias("root_a"))
        links, was = further(_sliced(left, head).where("root <> root_a").select("a", F.col("node").alias("b"))), links
        common.dropped(was, left)
        roots = common.components(links)
        left = unsettled()
    if not left.isEmpty():
        links, was = further(prefix_pairs(sets.join(left.select("node", "root").distinct(), "node"), percent)), links
        common.dropped(was)
        roots = common.components(links)

    # What the result still reads are the classes, their roots and the rows' own sets.
    common.dropped(sets, member, buckets, links, left)
    named = signed.select("node", "least").join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    ids = named.groupBy("root").agg(F.min("least").alias("component"))
    of_node = named.join(ids, "root").select("node", "component")
    return (
        table.join(of_node, "node", "left")
        .select("doc_id", *(["body"] if with_body else []), "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )
