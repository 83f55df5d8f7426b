"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame operations alone.

Test items are partitioned by the size of their shingle sets, in powers of two, since
the length of a sketch that can show a containment depends on it.  An item of a partition
with sizes up to u is sketched by its floor((1 - t) * u) + ``need`` least shingle hashes.
A document that contains a share of t or more of an item of n shingles lacks at most
floor((1 - t) * n) of them, so of a sketch of k it has k - floor((1 - t) * n) or more:
what has fewer is no candidate, and the search misses nothing, however long the document
is.  Candidates are verified by counting the shingles that they share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SHINGLE = 5
#: In hundredths.
CONTAINMENT = 80
#: Hashes of a sketch that a document must have besides those it may lack.
NEED = 3
#: Sketch rows up to which the sketches are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 100_000


def _words(text: Column) -> Column:
    return common.words_of(F.lower(text))


def _runs(words: str, size: int, make) -> Column:
    """``make(first, ...)`` of every run of ``size`` words; none if the text is shorter."""
    whole = F.transform(F.sequence(F.lit(1), F.size(words) - size + 1), lambda i: make(*[F.element_at(words, i + k) for k in range(size)]))
    return F.when(F.size(words) >= size, whole)


def _joined(*words: Column) -> Column:
    return F.concat_ws(" ", *words)


def items_of(benchmark: DataFrame, *, shingle: int = SHINGLE, containment: int = CONTAINMENT, need: int = NEED) -> DataFrame:
    """``item_id, item_body, width, shingles, partition, sketch, least``.

    An item with fewer words than ``shingle`` is one shingle of that width.  ``partition``
    bounds the item's size from above; ``least`` is how many of the sketch a document has
    that contains the item.
    """
    words = benchmark.select(F.col("item_id").cast("long").alias("item_id"), _words(F.col("text").cast("string")).alias("w")).where(F.size("w") > 0).dropDuplicates()
    width = F.least(F.size("w"), F.lit(shingle))
    cut = words.select("item_id", width.alias("width"), F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - width + 1), lambda i: F.concat_ws(" ", F.slice("w", i, width)))).alias("shingles"))
    n = F.size("shingles")
    sized = cut.withColumn("partition", F.pow(F.lit(2), F.ceil(F.log2(n.cast("double")))).cast("int"))
    hashed = F.array_sort(F.array_distinct(F.transform("shingles", lambda s: F.xxhash64(F.split(s, " ", -1)))))
    size = F.least(F.floor(F.col("partition") * (100 - containment) / 100).cast("int") + need, n)
    sketched = sized.withColumn("sketch", F.slice(hashed, F.lit(1), size))
    lacking = F.floor(n * (100 - containment) / 100).cast("int")
    return sketched.select("item_id", F.xxhash64("shingles").alias("item_body"), "width", "shingles", "partition", "sketch", F.greatest(F.size("sketch") - lacking, F.lit(1)).alias("least"))


def contained(docs: DataFrame, benchmark: DataFrame, *, shingle: int = SHINGLE, containment: int = CONTAINMENT, need: int = NEED, broadcast_rows: int = BROADCAST_ROWS, with_body: bool = False) -> DataFrame:
    """Pairs of a document and a test item it contains.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the lower-cased text; an item is contained if
    ``containment`` hundredths or more of its distinct shingles occur in the document.
    Returns ``doc_id, item_id, n_item, n_shared`` (long), once for each different pair of
    texts under the two ids.  Null or wordless documents and items occur in no pair;
    repeated rows give one pair; a null id is reported as null.  Whole texts of any length
    are searched; without documents or items there are no pairs.  ``with_body`` adds
    ``body``, the xxhash64 of the document's text.
    """
    items = common.written(items_of(benchmark, shingle=shingle, containment=containment, need=need), "items")
    sketches = items.select("width", "item_id", "item_body", "least", F.explode("sketch").alias("h"))
    known = items.agg(F.sum(F.size("sketch")).alias("rows"), F.collect_set("width").alias("widths"), F.max(F.array_max("sketch")).alias("most")).first()
    rows = common.identified(docs).select("doc_id", F.xxhash64("text").alias("body"), "text")
    split = rows.select("doc_id", "body", _words(F.col("text")).alias("w"))
    if known.rows is not None and known.rows <= broadcast_rows:
        sketches = F.broadcast(sketches)
    pair = ["doc_id", "body", "item_id", "item_body"]
    widths = sorted(known.widths or [shingle])
    hits = None
    for width in widths:
        # Hashes above the largest of any sketch cannot match.
        hashes = F.filter(_runs("w", width, F.xxhash64), lambda h: h <= F.lit(known.most if known.most is not None else 0))
        found = split.select("doc_id", "body", F.explode(F.array_distinct(hashes)).alias("h")).join(sketches.where(F.col("width") == width), "h").select(*pair, "least", "h")
        hits = found if hits is None else hits.union(found)
    # Repeated rows of a document bring the same hashes again, so different ones are counted.
    candidates = common.written(hits.distinct().groupBy(*pair).agg(F.count("*").alias("hits"), F.max("least").alias("least")).where("hits >= least").select(*pair), "candidates")
    # Shingles of the candidates alone, a row each; a shared one is a row of the join.
    asked = candidates.select("doc_id", "body").distinct()
    asked = asked.select(F.col("doc_id").alias("id2"), F.col("body").alias("body2"))
    texts = common.written(rows.join(asked, F.col("doc_id").eqNullSafe(F.col("id2")) & (F.col("body") == F.col("body2")), "left_semi").select("doc_id", "body", _words(F.col("text")).alias("w")), "candidate-texts")
    there = None
    for width in widths:
        cut = texts.select("doc_id", "body", F.explode(F.array_distinct(_runs("w", width, _joined))).alias("s")).withColumn("width", F.lit(width))
        there = cut if there is None else there.union(cut)
    there = there.distinct().select(F.col("doc_id").alias("id2"), F.col("body").alias("body2"), "width", "s")
    full = items.select(F.col("item_id").alias("i"), F.col("item_body").alias("b"), "width", F.size("shingles").cast("long").alias("n_item"), F.explode("shingles").alias("s"))
    wanted = candidates.join(full, F.col("item_id").eqNullSafe(F.col("i")) & (F.col("item_body") == F.col("b"))).select(*pair, "n_item", "width", "s")
    same = F.col("doc_id").eqNullSafe(F.col("id2")) & (F.col("body") == F.col("body2")) & (wanted["width"] == there["width"]) & (wanted["s"] == there["s"])
    shared = wanted.join(there, same).groupBy(*pair, "n_item").agg(F.count("*").alias("n_shared"))
    named_by = ["doc_id", "body"] if with_body else ["doc_id"]
    return shared.where(F.col("n_shared") * 100 >= F.col("n_item") * containment).select(*named_by, "item_id", "n_item", "n_shared").distinct()


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns, whose text contains no test item."""
    return common.without(docs, contained(docs, benchmark, **options, with_body=True))
