"""Line dedup by winnowing over line hashes, in DataFrame operations alone.

Of every window of ``min_run`` lines the least line hash is selected; neighbouring
windows mostly select the same one, which is then one fingerprint.  Two documents that
share a run of ``min_run`` lines are sure to share a fingerprint.  Fingerprints that
occur once leave the work.  From each place of the others the match is extended both
ways over the windows around it: a window is joined, by its hash, to the first place
where it occurs, and matching windows next to each other make up the whole repeated
run.  The lines of every later occurrence are deleted.  Shorter runs of ``min_words``
words or more are fingerprints of their own, found in the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

MIN_RUN = 3
#: Words that make a run of fewer lines count.
MIN_WORDS = 50
_BLANKS = " \t\x0b\x0c\r"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _trimmed(line: Column) -> Column:
    return F.trim(line, F.lit(_BLANKS))


def _numbered(text: Column) -> Column:
    """Numbers of the lines that are not blank."""
    return F.filter(F.transform(_lines(text), lambda line, i: F.when(F.length(_trimmed(line)) > 0, i)), lambda i: i.isNotNull())


def _grouped(chosen: Column) -> Column:
    """Starts of the runs of equal values of an array."""
    at = F.sequence(F.lit(0), F.size(chosen) - 1)
    return F.filter(at, lambda i: (i == 0) | (F.get(chosen, i) != F.get(chosen, i - 1)))


def _fingerprints(h: str, width: int) -> tuple[Column, Column]:
    """Of each window of ``width`` hashes the place of its least (the last of equal ones), and the hash of the window."""

    def least(i: Column) -> Column:
        best = i
        for k in range(1, width):
            best = F.when(F.get(h, i + k) <= F.get(h, best), i + k).otherwise(best)
        return best

    starts = F.sequence(F.lit(0), F.size(h) - width)
    return F.transform(starts, least), F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)]))


def repeated_lines(docs: DataFrame, *, min_run: int = MIN_RUN, min_words: int | None = MIN_WORDS) -> DataFrame:
    """``doc_id, body, gone``: per document with deletions, the ordinals (among lines not blank) to delete."""
    full = F.filter(F.transform(_lines(F.col("text")), _trimmed), lambda x: F.length(x) > 0)
    words = F.transform(full, lambda x: F.size(F.split(x, common.SPACE_CLASS, -1)))
    counted = [] if min_words is None else [words.alias("n")]
    hashed = docs.select("doc_id", "body", F.transform(full, lambda x: F.xxhash64(x)).alias("h"), *counted).where(F.size("h") >= (min_run if min_words is None else 1))
    # A fingerprint stands for the windows next to each other whose least hash it is.
    chosen, wholes = _fingerprints("h", min_run)
    enough = F.size("h") >= min_run
    empty = F.array().cast("array<bigint>")
    read = hashed.select("*", F.coalesce(F.when(enough, chosen), F.array().cast("array<int>")).alias("chosen"), F.coalesce(F.when(enough, wholes), empty).alias("wholes"))
    runs = read.select("*", F.when(F.size("chosen") > 0, _grouped(F.col("chosen"))).otherwise(F.array().cast("array<int>")).alias("runs"))

    def fingerprint(i: Column, nth: Column) -> Column:
        n = F.coalesce(F.get("runs", nth + 1), F.size("chosen")) - i
        return F.struct(F.get("h", F.get("chosen", i)).alias("mark"), i.cast("int").alias("at"), F.lit(min_run).alias("width"), F.slice("wholes", i + 1, n).alias("wholes"))

    every = [F.transform("runs", fingerprint)]
    for width in range(1, min_run if min_words is not None else 1):
        starts = F.filter(F.when(F.size("h") >= width, F.sequence(F.lit(0), F.size("h") - width)).otherwise(F.array().cast("array<int>")), lambda i: sum((F.get("n", i + k) for k in range(width)), F.lit(0)) >= min_words)  # noqa: B023
        whole = lambda i: F.xxhash64(F.lit(width), *[F.get("h", i + k) for k in range(width)])  # noqa: B023, E731
        every.append(F.transform(starts, lambda i: F.struct(whole(i).alias("mark"), i.cast("int").alias("at"), F.lit(width).alias("width"), F.array(whole(i)).alias("wholes"))))  # noqa: B023
    places = common.written(runs.select("doc_id", "body", F.inline(F.concat(*every))), "fingerprints")
    # Each table is written by itself, so that joins deal a very common line to several tasks.
    marks = common.written(places.groupBy("mark").agg(F.count("*").alias("times")).where("times > 1").select("mark"), "marks")
    # From a fingerprint the match extends both ways, over the windows that it stands for; the next fingerprint goes on from there.
    near = places.join(marks.hint("merge"), "mark").select("doc_id", "body", "mark", "at", "width", F.posexplode("wholes").alias("step", "whole"))
    windows = common.written(near.select("doc_id", "body", "mark", "whole", (F.col("at") + F.col("step")).alias("at"), "width"), "line-windows")
    common.dropped(places, marks)
    place = F.struct("doc_id", "body", "at")
    # A document's copies of one row are one document here.
    firsts = common.written(windows.groupBy("mark", "whole").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last").drop("last"), "first-windows")
    later = windows.join(firsts.hint("merge"), ["mark", "whole"]).where(place > F.col("first"))
    lines = F.flatten(F.collect_set(F.sequence(F.col("at"), F.col("at") + F.col("width") - 1)))
    found = common.written(later.groupBy("doc_id", "body").agg(F.array_distinct(lines).alias("gone")), "later-lines")
    common.dropped(windows, firsts)
    return found


def dedup(docs: DataFrame, *, min_run: int = MIN_RUN, min_words: int | None = MIN_WORDS) -> DataFrame:
    """Delete later occurrences of runs of ``min_run`` or more equal lines, or of ``min_words`` or more words (None: of lines alone).

    Lines end at ``\\n``; they are compared without white space at their ends;
    blank lines are passed over and stay.  A run is later if its document has a greater doc_id
    (null first), or the same and a greater hash of the text, or if it starts further
    down in the same document; so a run repeated inside one document, overlapping
    or not, is reduced to its first period.  Equal rows are one document and keep the same lines.
    Null ids are ids like any other here.  Texts of any length are read whole; an empty table
    gives an empty result.  Returns all columns of ``docs``, with the lines deleted from ``text``
    (null stays null; a text may become empty), and two more, lines as long, ``n_lines``
    and ``n_removed``; a column of ``docs`` that has such a name keeps it, and
    the new one gets underscores behind its own.
    """
    n_lines, n_removed = (common.fresh(docs, c) for c in ("n_lines", "n_removed"))
    body, gone, same_id = (common.fresh(docs, c) for c in ("body__", "gone__", "id__"))
    keyed = docs.withColumn(body, F.xxhash64(F.col("text")))
    found = repeated_lines(docs.select(F.col("doc_id"), F.xxhash64("text").alias("body"), "text"), min_run=min_run, min_words=min_words)
    found = found.select(F.col("doc_id").alias(same_id), F.col("body").alias(body + "2"), F.col("gone").alias(gone))
    joined = keyed.join(found.hint("merge"), keyed["doc_id"].eqNullSafe(F.col(same_id)) & (F.col(body) == F.col(body + "2")), "left")
    lines = _lines(F.col("text"))

    def rest(parts: Column) -> Column:
        removed = F.transform(F.col(gone), lambda i: F.element_at(parts["numbers"], i + 1))
        stay = F.array_except(F.sequence(F.lit(0), F.size(parts["lines"]) - 1), removed)
        return F.array_join(F.transform(stay, lambda i: F.element_at(parts["lines"], i + 1)), "\n")

    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(common.bound(F.struct(lines.alias("lines"), _numbered(F.col("text")).alias("numbers")), rest))
    out = [text.alias("text") if c.lower() == "text" else F.col(c) for c in keyed.columns if c != body]
    return joined.select(*out, F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long").alias(n_lines), F.coalesce(F.size(F.col(gone)), F.lit(0)).cast("long").alias(n_removed))
