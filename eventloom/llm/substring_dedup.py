"""Substring dedup: repeated word windows found with suffix automata of reference shards.

1. Every run of windows is named by its anchor, the least hash of the short word
   runs inside its windows.  Equal windows have equal anchors, so a window can only
   repeat where its anchor does; all else leaves the work here.  Such a run of windows
   is a segment, of bounded length; a hash of its words tells different ones apart.
2. The different segments of one anchor are its reference shard, each with the
   smallest document that has it.  Only shards of two or more texts need words, and
   these are fetched from the smallest document alone.
3. Per shard a suffix automaton is built in the task where the shard lies, and its
   segments are streamed over it.  Matching statistics give, for each window, the
   smallest document that has it; maximal spans of windows that an earlier document
   has are removed.  A shard of one text has one owner throughout.
4. Shards of more than ``shard_limit`` texts are not gathered in one task.  Their windows are dealt by
   where the anchor stands in them, some places at a time, and by the words that all windows of
   those places would have in common; the shards that come of it go through the same automata, dealt by fewer places if need be.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .wordhash import Words, mix, small_batches

WINDOW = 50
ANCHOR = 8
SHARD_LIMIT = 1024
#: Places of the anchor that a large shard is dealt by, one after another; the last leaves nothing to compare.
BANDS = (8, 1)
#: An anchor that occurs this often, and in more than one part in FREQUENT_MOST of such places, is passed over where a window has another.
FREQUENT, FREQUENT_MOST = 256, 20_000
#: Windows in a segment at most.
SEGMENT = 64
#: A segment's place is one long: its first word times this, plus its windows.
_PACK = 128


class SuffixAutomaton:
    """A generalised suffix automaton over tokens; each state knows the least owner of its occurrences."""

    def __init__(self, sequences: list[tuple[list[int], int]]):
        self.moves: list[dict[int, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [float("inf")]
        for tokens, owner in sequences:
            last = 0
            for c in tokens:
                last = self._extend(last, c)
                if owner < self.first[last]:
                    self.first[last] = owner
        for s in sorted(range(1, len(self.moves)), key=self.length.__getitem__, reverse=True):
            p = self.link[s]
            if self.first[s] < self.first[p]:
                self.first[p] = self.first[s]

    def _copy(self, p: int, q: int, c: int) -> int:
        moves, link = self.moves, self.link
        new = len(moves)
        moves.append(dict(moves[q]))
        self.length.append(self.length[p] + 1)
        link.append(link[q])
        self.first.append(float("inf"))
        link[q] = new
        while p != -1 and moves[p].get(c) == q:
            moves[p][c] = new
            p = link[p]
        return new

    def _extend(self, last: int, c: int) -> int:
        moves, link, length = self.moves, self.link, self.length
        q = moves[last].get(c)
        if q is not None:
            return q if length[q] == length[last] + 1 else self._copy(last, q, c)
        cur = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        self.first.append(float("inf"))
        p = last
        while p != -1 and c not in moves[p]:
            moves[p][c] = cur
            p = link[p]
        if p != -1:
            q = moves[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._copy(p, q, c)
        return cur

    def owners(self, tokens: list[int], window: int) -> list[float]:
        """For each window of ``tokens``, the least owner of its occurrences; infinite where it has none."""
        moves, link, length, first = self.moves, self.link, self.length, self.first
        out, v, n = [], 0, 0
        for i, c in enumerate(tokens):
            while v and c not in moves[v]:
                v = link[v]
                n = length[v]
            if c in moves[v]:
                v = moves[v][c]
                n += 1
            while length[link[v]] >= window and v:
                v = link[v]
                n = length[v]
            if i >= window - 1:
                out.append(first[v] if n >= window else float("inf"))
        return out


def anchors(words: Words, window: int, anchor: int, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments: text number, first word in the text, windows, anchor, and first word in ``words``."""
    none = np.zeros(0, np.int64)
    least = words.windows(anchor)
    have, width = 1, window - anchor + 1
    if len(least) < width:
        return none, none, none, none, none
    least = mix(least) >> np.uint64(1)
    if len(frequent):
        # Frequent runs of words name a window only if it has no other.
        place = np.minimum(np.searchsorted(frequent, least), len(frequent) - 1)
        least[frequent[place] == least] |= np.uint64(1 << 63)
    while 2 * have <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
    at = np.flatnonzero(words.valid(window))
    if not len(at):
        return none, none, none, none, none
    name = least[at] & np.uint64((1 << 63) - 1)
    text = np.searchsorted(words.first, at, side="right") - 1
    new = np.ones(len(at), bool)
    new[1:] = (name[1:] != name[:-1]) | (np.diff(at) != 1) | (text[1:] != text[:-1])
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(at)))
    if size.max() > SEGMENT:  # a run of one anchor in repetitive text
        parts = -(-size // SEGMENT)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        begin, size = np.repeat(begin, parts) + nth * SEGMENT, np.minimum(SEGMENT, np.repeat(size, parts) - nth * SEGMENT)
    return text[begin], at[begin] - words.first[text[begin]], size, name[begin].view(np.int64), at[begin]


def _keys(docs: DataFrame) -> DataFrame:
    return common.identified(docs).select("doc_id", F.xxhash64("text").alias("body"), "text")


#: A segment of a shard: how many its shard has, its least and its greatest document, the anchor's place in its words (-1: where its hash is), and the words.
_CUT = ("shard", "whole", "texts", "lo", "hi", "place", "words")
_VERDICT = "shard long, whole long, begin int, end int, first long"


def _matched(cuts: DataFrame, window: int) -> DataFrame:
    """Of the windows of each segment the least document that has them, in runs: ``shard, whole, begin, end, first``."""

    def shard(at: int, rows: dict[int, tuple[bytes, int, int]], out: list[list]) -> None:
        number: dict[bytes, int] = {}
        coded = {k: [number.setdefault(w, len(number)) for w in words.split(b" ")] for k, (words, _, _) in rows.items()}
        reference = SuffixAutomaton([(coded[k], lo) for k, (_, lo, _) in rows.items()])
        for k, (_, _, hi) in rows.items():
            begin, was = 0, None
            for i, owner in enumerate([*reference.owners(coded[k], window), None]):
                if owner != was:
                    if was is not None and was < hi:
                        for col, v in zip(out, (at, k, begin, i, int(was)), strict=True):
                            col.append(v)
                    begin, was = i, owner

    def flush(out: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["shard", "whole", "begin", "end", "first"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows arrive sorted by shard; a shard's rows are together, over batches if need be."""
        held: dict[int, tuple[bytes, int, int]] = {}
        at, out = None, [[], [], [], [], []]
        for batch in batches:
            for a, whole, words, lo, hi in zip(*(batch[c].to_pylist() for c in ("shard", "whole", "words", "lo", "hi")), strict=True):
                if a != at and held:
                    shard(at, held, out)
                    held = {}
                    if len(out[0]) > 20_000:
                        yield flush(out)
                        out = [[], [], [], [], []]
                at = a
                held[whole] = (words, lo, hi)
        if held:
            shard(at, held, out)
        yield flush(out)

    return cuts.select("shard", "whole", "words", "lo", "hi").repartition("shard").sortWithinPartitions("shard").mapInArrow(match, _VERDICT)


def _dealt(cuts: DataFrame, window: int, anchor: int, band: int) -> DataFrame:
    """Parts of segments, ``key, sub, place, words``, and whence they are: ``shard, whole, lo, hi, low``.

    A part has neighbouring windows in which the anchor stands first at one of ``band`` neighbouring places.  ``key`` is a hash
    of the words that any such window has, so equal windows have it in common; ``sub`` one of all its words.
    """
    code = lambda *parts: int.from_bytes(hashlib.blake2b(b" ".join(parts), digest_size=8).digest(), "little", signed=True)
    number = lambda n: str(n).encode()

    def runs(tokens: list[bytes], text: bytes, a: int, place: int) -> Iterator[tuple[int, int, int]]:
        """First and last window, and the anchor's first place in them."""
        last = len(tokens) - window
        if place >= 0:
            yield 0, last, place
            return
        low = 0
        for at in np.flatnonzero((mix(Words([text]).windows(anchor)) >> np.uint64(1)).view(np.int64) == a).tolist():
            if low <= min(at, last):
                yield max(low, at - window + anchor), min(at, last), at
                low = at + 1

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(9)]
            for a, whole, _, lo, hi, place, text in zip(*(batch[c].to_pylist() for c in _CUT), strict=True):
                tokens = text.split(b" ")
                for first, last, at in runs(tokens, text, a, place):
                    for j in range((at - last) // band, (at - first) // band + 1):
                        high = at - j * band
                        low = high - band + 1
                        begin, end = max(low, first), min(high, last)
                        part = tokens[begin : end + window]
                        key = code(number(a), number(j), *tokens[high : low + window])
                        for col, v in zip(out, (key, code(number(at - begin), *part), at - begin, b" ".join(part), a, whole, lo, hi, begin), strict=True):
                            col.append(v)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.binary()), *(pa.array(c, pa.int64()) for c in out[4:])], names=["key", "sub", "place", "words", "shard", "whole", "lo", "hi", "low"])

    return cuts.select(*_CUT).mapInArrow(deal, "key long, sub long, place long, words binary, shard long, whole long, lo long, hi long, low long")


def _owners(cuts: DataFrame, window: int, anchor: int, limit: int, bands: tuple[int, ...]) -> tuple[DataFrame, list[DataFrame]]:
    """As ``_matched``, for shards of any size, and the tables to drop after use."""
    large = cuts.where(F.col("texts") > limit)
    if not bands or large.isEmpty():
        return _matched(cuts, window), []
    parts = common.written(_dealt(large, window, anchor, bands[0]), "parts")
    alike = parts.groupBy("key", "sub").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.first("place").alias("place"), F.first("words").alias("words"))
    alike = common.written(alike.select(F.col("key").alias("shard"), F.col("sub").alias("whole"), "lo", "hi", "place", "words"), "different-parts")
    sizes = common.written(alike.groupBy("shard").agg(F.count("*").alias("texts")), "part-shards")
    sized = common.written(alike.join(sizes, "shard").select(*_CUT), "part-words")
    # What is alone in its shard has one owner throughout.
    windows = F.size(F.split(F.col("words").cast("string"), " ", -1)) - window + 1
    alone = sized.where("texts = 1 and lo < hi").select("shard", "whole", F.lit(0).alias("begin"), windows.alias("end"), F.col("lo").alias("first"))
    found, temporary = _owners(sized.where("texts > 1"), window, anchor, limit, bands[1:])
    said = common.written(alone.union(found).select(F.col("shard").alias("key"), F.col("whole").alias("sub"), "begin", "end", "first"), "part-verdicts")
    low = F.col("low").cast("int")
    back = parts.join(said, ["key", "sub"]).where("first < hi").select("shard", "whole", (low + F.col("begin")).alias("begin"), (low + F.col("end")).alias("end"), "first")
    return _matched(cuts.where(F.col("texts") <= limit), window).union(back), [parts, alike, sizes, sized, said, *temporary]


def repeated_spans(docs: DataFrame, *, window: int = WINDOW, anchor: int = ANCHOR, shard_limit: int = SHARD_LIMIT) -> tuple[DataFrame, DataFrame]:
    """What to remove, and the documents that may lose something.

    ``gone(doc_id, body, removals)``: spans (begin, end) of word numbers, end exclusive, of windows
    whose words also start in a document with a smaller doc_id.  ``texts(doc_id,
    body, text)``: documents with an anchor that an earlier one has; body is a hash of the
    text that tells apart different texts under one doc_id.
    """
    rows = _keys(docs)
    known = rows.where("doc_id is not null")
    frequent = np.zeros(0, np.uint64)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in small_batches(batch, "text"):
                words = Words(texts)
                text, begin, size, name, at = anchors(words, window, anchor, frequent)
                if len(text):
                    take = pa.array(text)
                    whole = words.runs(at, at + size + window - 1)
                    yield pa.RecordBatch.from_arrays(
                        [part["doc_id"].take(take), part["body"].take(take), pa.array(begin * _PACK + size), pa.array(name), pa.array(whole.view(np.int64))],
                        names=["doc_id", "body", "at", "anchor", "whole"],
                    )

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in small_batches(batch, "text"):
                yield pa.RecordBatch.from_arrays([pa.array(anchors(Words(texts), window, anchor, np.zeros(0, np.uint64))[3])], names=["anchor"])

    # An anchor inside a very common passage would gather all that stands beside the passage.
    # Fewer than FREQUENT_MOST anchors can hold more than that share of all that are counted.
    counts = common.written(known.mapInArrow(names, "anchor long").groupBy("anchor").count().where(F.col("count") >= FREQUENT), "frequent")
    total = counts.agg(F.sum("count")).first()[0] or 0
    often = counts.where(F.col("count") > total / FREQUENT_MOST).select("anchor").collect()
    frequent = np.sort(np.array([r.anchor for r in often], np.uint64))
    found = common.written(known.mapInArrow(find, "doc_id long, body long, at long, anchor long, whole long"), "anchors")
    # Written by itself, so that the join deals an anchor with very many places to several tasks.
    repeated = common.written(found.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("anchor", "lo"), "repeated")
    places = common.written(found.join(repeated, "anchor"), "places")
    common.dropped(counts, found, repeated)
    different = common.written(places.groupBy("anchor", "whole").agg(F.min(F.struct("doc_id", "body", "at")).alias("owner"), F.max("doc_id").alias("hi")), "segments")
    shards = common.written(different.groupBy("anchor").agg(F.count("*").alias("texts")).where("texts > 1"), "shards")
    sized = common.written(different.join(shards, "anchor", "left"), "sized")
    common.dropped(different, shards)

    asked = sized.where("texts is not null").groupBy("owner.doc_id", "owner.body").agg(F.collect_list(F.struct("owner.at", "anchor", "whole", "texts", "hi")).alias("hits"))
    losers = places.where("doc_id > lo").select("doc_id", "body").distinct()
    wanted = losers.join(asked, ["doc_id", "body"], "full_outer")
    texts = common.written(known.join(wanted, ["doc_id", "body"]), "hit-texts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw in small_batches(batch, "text"):
                out: list[list] = [[], [], [], [], [], []]
                for doc_id, text, hits in zip(part["doc_id"].to_pylist(), raw, part["hits"].to_pylist(), strict=True):
                    tokens = text.split()
                    for p in hits:
                        begin, size = divmod(p["at"], _PACK)
                        for col, v in zip(out, (p["anchor"], p["whole"], p["texts"], doc_id, p["hi"], b" ".join(tokens[begin : begin + size + window - 1])), strict=True):
                            col.append(v)
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:5]), pa.array(out[5], pa.binary())], names=["anchor", "whole", "texts", "lo", "hi", "words"])

    segments = common.written(texts.where("hits is not null").mapInArrow(cut, "anchor long, whole long, texts long, lo long, hi long, words binary"), "segment-words")
    found_, temporary = _owners(segments.select(F.col("anchor").alias("shard"), "whole", "texts", "lo", "hi", F.lit(-1).cast("long").alias("place"), "words"), window, anchor, shard_limit, BANDS)
    own = F.col("owner.doc_id")
    alone = sized.where(F.col("texts").isNull() & (own < F.col("hi"))).select("anchor", "whole", F.lit(0).alias("begin"), F.pmod("owner.at", F.lit(_PACK)).cast("int").alias("end"), own.alias("first"))
    verdicts = common.written(alone.union(found_), "verdicts")
    at = F.shiftright("at", _PACK.bit_length() - 1)
    spans = places.join(verdicts, ["anchor", "whole"]).where("first < doc_id").select("doc_id", "body", (at + F.col("begin")).alias("begin"), (at + F.col("end") + window - 1).alias("end"))
    gone = common.written(spans.groupBy("doc_id", "body").agg(F.collect_set(F.struct("begin", "end")).alias("removals")), "removals")
    common.dropped(places, sized, segments, verdicts, *temporary)
    return gone, texts.drop("hits")


def dedup(docs: DataFrame, *, window: int = WINDOW, anchor: int = ANCHOR, shard_limit: int = SHARD_LIMIT, keep_text: bool = True) -> DataFrame:
    """Remove every word covered by a window of ``window`` words that an earlier document has.

    Words are runs of ``[^\\x20\\x09-\\x0D]``; a document is earlier if its doc_id is
    smaller, so rows with equal doc_id do not remove each other's words; rows with a
    null doc_id are neither judged nor held against others.  Returns a row per input row:
    ``doc_id, n_words, n_removed, kept_sha256`` and, with ``keep_text``, ``kept_text``
    (kept words joined by one space).  Null, empty and short texts lose nothing; texts of any
    length are read whole; an empty table gives an empty result; other columns are not read.
    """
    gone, texts = repeated_spans(docs, window=window, anchor=anchor, shard_limit=shard_limit)
    fields = "doc_id long, body long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removals = batch["removals"].to_pylist() if "removals" in batch.schema.names else [None] * batch.num_rows
            done = 0
            for part, raw in small_batches(batch, "text"):
                out: list[list] = [[], [], [], []]
                for text, places in zip(raw, removals[done : done + len(raw)], strict=True):
                    words = text.split()
                    n = len(words)
                    if places:
                        gone = np.zeros(n + 1, np.int32)
                        np.add.at(gone, [p["begin"] for p in places], 1)
                        np.add.at(gone, [p["end"] for p in places], -1)
                        words = [words[i] for i in np.flatnonzero(np.cumsum(gone[:n]) == 0).tolist()]
                    rest = b" ".join(words)
                    for col, v in zip(out, (n, n - len(words), hashlib.sha256(rest).hexdigest(), rest), strict=True):
                        col.append(v)
                done += len(raw)
                columns = [part["doc_id"], part["body"], pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())]
                if keep_text:
                    columns.append(pa.array(out[3], pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in fields.split(", ")])

    changed = texts.join(gone, ["doc_id", "body"]).select("doc_id", "body", "text", "removals").mapInArrow(kept, fields)
    whole = _keys(docs).mapInArrow(kept, fields)
    by = [c.split()[0] for c in fields.split(", ")][2:]
    new = changed.select(F.col("doc_id").alias("id2"), F.col("body").alias("body2"), F.struct(*by).alias("new")).dropDuplicates(["id2", "body2"])
    both = whole.join(new, (F.col("doc_id") == F.col("id2")) & (F.col("body") == F.col("body2")), "left")
    return both.select("doc_id", *(F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) for c in by))
