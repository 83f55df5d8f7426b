"""Suffix-array dedup: byte strings that occur twice anywhere, found with two-stage suffix sorting.

1. A window of ``window`` bytes is named by its anchor, the run of 16 bytes in it with the
   least hash (of equal ones the first).  Equal windows have equal anchors at equal places, so a
   window can only repeat where its anchor does.  Neighbouring windows with the same
   anchor, at the same place, are a segment; no two windows of a segment are equal.
2. Segments are counted by anchor and by a hash of their bytes.  What lies in a segment
   that occurs twice is repeated throughout, and its text is not needed.  An anchor
   that occurs once leaves the work.  Only shards (an anchor's different segments)
   with a segment that occurs once need bytes, fetched once from one document that has them.
3. Shards meet in tasks, and a suffix array is built over some of them at a time: suffixes
   smaller than their successors are sorted directly, the rest are induced from them by one scan
   over the buckets of first bytes.  Neighbours in it that share a window's length are repeated.
4. A shard of more than ``shard_limit`` segments is not gathered in one task.  Its windows are dealt
   by where the anchor stands in them, 16 places at a time, and by the bytes that all windows of those places
   would have in common; what is equal then is counted, and the shards that remain go through the same steps,
   dealt by 4 places and by single ones if need be.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .wordhash import _power_tables as power_tables
from .wordhash import mix, small_batches

WINDOW = 200
#: Bytes of an anchor.
GRAM = 16
SHARD_LIMIT = 2048
#: Places of the anchor that a large shard is dealt by, one after another; the last leaves nothing to compare.
BANDS = (16, 4, 1)
#: Bytes under one suffix array (a shard more at most), and of a piece of a long text that is read at a time.
BLOCK = 1 << 19
PIECE = 1 << 19
#: A segment's place is one long: its first byte times this, plus its windows.
_PACK = 1 << 16
_A, _B = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)
#: Positions within a block are packed below the hashes.
_PLACE = np.uint64((1 << 24) - 1)


# ---- suffix arrays

#: Symbols of a gram: nine bits each, a byte plus one, or 0 between strings.
_STEP, _BITS = 7, 9


class SuffixArray:
    """Suffixes of several byte strings in order, told apart by their first ``depth`` bytes at least.

    ``order`` has the first positions in ``text``, where a 0 ends each string and bytes are one more
    than they are; ``left[i]`` is the number of bytes from i to the end of its string.
    """

    def __init__(self, strings: list[bytes], depth: int):
        self.depth = depth
        sizes = np.fromiter((len(s) + 1 for s in strings), np.int64, len(strings))
        self.begins = np.cumsum(sizes) - sizes
        n = int(sizes.sum())
        text = np.zeros(n + depth + 2 * _STEP, np.int16)
        text[:n] = np.frombuffer(b"\0".join([*strings, b""]), np.uint8)
        text[:n] += 1
        ends = self.begins + sizes - 1
        text[ends] = 0
        self.text, self.n = text, n
        self.left = np.repeat(ends, sizes) - np.arange(n)
        grams = np.zeros(n + depth + _STEP, np.int64)
        for j in range(_STEP):
            grams = (grams << _BITS) | text[j : j + len(grams)]
        known, rank = np.unique(grams, return_inverse=True)
        self.rank, self.most = rank.astype(np.int32), len(known)
        del grams, known, rank
        self.order = self._induced(self._sorted(np.flatnonzero(self._smaller())))

    def _smaller(self) -> np.ndarray:
        """Whether a suffix is smaller than its successor: by the next symbol that differs."""
        step = np.diff(self.text[: self.n].astype(np.int32), append=np.int32(512))
        at = np.where(step != 0, np.arange(self.n), self.n)
        return step[np.minimum.accumulate(at[::-1])[::-1]] > 0

    def _sorted(self, at: np.ndarray) -> np.ndarray:
        """Positions in the order of their suffixes, compared directly, gram by gram where still equal."""
        key = self.rank[at]
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        same = np.zeros(len(at) + 1, bool)
        same[1:-1] = key[1:] == key[:-1]
        deep = _STEP
        while deep < self.depth:
            # Groups of equal ones that have not reached the end of their strings.
            live = np.flatnonzero((same[1:] | same[:-1]) & (self.left[at] >= deep))
            if not len(live):
                break
            group = np.cumsum(~same[live])
            part = at[live]
            key, take = group, 0
            while deep < self.depth and (take == 0 or int(key.max()) * self.most < 1 << 62):
                key = key * self.most + self.rank[part + deep]
                deep, take = deep + _STEP, take + 1
            by = np.argsort(key, kind="stable")
            at[live], key = part[by], key[by]
            again = np.zeros(len(live), bool)
            again[1:] = key[1:] == key[:-1]
            same[live] = again
        return at

    def _induced(self, smaller: np.ndarray) -> np.ndarray:
        """The order of all suffixes, from that of those smaller than their successors."""
        text, n = self.text, self.n
        size, high = np.bincount(text[:n], minlength=257), np.bincount(text[smaller], minlength=257)
        end = np.cumsum(size)
        head = end - size  # where the next induced suffix of a bucket goes
        order = np.empty(n, np.int64)
        first = text[smaller].astype(np.int64)
        order[(end - high)[first] + np.arange(len(smaller)) - (np.cumsum(high) - high)[first]] = smaller
        for c in np.flatnonzero(size).tolist():
            low, full = int(end[c] - size[c]), int(head[c])
            while low < full:  # runs of one byte: each comes after those shorter by one
                before = order[low:full] - 1
                before = before[text[before] == c]  # before the first suffix comes the padding
                low = full
                order[full : full + len(before)] = before
                full += len(before)
            before = order[end[c] - size[c] : end[c]] - 1
            before = before[text[before] > c]
            into = text[before].astype(np.int64)
            by = np.argsort(into, kind="stable")
            into = into[by]
            many = np.bincount(into, minlength=257)
            order[head[into] + np.arange(len(into)) - (np.cumsum(many) - many)[into]] = before[by]
            head += many
        return order

    def common(self) -> np.ndarray:
        """Common prefix of each suffix and its successor in the order, in bytes: 0 or ``depth`` if that is reached."""
        out = np.zeros(max(self.n - 1, 0), np.int64)
        live = np.flatnonzero((self.left[self.order[:-1]] >= self.depth) & (self.left[self.order[1:]] >= self.depth))
        for deep in (*range(0, self.depth - _STEP, _STEP), self.depth - _STEP):
            live = live[self.rank[self.order[live] + deep] == self.rank[self.order[live + 1] + deep]]
        out[live] = self.depth
        return out

    def repeated(self) -> np.ndarray:
        """Whether the ``depth`` bytes from a position on also start at another."""
        out = np.zeros(self.n, bool)
        at = np.flatnonzero(self.common() >= self.depth)
        out[self.order[at]] = True
        out[self.order[at + 1]] = True
        return out


# ---- segments


def _octets(data: bytes) -> np.ndarray:
    """Eight bytes from each position on as one number, without the last seven positions."""
    out = np.empty(len(data) - 7, np.uint64)
    for i in range(min(8, len(out))):
        out[i::8] = np.frombuffer(data, "<u8", (len(data) - i) // 8, i)
    return out


def _gram_hashes(data: bytes) -> np.ndarray:
    eight = _octets(data)
    return mix(eight[:-8] * _A + (eight[8:] ^ (eight[8:] >> np.uint64(29))) * _B)


def segments(pieces: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each segment: its piece, first byte in that, windows, anchor, and hash of its bytes."""
    data = b"".join(pieces)
    width = window - GRAM + 1
    if len(data) < window:
        return (np.zeros(0, np.int64),) * 5
    hashes = _gram_hashes(data)
    least = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
    have = 1
    while 2 * have <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
    place = (least & _PLACE).astype(np.int64)
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    ends = np.cumsum(sizes)
    whole = np.ones(len(place), bool)
    for e in ends[:-1].tolist():  # windows over the end of a piece
        whole[max(0, e - window + 1) : e] = False
    at = np.flatnonzero(whole)
    if not len(at):
        return (np.zeros(0, np.int64),) * 5
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(place[at]) != 0) | (np.diff(at) != 1)
    begin = at[new]
    size = np.diff(np.append(np.flatnonzero(new), len(at)))
    up, down = power_tables(len(hashes) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * up[: len(hashes)], dtype=np.uint64)))
    body = mix((sums[begin + size + window - GRAM] - sums[begin]) * down[begin] + size.astype(np.uint64))
    piece = np.searchsorted(ends, begin, side="right")
    return piece, begin - (ends - sizes)[piece], size, hashes[place[begin]].view(np.int64), body.view(np.int64)


def _pieces(texts: list[bytes], window: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Texts, and long ones in overlapping pieces, so that each window lies in one: text numbers, first bytes and pieces, some at a time."""
    rows, begins, parts, total = [], [], [], 0
    for row, text in enumerate(texts):
        for begin in range(0, len(text) - window + 1, PIECE):
            if total >= PIECE:
                yield rows, begins, parts
                rows, begins, parts, total = [], [], [], 0
            rows.append(row)
            begins.append(begin)
            parts.append(text[begin : begin + PIECE + window - 1])
            total += len(parts[-1])
    if parts:
        yield rows, begins, parts


def _keys(docs: DataFrame) -> DataFrame:
    """``doc, body, text``: what a row loses depends on its text alone, so null ids may go by any number."""
    rows = common.identified(docs)
    return rows.select(F.coalesce("doc_id", F.lit(0)).alias("doc"), F.xxhash64("text").alias("body"), F.coalesce("text", F.lit("")).alias("text"))


#: A segment of a shard: its occurrences, the anchor's place in its bytes (-1: where its hash is), and the bytes.
_CUT = "shard long, whole long, n long, place long, bytes binary"


def _compared(cuts: DataFrame, window: int) -> DataFrame:
    """``shard, whole, begin, end``: runs of repeated windows of the segments that occur once."""

    def told(held: dict[tuple[int, int], tuple[int, bytes]]) -> pa.RecordBatch:
        array = SuffixArray([b for _, b in held.values()], window)
        edge = np.flatnonzero(np.diff(array.repeated().view(np.int8), prepend=np.int8(0), append=np.int8(0)))
        begin, end = edge[0::2], edge[1::2]
        row = np.searchsorted(array.begins, begin, side="right") - 1
        name = np.array(list(held), np.int64).reshape(-1, 2)
        once = np.fromiter((n == 1 for n, _ in held.values()), bool, len(held))[row]
        row, begin, end = row[once], begin[once], end[once]
        at = array.begins[row]
        return pa.RecordBatch.from_arrays([pa.array(name[row, 0]), pa.array(name[row, 1]), pa.array(begin - at, pa.int32()), pa.array(end - at, pa.int32())], names=["shard", "whole", "begin", "end"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows arrive sorted by shard; the shards of about BLOCK bytes share a suffix array."""
        held: dict[tuple[int, int], tuple[int, bytes]] = {}
        shard, total = None, 0
        for batch in batches:
            for a, whole, n, text in zip(*(batch[c].to_pylist() for c in ("shard", "whole", "n", "bytes")), strict=True):
                if a != shard and total >= BLOCK:
                    yield told(held)
                    held, total = {}, 0
                shard = a
                if (a, whole) not in held:  # a row that is repeated brings its cuts again
                    held[a, whole] = (n, text)
                    total += len(text)
        if held:
            yield told(held)

    rows = cuts.select("shard", "whole", "n", "bytes").repartition("shard").sortWithinPartitions("shard")
    return rows.mapInArrow(match, "shard long, whole long, begin int, end int")


def _dealt(cuts: DataFrame, window: int, band: int) -> DataFrame:
    """Parts of segments, ``key, sub, place, bytes`` and whence they are: ``shard, whole, n, low``.

    A part has the windows in which the anchor stands at one of ``band`` neighbouring places.  ``key``
    is a hash of the bytes that any such window has, so equal windows have it in common; ``sub`` one of all its bytes.
    """
    code = lambda *parts: int.from_bytes(hashlib.blake2b(b"|".join(parts), digest_size=8).digest(), "little", signed=True)
    number = lambda n: str(n).encode()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for a, whole, n, place, text in zip(*(batch[c].to_pylist() for c in ("shard", "whole", "n", "place", "bytes")), strict=True):
                if place < 0:
                    place = int(np.flatnonzero(_gram_hashes(text).view(np.int64) == a)[0])
                last = len(text) - window
                for j in range((place - last) // band, place // band + 1):
                    high = place - j * band
                    low = high - band + 1
                    begin, end = max(low, 0), min(high, last) + window
                    part = text[begin:end]
                    key = code(number(a), number(j), text[high : low + window])
                    for col, v in zip(out, (key, code(number(place - begin), part), place - begin, part, a, whole, n, begin), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.binary()), *(pa.array(c, pa.int64()) for c in out[4:])], names=["key", "sub", "place", "bytes", "shard", "whole", "n", "low"])

    return cuts.mapInArrow(deal, "key long, sub long, place long, bytes binary, shard long, whole long, n long, low long")


def repeats(cuts: DataFrame, sizes: DataFrame, window: int, limit: int, bands: tuple[int, ...]) -> tuple[DataFrame, list[DataFrame]]:
    """Runs of repeated windows, ``shard, whole, begin, end``, of segments that occur once, and the tables to drop after use.

    ``cuts`` are written segments, ``sizes(shard, texts)`` how many different ones each shard has.
    """
    large = common.written(sizes.where(F.col("texts") > limit).select("shard"), "large-shards")
    if not bands or large.isEmpty():
        return _compared(cuts, window), [large]
    small = _compared(cuts.join(large, "shard", "left_anti"), window)
    parts = common.written(_dealt(cuts.join(large, "shard").dropDuplicates(["shard", "whole"]), window, bands[0]), "parts")
    alike = parts.groupBy("key", "sub").agg(F.sum("n").alias("n"), F.first("place").alias("place"), F.first("bytes").alias("bytes"))
    alike = common.written(alike.select(F.col("key").alias("shard"), F.col("sub").alias("whole"), "n", "place", "bytes"), "different-parts")
    left = common.written(alike.groupBy("shard").agg(F.count("*").alias("texts"), F.min("n").alias("least")).where("texts > 1 and least = 1").select("shard", "texts"), "shards")
    within = common.written(alike.join(left, "shard").select(*alike.columns), "part-bytes")
    found, temporary = repeats(within, left, window, limit, bands[1:])
    whole = alike.where("n > 1").select("shard", "whole", F.lit(0).alias("begin"), (F.octet_length("bytes") - window + 1).cast("int").alias("end"))
    said = common.written(whole.union(found).select(F.col("shard").alias("key"), F.col("whole").alias("sub"), "begin", "end"), "part-verdicts")
    low = F.col("low").cast("int")
    back = parts.where("n = 1").join(said, ["key", "sub"]).select("shard", "whole", (low + F.col("begin")).alias("begin"), (low + F.col("end")).alias("end"))
    return small.union(back), [large, parts, alike, left, within, said, *temporary]


def repeated_spans(docs: DataFrame, *, window: int = WINDOW, shard_limit: int = SHARD_LIMIT) -> tuple[DataFrame, DataFrame]:
    """What to remove, and the texts that may lose something.

    ``gone(doc, body, removals)``: spans (begin, end) of bytes, end exclusive, of windows that start
    somewhere else too; ``texts(doc, body, text, hits)``.  ``doc`` is the doc_id, 0 for null.
    """
    rows = _keys(docs)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in small_batches(batch, "text", PIECE):
                for numbers, begins, pieces in _pieces(texts, window):
                    piece, begin, size, anchor, whole = segments(pieces, window)
                    take = pa.array(np.array(numbers)[piece])
                    place = (np.array(begins, np.int64)[piece] + begin) * _PACK + size
                    yield pa.RecordBatch.from_arrays([part["doc"].take(take), part["body"].take(take), pa.array(place), pa.array(anchor), pa.array(whole)], names=["doc", "body", "at", "anchor", "whole"])

    found = common.written(rows.mapInArrow(find, "doc long, body long, at long, anchor long, whole long"), "byte-segments")
    # Written by themselves, so that the joins deal a key with very many rows to several tasks.
    twice = common.written(found.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "anchors")
    places = common.written(found.join(twice, "anchor"), "places")
    common.dropped(found, twice)
    different = common.written(places.groupBy("anchor", "whole").agg(F.count("*").alias("n"), F.min(F.struct("doc", "body", "at")).alias("owner")), "different")
    shards = common.written(different.groupBy("anchor").agg(F.count("*").alias("texts"), F.min("n").alias("least")).where("least = 1").select("anchor", "texts"), "shards")

    asked = different.join(shards, "anchor").groupBy("owner.doc", "owner.body").agg(F.collect_list(F.struct("owner.at", "anchor", "whole", "n")).alias("hits"))
    wanted = common.written(places.select("doc", "body").distinct().join(asked, ["doc", "body"], "left"), "wanted")
    texts = common.written(rows.join(wanted, ["doc", "body"]), "hit-texts")
    common.dropped(wanted)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for _, raw in small_batches(batch, "text"):
                for text, hits in zip(raw, batch["hits"].slice(done, len(raw)), strict=True):
                    at, size = np.divmod(hits.values.field("at").to_numpy(), _PACK)
                    cuts = [text[b : b + s + window - 1] for b, s in zip(at.tolist(), size.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([*(hits.values.field(c) for c in ("anchor", "whole", "n")), pa.array(np.full(len(cuts), -1)), pa.array(cuts, pa.binary())], names=["shard", "whole", "n", "place", "bytes"])
                done += len(raw)

    cuts = common.written(texts.where("hits is not null").select("text", "hits").mapInArrow(cut, _CUT), "segment-bytes")
    size = F.pmod("owner.at", F.lit(_PACK)).cast("int")
    full = different.where("n > 1").select(F.col("anchor").alias("shard"), "whole", F.lit(0).alias("begin"), size.alias("end"))
    found, temporary = repeats(cuts, shards.withColumnRenamed("anchor", "shard"), window, shard_limit, BANDS)
    verdicts = common.written(full.union(found).withColumnRenamed("shard", "anchor"), "verdicts")
    common.dropped(shards, cuts, *temporary)
    at = F.shiftright("at", _PACK.bit_length() - 1)
    spans = places.join(verdicts, ["anchor", "whole"]).select("doc", "body", (at + F.col("begin")).alias("begin"), (at + F.col("end") + window - 1).alias("end"))
    gone = common.written(spans.groupBy("doc", "body").agg(F.collect_set(F.struct("begin", "end")).alias("removals")), "removals")
    common.dropped(places, different, verdicts)
    return gone, texts


def dedup(docs: DataFrame, *, window: int = WINDOW, shard_limit: int = SHARD_LIMIT, keep_bytes: bool = True) -> DataFrame:
    """Remove every byte covered by a string of ``window`` bytes that also starts somewhere else.

    Somewhere else is another place of the same text or any place of another row's; both lose it.
    Returns a row per input row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and, with
    ``keep_bytes``, ``kept_bytes`` (what is left, concatenated; a cut may split a character).  Rows
    with a null or repeated doc_id are rows like others, so a repeated row is the other's copy.
    Null, empty and short texts lose nothing; texts of any length are read whole, in
    overlapping pieces; an empty table gives an empty result; other columns are not read.
    """
    gone, texts = repeated_spans(docs, window=window, shard_limit=shard_limit)
    fields = "doc long, body long, n_removed long, n_spans long, kept_sha256 string" + ", kept_bytes binary" * keep_bytes
    names = [f.split()[0] for f in fields.split(", ")]

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for part, raw in small_batches(batch, "text"):
                out: list[list] = [[], [], [], []]
                for text, spans in zip(raw, batch["removals"].slice(done, len(raw)), strict=True):
                    depth = np.zeros(len(text) + 1, np.int32)
                    np.add.at(depth, spans.values.field("begin").to_numpy(), 1)
                    np.add.at(depth, spans.values.field("end").to_numpy(), -1)
                    stay = np.cumsum(depth[:-1]) == 0
                    rest = np.frombuffer(text, np.uint8)[stay].tobytes()
                    runs = np.count_nonzero(np.diff(stay.view(np.int8), prepend=np.int8(1)) < 0)
                    for col, v in zip(out, (len(text) - len(rest), runs, hashlib.sha256(rest).hexdigest(), rest), strict=True):
                        col.append(v)
                done += len(raw)
                yield pa.RecordBatch.from_arrays([part["doc"], part["body"], pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2]), *([pa.array(out[3], pa.binary())] if keep_bytes else [])], names=names)

    changed = texts.join(gone, ["doc", "body"]).dropDuplicates(["doc", "body"]).select("doc", "body", "text", "removals").mapInArrow(kept, fields)
    new = common.written(changed.select(F.col("doc").alias("doc2"), F.col("body").alias("body2"), F.struct(*names[2:]).alias("new")), "cut-texts")
    common.dropped(gone, texts)
    same = {"n_removed": F.lit(0).cast("long"), "n_spans": F.lit(0).cast("long"), "kept_sha256": F.sha2(F.col("text").cast("binary"), 256), "kept_bytes": F.col("text").cast("binary")}
    whole = common.identified(docs).select("doc_id", F.coalesce("doc_id", F.lit(0)).alias("doc"), F.xxhash64("text").alias("body"), F.coalesce("text", F.lit("")).alias("text"))
    whole = whole.select("doc_id", "doc", "body", F.octet_length("text").cast("long").alias("n_bytes"), *(same[c].alias(c) for c in names[2:]))
    both = whole.join(new, (F.col("doc") == F.col("doc2")) & (F.col("body") == F.col("body2")), "left")
    return both.select("doc_id", "n_bytes", *(F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) for c in names[2:]))
