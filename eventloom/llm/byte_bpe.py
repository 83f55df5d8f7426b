"""Byte-level BPE encoding and decoding by overlapping chunks.

Long texts are cut into chunks that overlap.  Each chunk is pre-tokenised by
itself, in parallel; two neighbours are stitched at the first boundary inside
their overlap that both found.  The pattern matches from left to right and looks
at most one character ahead, so from a common boundary on both see the same
pre-tokens.  Every chunk then encodes the pre-tokens between its own stitches,
matched with the text behind the stitch in view, as in the whole text.
A text whose neighbours share no boundary (one run longer than the overlap) is
encoded in one piece.  Decoding concatenates the bytes of the ids.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

CHUNK = 32_768
OVERLAP = 1_024
#: Boundaries this near to a chunk's cut end may move when text follows.
GUARD = 64
#: Entries of a worker's cache of encoded pre-tokens.
CACHE = 400_000


class Codec:
    """Encodes pre-tokens by a rank file and decodes ids; pre-tokens are cached."""

    def __init__(self, ranks_path: str, pattern: str):
        import regex
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.split = regex.compile(pattern).findall
        self.spans = regex.compile(pattern).finditer
        # Its own pattern takes a pre-token as it is, so that it merges bytes and splits nothing.
        self._piece = tiktoken.Encoding("own", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self._ids: dict[str, bytes] = {}

    def piece(self, piece: str) -> bytes:
        ids = np.asarray(self._piece(piece), "<u4").tobytes()
        if len(self._ids) < CACHE and len(piece) < 64:
            self._ids[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        known, new = self._ids.get, self.piece
        return b"".join([known(p) or new(p) for p in self.split(text)])

    def encode_between(self, text: str, begin: int, end: int | None) -> bytes:
        """Ids of the pre-tokens from the boundary ``begin`` to the boundary ``end``; the pattern sees what follows ``end``."""
        known, new = self._ids.get, self.piece
        out = []
        for m in self.spans(text, begin):
            if end is not None and m.start() >= end:
                break
            out.append(known(p := m.group()) or new(p))
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        table = self.bytes_of
        return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()])

    def boundaries(self, text: str, begin: int, end: int) -> list[int]:
        return [b for m in self.spans(text) if begin <= (b := m.start()) < end]


@lru_cache(2)
def codec(ranks_path: str, pattern: str) -> Codec:
    return Codec(ranks_path, pattern)


def encode(docs: DataFrame, ranks_path: str, pattern: str, *, keep_ids: bool = True, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Encode every whole text of ``docs(doc_id, text)`` and decode the ids again.

    Returns one row per input row: ``doc_id, n_tokens, ids_sha256,
    decoded_sha256`` and, with ``keep_ids``, ``ids`` (little-endian unsigned
    32-bit integers) and ``decoded`` (bytes).  Null and empty texts have no ids;
    repeated rows give repeated rows; a null doc_id stays null; other columns are
    not read.  An empty table gives an empty result.  The rank file must lie at
    the same path on every executor.
    """
    if not 2 * GUARD < overlap < chunk:
        raise ValueError("overlap must lie between 2 * GUARD and chunk")
    rows = common.identified(docs)
    long = F.length(F.coalesce("text", F.lit(""))) > chunk
    fields = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary, decoded binary" if keep_ids else "")

    def results(ids: list, texts: list[bytes | None], tool: Codec) -> pa.RecordBatch:
        out: dict[str, list] = {k.split()[0]: [] for k in fields.split(", ")}
        for doc_id, raw in zip(ids, texts, strict=True):
            got = raw or b""
            back = tool.decode(got)
            out["doc_id"].append(doc_id)
            out["n_tokens"].append(len(got) // 4)
            out["ids_sha256"].append(hashlib.sha256(got).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(back).hexdigest())
            if keep_ids:
                out["ids"].append(got)
                out["decoded"].append(back)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=False)], names=list(out))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(ranks_path, pattern)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                yield results(part["doc_id"].to_pylist(), [tool.encode(t or "") for t in part["text"].to_pylist()], tool)

    # Chunks know their neighbours only by number; what identifies a text is its hash, so repeated rows share the work.
    texts = rows.where(long).groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("key"), "doc_id", "text").agg(F.count("*").alias("copies"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, doc_id, copies, text in zip(*(batch[c].to_pylist() for c in ("key", "doc_id", "copies", "text")), strict=True):
                # The last chunk is longer than the overlap, or else the one before it reaches the end.
                n = max(1, -(-(len(text) - overlap) // chunk))
                pieces = [text[at : at + chunk + overlap] for at in range(0, n * chunk, chunk)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * n), pa.array([doc_id] * n, pa.int64()), pa.array([copies] * n, pa.int64()), pa.array([n] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array(pieces, pa.string())],
                    names=["key", "doc_id", "copies", "n", "no", "piece"],
                )

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(ranks_path, pattern)
        for batch in batches:
            heads, tails = [], []
            for piece in batch["piece"].to_pylist():
                heads.append(tool.boundaries(piece, GUARD, overlap - GUARD))
                tails.append([b - chunk for b in tool.boundaries(piece, chunk + GUARD, chunk + overlap - GUARD)])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64()))],
                names=[*batch.schema.names, "head", "tail"],
            )

    chunk_schema = "key string, doc_id long, copies long, n long, no long, piece string"
    chunks = texts.mapInArrow(cut, chunk_schema).repartition("key", "doc_id", "no").mapInArrow(bounds, chunk_schema + ", head array<long>, tail array<long>")
    pieces = common.written(chunks, "bpe-chunks")
    heads = pieces.select("key", "doc_id", (F.col("no") - 1).alias("no"), F.col("head").alias("next_head"))
    same = [pieces["key"] == heads["key"], pieces["doc_id"].eqNullSafe(heads["doc_id"]), pieces["no"] == heads["no"]]
    stitched = pieces.join(heads, same, "left").select(
        pieces["*"], F.array_min(F.array_intersect("tail", "next_head")).alias("stitch")
    ).drop("head", "tail")
    begins = stitched.select("key", "doc_id", (F.col("no") + 1).alias("no"), F.col("stitch").alias("begin"))
    same = [stitched["key"] == begins["key"], stitched["doc_id"].eqNullSafe(begins["doc_id"]), stitched["no"] == begins["no"]]
    spans = stitched.join(begins, same, "left").select(stitched["*"], begins["begin"])
    lost = (F.col("no") < F.col("n") - 1) & F.col("stitch").isNull()
    broken = spans.where(lost).select("key", "doc_id").distinct()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(ranks_path, pattern)
        for batch in batches:
            ids = []
            for piece, begin, stitch in zip(*(batch[c].to_pylist() for c in ("piece", "begin", "stitch")), strict=True):
                ids.append(tool.encode_between(piece, begin or 0, None if stitch is None else chunk + stitch))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("key", "doc_id", "copies", "no")), pa.array(ids, pa.binary())], names=["key", "doc_id", "copies", "no", "ids"])

    def same_text(a: DataFrame, b: DataFrame) -> list:
        return [a["key"] == b["key"], a["doc_id"].eqNullSafe(b["doc_id"])]

    sound = spans.join(broken, same_text(spans, broken), "left_anti")
    from_chunks = sound.mapInArrow(encoded, "key string, doc_id long, copies long, no long, ids binary")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(ranks_path, pattern)
        for batch in batches:
            for doc_id, copies, parts in zip(*(batch[c].to_pylist() for c in ("doc_id", "copies", "parts")), strict=True):
                yield results([doc_id] * copies, [b"".join(p["ids"] for p in parts)] * copies, tool)

    long_docs = (
        from_chunks.groupBy("key", "doc_id", "copies")
        .agg(F.array_sort(F.collect_list(F.struct("no", "ids"))).alias("parts"))
        .mapInArrow(joined, fields)
    )
    at_once = texts.join(broken, same_text(texts, broken), "left_semi").select("doc_id", "text", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("doc_id", "text")
    return rows.where(~long).mapInArrow(whole, fields).union(long_docs).union(at_once.mapInArrow(whole, fields))
