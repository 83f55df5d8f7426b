"""Vector code compression: product codes whose codebooks come from Lloyd rounds over cover trees.

1. Vectors are cut into parts.  Blocks of vectors, wherever they lie, get a cover tree per
   part: a node holds points within its radius of its own point, children halve
   that radius, and cumulative sums over the tree's order give the sum of any subtree.  Trees
   are built once and written; no vector leaves its block.
2. A round descends the trees.  If the nearest entry to a node's point stays the nearest for
   all within its radius, by the triangle inequality, the whole subtree is assigned by its sum.
   Only nodes where that is open are gone into, and only points of open leaves are
   compared one by one.
3. Sums per part and entry, a row each per task, give the next codebooks.  They and the seeds are
   all that passes through the driver; their size does not depend on the number of vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .vectors import narrowed, squared, whole, whole_row

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors of a block, and points of a leaf, at most.
BLOCK, LEAF = 8192, 16
_TREE = "points array<binary>, places array<binary>, nodes array<binary>"


class CoverTree:
    """Points in tree order.  ``nodes`` has a row each: first point (its own), end, squared radius, first child, end of children."""

    def __init__(self, points: np.ndarray, places: np.ndarray, nodes: np.ndarray):
        self.points, self.places, self.nodes = points, places, nodes
        self.sums = np.concatenate((np.zeros((1, points.shape[1]), np.int64), np.cumsum(points, axis=0)))

    @classmethod
    def build(cls, points: np.ndarray, leaf: int = LEAF) -> CoverTree:
        places = np.arange(len(points))
        nodes = [[0, len(points), 0, 0, 0]] if len(points) else []
        for node in nodes:  # grows as it goes
            begin, end = node[:2]
            mine = places[begin:end]
            gap = points[mine] - points[mine[0]]
            far = np.einsum("ij,ij->i", gap, gap)
            node[2] = int(far.max())
            if not node[2] or end - begin <= leaf:
                continue
            node[3], at, groups = len(nodes), begin, []
            while True:
                near = 4 * far <= node[2]
                groups.append(mine[near])
                nodes.append([at, at + len(groups[-1]), 0, 0, 0])
                at += len(groups[-1])
                mine = mine[~near]
                if not len(mine):
                    break
                gap = points[mine] - points[mine[0]]
                far = np.einsum("ij,ij->i", gap, gap)
            places[begin:end] = np.concatenate(groups)
            node[4] = len(nodes)
        return cls(points[places], places, np.array(nodes, np.int64).reshape(-1, 5))

    def assign(self, entries: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
        """Whole subtrees (first points, ends, entries); then points compared one by one and their entries."""
        sure, open_leaves = [], []
        front = self.nodes[:1]
        while len(front):
            far = squared(self.points[front[:, 0]], entries)
            best = far.argmin(axis=1)  # the first of equally near ones
            row = np.arange(len(front))
            near = np.sqrt(far[row, best].astype(np.float64))
            rest = far.astype(np.float64)
            rest[row, best] = np.inf
            # Roots are rounded: the margin makes what is sure no more than what is true.
            clear = (front[:, 2] == 0) | ((near + 2 * np.sqrt(front[:, 2].astype(np.float64))) * (1 + 1e-9) < np.sqrt(rest.min(axis=1)))
            sure.append((front[clear, 0], front[clear, 1], best[clear]))
            left = front[~clear]
            bare = left[:, 4] == 0
            open_leaves.append(left[bare])
            left = left[~bare]
            front = self.nodes[_ranges(left[:, 3], left[:, 4])]
        leaves = np.concatenate(open_leaves) if open_leaves else self.nodes[:0]
        single = _ranges(leaves[:, 0], leaves[:, 1])
        return sure, single, squared(self.points[single], entries).argmin(axis=1) if len(single) else single

    def totals(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Points and their sum for each entry."""
        count, total = np.zeros(len(entries), np.int64), np.zeros(entries.shape, np.int64)
        sure, single, best = self.assign(entries)
        for begin, end, entry in sure:
            np.add.at(count, entry, end - begin)
            np.add.at(total, entry, self.sums[end] - self.sums[begin])
        np.add.at(count, best, 1)
        np.add.at(total, best, self.points[single])
        return count, total

    def codes(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry and squared distance of every point, in the block's order."""
        found = np.zeros(len(self.points), np.int64)
        sure, single, best = self.assign(entries)
        for begin, end, entry in sure:
            found[_ranges(begin, end)] = np.repeat(entry, end - begin)
        found[single] = best
        gap = self.points - entries[found]
        code, error = np.empty_like(found), np.empty_like(found)
        code[self.places], error[self.places] = found, np.einsum("ij,ij->i", gap, gap)
        return code, error


def _ranges(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All numbers of several ranges, one after another."""
    size = end - begin
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())


def trees(kept: DataFrame, dim: int, parts: int, scale: int) -> DataFrame:
    """A row per block: the ids and labels of its vectors and a cover tree for each part, written."""
    label = kept.schema["label"].dataType.simpleString()
    width = dim // parts

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                block = batch.slice(i, BLOCK)
                x = whole(block["v"], dim, scale)
                grown = [CoverTree.build(x[:, p * width : (p + 1) * width]) for p in range(parts)]
                lists = [pa.ListArray.from_arrays(pa.array([0, block.num_rows], pa.int32()), block[c]) for c in ("vec_id", "label")]
                packed = [[a.astype(t).tobytes() for a in arrays] for arrays, t in (((g.points for g in grown), np.int32), ((g.places for g in grown), np.int32), ((g.nodes for g in grown), np.int64))]
                yield pa.RecordBatch.from_arrays([*lists, *(pa.array([p], pa.list_(pa.binary())) for p in packed)], names=["vec_id", "label", "points", "places", "nodes"])

    return common.written(kept.mapInArrow(plant, f"vec_id array<long>, label array<{label}>, {_TREE}"), "cover-trees")


def _read(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, list[CoverTree]]]:
    """Row number and trees of each block, one block in memory at a time."""
    for i in range(batch.num_rows):
        get = lambda c, t: (np.frombuffer(b.as_buffer(), t) for b in batch[c][i].values)  # noqa: B023, E731
        yield i, [CoverTree(p.reshape(-1, width).astype(np.int64), q, n.reshape(-1, 5)) for p, q, n in zip(get("points", np.int32), get("places", np.int32), get("nodes", np.int64), strict=True)]


def codebooks(planted: DataFrame, seeds: np.ndarray, rounds: int) -> np.ndarray:
    """Codebooks (part, entry, component) after ``rounds`` rounds from ``seeds``; an unused entry stays."""
    books = seeds
    for _ in range(rounds):

        def sums(batches: Iterator[pa.RecordBatch], books: np.ndarray = books) -> Iterator[pa.RecordBatch]:
            count, total = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
            for batch in batches:
                for _, block in _read(batch, books.shape[2]):
                    for p, tree in enumerate(block):
                        n, t = tree.totals(books[p])
                        count[p] += n
                        total[p] += t
            part, entry = np.nonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry]), pa.array(total[part, entry].tolist(), pa.list_(pa.int64()))], names=["part", "entry", "n", "total"])

        told = planted.select("points", "places", "nodes").mapInArrow(sums, "part int, entry int, n long, total array<long>")
        added = told.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.get("total", F.lit(i))) for i in range(books.shape[2]))).alias("total"))
        books = books.copy()
        for r in added.collect():
            books[r.part, r.entry] = [t // r.n for t in r.total]
    return books


def compress(
    table: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> DataFrame:
    """Product code and error of every vector: ``vec_id, code, error, label_error, codebooks_sha256``.

    Null vectors and those with a null or non-finite component are dropped; components count as
    ``floor(scale * x)``, held within ``vectors.BOUND``.  A code has two hexadecimal digits for
    each part.  Seeds are the ``entries`` rows with the smallest ids (null ids: none; rows that share
    an id by their components); fewer rows give fewer entries.  Every row of a repeated id is a
    vector of its own.  The length of all vectors is that of the smallest id's vector among those
    that can be cut into ``parts`` equal parts; rows of another length stay, with null code and
    error.  Equally near entries: the lower number.  ``label_error`` sums the errors of a
    label's rows, of rows without one too.  An empty table, or one without a seed, has no codes.
    Other columns are not read.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code's two hexadecimal digits tell up to 256 entries apart")
    kept = narrowed(table, id_col, vector_col, F.col(label_col).alias("label"))
    fitting = kept.where(f"vec_id is not null and size(v) > 0 and size(v) % {parts} = 0")
    least = fitting.orderBy("vec_id", "v").select(F.size("v").alias("n")).first()
    if least is None:
        label = F.lit(None)
        return kept.select("vec_id", label.cast("string").alias("code"), *(label.cast("long").alias(c) for c in ("error", "label_error")), label.cast("string").alias("codebooks_sha256"))
    dim = least.n
    first = fitting.where(F.size("v") == dim).orderBy("vec_id", "v").limit(entries).collect()
    seeds = np.array([whole_row(r.v, scale) for r in first], np.int64).reshape(len(first), parts, dim // parts).transpose(1, 0, 2)
    planted = trees(kept.where(F.size("v") == dim), dim, parts, scale)
    books = codebooks(planted, seeds, rounds)
    label = kept.schema["label"].dataType.simpleString()
    digits = np.array([f"{i:02x}" for i in range(256)])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, block in _read(batch, books.shape[2]):
                told = [tree.codes(books[p]) for p, tree in enumerate(block)]
                text = digits[told[0][0]]
                for c, _ in told[1:]:
                    text = np.char.add(text, digits[c])
                yield pa.RecordBatch.from_arrays([batch["vec_id"][i].values, batch["label"][i].values, pa.array(text.tolist(), pa.string()), pa.array(sum(e for _, e in told))], names=["vec_id", "label", "code", "error"])

    coded = planted.mapInArrow(code, f"vec_id long, label {label}, code string, error long")
    other = kept.where(F.size("v") != dim).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    rows = common.written(coded.union(other), "codes")
    common.dropped(planted)
    # Written by itself: small sums are broadcast by their measured size, and else a label with very many rows is split.
    sums = common.written(rows.groupBy("label").agg(F.try_sum("error").alias("label_error")), "label-errors").withColumnRenamed("label", "of")
    said = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    return rows.join(sums, rows["label"].eqNullSafe(sums["of"])).select("vec_id", "code", "error", "label_error", F.lit(said).alias("codebooks_sha256"))
