"""Centroid clustering: Lloyd rounds whose assignments are Orchard searches.

Each centroid has a list of the other centroids by their distance from it.  The search of
a vector starts at the centroid in the middle and goes down its list; whenever a centroid
nearer to the vector is found, the search goes on at the head of that one's list.  What has
been compared is marked and not compared again.  The search ends where the list is used up
or its next centroid is strictly more than twice as far from the current one as the vector
is: nothing from there on can be nearer, nor as near.

Centroids, their lists and the sums of a round (one row per centroid and task) are all that
passes through the driver, and their size does not depend on the number of vectors.
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

K, ROUNDS, DIM, SCALE = 16, 3, 64, 64
#: Vectors that one search handles at a time.
BLOCK = 4096


class Orchard:
    """Exact nearest centroids; of equally near ones the smaller number."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        gaps = squared(centroids, centroids)
        np.fill_diagonal(gaps, -1)
        # The first place of each sorted row is the centroid itself.
        self.lists = np.argsort(gaps, axis=1, kind="stable")[:, 1:]
        self.gaps = np.take_along_axis(gaps, self.lists, 1)
        self.start = int(gaps.sum(axis=1).argmin())

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number and squared distance of each vector's centroid, and how many distances that took."""
        n, k = len(x), len(self.centroids)
        best = np.full(n, self.start)
        gap = x - self.centroids[self.start]
        dist = np.einsum("ij,ij->i", gap, gap)
        place = np.zeros(n, np.int64)
        marked = np.zeros((n, k), bool)
        marked[:, self.start] = True
        live, compared = np.arange(n if k > 1 else 0), n
        while len(live):
            live = live[place[live] < k - 1]
            live = live[self.gaps[best[live], place[live]] <= 4 * dist[live]]
            other = self.lists[best[live], place[live]]
            place[live] += 1
            new = ~marked[live, other]
            row, other = live[new], other[new]
            marked[row, other] = True
            gap = x[row] - self.centroids[other]
            there = np.einsum("ij,ij->i", gap, gap)
            compared += len(row)
            nearer = (there < dist[row]) | ((there == dist[row]) & (other < best[row]))
            row = row[nearer]
            best[row], dist[row], place[row] = other[nearer], there[nearer], 0
        return best, dist, compared


def _blocks(batches: Iterator[pa.RecordBatch], dim: int, scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for i in range(0, batch.num_rows, BLOCK):
            part = batch.slice(i, BLOCK)
            yield part, whole(part["v"], dim, scale)


def seeds(kept: DataFrame, k: int, scale: int, salt: str) -> np.ndarray:
    """The vectors whose salted ids have the least hashes, in that order; rows that share an id go by their components."""
    by = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = kept.where("vec_id is not null").select(by.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([whole_row(r.v, scale) for r in first], np.int64)


def fit(kept: DataFrame, *, k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, salt: str = "1:") -> np.ndarray:
    """Centroids after ``rounds`` rounds over ``kept(vec_id, v)``; fewer than ``k`` where there are fewer vectors with an id."""
    centroids = seeds(kept, k, scale, salt)
    vectors = kept.select("v")
    for _ in range(rounds if len(centroids) else 0):
        search = Orchard(centroids)

        def sums(batches: Iterator[pa.RecordBatch], search: Orchard = search) -> Iterator[pa.RecordBatch]:
            count, total = np.zeros(len(search.centroids), np.int64), np.zeros(search.centroids.shape, np.int64)
            for _, x in _blocks(batches, dim, scale):
                best = search.nearest(x)[0]
                count += np.bincount(best, minlength=len(count))
                for c in np.unique(best):
                    total[c] += x[best == c].sum(axis=0)
            used = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(count[used]), pa.array(total[used].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "total"])

        parts = vectors.mapInArrow(sums, "cluster int, n long, total array<long>")
        added = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.get("total", F.lit(i))) for i in range(dim))).alias("total"))
        centroids = centroids.copy()
        for r in added.collect():
            centroids[r.cluster] = [t // r.n for t in r.total]
    return centroids


def cluster(table: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, salt: str = "1:") -> DataFrame:
    """Nearest centroid of every vector after ``rounds`` rounds: ``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``.

    Vectors of other than ``dim`` components, null ones and those with a null or non-finite
    component are left out; components count as ``floor(scale * x)``, held within
    ``vectors.BOUND``.  Every row of a repeated id is a vector of its own.  Rows with a null id
    are clustered but never seeds.  Fewer vectors than ``k`` give fewer centroids; an empty
    table, or one without any id, gives no row.  Other columns are not read.  Equally near
    centroids: the smaller number.  An inertia that does not fit a long is null.
    """
    kept = narrowed(table, id_col, vector_col).where(F.size("v") == dim)
    centroids = fit(kept, k=k, rounds=rounds, dim=dim, scale=scale, salt=salt)
    fields = "vec_id long, cluster int, distance long"
    if not len(centroids):
        return table.sparkSession.createDataFrame([], fields + ", cluster_inertia long, inertia long, centroid_sha256 string")
    search = Orchard(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(batches, dim, scale):
            best, dist, _ = search.nearest(x)
            yield pa.RecordBatch.from_arrays([part["vec_id"], pa.array(best, pa.int32()), pa.array(dist)], names=["vec_id", "cluster", "distance"])

    assigned = common.written(kept.mapInArrow(assign, fields), "clusters")
    spread = {r.cluster: r.s for r in assigned.groupBy("cluster").agg(F.try_sum("distance").alias("s")).collect()}
    total = None if None in spread.values() or sum(spread.values()) >= 1 << 63 else sum(spread.values())
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    by_number = lambda values: F.get(F.array(*map(F.lit, values)), F.col("cluster"))
    return assigned.select("*", by_number([spread.get(c, 0) for c in range(len(centroids))]).cast("long").alias("cluster_inertia"), F.lit(total).cast("long").alias("inertia"), by_number(hashes).alias("centroid_sha256"))
