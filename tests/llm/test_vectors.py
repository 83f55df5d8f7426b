"""Clustering and codes of vectors against brute force, with ties, repeated rows, nulls and odd lengths."""

import hashlib
import math

import numpy as np
import pytest

from eventloom.llm import centroid_clustering, vector_codes
from eventloom.llm.centroid_clustering import Orchard
from eventloom.llm.vector_codes import CoverTree
from eventloom.llm.vectors import BOUND, squared

SCHEMA = "vec_id long, embedding array<float>, label int, v string, cluster string, code string, n string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, k, "x", "y", "z", "w") for i, v, k in rows], SCHEMA)


def vectors(seed, n, dim, distinct=None):
    rnd = np.random.default_rng(seed)
    pool = rnd.normal(0, 0.2, (distinct or n, dim)).astype(np.float32)
    return [[float(x) for x in pool[i % len(pool)]] for i in range(n)]


def whole(v, scale):
    return [math.floor(scale * x) for x in v]


def nearest(v, centroids):
    """The least distance, and of equal ones the first."""
    far = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centroids]
    return far.index(min(far)), min(far)


def updated(points, numbers, centroids):
    out = []
    for c, old in enumerate(centroids):
        mine = [p for p, k in zip(points, numbers, strict=True) if k == c]
        out.append([sum(x) // len(mine) for x in zip(*mine, strict=True)] if mine else old)
    return out


def some_rows(dim):
    good = [(i, v, (None, 1, 2)[i % 3]) for i, v in enumerate(vectors(3, 150, dim, 90))]
    good += [(7, v, 1) for v in vectors(4, 3, dim)] + [(7, good[0][1], 1), (None, good[1][1], None)]
    bad = [(900, None, 1), (901, [0.1] * (dim - 1) + [float("nan")], 1), (902, [0.1] * (dim - 1) + [float("inf")], 2), (903, [None] * dim, 2)]
    return good, bad


def test_clusters(spark):
    good, bad = some_rows(8)
    short = [(904, [0.5] * 7, 1), (905, [], None)]
    got = centroid_clustering.cluster(table(spark, good + bad + short), k=6, rounds=3, dim=8, scale=64).collect()
    points = [whole(v, 64) for _, v, _ in good]
    by_hash = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v, _ in good if i is not None)
    centroids = [whole(v, 64) for _, v in by_hash[:6]]
    for _ in range(3):
        centroids = updated(points, [nearest(p, centroids)[0] for p in points], centroids)
    want = [(i, *nearest(p, centroids)) for (i, _, _), p in zip(good, points, strict=True)]
    order = lambda rows: sorted(rows, key=str)
    assert order((r.vec_id, r.cluster, r.distance) for r in got) == order(want)
    for r in got:
        assert r.cluster_inertia == sum(d for _, c, d in want if c == r.cluster)
        assert r.inertia == sum(d for _, _, d in want)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest()


@pytest.mark.parametrize("k", [1, 2, 5, 16, 40])
def test_orchard_is_exact_and_compares_less(k):
    rnd = np.random.default_rng(k)
    middles = rnd.integers(-400, 400, (k, 12))
    middles[k // 2] = middles[0]  # two equal centroids
    x = np.concatenate([middles[rnd.integers(0, k, 500)] + rnd.integers(-30, 30, (500, 12)), middles, (middles[:1] + middles) // 2])
    best, dist, compared = Orchard(middles).nearest(x)
    far = squared(x, middles)
    assert (best == far.argmin(axis=1)).all() and (dist == far.min(axis=1)).all()
    assert compared <= far.size and (k < 16 or compared < 0.9 * far.size)


def test_few_or_no_vectors(spark):
    three = [(5, [0.5, -0.5], 1), (6, [0.5, -0.5], None), (8, [-1.0, 2.0], 1)]
    got = centroid_clustering.cluster(table(spark, three), dim=2, scale=64).collect()
    assert {r.distance for r in got} == {0} and len({r.cluster for r in got}) == 2
    assert [r.vec_id for r in vector_codes.compress(table(spark, three), parts=2).where("error = 0").orderBy("vec_id").collect()] == [5, 6, 8]
    for rows in ([], [(1, None, 1)], [(2, [float("nan")] * 2, 1)]):
        assert centroid_clustering.cluster(table(spark, rows), dim=2).collect() == []
        assert vector_codes.compress(table(spark, rows), parts=2).collect() == []
    huge = [(1, [3e38, -3e38], 1), (2, [0.0, 0.0], 1)]
    assert centroid_clustering.cluster(table(spark, huge), dim=2, k=1, rounds=0).where("vec_id = 1").first().distance in (0, 2 * BOUND**2)
    assert {r.error for r in vector_codes.compress(table(spark, huge), parts=2).collect()} == {0}


def test_codes(spark):
    good, bad = some_rows(8)
    odd = [(906, [0.5] * 7, 1), (907, [], None), (908, [0.25] * 4, 2)]
    got = vector_codes.compress(table(spark, good + bad + odd), parts=4, entries=20, rounds=2, scale=256).collect()
    points = [whole(v, 256) for _, v, _ in good]
    first = [whole(v, 256) for i, v in sorted((i, v) for i, v, _ in good if i is not None)[:20]]
    books, codes = [], []
    for p in range(4):
        mine, book = [x[2 * p : 2 * p + 2] for x in points], [x[2 * p : 2 * p + 2] for x in first]
        for _ in range(2):
            book = updated(mine, [nearest(x, book)[0] for x in mine], book)
        books.append(book)
        codes.append([nearest(x, book) for x in mine])
    said = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    want = [(i, k, "".join(f"{c[n][0]:02x}" for c in codes), sum(c[n][1] for c in codes)) for n, (i, _, k) in enumerate(good)]
    label = {k: sum(e for _, g, _, e in want if g == k) for k in (None, 1, 2)}
    full = [(i, c, e, label[k], said) for i, k, c, e in want] + [(i, None, None, label[k], said) for i, _, k in odd]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, full))


@pytest.mark.parametrize("n", [1, 2, 30, 700])
def test_cover_tree(n):
    rnd = np.random.default_rng(n)
    points = np.concatenate([rnd.integers(-20, 20, (n, 4)) + c for c in rnd.integers(-4000, 4000, (8, 4))])
    points = np.concatenate([points, points[: len(points) // 3]])
    tree = CoverTree.build(points.copy(), leaf=4)
    assert sorted(tree.places.tolist()) == list(range(len(points))) and (tree.points == points[tree.places]).all()
    for begin, end, radius, child, after in tree.nodes.tolist():
        gap = tree.points[begin:end] - tree.points[begin]
        assert (gap * gap).sum(axis=1).max() == radius
        if after:
            children = tree.nodes[child:after]
            assert children[0, 0] == begin and children[-1, 1] == end and (children[1:, 0] == children[:-1, 1]).all()
            assert (4 * children[:, 2] <= radius).all()
            centres = tree.points[children[:, 0]]
            apart = squared(centres, centres)
            assert (4 * apart[~np.eye(len(centres), dtype=bool)] > radius).all()
    entries = np.concatenate([points[rnd.integers(0, len(points), 9)] + rnd.integers(-3, 3, (9, 4)), points[:1], points[:1]])
    far = squared(points, entries)
    code, error = tree.codes(entries)
    assert (code == far.argmin(axis=1)).all() and (error == far.min(axis=1)).all()
    count, total = tree.totals(entries)
    assert (count == np.bincount(far.argmin(axis=1), minlength=len(entries))).all()
    assert all((total[e] == points[code == e].sum(axis=0)).all() for e in range(len(entries)))
    sure, single, _ = tree.assign(entries)
    assert sum((end - begin).sum() for begin, end, _ in sure) + len(single) == len(points)
    if n == 700:
        assert len(single) < len(points) / 3
