"""Clusters against a plain walk in Python integers, and the bounds that spare distances."""

import hashlib
import math
import random

import numpy as np

from spanforge.llm import clusters as K

SCHEMA = "vec_id bigint, embedding array<float>"


def plain(rows, c):
    kept = [(i, e) for i, e in rows if e is not None and len(e) == c.dimension and all(x is not None and math.isfinite(x) for x in e)]
    edge = lambda x: max(-(2**63), min(2**63 - 1, math.floor(c.scale * x)))
    kept = [(i, tuple(edge(float(np.float32(x))) for x in e)) for i, e in kept]
    first = sorted((hashlib.sha256(f"{c.salt}{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    centroids = [v for _, v in first[: c.centroids]]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for turn in range(c.rounds + 1):
        near = [min(range(len(centroids)), key=lambda k: (square(v, centroids[k]), k)) for _, v in kept]
        if turn < c.rounds:
            for k in range(len(centroids)):
                own = [v for (_, v), n in zip(kept, near) if n == k]
                if own:
                    centroids[k] = tuple(sum(x) // len(own) for x in zip(*own))
    long = 2**63 - 1
    d = [min(long, square(v, centroids[n])) for (_, v), n in zip(kept, near)]
    by = [min(long, sum(x for x, n in zip(d, near) if n == k)) for k in range(len(centroids))]
    digest = [hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for v in centroids]
    return sorted((-1 if i is None else i, n, x, by[n], min(long, sum(d)), digest[n]) for (i, _), n, x in zip(kept, near, d))


def got(spark, rows, c, schema=SCHEMA):
    found = K.inertia(spark.createDataFrame(rows, schema).repartition(3), c).collect()
    return sorted((-1 if r[0] is None else r[0], *r[1:]) for r in found)


def test_equals_a_plain_walk(spark):
    rng = random.Random(4)
    c = K.Clustering(centroids=7, rounds=5, dimension=4)
    rows = [(i, [rng.gauss(i % 5, 0.4) for _ in range(4)]) for i in range(400)]
    rows += [(1000 + i, [0.5, 0.5, -1.0, 2.0]) for i in range(200)]  # one vector holds a third of the rows
    assert got(spark, rows, c) == plain(rows, c)


def test_ties_go_to_the_smaller_number(spark):
    c = K.Clustering(centroids=6, rounds=5, dimension=2, scale=1)
    rows = [(i, [float(i % 3), float(i // 3 % 3)]) for i in range(60)]
    assert got(spark, rows, c) == plain(rows, c)


def test_large_components_stay_exact(spark):
    c = K.Clustering(centroids=3, rounds=2, dimension=3)
    for big in (2.0**15, 2.0**22, 2.0**30, 1e38):
        rows = [(i, [big * (1 + i % 3), -big / (1 + i), float(i)]) for i in range(12)]
        assert got(spark, rows, c) == plain(rows, c), big


def test_defined_results(spark):
    c = K.Clustering(centroids=4, rounds=5, dimension=2)
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.1, 0.2]), (1, [0.1, 0.2]), (1, [3.0, 0.2]), (None, [1.0, 1.0]), (2, None), (3, []), (4, [1.0]), (5, [1.0, None]), (6, [nan, 0.0]), (7, [0.0, -inf])]
    assert got(spark, rows, c) == plain(rows, c)
    assert got(spark, rows[:1], c) == plain(rows[:1], c)
    assert got(spark, [], c) == []
    wide = [(*r, 1, 2) for r in rows]
    assert got(spark, wide, c, SCHEMA + ", v int, `a.b` int") == plain(rows, c)


def test_bounds_hold_and_spare_scans(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=8) * 0.05 + np.eye(8)[i % 8]).tolist()) for i in range(2000)]
    c = K.Clustering(centroids=8, rounds=5, dimension=8)
    state, centroids = K.clustered(spark.createDataFrame(rows, SCHEMA), c)
    far = 0
    for r in state.collect():
        d = np.sqrt(((np.array(r["v"]) - centroids) ** 2).sum(1))
        assert d[r["cluster"]] <= r["upper"] and np.delete(d, r["cluster"]).min() >= r["lower"]
        far += r["scanned"]
    assert far < 200
