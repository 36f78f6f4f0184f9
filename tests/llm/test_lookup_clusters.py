import hashlib
import math
import random

import numpy as np

from opinio.llm import lookup_clusters as L
from opinio.llm.registry import QUERIES


def brute(rows, k=16, rounds=3, dims=64, scale=64):
    """rows: (vec_id, vector or None) -> sorted (vec_id, cluster, distance, cluster_inertia, inertia, centroid)."""
    kept = [(i, [max(-L.MAX_VALUE, min(L.MAX_VALUE, math.floor(scale * x))) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in order[:k]] or [[0] * dims]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        members = [[] for _ in centroids]
        for _, v in kept:
            members[near(v)[1]].append(v)
        centroids = [[sum(x) // len(m) for x in zip(*m)] if m else c for m, c in zip(members, centroids)]
    out = [(i, *near(v)[::-1]) for i, v in kept]
    return sorted(((i, c, d, sum(x[2] for x in out if x[1] == c), sum(x[2] for x in out), centroids[c]) for i, c, d in out), key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_distances_are_exact():
    rnd = np.random.default_rng(0)
    v, c = rnd.integers(-L.MAX_VALUE, L.MAX_VALUE, (50, 64)), rnd.integers(-L.MAX_VALUE, L.MAX_VALUE, (5, 64))
    assert L.distances(v, c).tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, y)) for y in c] for x in v]


def test_equals_brute_force(spark):
    rnd = random.Random(5)
    for n, dims, k in ((200, 64, 16), (60, 3, 4), (9, 5, 16)):
        rows = [(i, [rnd.choice([rnd.gauss(0, 1), 0.5, -0.25]) for _ in range(dims)]) for i in range(n)]
        rows += rows[:5]                                      # repeated rows
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
        assert got(L.cluster(df, k=k, dims=dims)) == brute(rows, k, dims=dims)


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 0.0]), (6, [0.0] * 3), (7, [1.0, -1.0]), (7, [1.0, -1.0]),
            (8, [1e300, -1e300]), (None, [0.5, 0.5]), (7, [-3.0, 2.0]), (9, [-0.0, 0.01])]
    data = [(*r, "x", None, k) for k, r in enumerate(rows)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, cluster string, v int, distance int").repartition(3)
    assert got(L.cluster(df, k=3, dims=2)) == brute(rows, 3, dims=2)
    assert L.cluster(df.where("1 = 0"), dims=2).count() == 0
    only = spark.createDataFrame([(None, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert got(L.cluster(only, dims=2)) == brute([(None, [1.0, 2.0])], dims=2)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    expected = sorted(((*r[:5], hashlib.sha256(",".join(map(str, r[5])).encode()).hexdigest()) for r in brute(rows)), key=str)
    assert got(QUERIES["op13_centroids"](spark, sf)) == expected
