from collections import defaultdict

import numpy as np
import pytest

from opinio.llm import cover_tree as C
from opinio.llm.registry import QUERIES


def brute(rows, cosine=0.95):
    """rows: (id, vector or None) -> sorted (id, n_links, component_id, kept)."""
    good, n = {}, len(rows)
    for k, (_, v) in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[k] = np.array(v, float) / np.linalg.norm(np.array(v, float) / max(map(abs, v))) / max(map(abs, v))
    links = defaultdict(set)
    for a in good:
        for b in good:
            if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] >= cosine:
                links[a].add(b)
                links[b].add(a)
    out, label = [], {}
    for k in range(n):
        if k not in label:
            seen, todo = {k}, [k]
            while todo:
                for x in links[todo.pop()]:
                    if x not in seen:
                        seen.add(x)
                        todo.append(x)
            least = min((rows[x][0] for x in seen if rows[x][0] is not None), default=None)
            label |= dict.fromkeys(seen, least)
        out.append((rows[k][0], len(links[k]), label[k], rows[k][0] == label[k]))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def clustered(rng, n, dims, spread):
    centres = rng.normal(size=(6, dims))
    x = centres[rng.integers(0, 6, n)] + spread * rng.normal(size=(n, dims))
    x[: n // 4] = centres[0] + spread / 3 * rng.normal(size=(n // 4, dims))    # a large group
    return x


def tree_of(x):
    return C.CoverTree(x, np.stack([np.arange(len(x)), np.arange(len(x))], axis=1), np.ones(len(x), np.int64), leaf=2)


@pytest.mark.parametrize("dims,spread", [(2, 0.1), (3, 0.3), (16, 0.1), (64, 0.15), (64, 1.0)])
def test_tree_is_nested_and_covers(dims, spread):
    t = tree_of(clustered(np.random.default_rng(1), 400, dims, spread))
    seen = 0
    for k in range(len(t.nodes)):
        members = t.u[t.p0[k]:t.p1[k]]
        assert np.linalg.norm(members - t.u[t.centre[k]], axis=1).max() <= t.radius[k]
        if t.c0[k] < t.c1[k]:
            kids = range(t.c0[k], t.c1[k])
            assert t.centre[k] in t.centre[t.c0[k]:t.c1[k]]                    # nested
            assert [t.p0[k], *t.p1[list(kids)]] == [*t.p0[list(kids)], t.p1[k]]
            assert t.radius[list(kids)].max() <= t.radius[k] / 2 + 1e-3        # halved
        else:
            seen += t.p1[k] - t.p0[k]
    assert seen == 400 and sorted(t.digests[:, 0]) == list(range(400))


@pytest.mark.parametrize("cosine", [0.95, 0.5, 0.999])
@pytest.mark.parametrize("dims,spread", [(2, 0.05), (3, 0.3), (64, 0.15), (64, 0.4)])
def test_traversal_finds_all_links(dims, spread, cosine, monkeypatch):
    monkeypatch.setattr(C, "_PRODUCT", 200)                   # tiles, too
    monkeypatch.setattr(C, "_TILE", (7, 11))
    rng = np.random.default_rng(2)
    x, y = clustered(rng, 300, dims, spread), clustered(rng, 200, dims, spread)
    y[:50] = x[:50]
    a, b = tree_of(x), tree_of(y)
    a.n[:] = rng.integers(1, 5, len(a.n))
    a._set(a.x, a.digests, a.n, a.nodes, a.radius32)
    near = a.u @ a.u.T >= cosine
    np.fill_diagonal(near, False)
    met = C.Traversal(a, a, cosine)
    assert met.links()[0].tolist() == (near @ a.n).tolist()
    cross = C.Traversal(C.CoverTree.load(a.dump()), b, cosine)
    near = a.u @ b.u.T >= cosine
    assert cross.links()[0].tolist() == (near @ b.n).tolist() and cross.links()[1].tolist() == (near.T @ a.n).tolist()
    place, first = cross.star()
    full = np.block([[np.zeros((300, 300), bool), near], [near.T, np.zeros((200, 200), bool)]])
    label = np.arange(500)
    label[place] = first
    want = np.arange(500)
    while True:
        low = np.where(full, want[None, :], 500).min(axis=1)
        new = np.minimum(want, low)
        if (new == want).all():
            break
        want = new
    assert label.tolist() == want.tolist()


def test_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    for n, dims, strip in ((150, 3, 20), (200, 64, 1 << 16), (120, 8, 7)):
        x = clustered(rng, n, dims, 0.2)
        rows = [(int(i), [float(z) for z in v]) for i, v in zip(rng.permutation(n), x)]
        rows += [(1000 + k, rows[0][1]) for k in range(30)] + rows[:3]         # equal vectors, repeated rows
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
        assert got(C.near_duplicates(df, strip=strip)) == brute(rows)


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 2.0]), (8, [2.0, 4.0]),
            (9, [1.0, 2.0, 0.0]), (None, [1.0, 2.01]), (None, None), (7, [1.0, 2.0]), (10, [-1.0, -2.0]), (11, [1e300, 2e300]),
            (12, [1e-300, 2e-300]), (13, [-0.0, 1.0]), (14, [0.0, 1.0]), (None, [5.0, 0.0]), (None, [5.0, 0.0])]
    data = [(*r, "x", None, k) for k, r in enumerate(rows)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, d1 string, vector int, n int").repartition(3)
    expected = [(i, n, c, i == c) for i, n, c, _ in brute(rows)]
    assert got(C.near_duplicates(df)) == sorted(expected, key=str)
    assert C.near_duplicates(df.where("1 = 0")).count() == 0
    assert got(C.near_duplicates(df.where("vec_id < 7"))) == [(i, 0, i, True) for i in range(1, 7)]
    words = df.select(df.vec_id.cast("string").alias("vec_id"), "embedding")
    assert C.near_duplicates(words).schema["component_id"].dataType.simpleString() == "string"


def test_vectors_of_one_direction(spark):
    """Scaled copies are unlike vectors at distance nought, also as pivots."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(3, 5))
    rows = [(k, [float(z) * (1 + k % 7) for z in base[k % 3]]) for k in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    assert got(C.near_duplicates(df, strip=4, least_strips=9)) == brute(rows)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert got(QUERIES["op11_cover_tree"](spark, sf)) == brute(rows)
