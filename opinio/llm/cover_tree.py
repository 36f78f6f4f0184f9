"""Exact near-duplicate vectors: cover trees and a dual traversal.

Vectors become unit vectors; cosine at least c is a distance of at most t = sqrt(2 - 2c).  Equal vectors are
one class with a count.  The classes are dealt into strips: by the nearest of a few pivots, a cell of more
than ``STRIP`` classes also by hash, so that no strip depends on how many rows are alike.

Per strip, a cover tree is built: the root covers all; a node's children are centres among its members that are
pairwise further apart than half the node's nominal radius (the node's own centre is the first), every member goes to its nearest
one, and so on with halved radii.  Nodes know their true covering radius.  Two trees (or a tree with itself) are
traversed together, from pairs of roots down: a pair of nodes further apart than t plus both
radii is dropped, a pair closer than t less both radii links all their members at once, others are replaced by the
pairs of their children; what is left are pairs of leaves, compared in double precision.  The children of large nodes
meet in matrix tiles of single precision with a margin, so that bounds only ever keep too much.

Nothing expands a group into pairs: tasks return, per class, the number of rows linked with it, and a spanning
star of each component they see.  Strips meet in pairs; a strip's tree goes to each partner once, and pairs whose cells are
too far apart are dropped before.  Work that no bound can avoid (vectors in general position) grows with the square of
the number of classes.

Bounds: at most ``PIVOTS`` pivots, chosen by hash; at most about ``STRIP`` classes a strip.

Defined cases: a vector that is null, empty, zero or holds null or non-finite components has no links and is its own
component; vectors of different lengths never link; repeated rows link with each other; rows with a null id take part,
and a component without any id is null; ties do not arise, since all pairs are found; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage
from .components import components

COSINE = 0.95
PIVOTS = 256
STRIP = 1 << 16
LEAST_STRIPS = 3
LEAF = 16
_TILE = (512, 2048)
_CHUNK = 1 << 16                                             # pairs whose vectors are held at a time
_PRODUCT = 1 << 20                                           # child pairs that are listed at a time
_MARGIN = 1e-9
_LEAST_RADIUS = 1e-6                                         # a node that is smaller is a leaf
_MARGIN32 = 4e-6                                             # error of a single precision dot product of unit vectors


def unit(x: np.ndarray) -> np.ndarray:
    """Rows as unit vectors in double precision."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _parsed(b: pa.RecordBatch):
    """(row numbers, matrix, digests) for each length of the usable vectors of a batch."""
    column = b.column(b.schema.get_field_index("vector"))
    length = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    at = np.concatenate(([0], np.cumsum(length)))[:-1]
    for dims in np.unique(length[length > 0]):
        rows = np.flatnonzero(length == dims)
        x = flat[at[rows][:, None] + np.arange(dims)] + 0.0   # -0.0 becomes 0.0
        good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
        rows, x = rows[good], np.ascontiguousarray(x[good])
        if len(rows):
            digests = np.array([np.frombuffer(hashlib.blake2b(v.tobytes(), digest_size=16).digest(), np.int64) for v in x])
            yield rows, x, digests


def _vectors(x: np.ndarray) -> pa.Array:
    return pa.array([v.tobytes() for v in x], pa.binary())


def _sample(most: int):
    """Task: the vectors of the smallest digests, and how many usable rows there are (in the first row)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple[int, int], tuple[int, bytes]] = {}
        n = 0
        for b in batches:
            for rows, x, digests in _parsed(b):
                n += len(rows)
                for k in np.lexsort((digests[:, 1], digests[:, 0]))[:most]:
                    kept[tuple(digests[k].tolist())] = (x.shape[1], x[k].tobytes())
            kept = dict(sorted(kept.items())[:most])
        rows = sorted(kept.items())
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k, _ in rows], pa.int64()), pa.array([k[1] for k, _ in rows], pa.int64()),
             pa.array([v[0] for _, v in rows], pa.int32()), pa.array([v[1] for _, v in rows], pa.binary()),
             pa.array([n if i == 0 else 0 for i in range(len(rows))], pa.int64())], names=["d1", "d2", "dims", "vector", "n"])
    return run


class Cells:
    """Nearest pivots by length; a length without pivots is one cell."""

    def __init__(self, pivots: dict[int, np.ndarray]):
        self.pivots = pivots

    def nearest(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, distance to its pivot) of unit vectors."""
        p = self.pivots.get(u.shape[1])
        if p is None:
            return np.zeros(len(u), np.int64), np.full(len(u), 2.0)
        cell = (u @ p.T).argmax(axis=1)
        return cell, np.linalg.norm(u - p[cell], axis=1)


def _located(cells: Cells):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, x, digests in _parsed(b):
                cell, far = cells.nearest(unit(x))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), x.shape[1]), pa.int32()), pa.array(cell, pa.int32()), pa.array(digests[:, 0]),
                     pa.array(far)], names=["dims", "cell", "d1", "far"])
    return run


def _dealt(cells: Cells, strips: dict[tuple[int, int], tuple[int, int]]):
    """Task: the classes of each batch with their strip; strips: (dims, cell) -> (first strip, strips)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, x, digests in _parsed(b):
                _, first, n = np.unique(digests, axis=0, return_index=True, return_counts=True)
                x, digests = x[first], digests[first]
                cell, _ = cells.nearest(unit(x))
                base, parts = np.array([strips[x.shape[1], int(c)] for c in cell], dtype=np.int64).reshape(-1, 2).T
                yield pa.RecordBatch.from_arrays(
                    [pa.array(base + digests[:, 1] % parts, pa.int32()), pa.array(digests[:, 0]), pa.array(digests[:, 1]),
                     _vectors(x), pa.array(n, pa.int64())], names=["strip", "d1", "d2", "vector", "n"])
    return run


class CoverTree:
    """Nodes as arrays; a node's children and its members are ranges (members in tree order)."""

    def __init__(self, x: np.ndarray, digests: np.ndarray, n: np.ndarray, leaf: int = LEAF):
        u = unit(x)
        order = np.arange(len(u))
        self.nodes: list[list] = [[0, 0.0, 0, 0, 0, len(u)]]   # centre, radius, children [a, b), members [a, b)
        self.nodes[0][1] = far = float(np.linalg.norm(u - u[0], axis=1).max())
        todo = [(0, far)]
        while todo:
            k, nominal = todo.pop()
            centre, radius, _, _, p0, p1 = self.nodes[k]
            if p1 - p0 <= leaf:
                continue
            members = order[p0:p1]
            nominal = min(nominal, radius) / 2
            if nominal < _LEAST_RADIUS:
                continue
            centres, child = _cover(u, members, centre, nominal)
            far = np.linalg.norm(u[members] - u[centres[child]], axis=1)
            radii = np.zeros(len(centres))
            np.maximum.at(radii, child, far)
            rank = np.argsort(radii, kind="stable")           # small children first: tiles share tight bounds
            place = np.empty_like(rank)
            place[rank] = np.arange(len(rank))
            child, centres, radii = place[child], centres[rank], radii[rank]
            order[p0:p1] = members[np.argsort(child, kind="stable")]
            ends = p0 + np.cumsum(np.bincount(child, minlength=len(centres)))
            at = len(self.nodes)
            self.nodes[k][2:4] = at, at + len(centres)
            start = p0
            for i, (c, r, end) in enumerate(zip(centres.tolist(), radii.tolist(), ends.tolist())):
                self.nodes.append([c, r, 0, 0, start, end])
                if end - start > leaf:
                    todo.append((at + i, nominal))
                start = end
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        nodes = np.array(self.nodes)
        nodes[:, 0] = place[nodes[:, 0].astype(np.int64)]
        self._set(x[order], digests[order], n[order], nodes[:, [0, 2, 3, 4, 5]].astype(np.int32),
                  np.nextafter(nodes[:, 1].astype(np.float32), np.float32(np.inf)))

    def _set(self, x, digests, n, nodes, radius):
        self.x, self.digests, self.n, self.nodes, self.radius32 = x, digests, n, nodes, radius
        self.u = unit(x)
        self.u32 = self.u.astype(np.float32)
        self.radius = radius.astype(np.float64)
        self.centre, self.c0, self.c1, self.p0, self.p1 = nodes.T
        self.weight = np.concatenate(([0], np.cumsum(n)))     # rows before a place

    def dump(self) -> bytes:
        return pickle.dumps((self.x, self.digests, self.n, self.nodes, self.radius32), protocol=5)

    @classmethod
    def load(cls, data: bytes) -> CoverTree:
        tree = cls.__new__(cls)
        tree._set(*pickle.loads(data))
        return tree


def _cover(u: np.ndarray, members: np.ndarray, centre: int, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Centres (the given one first) further apart than ``radius`` that cover the members, and each member's centre."""
    kind = np.float32 if radius > 0.05 else np.float64        # single precision does not tell close vectors apart
    least = kind(1 - radius * radius / 2)
    v = u[members].astype(kind)
    best = v @ u[centre].astype(kind)
    child = np.where(best >= least, 0, -1)
    centres = [centre]
    child[members == centre] = 0
    while True:
        left = np.flatnonzero(child < 0)
        if not len(left):
            return np.array(centres), child
        some = left[:512]
        near = v[some] @ v[some].T >= least
        taken = np.zeros(len(some), bool)
        new = []
        for i in range(len(some)):                            # greedily, within the block
            if not taken[i]:
                new.append(i)
                taken |= near[i]
        chosen = some[new]
        for s in range(0, len(left), 4096):
            part = left[s:s + 4096]
            dots = v[part] @ v[chosen].T
            covered = np.flatnonzero(dots.max(axis=1) >= least)
            child[part[covered]] = len(centres) + dots[covered].argmax(axis=1)
        child[chosen] = len(centres) + np.arange(len(chosen))
        centres.extend(members[chosen].tolist())


def _products(a0, a1, b0, b1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All (i, j) of the range pairs [a0, a1) x [b0, b1), and the pair they belong to."""
    wide = b1 - b0
    n = (a1 - a0) * wide
    of = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    return a0[of] + k // wide[of], b0[of] + k % wide[of], of


class Traversal:
    """Links between two trees, or within one (``b`` is ``a``): rows linked per class, and linked places."""

    def __init__(self, a: CoverTree, b: CoverTree, cosine: float):
        self.a, self.b, self.own = a, b, a is b
        self.cosine, self.t = cosine, math.sqrt(max(0.0, 2 - 2 * cosine))
        self.whole = [np.zeros(len(a.u) + 1, np.int64), np.zeros(len(b.u) + 1, np.int64)]   # by differences
        self.single = [np.zeros(len(a.u), np.int64), np.zeros(len(b.u), np.int64)]
        self.tied: list[np.ndarray] = []                      # linked places (a, b)
        self.joined: tuple[set[int], set[int]] = (set(), set())   # nodes whose members are all connected
        self.selves: list[int] = []                           # nodes linked with themselves as a whole
        self._drain([np.zeros((1, 2), np.int64)])

    def _drain(self, todo: list[np.ndarray]) -> None:
        """Pairs of nodes, depth first."""
        while todo:
            pairs = todo.pop()
            if len(pairs) > _CHUNK:
                todo += [pairs[_CHUNK:], pairs[:_CHUNK]]
                continue
            i, j = self._undecided(pairs)
            if not len(i):
                continue
            a, b = self.a, self.b
            leaf_a, leaf_b = a.c0[i] == a.c1[i], b.c0[j] == b.c1[j]
            both = leaf_a & leaf_b
            self._leaves(i[both], j[both])
            i, j, leaf_a, leaf_b = (z[~both] for z in (i, j, leaf_a, leaf_b))
            # a leaf stays itself next to the other's children
            a0, a1 = np.where(leaf_a, i, a.c0[i]), np.where(leaf_a, i + 1, a.c1[i])
            b0, b1 = np.where(leaf_b, j, b.c0[j]), np.where(leaf_b, j + 1, b.c1[j])
            n = (a1 - a0) * (b1 - b0)
            for k in np.flatnonzero(n > _PRODUCT):
                self._tiles(int(a0[k]), int(a1[k]), int(b0[k]), int(b1[k]), self.own and i[k] == j[k])
            small = np.flatnonzero(n <= _PRODUCT)
            group = np.cumsum(n[small]) // _PRODUCT
            for g in np.unique(group):
                s = small[group == g]
                x, y, of = _products(a0[s], a1[s], b0[s], b1[s])
                once = (i[s] != j[s])[of] | (x <= y) if self.own else np.ones(len(x), bool)
                for rest in np.array_split(np.stack([x[once], y[once]], axis=1), max(1, len(x) // _CHUNK)):
                    self._drain([rest])

    def _tiles(self, a0: int, a1: int, b0: int, b1: int, same: bool) -> None:
        a, b = self.a, self.b
        for r in range(a0, a1, _TILE[0]):
            re = min(r + _TILE[0], a1)
            left = a.u32[a.centre[r:re]]
            for c in range(b0, b1, _TILE[1]):
                ce = min(c + _TILE[1], b1)
                if same and ce <= r:
                    continue
                reach = min(2.0, self.t + float(a.radius[r:re].max()) + float(b.radius[c:ce].max()))
                dots = left @ b.u32[b.centre[c:ce]].T
                at = np.flatnonzero(dots >= np.float32(1 - reach * reach / 2 - _MARGIN32))
                if len(at):
                    pairs = np.stack([r + at // (ce - c), c + at % (ce - c)], axis=1)
                    self._drain([pairs[pairs[:, 0] <= pairs[:, 1]] if same else pairs])

    def _undecided(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.a, self.b
        i, j = pairs[:, 0], pairs[:, 1]
        d = np.linalg.norm(a.u[a.centre[i]] - b.u[b.centre[j]], axis=1)
        reach = a.radius[i] + b.radius[j]
        inside = d + reach < self.t - _MARGIN
        self._whole(i[inside], j[inside])
        rest = ~inside & (d - reach <= self.t + _MARGIN)
        return i[rest], j[rest]

    def _whole(self, i: np.ndarray, j: np.ndarray) -> None:
        """All members of node i link with all of node j."""
        if not len(i):
            return
        sides = ((self.a, i, self.b, j, 0), (self.b, j, self.a, i, 1))
        for of, x, other, y, side in sides:
            rows = other.weight[other.p1[y]] - other.weight[other.p0[y]]
            if self.own and side:
                rows = np.where(i == j, 0, rows)              # a node with itself counts once
            np.add.at(self.whole[side], of.p0[x], rows)
            np.add.at(self.whole[side], of.p1[x], -rows)
        if self.own:
            self.selves += i[i == j].tolist()
        for side, x in ((0, i), (1, j)):
            self.joined[side].update(np.unique(x).tolist())
        self.tied.append(np.stack([self.a.p0[i], self.b.p0[j]], axis=1))

    def _leaves(self, i: np.ndarray, j: np.ndarray) -> None:
        a, b = self.a, self.b
        for s in range(0, len(i), 256):
            x, y, _ = _products(*(z.astype(np.int64) for z in (a.p0[i[s:s + 256]], a.p1[i[s:s + 256]], b.p0[j[s:s + 256]], b.p1[j[s:s + 256]])))
            if self.own:
                # a leaf met with itself has each of its pairs twice
                twice = np.repeat(i[s:s + 256] == j[s:s + 256], (a.p1[i[s:s + 256]] - a.p0[i[s:s + 256]]) * (b.p1[j[s:s + 256]] - b.p0[j[s:s + 256]]))
                x, y = x[~twice | (x < y)], y[~twice | (x < y)]
            linked = np.einsum("ij,ij->i", a.u[x], b.u[y]) >= self.cosine
            x, y = x[linked], y[linked]
            np.add.at(self.single[0], x, b.n[y])
            np.add.at(self.single[1], y, a.n[x])
            self.tied.append(np.stack([x, y], axis=1))

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Rows linked with each class of the two trees, itself excepted."""
        a, b = (w[:-1].cumsum() + s for w, s in zip(self.whole, self.single))
        if self.own:
            both = a + b
            own = np.zeros(len(both) + 1, np.int64)           # members counted with themselves, where a node was linked as a whole
            for k in self.selves:
                own[self.a.p0[k]] += 1
                own[self.a.p1[k]] -= 1
            return both - own[:-1].cumsum() * self.a.n, both
        return a, b

    def star(self) -> tuple[np.ndarray, np.ndarray]:
        """(place, place of its component's first) of all connected places but the first; those of b come after those of a."""
        shift = 0 if self.own else len(self.a.u)
        edges = [e + [0, shift] for e in self.tied]
        for tree, nodes, more in ((self.a, self.joined[0], 0), (self.b, self.joined[1], shift)):
            if nodes:
                k = np.array(sorted(nodes))
                x, y, _ = _products(tree.p0[k].astype(np.int64), tree.p1[k].astype(np.int64), tree.p0[k].astype(np.int64),
                                    tree.p0[k].astype(np.int64) + 1)
                edges.append(np.stack([x, y], axis=1) + more)
        total = len(self.a.u) + (0 if self.own else len(self.b.u))
        label = np.arange(total)
        if edges:
            e = np.unique(np.concatenate(edges), axis=0)
            while True:
                low = np.minimum(label[e[:, 0]], label[e[:, 1]])
                before = label.copy()
                for side in (0, 1):
                    np.minimum.at(label, before[e[:, side]], low)
                    np.minimum.at(label, e[:, side], low)
                while (label != (jump := label[label])).any():
                    label = jump
                if (label[e[:, 0]] == label[e[:, 1]]).all():
                    break
        moved = np.flatnonzero(label != np.arange(total))
        return moved, label[moved]


_OUT = "pair int, tree binary, d1 long, d2 long, links long, n long, to1 long, to2 long"


def _found(pair: int, digests: np.ndarray, links: np.ndarray, n: np.ndarray | None, star) -> pa.RecordBatch:
    """Rows of classes (links), and rows of stars (place, first)."""
    held = np.arange(len(links)) if n is not None else np.flatnonzero(links)
    place, first = star
    k, m = len(held), len(place)
    none = pa.nulls(k, pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(k + m, pair), pa.int32()), pa.nulls(k + m, pa.binary()),
         pa.array(np.concatenate([digests[held, 0], digests[place, 0]])), pa.array(np.concatenate([digests[held, 1], digests[place, 1]])),
         pa.array(np.concatenate([links[held], np.zeros(m, np.int64)])),
         pa.array(np.concatenate([n, np.zeros(m, np.int64)]) if n is not None else np.zeros(k + m, np.int64)),
         pa.concat_arrays([none, pa.array(digests[first, 0])]), pa.concat_arrays([none, pa.array(digests[first, 1])])],
        names=["pair", "tree", "d1", "d2", "links", "n", "to1", "to2"])


def _built(cosine: float, partners: dict[int, list[int]], kinds: dict[int, tuple[int, str]]):
    """A strip's classes -> its tree for every partner, and the links within it."""
    def run(table: pa.Table) -> pa.Table:
        strip = table.column("strip")[0].as_py()
        dims, kind = kinds[strip]
        digests = np.stack([table.column(c).to_numpy() for c in ("d1", "d2")], axis=1)
        digests, first, of = np.unique(digests, axis=0, return_index=True, return_inverse=True)
        n = np.zeros(len(digests), np.int64)
        np.add.at(n, of.reshape(-1), table.column("n").to_numpy())
        column = table.column("vector")
        x = np.frombuffer(b"".join(column[int(k)].as_py() for k in first), dtype=kind).reshape(-1, dims)
        tree = CoverTree(x, digests, n)
        met = Traversal(tree, tree, cosine)
        out = [_found(-1 - strip, tree.digests, met.links()[0], tree.n, met.star())]
        if partners.get(strip):
            data, many = tree.dump(), partners[strip]
            empty = pa.nulls(len(many), pa.int64())
            out.append(pa.RecordBatch.from_arrays([pa.array(many, pa.int32()), pa.array([data] * len(many), pa.binary()), *[empty] * 6],
                                                  names=out[0].schema.names))
        return pa.Table.from_batches(out)
    return run


def _crossed(cosine: float):
    """Two trees -> the links between them; rows without a tree pass."""
    def run(table: pa.Table) -> pa.Table:
        data = table.column("tree").drop_null().to_pylist()
        if not data:
            return table
        a, b = (CoverTree.load(x) for x in data)
        met = Traversal(a, b, cosine)
        batch = _found(table.column("pair")[0].as_py(), np.concatenate([a.digests, b.digests]),
                       np.concatenate(met.links()), None, met.star())
        return pa.Table.from_batches([batch])
    return run


def _class_links(vectors: DataFrame, cosine: float, strip: int, least_strips: int) -> DataFrame:
    """``d1, d2, links, n`` of classes and ``d1, d2, to1, to2`` of stars, in one written table."""
    element = vectors.schema["vector"].dataType.elementType.simpleString()
    kind, size = ("<f4", 4) if element == "float" else ("<f8", 8)
    sample = cut_lineage(vectors.select("vector").mapInArrow(_sample(PIVOTS), "d1 long, d2 long, dims int, vector binary, n long"))
    n = sample.agg(F.sum("n")).first()[0] or 0
    most = min(PIVOTS, max(least_strips, math.ceil(n / strip)))
    chosen = (sample.groupBy("d1", "d2", "dims").agg(F.first("vector").alias("vector")).orderBy("d1", "d2").limit(PIVOTS).collect())
    of_dims: dict[int, list[np.ndarray]] = {}
    for r in chosen:
        some = of_dims.setdefault(r.dims, [])
        if len(some) < most:
            some.append(np.frombuffer(bytes(r.vector), kind))
    cells = Cells({d: unit(np.array(v)) for d, v in of_dims.items()})

    # how many classes a cell holds (to within a few percent) decides its strips, how far it reaches its partners
    held = (vectors.select("vector").mapInArrow(_located(cells), "dims int, cell int, d1 long, far double")
            .groupBy("dims", "cell").agg(F.approx_count_distinct("d1", 0.05).alias("n"), F.max("far").alias("far")).collect())
    # pivots without rows go (one of two in the same direction), so that no later rounding finds an empty cell
    used = {d: sorted(r.cell for r in held if r.dims == d) for d in cells.pivots}
    place = {(d, c): k for d, some in used.items() for k, c in enumerate(some)}
    cells = Cells({d: cells.pivots[d][some] for d, some in used.items() if some})
    strips, kinds, members, at = {}, {}, [], 0
    for r in sorted(held):
        parts = max(1, math.ceil(1.2 * r.n / strip))
        cell = place.get((r.dims, r.cell), 0)
        strips[r.dims, cell] = (at, parts)
        for k in range(parts):
            kinds[at + k] = (r.dims, kind)
            members.append((at + k, r.dims, cell, r.far))
        at += parts
    partners: dict[int, list[int]] = {}
    t = math.sqrt(max(0.0, 2 - 2 * cosine))
    pair = 0
    for x, (i, dims, cell, far) in enumerate(members):
        for j, dims2, cell2, far2 in members[x + 1:]:
            if dims != dims2:
                continue
            pivots = cells.pivots.get(dims)
            if cell != cell2 and np.linalg.norm(pivots[cell] - pivots[cell2]) - far - far2 > t + _MARGIN:
                continue
            for s in (i, j):
                partners.setdefault(s, []).append(pair)
            pair += 1
    dealt = vectors.select("vector").mapInArrow(_dealt(cells, strips), "strip int, d1 long, d2 long, vector binary, n long")
    trees = dealt.groupBy("strip").applyInArrow(_built(cosine, partners, kinds), _OUT)
    return cut_lineage(trees.groupBy("pair").applyInArrow(_crossed(cosine), _OUT).drop("pair", "tree"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        d, known = np.zeros((b.num_rows, 2), np.int64), np.zeros(b.num_rows, bool)
        for rows, _, digests in _parsed(b):
            d[rows], known[rows] = digests, True
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, mask=~known) for c in d.T)], names=["vec_id", "d1", "d2"])


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE,
                    strip: int = STRIP, least_strips: int = LEAST_STRIPS) -> DataFrame:
    """One row per row: ``vec_id, n_links`` (other rows linked directly), ``component_id`` (smallest id reachable), ``kept``."""
    vectors = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector"))
    id_type = vectors.schema["vec_id"].dataType.simpleString()
    found = _class_links(vectors, cosine, strip, least_strips)
    rows = cut_lineage(vectors.mapInArrow(_digests, f"vec_id {id_type}, d1 long, d2 long"))

    links = found.where(F.col("to1").isNull()).groupBy("d1", "d2").agg(F.sum("links").alias("links"), F.sum("n").alias("n"))
    stars = found.where(F.col("to1").isNotNull()).select(F.struct("d1", "d2").alias("a"), F.struct(F.col("to1").alias("d1"), F.col("to2").alias("d2")).alias("b"))
    label = components(stars).select("node.d1", "node.d2", "label")
    least = rows.where(F.col("d1").isNotNull()).groupBy("d1", "d2").agg(F.min("vec_id").alias("least"))
    classes = (links.join(least, ["d1", "d2"]).join(label, ["d1", "d2"], "left")
               .withColumn("label", F.coalesce("label", F.struct("d1", "d2"))))
    whole = classes.groupBy("label").agg(F.min("least").alias("component_id"))
    classes = classes.join(whole, "label").select("d1", "d2", (F.col("links") + F.col("n") - 1).alias("n_links"), "component_id")
    out = rows.join(classes, ["d1", "d2"], "left")
    alone = F.col("d1").isNull()
    return (out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                       F.when(alone, F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
            .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))))
