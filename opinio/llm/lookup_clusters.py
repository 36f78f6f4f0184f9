"""Centroid clustering of integer vectors with scalar lookup tables.

A vector takes part if it has exactly ``dims`` components, all finite; component x becomes the integer
``floor(scale * x)``.  The k first centroids are the vectors with the smallest seeded SHA-256 of their id.  A
round assigns every vector to its nearest centroid (ties: smaller number) and moves each centroid
that has vectors to the floor of their mean.

Distances come from lookup tables: for each dimension, every integer value that occurs in a batch is
tabulated once against all centroids (squared difference); a vector's distances are gathers from these
tables, summed over the dimensions.  A round is one pass over the vectors; tasks send k x dims sums, which are
added by a grouped aggregation, and only the k centroids reach the driver.  All sums are integers, so the
result does not depend on how the rows are dealt out.

Defined cases: vectors that are null, of another length, or hold null or non-finite components give
no row; integers beyond +-2^27 count as that (so that distances fit 64 bits); a null id is never a first centroid but
its vector is assigned; repeated rows count each, and of rows with one id the smaller vector comes first as a first centroid;
fewer than k vectors make fewer centroids; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinio.sources.tables import literal_table

from .common import cut_lineage

K = 16
ROUNDS = 3
DIMS = 64
SCALE = 64
MAX_VALUE = 1 << 27


def _takes_part(vector: Column, dims: int) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == dims) & finite, F.lit(False))


def integers(vectors: DataFrame, id_col: str, vector_col: str, dims: int, scale: int) -> DataFrame:
    """``vec_id, v`` of the vectors that take part, v as array<int>."""
    vector = F.col(vector_col).cast("array<double>")
    most = float(MAX_VALUE)
    v = F.transform("x", lambda x: F.floor(F.greatest(F.lit(-most), F.least(F.lit(most), F.lit(float(scale)) * x))).cast("int"))
    return (vectors.select(F.col(id_col).alias("vec_id"), vector.alias("x")).where(_takes_part(F.col("x"), dims))
            .select("vec_id", v.alias("v")))


def distances(values: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances (rows x centroids) by table gathers."""
    out = np.zeros((len(values), len(centroids)), dtype=np.int64)
    for d in range(values.shape[1]):
        occurring, code = np.unique(values[:, d], return_inverse=True)
        out += ((occurring[:, None] - centroids[None, :, d]) ** 2)[code]
    return out


def _batch(b: pa.RecordBatch, dims: int) -> np.ndarray:
    column = b.column(b.schema.get_field_index("v"))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _moved(centroids: np.ndarray):
    """Task: counts and sums of its vectors by nearest centroid."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for b in batches:
            v = _batch(b, dims)
            near = distances(v, centroids).argmin(axis=1)
            count += np.bincount(near, minlength=k)
            np.add.at(total, near, v)
        held = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(held, dims), pa.int32()), pa.array(np.tile(np.arange(dims), len(held)), pa.int32()),
             pa.array(np.repeat(count[held], dims)), pa.array(total[held].reshape(-1))], names=["cluster", "dim", "n", "total"])
    return run


def _assigned(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            far = distances(_batch(b, centroids.shape[1]), centroids)
            near = far.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(near, pa.int32()), pa.array(far[np.arange(len(near)), near])],
                                             names=["vec_id", "cluster", "distance"])
    return run


def first_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.select(order.alias("order"), "v").where(F.col("order").isNotNull()).orderBy("order", "v").limit(k).collect()
    return np.array([r.v for r in first], dtype=np.int64)


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, rounds: int = ROUNDS,
            dims: int = DIMS, scale: int = SCALE, seed: int = 1) -> DataFrame:
    """One row per vector that takes part: ``vec_id, cluster, distance, cluster_inertia, inertia, centroid`` (array<long>)."""
    spark = vectors.sparkSession
    rows = integers(vectors, id_col, vector_col, dims, scale)
    kind = rows.schema["vec_id"].dataType.simpleString()
    centroids = first_centroids(rows, k, seed)
    if not len(centroids):                                    # no vector with an id: one centroid that none is moved to
        centroids = np.zeros((1, dims), np.int64)
    for _ in range(rounds):
        sums = (rows.select("v").mapInArrow(_moved(centroids), "cluster int, dim int, n long, total long")
                .groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")))
        for r in sums.collect():                              # k x dims rows
            centroids[r.cluster, r.dim] = int(r.total) // r.n
    out = cut_lineage(rows.mapInArrow(_assigned(centroids), f"vec_id {kind}, cluster int, distance long"))
    per = out.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    found = literal_table(spark, [(c, [int(x) for x in row]) for c, row in enumerate(centroids)],
                          "cluster int, centroid array<bigint>")
    inertia = out.agg(F.sum("distance")).scalar()
    return (out.join(F.broadcast(per.join(found, "cluster")), "cluster").withColumn("inertia", inertia)   # k rows
            .select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"))
