"""Centroid clustering of quantised vectors: identical vectors are one weighted
point of Lloyd's rounds.

Vectors become integers, so equal ones meet in one row with a multiplicity, and
every sum is exact and independent of order. Rounds run on the distinct vectors
alone; the clusters are joined back to the vectors' ids at the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.runtime import table

K, ROUNDS, DIMS, SCALE = 16, 3, 64, 64
FIGURES = "cluster int, size long, cluster_inertia long, inertia long, centroid array<int>"


def largest(dims: int) -> int:
    """Integers up to this size have squared distances that fit a long."""
    return isqrt((1 << 63) // (4 * dims)) - 1


def quantised(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """`(id, q)`: floor(scale * x) of every component, for vectors of exactly
    `dims` components, none null or non-finite. A vector with an integer
    of more than largest() is left out too, for its distances fit no long."""
    x = F.col(vector)
    scaled = F.transform(x, lambda c: F.floor(c.cast("double") * scale))
    fine = (F.size(x) == dims) & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) * scale >= largest(dims)))
    # the floor is only taken of what passed
    return df.select(F.col(id_col).cast("long").alias("id"), F.when(fine, scaled).alias("q")).where("q is not null").select("id", F.col("q").cast("array<int>").alias("q"))


def distinct(points: DataFrame) -> DataFrame:
    """`(q, n)`: distinct vectors and their multiplicities, by partial counts."""
    return points.groupBy("q").agg(F.count("*").alias("n"))


def first_centroids(points: DataFrame, k: int = K, seed: str = "1") -> list[tuple[int, ...]]:
    """The vectors of the `k` ids with the smallest sha256 of `seed:id`, in that
    order; of rows that share an id the smaller vectors come first. Rows without
    an id start no centroid; fewer rows give fewer centroids."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    some = points.where("id is not null").select(key.alias("h"), "q").orderBy("h", "q").limit(k)
    return [tuple(r.q) for r in some.collect()]


def _nearest(q: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each row's nearest centroid (the smallest of equals), and the
    squared distance, both exact."""
    top = int(max(np.abs(q).max(initial=0), np.abs(centroids).max(initial=0)))
    if 4 * q.shape[1] * top * top < 1 << 53:  # float products are exact
        x, c = q.astype(np.float64), centroids.astype(np.float64)
        d = (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)
    else:
        d = np.stack([((q - c) ** 2).sum(axis=1) for c in centroids], axis=1)
    near = d.argmin(axis=1)
    return near, d[np.arange(len(d)), near].astype(np.int64)


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.int64)


def moved(points: DataFrame, centroids: list[tuple[int, ...]]) -> list[tuple[int, ...]]:
    """Centroids after one round over `(q, n)`: the floor of the weighted mean of
    what is nearest to each; one that is nearest to none stays.

    A task gives one row a cluster and component, with a sum and a weight; the
    driver gets the number of clusters times components."""
    at = np.array(centroids, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, weights = np.zeros(at.shape, object), np.zeros(len(at), object)
        for b in batches:
            q, n = _vectors(b.column(0), at.shape[1]), b.column(1).to_numpy()
            near, _ = _nearest(q, at)
            for c in np.unique(near).tolist():
                own = near == c
                # multiplicities in two halves, so that products stay within a long
                low, high = n[own] & 0xFFFF, n[own] >> 16
                part = (q[own] * low[:, None]).sum(axis=0).astype(object) + (q[own].T.astype(object) @ high.astype(object)) * 65536
                sums[c] += part
                weights[c] += int(n[own].sum())
        c, j = np.nonzero(np.broadcast_to((weights != 0)[:, None], at.shape))
        text = [pa.array([str(v) for v in x], pa.string()) for x in (sums[c, j], weights[c])]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(j, pa.int32()), *text], names=["c", "j", "s", "n"])

    part = points.select("q", "n").mapInArrow(run, "c int, j int, s string, n string")
    total = part.groupBy("c", "j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum(F.col("n").cast("decimal(38,0)")).alias("n"))
    new = [list(c) for c in centroids]
    for r in total.collect():
        new[r.c][r.j] = int(r.s) // int(r.n)
    return [tuple(c) for c in new]


def assigned(points: DataFrame, centroids: list[tuple[int, ...]]) -> DataFrame:
    """`points`' columns `(q, n)` with `cluster` and `distance`."""
    at = np.array(centroids, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near, d = _nearest(_vectors(b.column(0), at.shape[1]), at)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(near, pa.int32()), pa.array(d, pa.int64())], names=["q", "n", "cluster", "distance"])

    return points.select("q", "n").mapInArrow(run, "q array<int>, n long, cluster int, distance long")


@dataclass
class Clustering:
    """`rows`: `(id, cluster, distance)` for every vector; `clusters`: `(cluster,
    size, cluster_inertia, inertia, centroid)` for every cluster that has one."""

    rows: DataFrame
    clusters: DataFrame


def cluster(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: str = "1") -> Clustering:
    """Clusters of the vectors that quantised() keeps, after `rounds` rounds and
    one more assignment.

    Repeated rows are returned each; a row without an id is clustered but starts
    no centroid; without a vector that has an id nothing is returned; other
    columns aren't read. Inertias beyond a long are null.

    Rows of one vector meet in partial counts; only distinct vectors are
    reread. The join back is one of many rows to one, which adaptive execution
    splits where a vector is very common. Clusters are as few as `k`.
    """
    points = table(quantised(df, id_col, vector, dims, scale), "vectors")
    spark = df.sparkSession
    centroids = first_centroids(points, k, seed)
    if not centroids:
        rows = points.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).where("false")
        return Clustering(rows, spark.createDataFrame([], FIGURES))
    unlike = table(distinct(points), "distinct")
    for _ in range(rounds):
        centroids = moved(unlike, centroids)
    near = table(assigned(unlike, centroids), "assigned")
    total = F.sum(F.col("distance").cast("decimal(20,0)") * F.col("n").cast("decimal(18,0)"))
    sums = near.groupBy("cluster").agg(F.sum("n").alias("size"), total.alias("own")).collect()
    inertia = sum(int(r.own) for r in sums)
    long = lambda x: x if x < 1 << 63 else None
    made = [(r.cluster, r.size, long(int(r.own)), long(inertia), list(centroids[r.cluster])) for r in sums]
    return Clustering(points.join(near, "q").select("id", "cluster", "distance"), spark.createDataFrame(made, FIGURES))


def digest(centroid: Column) -> Column:
    """sha256 of the components as decimal integers joined by commas."""
    return F.sha2(F.array_join(centroid.cast("array<string>"), ","), 256)
