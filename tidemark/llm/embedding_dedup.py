"""Embedding near-dedup: spherical k-means cells and blocked cosine products.

Each vector belongs to the cell of its nearest centroid and also visits cells of
smaller number whose boundary is near: a pair within the threshold is compared
in the smaller of its two cells. `margin` says how near. As |u - v| is at most
r = sqrt(2 - 2 * threshold), a boundary (a plane with normal c' - c) that lies
between u and v is within r of v; that bound ("sure") is exact but visits most
cells in many dimensions. For a difference of no special direction, the part
along one normal has standard deviation r / sqrt(d); the default visits cells
within `margin` = 4 of these.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.runs import bounds, whole_runs
from tidemark.operators.graph import connected_components
from tidemark.runtime import cut, table

THRESHOLD = 0.95
MARGIN = 4.0
#: Vectors and numbers that centroids are fitted on, at most, and how many of
#: these a centroid needs at least.
SAMPLE, SAMPLE_NUMBERS, EACH = 40_000, 8_000_000, 4
#: Vectors on either side of a block of cosine products.
BLOCK = 1024


def usable(v: Column) -> Column:
    """Whether a vector can link: not null or zero, all components finite."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def units(column: pa.ChunkedArray | pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of unit length, padded with zeros to `dim`, and their lengths."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = np.zeros((len(size), dim))
    x[np.arange(dim) < size[:, None]] = flat
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True)), size


def fit_centroids(sample: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Spherical k-means: unit centroids; empty cells are seeded anew."""
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(sample)))
    c = sample[rng.choice(len(sample), k, replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([(sample[i : i + 4096] @ c.T).argmax(axis=1) for i in range(0, len(sample), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, near, sample)
        norm = np.sqrt((total * total).sum(axis=1))
        empty = norm < 1e-12
        total[empty] = sample[rng.choice(len(sample), int(empty.sum()))]
        c = total / np.sqrt((total * total).sum(axis=1, keepdims=True))
    return c


def _visits(points: DataFrame, centroids: np.ndarray, threshold: float, margin: float | str) -> DataFrame:
    """`(cell, home, id, n, v)`: each vector in its own cell and in those of
    smaller number whose boundary is within reach, which is by its own length
    whatever the longest vector's is."""
    r = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    apart = np.sqrt(np.maximum(0, 2 - 2 * centroids @ centroids.T))
    dim = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 1024):
                b = whole.slice(i, 1024)
                x, size = units(b.column(2), dim)
                reach = np.full(len(x), r) if margin == "sure" else np.minimum(r, margin * r / np.sqrt(size))
                dots = x @ centroids.T
                own = dots.argmax(axis=1)
                near = dots >= dots[np.arange(len(own)), own][:, None] - reach[:, None] * apart[own]
                near &= np.arange(len(centroids)) < own[:, None]
                row, cell = np.nonzero(near)
                row, cell = np.r_[np.arange(len(own)), row], np.r_[own, cell]
                home = np.arange(len(row)) < len(own)
                taken = b.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(home), *taken.columns], names=["cell", "home", "id", "n", "v"])

    kind = points.schema["v"].dataType.simpleString()
    return points.select("id", "n", "v").mapInArrow(run, f"cell int, home boolean, id long, n long, v {kind}")


def _blocks(rows: DataFrame) -> DataFrame:
    """`(unit, side, id, n, v)`: cells dealt into blocks. Homes and visitors of a
    cell are each dealt into parts of about BLOCK; every pair of home parts, and
    of a home and a visitor part, is a unit. In a unit sides 0 and 1 are compared
    with one another, side -1 with itself."""
    count = rows.groupBy("cell").agg(F.count(F.when(F.col("home"), 1)).alias("h"), F.count(F.when(~F.col("home"), 1)).alias("o"))
    rows = rows.join(count, "cell")
    h, o = F.ceil(F.col("h") / BLOCK), F.ceil(F.col("o") / BLOCK)
    own = F.when(F.col("home"), F.pmod(F.xxhash64("id"), h)).otherwise(F.pmod(F.xxhash64("id"), o)).cast("long")
    rows = rows.withColumn("_own", own)
    unit = lambda kind, a, b: F.xxhash64(F.lit(kind), "cell", a, b)
    me = F.col("_own")
    mates = F.transform(F.sequence(F.lit(0).cast("long"), h - 1), lambda b: F.struct(unit("h", F.least(me, b), F.greatest(me, b)).alias("unit"), F.when(me == b, -1).when(me < b, 0).otherwise(1).alias("side")))
    guests = F.when(o > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(o - 1, F.lit(0).cast("long"))), lambda b: F.struct(unit("v", me, b).alias("unit"), F.lit(0).alias("side"))))
    hosts = F.when(h > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(h - 1, F.lit(0).cast("long"))), lambda a: F.struct(unit("v", a, me).alias("unit"), F.lit(1).alias("side"))))
    none = F.array().cast("array<struct<unit:bigint,side:int>>")
    all_ = F.when(F.col("home"), F.concat(mates, F.coalesce(guests, none))).otherwise(F.coalesce(hosts, none))
    return rows.select(F.explode(all_).alias("u"), "id", "n", "v").select("u.unit", "u.side", "id", "n", "v")


def _compare(a: tuple, b: tuple | None, threshold: float):
    """Positions of pairs at the threshold; within a if b is None."""
    xa, da = a
    xb, db = a if b is None else b
    for i in range(0, len(xa), 512):
        hit = (xa[i : i + 512] @ xb.T >= threshold) & (da[i : i + 512, None] == db)
        if b is None:
            hit &= np.arange(len(xb)) > np.arange(i, min(i + 512, len(xa)))[:, None]
        p, q = np.nonzero(hit)
        if len(p):
            yield p + i, q


def links(points: DataFrame, dim: int, centroids: np.ndarray, threshold: float = THRESHOLD, margin: float | str = MARGIN) -> DataFrame:
    """`(id, links, other)` parts: how many vectors (`n` of each point counted)
    a point links to in a unit, and a point that it is connected with."""
    from tidemark.llm.simhash import _settle

    rows = table(_visits(points, centroids, threshold, margin), "visits")
    parts = _blocks(rows).repartition("unit").sortWithinPartitions("unit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_runs(batches):
            start, length = bounds(t.column(0).to_numpy())
            for s, m in zip(start.tolist(), length.tolist(), strict=True):
                if m < 2:
                    continue
                u = t.slice(s, m)
                side, ids, n = (u.column(i).to_numpy() for i in (1, 2, 3))
                x, d = units(u.column(4), dim)
                label, count = np.arange(m), np.zeros(m, np.int64)
                for mine, other in ((-1, None), (0, 1)):
                    p0 = np.flatnonzero(side == mine)
                    q0 = p0 if other is None else np.flatnonzero(side == other)
                    for p, q in _compare((x[p0], d[p0]), None if other is None else (x[q0], d[q0]), threshold):
                        p, q = p0[p], q0[q]
                        np.add.at(count, p, n[q])
                        np.add.at(count, q, n[p])
                        label = _settle(m, p, q, label)
                some = np.flatnonzero(count)
                if len(some):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(count[some]), pa.array(ids[label[some]])], names=["id", "links", "other"])

    return parts.mapInArrow(run, "id long, links long, other long")


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, margin: float | str = MARGIN, cells: int | None = None) -> DataFrame:
    """`(id, n_links, component_id, kept)` for every row of `df`.

    Vectors that are null, empty, zero or hold a null or non-finite component
    link with nothing, nor do vectors of unlike lengths. Equal vectors, which
    always link, are compared as one and counted with their number; rows that
    share an id count each, by their own vectors, and a row without an id is its own component (null).
    An empty table gives no rows. One row per component is kept: its smallest id.

    Centroids are fitted on a bounded sample (SAMPLE vectors of smallest hash);
    every vector is assigned and compared.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v")).withColumn("ok", usable(F.col("v")))
    found = rows.where("ok and id is not null").groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    points = table(found.withColumn("no", F.monotonically_increasing_id()), "points")
    n, dim = points.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n:
        return rows.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    most = max(1, min(SAMPLE, SAMPLE_NUMBERS // dim))
    sample = points.select("v", F.xxhash64("id").alias("h")).orderBy("h").limit(most).toArrow()
    x, _ = units(sample.column(0), dim)
    k = cells or int(max(1, min(np.sqrt(n) / 2, len(x) / EACH)))
    parts = cut(links(points.select(F.col("no").alias("id"), "n", "v"), dim, fit_centroids(x, k), threshold, margin))
    count = parts.groupBy(F.col("id").alias("no")).agg(F.sum("links").alias("links"))
    comp = cut(connected_components(parts.where("id <> other"), "id", "other").withColumnRenamed("node", "no"))
    least = comp.join(points.select("no", "id"), "no").groupBy("component").agg(F.min("id").alias("least"))
    comp = comp.join(least, "component").select("no", "least")
    known = points.select(F.col("v").alias("_v"), "id", "no", "n").join(count, "no", "left").join(comp, "no", "left")
    known = known.select("_v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("least", "id").alias("component_id"))
    fine = rows.where("ok and id is not null").join(known, F.col("v") == F.col("_v")).select("id", "n_links", "component_id")
    rest = rows.where("not ok or id is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return fine.unionByName(rest).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
