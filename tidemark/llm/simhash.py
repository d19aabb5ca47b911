"""SimHash near-duplicates: fingerprints, and all links up to a few bits.

A fingerprint is embedded as the bit counts of its 32 two-bit segments; the
Manhattan distance of two embeddings is at most the number of differing bits.
The embedding is cut into `b` groups of segments. Two points within Manhattan
distance k agree on at least b - k groups, so a grid whose cells are the values
of b - k groups, one grid for each choice of groups, puts every such pair into
a common cell. There the Manhattan bound prunes and the bits decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tidemark.operators.graph import connected_components
from tidemark.runtime import cut, table

SHINGLE = 4
BITS = 4
#: Rows of one cell that a task compares with one another at a time.
BLOCK = 2048
#: Shingle hashes whose bits are counted at a time.
CHUNK = 100_000
_EVEN = 0x5555555555555555


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text: bit i is set if it is in over half of the
    XXH64 hashes (seed 42) of its word shingles, repeats included. A-Z count as
    a-z, words end at ASCII white space; a shorter text is one shingle, one
    without words has fingerprint 0."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    n = max(1, len(words) - shingle + 1)
    starts, stops = [0, *ends[: n - 1]], [e - 1 for e in ends[min(shingle, len(words)) - 1 :]]
    count = np.zeros(64, np.int64)
    for k in range(0, n, CHUNK):
        pairs = zip(starts[k : k + CHUNK], stops[k : k + CHUNK], strict=True)
        h = np.array([xxh64_intdigest(joined[a:b], 42) for a, b in pairs], "<u8")
        count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > n, bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """`(id, fp)` for every row; a null text has fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [fingerprint(t.as_py() or "", shingle) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], names=["id", "fp"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("t")).mapInArrow(run, "id long, fp long")


def embed(fp: Column) -> Column:
    """Bit counts of the 32 two-bit segments, two bits for each."""
    high = F.shiftrightunsigned(fp, 1)
    two = fp.bitwiseAND(high).bitwiseAND(F.lit(_EVEN))
    return fp.bitwiseXOR(high).bitwiseAND(F.lit(_EVEN)).bitwiseOR(F.shiftleft(two, 1))


def groups_for(n: int, k: int) -> int:
    """Number of segment groups for which the cells of n fingerprints stay
    small: costs are the cells each is put in and the other points there (a
    segment's count holds 1.5 bits). Any number gives the same links."""

    def cost(b: int) -> float:
        return comb(b, k) * (4 + n / 2 ** (48 * (b - k) / b))

    return min(range(k + 1, k + 7), key=cost)


def _masks(b: int, k: int) -> list[int]:
    parts = np.array_split(np.arange(32), b)
    part = [sum(3 << (2 * int(s)) for s in p) for p in parts]
    masks = [sum(part[i] for i in c) for c in combinations(range(b), b - k)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def _settle(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Smallest reachable row for each of n rows, given links a-b."""
    while len(a):
        la, lb = label[a], label[b]
        off = la != lb
        if not off.any():
            break
        a, b, la, lb = a[off], b[off], la[off], lb[off]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def _linked(fp_a, e_a, fp_b, e_b, k: int) -> np.ndarray:
    """Which pairs differ in at most k bits, behind the Manhattan bound."""
    low = _manhattan(e_a, e_b) <= k
    low[low] = np.bitwise_count((fp_a ^ fp_b)[low]) <= k
    return low


def _manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum over segments of |difference| of two-bit counts 0, 1, 2."""
    x = a ^ b
    two = x & np.uint64(0xAAAAAAAAAAAAAAAA)
    # 0-2 differ by two (10), 1-2 by one (11), 0-1 by one (01)
    one = x & np.uint64(_EVEN)
    pure = (two >> np.uint64(1)) & ~one
    return np.bitwise_count(one) + 2 * np.bitwise_count(pure)


def _stars(cell: np.ndarray, side: np.ndarray, rep: np.ndarray, fp: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect, within each cell, the rows that chains of close
    pairs connect: each row to the first of its kind. Cells are runs; in a cell
    with sides 0 and 1 only rows of unlike sides are compared."""
    n = len(cell)
    e = fp - ((fp >> np.uint64(1)) & np.uint64(_EVEN))
    label = np.arange(n)
    start = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    length = np.diff(np.r_[start, n])
    size = np.repeat(length, length)
    small = size <= 64
    for s in range(1, min(64, int(length.max(initial=0)))):
        i = np.flatnonzero((cell[s:] == cell[:-s]) & small[s:])
        if not len(i):
            break
        i = i[(side[i] < 0) | (side[i] != side[i + s])]
        i = i[_linked(fp[i], e[i], fp[i + s], e[i + s], k)]
        label = _settle(n, i, i + s, label)
    for s, m in zip(start[length > 64].tolist(), length[length > 64].tolist(), strict=True):
        for r in range(s, s + m, 256):
            rows = np.arange(r, min(r + 256, s + m))
            rest = np.arange(r, s + m)
            a, b = np.broadcast_arrays(rows[:, None], rest)
            want = (b > a) & ((side[a] < 0) | (side[a] != side[b])) & (label[a] != label[b])
            a, b = a[want], b[want]
            hit = _linked(fp[a], e[a], fp[b], e[b], k)
            label = _settle(n, a[hit], b[hit], label)
    own = np.flatnonzero(label != np.arange(n))
    return rep[own], rep[label[own]]


def close_links(points: DataFrame, k: int = BITS, block: int = BLOCK, groups: int | None = None) -> DataFrame:
    """Links `(a, b)` between the ids of `(id, fp)` rows of distinct
    fingerprints, enough to connect all that chains of fingerprints within k
    bits connect.

    Each point goes to one cell of each grid; a cell with over `block` points is
    dealt into parts of about that size, and each pair of parts is a unit of its
    own, so that no task gathers a large cell and each gives at most a link a
    row, not a row a pair.
    """
    b = groups or groups_for(points.count(), k)
    e = embed(F.col("fp"))
    keys = F.array(*(F.xxhash64(F.lit(i), e.bitwiseAND(F.lit(m))) for i, m in enumerate(_masks(b, k))))
    rows = points.select("id", "fp", F.explode(keys).alias("cell"))
    large = rows.groupBy("cell").count().where(F.col("count") > block).select("cell", F.ceil(F.col("count") / block).alias("parts"))
    rows = rows.join(large, "cell", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("fp", "cell"), F.col("parts"))
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0L, parts - 1)")))
    unit = F.when(F.col("parts") == 1, F.col("cell")).otherwise(F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other")))
    side = F.when(F.col("own") == F.col("other"), -1).when(F.col("own") < F.col("other"), 0).otherwise(1).cast("byte")
    units = rows.select(unit.alias("cell"), side.alias("side"), "id", "fp").repartition("cell").sortWithinPartitions("cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.zeros(0, t) for t in ("i8", "i1", "i8", "u8")]

        def links(cols) -> pa.RecordBatch:
            x, y = _stars(*cols, k)
            return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

        for batch in batches:
            new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            new[3] = new[3].view("u8")
            held = [np.concatenate(x) for x in zip(held, new, strict=True)]
            last = int(np.searchsorted(held[0], held[0][-1]))
            if last:
                yield links([x[:last] for x in held])
                held = [x[last:] for x in held]
        if len(held[0]):
            yield links(held)

    return units.mapInArrow(run, "a long, b long").distinct()


def components(fps: DataFrame, k: int = BITS) -> DataFrame:
    """`(fp, component)` for each distinct fingerprint of `fps`: the smallest one
    that links of at most k differing bits reach. Rows of one id don't link."""
    points = cut(fps.select(F.col("fp").alias("id"), "fp").distinct())
    found = connected_components(close_links(points, k))
    return points.join(found.withColumnRenamed("node", "id"), "id", "left").select("fp", F.coalesce("component", "id").alias("component"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = BITS, shingle: int = SHINGLE) -> DataFrame:
    """`(id, fp, component_id)` for every row with an id: the fingerprint and
    the smallest id that links of at most k differing bits reach.

    A null text counts as empty, empty texts share fingerprint 0 and so one
    component; rows of the same id are all returned; rows without an id are
    returned with their fingerprint's component; an empty table gives none.
    Copies meet as one fingerprint before anything is compared.
    """
    fps = table(fingerprints(df, id_col, text, shingle), "fingerprints")
    points = cut(fps.where("id is not null").groupBy("fp").agg(F.min("id").alias("id")))
    found = connected_components(close_links(points, k))
    label = points.join(found.withColumnRenamed("node", "id"), "id", "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    return fps.join(label, "fp", "left").select("id", "fp", "component_id")
