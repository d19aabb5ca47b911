import hashlib
import math
import random
from collections import Counter

import duckdb
import pytest

from tidemark.llm import centroids
from tidemark.llm.q_centroids import ORACLE_SQL, op12_centroids


def by_hand(rows, k=16, rounds=3, dims=64):
    """The contract in plain integers, without multiplicities."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, tuple(math.floor(64 * x) for x in v)))
    order = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), q) for i, q in kept if i is not None)
    at = [q for _, q in order[:k]]
    if not at:
        return []

    def near(q):
        return min((sum((x - y) ** 2 for x, y in zip(q, c, strict=True)), n) for n, c in enumerate(at))

    for _ in range(rounds):
        found = [near(q)[1] for _, q in kept]
        for c in set(found):
            own = [q for (_, q), f in zip(kept, found, strict=True) if f == c]
            at[c] = tuple(sum(x) // len(own) for x in zip(*own, strict=True))
    last = [near(q) for _, q in kept]
    inertia = Counter()
    for d, c in last:
        inertia[c] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), digest[c]) for (i, _), (d, c) in zip(kept, last, strict=True)), key=str)


def odd_rows(n=300, dims=64):
    rng = random.Random(5)
    base = [[rng.uniform(-1, 1) for _ in range(dims)] for _ in range(25)]
    rows = [(i, [x + rng.choice([0, 0, 0, 0.02]) * rng.random() for x in rng.choice(base)]) for i in range(n)]
    rows += [(1000 + i, base[0]) for i in range(150)]
    rows += [(5, base[1]), (5, base[2]), (None, base[3]), (7, None), (8, []), (9, [1.0] * (dims - 1)), (10, [1.0] * (dims + 1))]
    rows += [(11, [None] + [0.5] * (dims - 1)), (12, [float("nan")] + [0.5] * (dims - 1)), (13, [float("-inf")] + [0.5] * (dims - 1)), (14, [0.0] * dims), (-3, [-0.01] * dims)]
    return rows


@pytest.mark.parametrize("kind", ["float", "double"])
def test_odd_rows(spark, tmp_path, kind):
    rows = [(i, v, 1, 2) for i, v in odd_rows()]
    d = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, cluster int, q int")
    d.repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    back = [(r.vec_id, r.embedding) for r in d.select("vec_id", "embedding").collect()]
    assert sorted(map(tuple, op12_centroids(spark, str(tmp_path)).collect()), key=str) == by_hand(back)


def test_query_and_sql(spark):
    sf = "/root/testdata/sf0.001"
    got = sorted(map(tuple, op12_centroids(spark, sf).collect()), key=str)
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert got == by_hand(rows)
    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS FROM '{sf}/embeddings.parquet'")
    assert sorted(c.sql(ORACLE_SQL["op12_centroids"]).fetchall(), key=str) == got


def test_large_components_and_weights(spark):
    top = (centroids.largest(2) - 1) / 64
    rows = [(1, [top, -top]), (2, [-top, top]), (3, [top, top]), (4, [top * 2, 0.0]), (5, [1e300, 0.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = centroids.cluster(d, k=2, rounds=1, dims=2)
    assert sorted((r.id, r.distance) for r in out.rows.collect()) == [(i, d) for i, _, d, *_ in by_hand(rows[:3], 2, 1, 2)]
    heavy = spark.createDataFrame([([3, -5], 1 << 40), ([4, -6], 3)], "q array<int>, n long")
    assert centroids.moved(heavy, [(0, 0), (99, 99)]) == [((3 * (1 << 40) + 12) // ((1 << 40) + 3), (-5 * (1 << 40) - 18) // ((1 << 40) + 3)), (99, 99)]


def test_few_and_no_vectors(spark, tmp_path):
    d = spark.createDataFrame([(2, [0.5] * 64), (2, [0.5] * 64), (None, [0.25] * 64)], "vec_id long, embedding array<float>")
    out = centroids.cluster(d)
    # both centroids start on the same vector; the second one is left with it
    assert sorted((r.id or 0, r.cluster, r.distance) for r in out.rows.collect()) == [(0, 0, 0), (2, 1, 0), (2, 1, 0)]
    assert sorted((r.cluster, r.size, r.inertia, r.centroid[0]) for r in out.clusters.collect()) == [(0, 1, 0, 16), (1, 2, 0, 32)]
    for name, rows in (("none", d.where("false")), ("no_id", d.where("vec_id is null"))):
        rows.write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
        assert op12_centroids(spark, f"{tmp_path}/{name}").count() == 0
