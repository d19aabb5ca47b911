import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import resampling as rs


def test_weights_are_poisson(spark):
    d = spark.range(200).select(F.col("id").alias("c"), F.explode(F.sequence(F.lit(0), F.lit(499))).alias("r"))
    n = {r.w: r.n for r in d.groupBy(rs.weight(F.col("r"), F.col("c")).alias("w")).agg(F.count("*").alias("n")).collect()}
    for k, share in enumerate([0.3679, 0.3679, 0.1839, 0.0613]):
        assert abs(n[k] / 100_000 - share) < 0.006
    assert abs(sum(w * x for w, x in n.items()) / 100_000 - 1) < 0.02
    assert len(rs.thresholds()) > 10 and rs.thresholds() == sorted(rs.thresholds())


def weights(spark, clusters, replicates):
    d = spark.createDataFrame([(c,) for c in clusters], "c string").withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    return {(r.c, r.r): r.w for r in d.select("c", "r", rs.weight(F.col("r"), F.col("c")).alias("w")).collect()}


def test_bounds_by_hand(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), f"c{rng.randrange(12)}", rng.randrange(2), 1, rng.randrange(2), rng.randrange(2)) for _ in range(300)]
    d = spark.createDataFrame(rows, "k string, c string, g long, n long, h long, m long").repartition(7)
    w = weights(spark, {r[1] for r in rows}, 200)
    share = lambda a, b: a * 10_000 // b if b else 0
    low = lambda xs: sorted(xs)[9]
    for r in rs.share_bounds(d, "c", {"x": ("g", "n"), "y": ("h", "m")}, ["k"], 200).collect():
        own = [x for x in rows if x[0] == r.k]
        assert r.clusters == len({x[1] for x in own})
        for got, bound, a, b in ((r.x_e4, r.x_lower_e4, 2, 3), (r.y_e4, r.y_lower_e4, 4, 5)):
            assert got == share(sum(x[a] for x in own), sum(x[b] for x in own))
            assert bound == low(share(sum(w[x[1], i] * x[a] for x in own), sum(w[x[1], i] * x[b] for x in own)) for i in range(200))
    r = rs.paired_difference(d, "c", ("g", "n"), ("h", "m"), 100, replicates=200).first()
    gain = lambda u: share(sum(u(x) * x[4] for x in rows), sum(u(x) * x[5] for x in rows)) - share(sum(u(x) * x[2] for x in rows), sum(u(x) * x[3] for x in rows))
    assert (r.delta_e4, r.lower_bound_e4) == (gain(lambda x: 1), low(gain(lambda x, i=i: w[x[1], i]) for i in range(200)))
    assert r.no_worse == (r.lower_bound_e4 >= -100)


def test_p90_by_hand(spark):
    rng = random.Random(4)
    arms = [[(f"c{rng.randrange(8)}", rng.randrange(-3, 60 - 20 * arm)) for _ in range(90)] + [(f"only{arm}", 5)] for arm in (0, 1)]
    a, b = (spark.createDataFrame([*x, ("c1", None)], "c string, e long") for x in arms)
    shared = {c for c, _ in arms[0]} & {c for c, _ in arms[1]}
    w = weights(spark, shared, 100)

    def p90(arm, u):
        pool = sorted(e for c, e in arms[arm] if c in shared for _ in range(u(c)))
        return pool[-(-9 * len(pool) // 10) - 1] if pool else None

    def gain(u):
        x, y = p90(0, u), p90(1, u)
        return (x - y) * 10_000 // x if x and x > 0 else 0

    r = rs.paired_p90(a, b, "c", "e", 100).first()
    assert (r.clusters, r.before, r.after, r.improvement_e4) == (len(shared), p90(0, lambda c: 1), p90(1, lambda c: 1), gain(lambda c: 1))
    assert r.lower_bound_e4 == sorted(gain(lambda c, i=i: w[c, i]) for i in range(100))[4]
    assert rs.paired_p90(a.where("c = 'only0'"), b, "c", "e", 100).count() == 0


def test_odd_tables(spark):
    d = spark.createDataFrame([(f"c{i}", 8, 10, 9, 10) for i in range(20)], "c string, g0 long, n0 long, g1 long, n1 long")
    r = rs.paired_difference(d, "c", ("g0", "n0"), ("g1", "n1"), replicates=100).first()
    assert (r.clusters, r.delta_e4, r.lower_bound_e4, r.no_worse) == (20, 1000, 1000, True)
    r = rs.paired_difference(d, "c", ("g1", "n1"), ("g0", "n0"), replicates=100).first()
    assert (r.delta_e4, r.lower_bound_e4, r.no_worse) == (-1000, -1000, False)
    assert rs.paired_difference(d.where("false"), "c", ("g0", "n0"), ("g1", "n1"), replicates=100).count() == 0
    none = rs.share_bounds(d.where("false"), "c", {"x": ("g0", "n0")}, replicates=100).first()
    assert (none.clusters, none.x_e4, none.x_lower_e4) == (0, 0, 0)
    odd = spark.createDataFrame([(None, 1, 2), (None, 1, 2), ("a", None, None)], "c string, g long, n long")
    r = rs.share_bounds(odd, "c", {"x": ("g", "n")}, replicates=100).first()
    assert (r.clusters, r.x_e4) == (2, 5000) and r.x_lower_e4 in (0, 5000)
    e = spark.createDataFrame([("u", "k", 0, 3, 0), ("v", "k", 0, 1, 0), ("u", "q", 2, 2, 4)], "c string, kind string, m long, p long, t long")
    got = {r.kind: (r.n_truth, r.precision_e4, r.recall_e4, r.precision_lower_e4) for r in rs.event_bounds(e, "c", "kind", "m", "p", "t", 100).collect()}
    assert got["k"] == (0, 0, 0, 0) and got["q"][:3] == (4, 10_000, 5000)


@pytest.mark.parametrize("n", [1, 19, 20, 100, 2000])
def test_place_is_nearest_rank(n):
    assert rs._place(5, n) == max(0, int(np.ceil(n * 5 / 100)) - 1)
