import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import loops as lp

S = "media string, work string, s long, e long"


def test_hint_only(spark):
    c = spark.createDataFrame([("m", 0, "a", 1, 100, 110), ("m", 0, "b", 2, 100, 110), ("m", 1, "a", 1, 200, 210), ("m", 2, "b", 1, 400, 410), ("m", 3, "b", 1, 500, 510)], "media string, cluster long, work string, rank int, s long, e long")
    spans = spark.createDataFrame([("m", "a", 0, 90), ("m", "z", 300, 350)], S)
    got = [(r.cluster, r.work) for r in lp.hint_only(c, spans, spans).orderBy("cluster").collect()]
    # a is still on for the first two; b is new, then apart by z, then nothing lies between
    assert got == [(0, "b"), (2, "b")]
    assert lp.hint_only(c.where("false"), spans, spans).count() == 0


def test_copies_and_mirrors(spark):
    h = "media string, id long, connector string, key string, artist string, title string, at long"
    d = spark.createDataFrame([("m", 1, "x", "a|t", "alpha", "title", 0), ("m", 2, "y", "a|t", "alpha", "title", 60_000), ("m", 3, "y", "b|t", "alphb", "titla", 100), ("m", 4, "x", "a|t", "alpha", "title", 5), ("m", 5, "y", "c", "other", "thing", 9), ("m", 6, "y", "a|t", "alpha", "title", 60_006)], h)
    got = sorted((r.a, r.b, r.confidence) for r in lp.copies(d, alike=0.8).collect())
    assert got == [(1, 2, 9000), (1, 3, 7500), (2, 4, 9000), (3, 4, 7500)]
    g = "media string, id long, grp long, key string, at long"
    src = spark.createDataFrame([("m", 1, 7, "k", 0), ("m", 2, 7, "k", 10), ("m", 3, 8, "k", 20), ("m", 4, 9, "q", 0)], g)
    mir = spark.createDataFrame([("m", 1, 1, "k", 5), ("m", 2, 1, "k", 6), ("m", 3, 1, "k", 7), ("m", 4, 1, "q", 90_000)], g)
    assert [tuple(r) for r in lp.mirror_agreements(src, mir).collect()] == [("m", 2)]


def test_generations_stop(spark):
    start = spark.createDataFrame([(0,)], "x long")
    double = lambda d: d.agg(F.sum("x").alias("total"))
    more = lambda fused, rows, left: rows.agg((F.max("x") + 1).alias("x"))
    same = lambda w: w
    run = lambda plan, recognise, most, budget: lp.generations(start, double, plan, recognise, most, budget)
    fused, rows, why = run(more, same, 3, 10)
    assert (fused.first().total, rows.count(), why) == (6, 4, "generations")
    assert run(lambda f, r, left: r.where("false"), same, 3, 10)[2] == "no_requests"
    assert run(more, lambda w: w.where("false"), 3, 10)[2] == "no_evidence"
    fused, _, why = run(more, same, 9, 2)
    assert (fused.first().total, why) == (3, "budget")


def test_pcm(spark, tmp_path):
    (tmp_path / "a.pcm").write_bytes(np.array([1, -2, 300], "<i2").tobytes() + b"x")
    assert lp.read_pcm(spark, str(tmp_path)).first().samples == [1, -2, 300]


def test_tiers_without_thresholds(spark):
    t = spark.createDataFrame([("likely", None), ("possible", 3)], "tier string, min_index long")
    d = spark.createDataFrame([(2,), (3,), (9,)], "i long")
    assert [r.tier for r in lp.calibrated_tiers(d, "i", t).orderBy("i").collect()] == ["unclear", "possible", "possible"]
    assert [r.tier for r in lp.calibrated_tiers(d, "i", t.where("false")).orderBy("i").collect()] == ["unclear"] * 3
