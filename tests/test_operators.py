import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tidemark.functions import labels
from tidemark.functions.exact import half_up, iou_e4, ratio_e4
from tidemark.operators import evidence, intervals, schedule
from tidemark.sources import records
from tidemark.streaming import streams

SPANS = [("a", 0, 10), ("a", 10, 20), ("a", 30, 40), ("a", 35, 38), ("a", 5, 5), ("a", 9, 3), ("a", None, 4), ("b", 1, 2), ("b", 1, 2)]


def made(spark, rows, schema="k string, s long, e long"):
    return spark.createDataFrame(rows, schema)


def test_islands_touch_nest_and_skip_odd_spans(spark):
    got = intervals.islands(made(spark, SPANS), ["k"], "s", "e").collect()
    assert sorted((r.k, r.s, r.e, r.n) for r in got) == [("a", 0, 20, 2), ("a", 30, 40, 2), ("b", 1, 2, 2)]


def test_islands_by_slots_are_the_same(spark):
    import random

    rng = random.Random(4)
    rows = [(rng.choice("ab"), s := rng.randrange(2000), s + rng.randrange(-5, 90)) for _ in range(400)]
    d = made(spark, rows)
    for gap in (0, 7):
        want = sorted(tuple(r) for r in intervals.islands(d, ["k"], "s", "e", gap=gap).collect())
        for slot in (1, 50, 5000):
            assert sorted(tuple(r) for r in intervals.islands(d, ["k"], "s", "e", gap=gap, slot=slot).collect()) == want


def test_exact_beyond_doubles(spark):
    n = 2**53 + 1
    d = spark.range(1).select(half_up(F.lit(2 * n), F.lit(2)).alias("h"), ratio_e4(F.lit(450_359_962_737_049), F.lit(450_359_962_737_050)).alias("r"))
    assert tuple(d.first()) == (n, 10_000)


def test_isotonic_pools(spark):
    d = spark.createDataFrame([("g", i, k, 10) for i, k in enumerate((1, 5, 3, 4, 9, 2))] + [("h", 0, 0, 0), ("h", 1, 1, 2)], "k string, x long, g long, t long")
    got = [(r.k, r.x, r.fit_e4) for r in evidence.isotonic(d, ["k"], "x", "g", "t").orderBy("k", "x").collect()]
    assert got == [("g", 0, 1000), ("g", 1, 4000), ("g", 2, 4000), ("g", 3, 4000), ("g", 4, 5500), ("g", 5, 5500), ("h", 0, 0), ("h", 1, 5000)]


def test_subtract_and_intersect(spark):
    a, b = made(spark, SPANS), made(spark, [("a", 5, 32), ("c", 0, 9)])
    assert sorted((r.k, r.s, r.e) for r in intervals.subtract(a, b, ["k"], "s", "e").collect()) == [("a", 0, 5), ("a", 32, 40), ("b", 1, 2)]
    assert sorted((r.k, r.s, r.e) for r in intervals.intersect(a, b, ["k"], "s", "e").collect()) == [("a", 5, 20), ("a", 30, 32)]


def test_overlap_join_finds_each_pair_once(spark):
    a = made(spark, [("a", 0, 100), ("a", 95, 300)])
    b = made(spark, [("a", 99, 250), ("a", 100, 101), ("b", 0, 9)]).select("k", F.col("s").alias("s2"), F.col("e").alias("e2"))
    got = intervals.overlap_join(a, b, ["k"], "s", "e", "s2", "e2", 30).collect()
    assert sorted((r.s, r.s2) for r in got) == [(0, 99), (95, 99), (95, 100)]


def test_windows_tail_and_short_media(spark):
    d = spark.createDataFrame([(1, 30), (2, 31), (3, 7), (4, 0)], "m int, d long")
    got = schedule.sliding_windows(d, "d", 12, 9).collect()
    by = {m: sorted((r.start, r.end, r.is_tail) for r in got if r.m == m) for m in (1, 2, 3, 4)}
    assert by[1] == [(0, 12, False), (9, 21, False), (18, 30, False)]
    assert by[2] == [(0, 12, False), (9, 21, False), (18, 30, False), (19, 31, True)]
    assert by[3] == [(0, 7, False)] and by[4] == []


def test_admission_skips_what_does_not_fit(spark):
    d = spark.createDataFrame([("a", 1, 6, 10), ("a", 2, 5, 10), ("a", 3, 4, 10), ("b", 1, 11, 10)], "k string, p int, c long, b long")
    got = schedule.admit(d, ["k"], ["p"], "c", "b").where("admitted").collect()
    assert sorted((r.k, r.p) for r in got) == [("a", 1), ("a", 3)]


def test_exact_arithmetic(spark):
    d = spark.createDataFrame([(1, 3), (5, 0), (7, 2), (-7, 2), (-5, 2), (1, 20000)], "n long, d long")
    got = d.select(ratio_e4(F.col("n"), F.col("d")).alias("r"), F.when(F.col("d") > 0, half_up(F.col("n"), F.col("d"))).alias("h")).collect()
    assert [r.r for r in got][:3] == [3333, 0, 10000] and got[5].r == 1
    assert [r.h for r in got] == [0, None, 4, -4, -3, 0]
    lit = lambda *x: [F.lit(v).cast("long") for v in x]
    assert spark.range(1).select(iou_e4(*lit(0, 10, 5, 15)).alias("x")).first().x == 3333


def test_label_folds(spark):
    fold = spark.createDataFrame([("  Ｃafé   ①\n",)], "t string").select(labels.display_fold("t").alias("d"), labels.score_fold("t").alias("s")).first()
    assert (fold.d, fold.s) == ("café 1", "cafe 1")


def test_statistics(spark):
    d = spark.createDataFrame([("g", x, 2 * x + 1) for x in range(9)] + [("g", 20, 500)], "k string, x long, y long")
    r = evidence.theil_sen(d, ["k"], "x", "y").first()
    assert r.slope == 2 and r.intercept == 1 and r.residual == 459
    k = spark.createDataFrame([(10, 10), (0, 5), (0, 0)], "k long, n long").select(evidence.clopper_pearson_e4(F.col("k"), F.col("n")).alias("b")).collect()
    assert [x.b for x in k] == [math.floor(0.05**0.1 * 10000), 0, 0]


def test_ledger_conflicts(spark):
    rows = [(1, "prepared", None, 0, 1), (2, "prepared", None, 0, 1), (2, "dispatched", None, 0, 2), (2, "resolved", "billed", 5, 3), (2, "resolved", "billed", 5, 3), (3, "resolved", "billed", 5, 1), (3, "resolved", "free", 5, 1)]
    d = spark.createDataFrame(rows, "a long, ev string, o string, u long, t long")
    got = {r.a: (r.dispatched, r.o, r.spent, r.conflict) for r in evidence.ledger_fold(d, "a", "ev", "o", "u", "t").collect()}
    assert got[1] == (False, None, 0, False) and got[2] == (True, "billed", 5, False) and got[3][3]


def test_records(spark, tmp_path):
    schema = StructType([StructField("id", LongType()), StructField("t", StringType())])
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.jsonl").write_text('{"id":1,"t":"x"}\n\n{"id":2,\n{"id":3,"t":null}\n')
    got = records.read_journal(spark, str(tmp_path / "j"), schema)
    assert sorted(r.id for r in got.collect()) == [1, 3]
    records.write_canonical(got, str(tmp_path / "out"))
    back = records.read_jsonl(spark, str(tmp_path / "out"), schema)
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ['{"id":1,"t":"x"}', '{"id":3,"t":null}']
    assert records.verify(back, ["id"], records.manifest(got, ["id"])).count() == 0
    assert records.verify(back.where("id = 1"), ["id"], records.manifest(got, ["id"])).count() == 1


@pytest.fixture
def feed(spark, tmp_path):
    src = tmp_path / "in"
    rows = [(u, 1_700_000_000 + 5 * i, i % 2 == 0 and u == "x") for u in ("x", "y") for i in range(60)]
    spark.createDataFrame(rows, "u string, t long, bad boolean").coalesce(1).write.parquet(str(src))
    return spark.readStream.schema("u string, t long, bad boolean").parquet(str(src)).withColumn("at", F.timestamp_seconds("t"))


def drain(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


def test_breaker_stream(spark, feed):
    got = drain(spark, streams.breaker(feed, "u", "t", "bad"), "b")
    assert [(r.u, r.action) for r in got] == [("x", "open")]


def test_session_stream(spark, feed):
    got = drain(spark, streams.sessions(feed, "u", "at", "1 minute", "1 minute"), "s", "complete")
    assert sorted((r.u, r.n) for r in got) == [("x", 60), ("y", 60)]


def test_sliding_stream(spark, feed):
    got = drain(spark, streams.hops(feed, "u", "at", "1 minute", "30 seconds", "1 minute"), "h", "complete")
    # 60 events, each in two windows
    assert sum(r.n for r in got if r.u == "x") == 120 and all((r.end - r.start).seconds == 60 for r in got)


def test_ingest_once(spark, feed):
    twice = feed.unionByName(feed)
    assert len(drain(spark, streams.ingest_once(twice, ["u", "t"], "at", "1 hour"), "i")) == 120
