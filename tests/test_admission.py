import random

from pyspark.sql import functions as F

from tidemark.operators import admission as adm


def greedy(rows, limit, window):
    """Per key, in order, against a plain list of all admitted times."""
    out, held = {}, {}
    for k, i, t in sorted(rows, key=lambda r: (str(r[0]), r[2] if r[2] is not None else -1, r[1])):
        if t is None:
            out[i] = False, 0
            continue
        near = [x for x in held.get(k, []) if x > t - window]
        if len(near) < limit:
            held.setdefault(k, []).append(t)
            out[i] = True, 0
        else:
            out[i] = False, max(1, near[len(near) - limit] + window - t) if limit else window
    return out


def test_limits_against_a_plain_list(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["a", "b", None]), i, rng.choice([None, *range(400)]) if i % 40 == 0 else rng.randrange(400)) for i in range(500)]
    rows += [("busy", 1000 + i, i // 3) for i in range(900)]
    d = spark.createDataFrame(rows, "k string, id long, t long").withColumn("admitted", F.lit("own")).repartition(6)
    for limit, window in ((1, 10), (3, 25), (5, 1), (0, 7), (2, 1000)):
        got = {r.id: (r.admitted, r.wait) for r in adm.limited(d, ["k"], "t", "id", limit, window).collect()}
        assert got == greedy(rows, limit, window)
    # a refused event doesn't count: of a steady stream every third is admitted
    steady = spark.createDataFrame([("x", i, i) for i in range(30)], "k string, id long, t long")
    assert [r.id for r in adm.limited(steady, ["k"], "t", "id", 1, 3).where("admitted").orderBy("id").collect()] == list(range(0, 30, 3))
    assert adm.limited(d.where("false"), ["k"], "t", "id", 1, 1).count() == 0


def test_breaker_opens_cools_latches_and_resets(spark):
    day = 86_400
    rows = [("p", i, i * 10, True) for i in range(20)]  # trips at its 4th sample
    rows += [("p", 100 + i, 500 + i * 10, True) for i in range(4)]  # after the cooldown again: latched
    rows += [("p", 200 + i, 2000 + i, True) for i in range(9)]  # latched until midnight
    rows += [("p", 300 + i, day + i, True) for i in range(4)]
    rows += [("q", 400 + i, i * 10, i % 5 == 4) for i in range(12)] + [("q", 500, None, True), ("q", 501, 130, None)]
    d = spark.createDataFrame(rows, "k string, id long, t long, f boolean").repartition(3)
    b = adm.breakers(d, ["k"], "t", "id", "f", window_s=100, least=4, percent=30, cooldown_s=300, latch=2, daily=25)
    assert {r.id: r.opened for r in b.where("opened is not null").collect()} == {3: "open", 103: "latched", 303: "open"}
    assert [r.id for r in b.where("over_budget").collect()] == [201]
    assert b.count() == len(rows) and adm.breakers(d.where("false"), ["k"], "t", "id", "f").count() == 0
