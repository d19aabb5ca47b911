"""Interval, join and schedule queries over the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import intervals as iv
from tidemark.operators import schedule as sc
from tidemark.runtime import read_table

SEC = 1_000_000
TEN_MIN, HOUR, DAY = 600 * SEC, 3600 * SEC, 86400 * SEC
#: The range that the events lie in: 2024-01-01 to 2024-01-31, in microseconds.
LO, HI = 1_704_067_200 * SEC, 1_706_659_200 * SEC


def supports(spark: SparkSession, sf_dir: str, width_us: int = TEN_MIN, kinds: list[str] | None = None) -> DataFrame:
    """Each event as a span [ts, ts + width) in microseconds."""
    e = read_table(spark, sf_dir, "events")
    if kinds:
        e = e.where(F.col("event_type").isin(kinds))
    s = F.unix_micros("ts")
    return e.select("user_id", "event_id", "event_type", "value", s.alias("s"), (s + width_us).alias("e"))


def q_islands_stats(spark, d):
    return iv.island_stats(supports(spark, d), ["user_id"], "s", "e", slot=DAY)


def q_union(spark, d):
    return iv.islands(supports(spark, d), ["user_id"], "s", "e", slot=DAY)


def q_subtract(spark, d):
    k = ["user_id", "s", "e"]
    return iv.subtract(supports(spark, d, HOUR, ["view"]).select(*k), supports(spark, d, HOUR, ["click"]).select(*k), ["user_id"], "s", "e")


def q_intersection(spark, d):
    k = ["user_id", "s", "e"]
    i = iv.intersect(supports(spark, d, HOUR, ["view"]).select(*k), supports(spark, d, HOUR, ["click"]).select(*k), ["user_id"], "s", "e")
    return i.groupBy("user_id").agg(F.sum(F.col("e") - F.col("s")).alias("len"), F.count("*").alias("pieces"))


def q_targets(spark, d):
    lo, hi = F.lit(LO).cast("long"), F.lit(HI).cast("long")
    return iv.targets(supports(spark, d, HOUR).select("user_id", "s", "e"), ["user_id"], "s", "e", lo, hi, 4 * SEC, 3 * SEC, 8 * SEC)


def q_segments(spark, d):
    return iv.elementary_segments(supports(spark, d, HOUR), ["user_id"], "s", "e")


def q_agreements(spark, d):
    """Overlaps of at least five minutes between the two families of each user's
    supports: how many distinct ones, and whether two begin an hour apart."""
    fam = F.when(F.col("event_type").isin("view", "click"), "A").otherwise("B")
    x = supports(spark, d).withColumn("fam", fam)
    a = x.where("fam = 'A'").select("user_id", F.col("s").alias("as"), F.col("e").alias("ae"))
    b = x.where("fam = 'B'").select("user_id", F.col("s").alias("bs"), F.col("e").alias("be"))
    return iv.agreements(a, b, ["user_id"], "as", "ae", "bs", "be", 300 * SEC, HOUR, HOUR)


def q_starts_in_span(spark, d):
    sp = supports(spark, d, HOUR, ["purchase"]).select("user_id", F.col("event_id").alias("span_id"), "s", "e")
    pts = supports(spark, d).select("user_id", F.col("event_id").alias("point_id"), F.col("s").alias("at"))
    return iv.points_in_spans(pts, sp, ["user_id"], "at", "s", "e", HOUR).groupBy("user_id", "span_id").agg(F.count("*").alias("points"))


def _views_clicks(spark, d):
    x = supports(spark, d)
    v = x.where("event_type = 'click'").select("user_id", F.col("event_id").alias("click_id"), F.col("s").alias("t"))
    return v, x.where("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"), F.col("s").alias("vt"))


def q_asof_backward(spark, d):
    c, v = _views_clicks(spark, d)
    return iv.asof(c, v, ["user_id"], "t", "vt", "view_id").select("user_id", "click_id", F.col("asof").alias("view_id"))


def q_asof_forward(spark, d):
    c, v = _views_clicks(spark, d)
    return iv.asof(c, v, ["user_id"], "t", "vt", "view_id", forward=True).select("user_id", "click_id", F.col("asof").alias("view_id"))


def q_nearest(spark, d):
    c, v = _views_clicks(spark, d)
    x = iv.asof(c, v, ["user_id"], "t", "vt", "view_id", out="p")
    x = iv.asof(x, v, ["user_id"], "t", "vt", "view_id", forward=True, out="n")
    before, after = F.col("t") - F.col("p_t"), F.col("n_t") - F.col("t")
    back = F.coalesce(before <= after, F.col("p").isNotNull())
    return x.select("user_id", "click_id", F.when(back, F.col("p")).otherwise(F.col("n")).alias("view_id"), F.when(back, before).otherwise(after).alias("gap"))


def q_runs_with_core(spark, d):
    return iv.runs_with_core(supports(spark, d), ["user_id"], "s", "e", HOUR, 2 * TEN_MIN)


def q_offset_mode(spark, d):
    x = read_table(spark, d, "events").select("user_id", F.round("value").cast("long").alias("v"))
    return iv.offset_cluster(x, ["user_id"], "v", 100, 7, 20)


def q_clusters(spark, d):
    """Transitive clusters of strictly overlapping spans."""
    x = supports(spark, d, HOUR, ["view", "purchase"])
    return iv.islands(x.withColumn("e", F.col("e") - 1), ["user_id"], "s", "e", gap=0).withColumn("e", F.col("e") + 1)


def q_duration_partition(spark, d):
    """Time per user by the strongest activity at each moment, and the rest."""
    order = ["purchase", "signup", "click", "view", "error"]
    x = supports(spark, d, HOUR)
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("event_type"))
    ev = x.select("user_id", rank.alias("k"), F.explode(F.array(F.struct(F.col("s").alias("t"), F.lit(1).alias("d")), F.struct(F.least("e", F.lit(HI)).alias("t"), F.lit(-1).alias("d")))).alias("m"))
    ev = ev.groupBy("user_id", F.col("m.t").alias("t")).agg(*(F.sum(F.when(F.col("k") == i + 1, F.col("m.d")).otherwise(0)).alias(f"d{i}") for i in range(5)))
    w = Window.partitionBy("user_id").orderBy("t")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    seg = ev.select("user_id", "t", F.lead("t").over(w).alias("u"), *(F.sum(f"d{i}").over(run).alias(f"c{i}") for i in range(5)))
    cls = F.coalesce(*(F.when(F.col(f"c{i}") > 0, F.lit(o)) for i, o in enumerate(order)))
    seg = seg.where("u is not null").withColumn("cls", cls)
    length = F.col("u") - F.col("t")
    out = seg.groupBy("user_id").agg(*(F.sum(F.when(F.col("cls") == o, length).otherwise(0)).alias(o) for o in order))
    return out.withColumn("idle", F.lit(HI - LO) - sum((F.col(o) for o in order[1:]), F.col(order[0])))


def q_competing(spark, d):
    """Per user and kind of event, other kinds whose covered time overlaps at
    least half of its own."""
    i = iv.islands(supports(spark, d, 6 * HOUR), ["user_id", "event_type"], "s", "e").drop("n")
    return iv.competing(i, ["user_id"], "event_type", "s", "e", 6 * HOUR)


def _durations(spark, d):
    x = supports(spark, d)
    return x.groupBy("user_id").agg(F.expr("(max(s) - min(s)) div 60000000").alias("dur"))


def q_windows(spark, d):
    return sc.sliding_windows(_durations(spark, d), "dur", 1200, 900, 0).select("user_id", "start", "end", "is_tail")


def q_region_windows(spark, d):
    i = iv.islands(supports(spark, d, HOUR), ["user_id"], "s", "e").drop("n")
    return sc.region_windows(i, "s", "e", 1800 * SEC, 900 * SEC).select("user_id", "s", "e", "w_start", "w_end", "is_tail")


def q_grid(spark, d):
    """All 18 schedules of width, hop and phase, with their window counts."""
    g = spark.range(1).select(F.explode(F.array(*map(F.lit, (8, 10, 12)))).alias("w")).select("w", F.explode(F.array(*map(F.lit, (3, 6, 9)))).alias("h")).select("w", "h", F.explode(F.array(F.lit(0), F.lit(1))).alias("p"))
    t = _durations(spark, d).agg(F.max("dur").alias("dur"))
    return g.crossJoin(t).select(F.col("w").alias("width"), F.col("h").alias("hop"), F.col("p").alias("phase"), F.expr("(dur - w - p * h div 2) div h + 1").alias("windows"))


def q_every_nth(spark, d):
    return sc.every_nth(supports(spark, d).select("user_id", "event_id", "s"), ["user_id"], ["s", "event_id"], 3).select("user_id", "event_id")


def q_even_subsample(spark, d):
    return sc.even_subsample(supports(spark, d).select("user_id", "event_id", "s"), ["user_id"], ["s", "event_id"], 7).select("user_id", "event_id")


def q_largest_remainder(spark, d):
    n = read_table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("w"))
    return sc.largest_remainder(n, "w", 100, ["nation"]).select("nation", "w", "seats")


def q_independent(spark, d):
    x = supports(spark, d, HOUR).withColumns({"trial": F.expr(f"s div {HOUR // 2}"), "light": F.col("event_type") == "click"})
    return sc.independent_trials(x, ["user_id"], "trial", "event_type", "s", "e", "light")


def q_budget(spark, d):
    """Orders admitted by priority under half of their customer's total."""
    o = read_table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", F.round(F.col("o_totalprice") * 100).cast("long").alias("cost"))
    o = o.withColumn("budget", F.expr("sum(cost) over (partition by o_custkey) div 2"))
    return sc.admit(o, ["o_custkey"], ["o_orderpriority", "o_orderkey"], "cost", "budget").where("admitted").select("o_custkey", "o_orderkey", "cost")


def q_occurrence(spark, d):
    w = Window.partitionBy("user_id", "event_type").orderBy("s", "event_id")
    x = supports(spark, d)
    return x.select("user_id", "event_id", (F.row_number().over(w) - 1).alias("occurrence"), (F.col("s") - F.lag("s").over(w)).alias("since"))


QUERIES = {
    "interval_islands_stats": q_islands_stats,
    "interval_union": q_union,
    "interval_subtract": q_subtract,
    "interval_intersection_len": q_intersection,
    "uncovered_targets": q_targets,
    "elementary_segments_multiplicity": q_segments,
    "cross_family_agreements": q_agreements,
    "starts_in_span": q_starts_in_span,
    "asof_backward": q_asof_backward,
    "asof_forward": q_asof_forward,
    "nearest_occurrence": q_nearest,
    "runs_with_core": q_runs_with_core,
    "offset_mode": q_offset_mode,
    "hint_clusters": q_clusters,
    "duration_partition": q_duration_partition,
    "competing_candidates": q_competing,
    "window_schedule": q_windows,
    "rescan_schedule": q_region_windows,
    "transform_grid": q_grid,
    "every_nth": q_every_nth,
    "even_subsample": q_even_subsample,
    "largest_remainder": q_largest_remainder,
    "independent_trials": q_independent,
    "budget_plan": q_budget,
    "occurrence_index": q_occurrence,
}


def _sp(width: int, where: str = "true") -> str:
    return f"SELECT user_id, event_id, event_type, epoch_us(ts) AS s, epoch_us(ts) + {width} AS e FROM events WHERE {where}"


def _isl(src: str, keys: str = "user_id", gap: str = "s > pe") -> str:
    """SQL of the islands of `src` (keys, s, e)."""
    return f"""SELECT {keys}, min(s) AS s, max(e) AS e, count(*) AS n FROM (
 SELECT *, sum(CASE WHEN pe IS NULL OR {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM (
 SELECT *, max(e) OVER (PARTITION BY {keys} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM ({src})))
 GROUP BY {keys}, g"""


def _cover(cond: str) -> str:
    """SQL of the segments of view (l) and click (r) spans, islands of `cond`."""
    seg = f"""SELECT user_id, t AS s, u AS e FROM (SELECT user_id, t, lead(t) OVER w AS u, sum(l) OVER w AS l, sum(r) OVER w AS r FROM (
 SELECT user_id, t, sum(l) AS l, sum(r) AS r FROM (
 SELECT user_id, s AS t, 1 AS l, 0 AS r FROM ({_sp(HOUR, "event_type = 'view'")}) UNION ALL SELECT user_id, e, -1, 0 FROM ({_sp(HOUR, "event_type = 'view'")})
 UNION ALL SELECT user_id, s, 0, 1 FROM ({_sp(HOUR, "event_type = 'click'")}) UNION ALL SELECT user_id, e, 0, -1 FROM ({_sp(HOUR, "event_type = 'click'")})) GROUP BY user_id, t)
 WINDOW w AS (PARTITION BY user_id ORDER BY t)) WHERE u IS NOT NULL AND {cond}"""
    return _isl(seg)


_VC = "c AS (SELECT user_id, event_id AS click_id, epoch_us(ts) AS t FROM events WHERE event_type = 'click'), v AS (SELECT user_id, min(event_id) AS view_id, epoch_us(ts) AS vt FROM events WHERE event_type = 'view' GROUP BY user_id, ts)"
_BACK = "SELECT c.user_id, click_id, t, view_id, vt FROM c ASOF LEFT JOIN v ON c.user_id = v.user_id AND c.t >= v.vt"
_FORE = "SELECT c.user_id, click_id, t, view_id, vt FROM c ASOF LEFT JOIN v ON c.user_id = v.user_id AND c.t <= v.vt"
_DUR = "SELECT user_id, (max(epoch_us(ts)) - min(epoch_us(ts))) // 60000000 AS dur FROM events GROUP BY user_id"

_PART = ["purchase", "signup", "click", "view", "error"]

ORACLE_SQL = {
    "interval_islands_stats": f"""SELECT user_id, CAST(sum(e - s) AS BIGINT) AS covered, count(*) AS islands, CAST(coalesce(max(gap), 0) AS BIGINT) AS largest_gap
 FROM (SELECT *, s - lag(e) OVER (PARTITION BY user_id ORDER BY s) AS gap FROM ({_isl(_sp(TEN_MIN))})) GROUP BY user_id""",
    "interval_union": f"SELECT user_id, s, e, n FROM ({_isl(_sp(TEN_MIN))})",
    "interval_subtract": f"SELECT user_id, s, e FROM ({_cover('l > 0 AND r = 0')})",
    "interval_intersection_len": f"SELECT user_id, CAST(sum(e - s) AS BIGINT) AS len, count(*) AS pieces FROM ({_cover('l > 0 AND r > 0')}) GROUP BY user_id",
    "uncovered_targets": f"""WITH i AS (SELECT user_id, s, e, lead(s) OVER w AS nx, lag(e) OVER w AS pv FROM ({_isl(_sp(HOUR), gap=f's - pe > {4 * SEC}')}) WINDOW w AS (PARTITION BY user_id ORDER BY s)),
 o AS (SELECT user_id, greatest(e, {LO}) AS a, least(coalesce(nx, {HI}), {HI}) AS b FROM i UNION ALL SELECT user_id, {LO}, least(s, {HI}) FROM i WHERE pv IS NULL),
 g AS (SELECT user_id, greatest(a - {3 * SEC}, {LO}) AS s, least(b + {3 * SEC}, {HI}) AS e FROM o WHERE b > a)
 SELECT user_id, s, e FROM ({_isl('SELECT * FROM g')}) WHERE e - s >= {8 * SEC}""",
    "elementary_segments_multiplicity": f"""SELECT user_id, s, e, multiplicity FROM (SELECT user_id, t AS s, lead(t) OVER w AS e, CAST(sum(d) OVER w AS BIGINT) AS multiplicity FROM (
 SELECT user_id, t, sum(d) AS d FROM (SELECT user_id, s AS t, 1 AS d FROM ({_sp(HOUR)}) UNION ALL SELECT user_id, e, -1 FROM ({_sp(HOUR)})) GROUP BY user_id, t)
 WINDOW w AS (PARTITION BY user_id ORDER BY t)) WHERE multiplicity > 0 AND e IS NOT NULL""",
    "cross_family_agreements": f"""WITH x AS ({_sp(TEN_MIN)}), o AS (SELECT DISTINCT a.user_id, greatest(a.s, b.s) AS s, least(a.e, b.e) AS e FROM x a JOIN x b ON a.user_id = b.user_id AND a.s < b.e AND b.s < a.e
 WHERE a.event_type IN ('view', 'click') AND b.event_type NOT IN ('view', 'click') AND least(a.e, b.e) - greatest(a.s, b.s) >= {300 * SEC})
 SELECT user_id, count(*) AS agreements, count(*) >= 2 AND max(s) - min(s) >= {HOUR} AS separated FROM o GROUP BY user_id""",
    "starts_in_span": f"""WITH x AS ({_sp(HOUR)}) SELECT p.user_id, q.event_id AS span_id, count(*) AS points FROM x p JOIN x q ON p.user_id = q.user_id AND p.s >= q.s AND p.s < q.e
 WHERE q.event_type = 'purchase' GROUP BY p.user_id, q.event_id""",
    "asof_backward": f"WITH {_VC} SELECT user_id, click_id, view_id FROM ({_BACK})",
    "asof_forward": f"WITH {_VC} SELECT user_id, click_id, view_id FROM ({_FORE})",
    "nearest_occurrence": f"""WITH {_VC}, b AS ({_BACK}), f AS ({_FORE}) SELECT b.user_id, b.click_id,
 CASE WHEN coalesce(b.t - b.vt <= f.vt - b.t, b.view_id IS NOT NULL) THEN b.view_id ELSE f.view_id END AS view_id,
 CASE WHEN coalesce(b.t - b.vt <= f.vt - b.t, b.view_id IS NOT NULL) THEN b.t - b.vt ELSE f.vt - b.t END AS gap FROM b JOIN f USING (click_id)""",
    "runs_with_core": f"SELECT user_id, s, e, n FROM ({_isl(_sp(TEN_MIN), gap=f's - pe >= {HOUR}')}) WHERE e - s >= {2 * TEN_MIN}",
    "offset_mode": """WITH x AS (SELECT user_id, CAST(round(value) AS BIGINT) AS v FROM events),
 c AS (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY v RANGE BETWEEN CURRENT ROW AND 100 FOLLOWING) AS k, count(*) OVER (PARTITION BY user_id) AS total FROM x),
 b AS (SELECT user_id, v AS lo, k, total FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY k DESC, v) AS r FROM c) WHERE r = 1 AND 2 * k >= total),
 m AS (SELECT user_id, k, total, list(v ORDER BY v) AS l FROM x JOIN b USING (user_id) WHERE v BETWEEN lo AND lo + 100 GROUP BY ALL),
 d AS (SELECT *, CASE WHEN k % 2 = 1 THEN l[k // 2 + 1] ELSE (l[k // 2] + l[k // 2 + 1] + 1) // 2 END AS mid FROM m)
 SELECT user_id, mid - 7 AS anchor, greatest(list_max(list_transform(l, lambda x: abs(x - mid))), 20) AS uncertainty, k AS support, total FROM d""",
    "hint_clusters": f"SELECT user_id, s, e, n FROM ({_isl(_sp(HOUR, chr(101) + 'vent_type IN (' + chr(39) + 'view' + chr(39) + ', ' + chr(39) + 'purchase' + chr(39) + ')'), gap='s >= pe')})",
    "duration_partition": f"""WITH ev AS (SELECT user_id, event_type, s AS t, 1 AS d FROM ({_sp(HOUR)}) UNION ALL SELECT user_id, event_type, least(e, {HI}), -1 FROM ({_sp(HOUR)})),
 g AS (SELECT user_id, t, {", ".join(f"sum(CASE WHEN event_type = '{o}' THEN d ELSE 0 END) AS d{i}" for i, o in enumerate(_PART))} FROM ev GROUP BY user_id, t),
 seg AS (SELECT user_id, t, lead(t) OVER w AS u, {", ".join(f"sum(d{i}) OVER w AS c{i}" for i in range(5))} FROM g WINDOW w AS (PARTITION BY user_id ORDER BY t)),
 k AS (SELECT user_id, u - t AS n, CASE {" ".join(f"WHEN c{i} > 0 THEN '{o}'" for i, o in enumerate(_PART))} END AS cls FROM seg WHERE u IS NOT NULL)
 SELECT user_id, {", ".join(f"CAST(sum(CASE WHEN cls = '{o}' THEN n ELSE 0 END) AS BIGINT) AS {o}" for o in _PART)},
 CAST({HI - LO} - sum(CASE WHEN cls IS NULL THEN 0 ELSE n END) AS BIGINT) AS idle FROM k GROUP BY user_id""",
    "competing_candidates": f"""WITH i AS ({_isl(_sp(6 * HOUR), 'user_id, event_type')}), own AS (SELECT user_id, event_type, sum(e - s) AS own FROM i GROUP BY ALL),
 b AS (SELECT p.user_id, p.event_type, q.event_type AS o, sum(least(p.e, q.e) - greatest(p.s, q.s)) AS n FROM i p JOIN i q ON p.user_id = q.user_id AND p.event_type <> q.event_type AND p.s < q.e AND q.s < p.e GROUP BY ALL)
 SELECT own.user_id, own.event_type, CAST(own AS BIGINT) AS own, count(o) AS competing FROM own LEFT JOIN b ON own.user_id = b.user_id AND own.event_type = b.event_type AND 2 * n >= own GROUP BY ALL""",
    "window_schedule": f"""WITH d AS ({_DUR}), r AS (SELECT user_id, dur, unnest(range(0, dur - 1200 + 1, 900)) AS s FROM d WHERE dur > 1200)
 SELECT user_id, s AS start, s + 1200 AS "end", false AS is_tail FROM r UNION ALL SELECT user_id, dur - 1200, dur, true FROM d WHERE dur > 1200 AND (dur - 1200) % 900 <> 0
 UNION ALL SELECT user_id, 0, dur, false FROM d WHERE dur > 0 AND dur <= 1200""",
    "rescan_schedule": f"""WITH i AS ({_isl(_sp(HOUR))}), r AS (SELECT user_id, s, e, unnest(range(0, e - s - {1800 * SEC} + 1, {900 * SEC})) AS k FROM i)
 SELECT user_id, s, e, s + k AS w_start, s + k + {1800 * SEC} AS w_end, false AS is_tail FROM r
 UNION ALL SELECT user_id, s, e, e - {1800 * SEC}, e, true FROM i WHERE (e - s - {1800 * SEC}) % {900 * SEC} <> 0""",
    "transform_grid": f"""SELECT width, hop, phase, (dur - width - phase * hop // 2) // hop + 1 AS windows FROM (SELECT max(dur) AS dur FROM ({_DUR})), (SELECT unnest([8, 10, 12]) AS width), (SELECT unnest([3, 6, 9]) AS hop), (SELECT unnest([0, 1]) AS phase)""",
    "every_nth": "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE (r - 1) % 3 = 0",
    "even_subsample": """WITH x AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events)
 SELECT user_id, event_id FROM x WHERE n <= 7 OR list_contains(list_transform(range(7), lambda i: i * n // 7), r)""",
    "largest_remainder": """WITH w AS (SELECT c_nationkey AS nation, count(*) AS w FROM customer GROUP BY 1), f AS (SELECT *, CAST(sum(w) OVER () AS BIGINT) AS t FROM w),
 g AS (SELECT *, w * 100 // t AS k, w * 100 % t AS r FROM f), h AS (SELECT *, 100 - sum(k) OVER () AS l, row_number() OVER (ORDER BY r DESC, nation) AS p FROM g)
 SELECT nation, w, CAST(k + (CASE WHEN p <= l THEN 1 ELSE 0 END) AS BIGINT) AS seats FROM h""",
    "independent_trials": f"""WITH RECURSIVE h AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY e, s, trial) AS r FROM (
 SELECT user_id, s // {HOUR // 2} AS trial, min(s) AS s, max(e) AS e, CASE WHEN bool_and(event_type = 'click') THEN 5000 ELSE 10000 END AS w FROM ({_sp(HOUR)}) GROUP BY ALL)),
 g AS (SELECT user_id, 1::BIGINT AS r FROM h WHERE r = 1 UNION ALL SELECT g.user_id, (SELECT min(n.r) FROM h n WHERE n.user_id = g.user_id AND n.s >= c.e) FROM g JOIN h c ON c.user_id = g.user_id AND c.r = g.r
 WHERE EXISTS (SELECT 1 FROM h n WHERE n.user_id = g.user_id AND n.s >= c.e))
 SELECT user_id, CAST(sum(w) AS BIGINT) AS trials_e4 FROM g JOIN h USING (user_id, r) GROUP BY user_id""",
    "budget_plan": """WITH RECURSIVE o AS (SELECT o_custkey, o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cost, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) OVER (PARTITION BY o_custkey) AS BIGINT) // 2 AS budget, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) AS r FROM orders),
 g AS (SELECT o_custkey, r, o_orderkey, cost, cost <= budget AS ok, budget - CASE WHEN cost <= budget THEN cost ELSE 0 END AS rest FROM o WHERE r = 1
 UNION ALL SELECT o.o_custkey, o.r, o.o_orderkey, o.cost, o.cost <= g.rest, g.rest - CASE WHEN o.cost <= g.rest THEN o.cost ELSE 0 END FROM g JOIN o ON o.o_custkey = g.o_custkey AND o.r = g.r + 1)
 SELECT o_custkey, o_orderkey, cost FROM g WHERE ok""",
    "occurrence_index": """SELECT user_id, event_id, CAST(row_number() OVER w - 1 AS INTEGER) AS occurrence, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS since FROM events
 WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)""",
}
