"""Query over corpus scores: users' even events are the truth, odd ones predictions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import corpus as co
from tidemark.plans import episodes as pe

HOUR = pe.HOUR


def q_scores(spark, d):
    """Scores of recordings, their strata, tiers, and all; the n-th prediction of
    a work in a recording meets its n-th true episode if they lie within a day."""
    w = pe.windows(spark, d).select(F.col("media").cast("string").alias("set"), F.concat(F.lit("s"), F.col("media") % 5).alias("stratum"), "id", "work", "s", "e", "candidate", "status")
    n = Window.partitionBy("set", "work").orderBy("s", "id")
    t, p = (w.where(c).withColumn("n", F.row_number().over(n)) for c in ("id % 2 = 0", "id % 2 = 1"))
    pairs = p.alias("p").join(t.alias("t"), ["set", "work", "n"]).where(F.abs(F.col("p.s") - F.col("t.s")) <= 24 * HOUR).select("set", F.col("p.id").alias("pred"), F.col("t.id").alias("truth"))
    truth = t.select("set", "stratum", "id", "work", "s", "e", (F.col("s") - HOUR).alias("s_lo"), (F.col("s") + HOUR).alias("s_hi"), (F.col("e") - HOUR).alias("e_lo"), (F.col("e") + HOUR).alias("e_hi"), (F.col("n") > 1).alias("repeat"), (F.col("id") % 3 == 0).alias("overlapped"), (F.col("candidate") == "error").alias("component"))
    tier = F.when(F.col("id") % 4 == 1, "likely").when(F.col("id") % 3 == 0, "possible").otherwise("unclear")
    pred = p.select("set", "stratum", "id", "work", tier.alias("tier"), "s", "e", F.col("e").alias("start_bound"), F.col("s").alias("end_bound"), (F.col("status") == "error").alias("component"))
    out = co.scored(co.facts(truth, pred, pairs))
    names = {c: F.coalesce(c, F.lit("")) for c in ("set", "stratum", "tier")}
    return out.withColumns(names | {c: F.coalesce(c, F.lit(-1)) for c in out.columns if c.startswith(("macro_", "start_error", "end_error"))})


QUERIES = {"corpus_scores": q_scores}

_R = lambda a, b: f"CAST(CASE WHEN {b} > 0 THEN least(10000, (({a}) * 20000 + {b}) // (2 * ({b}))) ELSE 0 END AS BIGINT)"
_PRF = lambda n, r, p, t: f"{_R(r, p)} AS {n}_precision_e4, {_R(r, t)} AS {n}_recall_e4, {_R(f'2 * ({r})', f'({p} + {t})')} AS {n}_f1_e4"
_OUT = lambda x, lo, hi: f"CASE WHEN t.id IS NOT NULL THEN greatest({lo} - {x}, {x} - ({hi}), 0) END"
_KINDS = ", ".join(f"CAST(t.id IS NOT NULL AND (t.candidate = 'error') = {a} AND (p.status = 'error') = {b} AS INT) AS {'component' if a == 'true' else 'performed'}_as_{'component' if b == 'true' else 'performed'}" for a in ("false", "true") for b in ("false", "true"))
_FACT = lambda cols: ", ".join(f"{cols.get(c, '0')} AS {c}" for c in co.COUNTS) + ", " + ", ".join(f"{cols.get(c, 'NULL')} AS {c}" for c in co.ERRORS)
_INNER = "greatest(0, least(p.e, t.e + {h}) - greatest(p.s, t.s - {h}))".format(h=HOUR)

ORACLE_SQL = {
    "corpus_scores": f"""WITH {pe._W}, x AS (SELECT CAST(media AS VARCHAR) AS set_, 's' || media % 5 AS stratum, id, work, s, e, candidate, status FROM w), t AS (SELECT *, row_number() OVER (PARTITION BY set_, work ORDER BY s, id) AS n FROM x WHERE id % 2 = 0), p AS (SELECT *, row_number() OVER (PARTITION BY set_, work ORDER BY s, id) AS n FROM x WHERE id % 2 = 1),
 j AS (SELECT p.set_, p.stratum, p.work AS pw, p.id AS pid, t.id AS tid, CASE WHEN p.id % 4 = 1 THEN 'likely' WHEN p.id % 3 = 0 THEN 'possible' ELSE 'unclear' END AS tier, 1 AS occurrence_predicted, CAST(t.id IS NOT NULL AS INT) AS occurrence_correct, CAST(coalesce(p.e < t.s - {HOUR}, false) AS INT) AS start_violations, CAST(coalesce(p.s > t.e + {HOUR}, false) AS INT) AS end_violations,
  coalesce({_R(_INNER, f"(p.e - p.s) + (t.e - t.s + {2 * HOUR}) - {_INNER}")}, 0) AS iou_e4, CAST(coalesce(t.n > 1, false) AS INT) AS repeat_correct, CAST(coalesce(t.id % 3 = 0, false) AS INT) AS overlap_correct, {_OUT('p.s', f't.s - {HOUR}', f't.s + {HOUR}')} AS start_error, {_OUT('p.e', f't.e - {HOUR}', f't.e + {HOUR}')} AS end_error, {_KINDS}
  FROM p LEFT JOIN t ON t.set_ = p.set_ AND t.work = p.work AND t.n = p.n AND abs(p.s - t.s) <= {24 * HOUR}),
 ev AS (SELECT set_, stratum, work, s AS tp, 1 AS l, 0 AS r FROM p UNION ALL SELECT set_, stratum, work, e, -1, 0 FROM p UNION ALL SELECT set_, stratum, work, s - {HOUR}, 0, 1 FROM t UNION ALL SELECT set_, stratum, work, e + {HOUR}, 0, -1 FROM t), eg AS (SELECT set_, stratum, work, tp, sum(l) AS l, sum(r) AS r FROM ev GROUP BY ALL),
 es AS (SELECT set_, stratum, lead(tp) OVER v - tp AS n, sum(l) OVER v AS l, sum(r) OVER v AS r FROM eg WINDOW v AS (PARTITION BY set_, work ORDER BY tp)), tm AS (SELECT set_, stratum, sum(CASE WHEN l > 0 AND r > 0 THEN n ELSE 0 END) AS tp, sum(CASE WHEN l > 0 AND r = 0 THEN n ELSE 0 END) AS fp, sum(CASE WHEN l = 0 AND r > 0 THEN n ELSE 0 END) AS fn FROM es GROUP BY ALL),
 f AS (SELECT set_, stratum, tier, {_FACT({c: c for c in ("occurrence_predicted", "occurrence_correct", "start_violations", "end_violations", "iou_e4", "repeat_correct", "overlap_correct", *co.ERRORS, *co.COUNTS[-4:])})} FROM j
  UNION ALL SELECT set_, stratum, NULL, {_FACT({"occurrence_truth": "1", "repeat_truth": "CAST(n > 1 AS INT)", "overlap_truth": "CAST(id % 3 = 0 AS INT)"})} FROM t
  UNION ALL SELECT set_, stratum, NULL, {_FACT({"work_predicted": "1", "work_correct": "c"})} FROM (SELECT set_, stratum, pw, max(occurrence_correct) AS c FROM j GROUP BY ALL)
  UNION ALL SELECT set_, stratum, NULL, {_FACT({"work_truth": "1"})} FROM (SELECT DISTINCT set_, stratum, work FROM t)
  UNION ALL SELECT set_, stratum, NULL, {_FACT({"tp_ms": "tp", "fp_ms": "fp", "fn_ms": "fn"})} FROM tm),
 a AS (SELECT grouping_id(set_, stratum, tier) AS g, set_, stratum, tier, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in co.COUNTS)}, {', '.join(f'CAST(quantile_disc({c}, {q}) AS BIGINT) AS {c}_p{int(100 * q)}' for c in co.ERRORS for q in (0.5, 0.9))} FROM f GROUP BY GROUPING SETS ((set_, stratum), (stratum), (tier), ())),
 b AS (SELECT CASE g WHEN 1 THEN 'set' WHEN 5 THEN 'stratum' WHEN 6 THEN 'tier' ELSE 'overall' END AS level, * EXCLUDE (g), {_PRF('work', 'work_correct', 'work_predicted', 'work_truth')}, {_PRF('occurrence', 'occurrence_correct', 'occurrence_predicted', 'occurrence_truth')}, {_PRF('segment', 'tp_ms', '(tp_ms + fp_ms)', '(tp_ms + fn_ms)')},
  {_R('repeat_correct', 'repeat_truth')} AS repeat_recall_e4, {_R('overlap_correct', 'overlap_truth')} AS overlap_recall_e4, CASE WHEN occurrence_truth > 0 THEN iou_e4 // occurrence_truth ELSE 0 END AS mean_iou_e4 FROM a WHERE g <> 6 OR tier IS NOT NULL),
 mc AS (SELECT CASE WHEN grouping(stratum) = 1 THEN 'overall' ELSE 'stratum' END AS level, stratum, CAST(sum(segment_precision_e4) // count(*) AS BIGINT) AS macro_segment_precision_e4, CAST(sum(segment_recall_e4) // count(*) AS BIGINT) AS macro_segment_recall_e4 FROM b WHERE level = 'set' GROUP BY GROUPING SETS ((stratum), ()))
 SELECT b.* EXCLUDE (set_) REPLACE (coalesce(b.stratum, '') AS stratum, coalesce(tier, '') AS tier, {', '.join(f'coalesce({c}_p{n}, -1) AS {c}_p{n}' for c in co.ERRORS for n in (50, 90))}), coalesce(set_, '') AS "set", coalesce(macro_segment_precision_e4, -1) AS macro_segment_precision_e4, coalesce(macro_segment_recall_e4, -1) AS macro_segment_recall_e4 FROM b LEFT JOIN mc ON mc.level = b.level AND mc.stratum IS NOT DISTINCT FROM b.stratum""",
}
