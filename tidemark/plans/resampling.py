"""Queries over bootstrap bounds."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import resampling as rs
from tidemark.runtime import read_table


def _judged(spark, d):
    """Labelled documents with two rules' guesses; a source in a language is a cluster."""
    docs = read_table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    s = docs.join(read_table(spark, d, "labels"), "doc_id").withColumn("c", F.concat_ws("/", "lang", "source"))
    first, second = (F.col("n_chars") >= n for n in (400, 800))
    good = F.col("quality") == 1
    return s.select("c", "lang", "quality", *(x.cast("long").alias(n) for n, x in (("g0", first & good), ("n0", first), ("g1", second & good), ("n1", second))))


def q_bounds(spark, d):
    """Precision and recall of a rule over languages, with bounds by sources."""
    return rs.share_bounds(_judged(spark, d), "c", {"precision": ("g0", "n0"), "recall": ("g0", "quality")}, ["lang"])


def q_paired(spark, d):
    """What the second rule's precision has over the first one's."""
    return rs.paired_difference(_judged(spark, d), "c", ("g0", "n0"), ("g1", "n1"))


def q_p90(spark, d):
    """Delays of two halves of lines by supplier, as errors of two arms."""
    li = read_table(spark, d, "lineitem").select("l_suppkey", "l_returnflag", F.round(F.col("l_extendedprice") / 1000).cast("long").alias("err"))
    return rs.paired_p90(li.where("l_returnflag = 'N'"), li.where("l_returnflag = 'R'"), "l_suppkey", "err", 200)


def q_events(spark, d):
    """Kinds of users' events found within bounds of their values."""
    e = read_table(spark, d, "events")
    found, true = F.col("value") >= 30, F.col("event_id") % 3 != 0
    return rs.event_bounds(e.select("user_id", "event_type", *(x.cast("long").alias(n) for n, x in (("m", found & true), ("p", found), ("t", true)))), "user_id", "event_type", "m", "p", "t")


QUERIES = {"precision_bounds": q_bounds, "paired_difference": q_paired, "paired_p90": q_p90, "event_bounds": q_events}

_W = lambda c: "(" + " + ".join(f"CAST(h >= {t} AS BIGINT)" for t in rs.thresholds()) + f") AS w FROM (SELECT *, CAST('0x' || substr(md5('{rs.SEED}|' || r || '|' || {c}), 1, 8) AS BIGINT) AS h"
_S = lambda a, b: f"CASE WHEN {b} > 0 THEN {a} * 10000 // {b} ELSE 0 END"
_J = "j AS (SELECT lang || '/' || source AS c, lang, CAST(quality AS BIGINT) AS quality, CAST(n_chars >= 400 AND quality = 1 AS BIGINT) AS g0, CAST(n_chars >= 400 AS BIGINT) AS n0, CAST(n_chars >= 800 AND quality = 1 AS BIGINT) AS g1, CAST(n_chars >= 800 AS BIGINT) AS n1 FROM documents JOIN labels USING (doc_id))"


def _low(n: int, of: str) -> str:
    return f"list_sort(list({of}))[{rs._place(rs.LOWER, n) + 1}]"


ORACLE_SQL = {
    "precision_bounds": f"""WITH {_J}, o AS (SELECT lang, c, sum(g0) AS g, sum(n0) AS n, sum(quality) AS q FROM j GROUP BY ALL), w AS (SELECT *, {_W('c')} FROM o, range({rs.REPLICATES}) AS x(r))),
 s AS (SELECT lang, r, sum(w * g) AS g, sum(w * n) AS n, sum(w * q) AS q FROM w GROUP BY ALL), b AS (SELECT lang, {_low(rs.REPLICATES, _S('g', 'n'))} AS p, {_low(rs.REPLICATES, _S('g', 'q'))} AS q FROM s GROUP BY lang)
 SELECT lang, count(*) AS clusters, CAST({_S('sum(g)', 'sum(n)')} AS BIGINT) AS precision_e4, CAST({_S('sum(g)', 'sum(o.q)')} AS BIGINT) AS recall_e4, CAST(max(p) AS BIGINT) AS precision_lower_e4, CAST(max(b.q) AS BIGINT) AS recall_lower_e4 FROM o JOIN b USING (lang) GROUP BY lang""",
    "paired_difference": f"""WITH {_J}, o AS (SELECT c, sum(g0) AS g0, sum(n0) AS n0, sum(g1) AS g1, sum(n1) AS n1 FROM j GROUP BY c), w AS (SELECT *, {_W('c')} FROM o, range({rs.REPLICATES}) AS x(r))),
 s AS (SELECT r, sum(w * g0) AS g0, sum(w * n0) AS n0, sum(w * g1) AS g1, sum(w * n1) AS n1 FROM w GROUP BY r), b AS (SELECT {_low(rs.REPLICATES, _S('g1', 'n1') + ' - (' + _S('g0', 'n0') + ')')} AS low FROM s)
 SELECT count(*) AS clusters, CAST({_S('sum(g1)', 'sum(n1)')} - ({_S('sum(g0)', 'sum(n0)')}) AS BIGINT) AS delta_e4, CAST(max(low) AS BIGINT) AS lower_bound_e4, max(low) >= -100 AS no_worse FROM o, b""",
    "paired_p90": f"""WITH v AS (SELECT CAST(l_suppkey AS VARCHAR) AS c, CAST(l_returnflag = 'R' AS INT) AS arm, CAST(round(l_extendedprice / 1000) AS BIGINT) AS value, count(*) AS n FROM lineitem WHERE l_returnflag IN ('N', 'R') GROUP BY ALL),
 k AS (SELECT c FROM v GROUP BY c HAVING count(DISTINCT arm) = 2), d AS (SELECT c, r, CASE WHEN r < 0 THEN 1 ELSE w END AS w FROM (SELECT *, {_W('c')} FROM k, range(-1, 200) AS x(r)))),
 p AS (SELECT r, arm, value, sum(n * w) AS n FROM v JOIN d USING (c) WHERE w > 0 GROUP BY ALL), u AS (SELECT *, sum(n) OVER (PARTITION BY r, arm ORDER BY value) AS upto, sum(n) OVER (PARTITION BY r, arm) AS total FROM p),
 q AS (SELECT r, arm, min(value) AS value FROM u WHERE 100 * upto >= 90 * total GROUP BY ALL), g AS (SELECT r, max(value) FILTER (arm = 0) AS b, max(value) FILTER (arm = 1) AS a FROM q GROUP BY r),
 i AS (SELECT r, b, a, CASE WHEN b > 0 THEN CAST(floor((b - a) * 10000 / b) AS BIGINT) ELSE 0 END AS gain FROM g)
 SELECT (SELECT count(*) FROM k) AS clusters, max(b) FILTER (r < 0) AS before, max(a) FILTER (r < 0) AS after, max(gain) FILTER (r < 0) AS improvement_e4, list_sort(list_concat(list(gain) FILTER (r >= 0), list_resize([]::BIGINT[], 200 - count(*) FILTER (r >= 0), 0)))[{rs._place(rs.LOWER, 200) + 1}] AS lower_bound_e4 FROM i""",
    "event_bounds": f"""WITH j AS (SELECT user_id, event_type, CAST(value >= 30 AND event_id % 3 <> 0 AS BIGINT) AS m, CAST(value >= 30 AS BIGINT) AS p, CAST(event_id % 3 <> 0 AS BIGINT) AS t FROM events), o AS (SELECT event_type, user_id, sum(m) AS m, sum(p) AS p, sum(t) AS t FROM j GROUP BY ALL),
 w AS (SELECT *, {_W('user_id')} FROM o, range({rs.REPLICATES}) AS x(r))), s AS (SELECT event_type, r, sum(w * m) AS m, sum(w * p) AS p, sum(w * t) AS t FROM w GROUP BY ALL), b AS (SELECT event_type, {_low(rs.REPLICATES, _S('m', 'p'))} AS lp, {_low(rs.REPLICATES, _S('m', 't'))} AS lr FROM s GROUP BY event_type)
 SELECT event_type, CAST(sum(t) AS BIGINT) AS n_truth, CAST(sum(p) AS BIGINT) AS n_predicted, CAST(sum(m) AS BIGINT) AS n_matched, CAST({_S('sum(m)', 'sum(p)')} AS BIGINT) AS precision_e4, CAST({_S('sum(m)', 'sum(t)')} AS BIGINT) AS recall_e4, CAST(max(lp) AS BIGINT) AS precision_lower_e4, CAST(max(lr) AS BIGINT) AS recall_lower_e4 FROM o JOIN b USING (event_type) GROUP BY event_type""",
}
