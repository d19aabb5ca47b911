"""Votes, identity, scores, ledgers and labels over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import labels as lb
from tidemark.functions.exact import half_up, ratio_e4
from tidemark.operators import evidence as ev
from tidemark.operators.graph import connected_components
from tidemark.plans.intervals import HOUR, _sp, supports
from tidemark.runtime import read_table


def q_majority(spark, d):
    return ev.majority(read_table(spark, d, "lineitem").select("l_suppkey", "l_shipdate", "l_returnflag", F.col("l_linenumber").alias("candidate")), ["l_suppkey"], "candidate")


def q_hulls(spark, d):
    return ev.trial_hulls(supports(spark, d).withColumn("trial", F.floor(F.col("s") / HOUR)), ["user_id"], "trial", "event_type", "s", "e").withColumn("providers", F.concat_ws(",", "providers"))


def q_discounted(spark, d):
    n = read_table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("votes"))
    return ev.discounted(n, ["user_id"], "event_type", "votes", ["click", "purchase", "view"])


def _edges(spark, d):
    li = read_table(spark, d, "lineitem")
    return li.select(F.col("l_partkey").alias("a"), (F.col("l_suppkey") + 1_000_000_000).alias("b"))


def _sizes(components):
    """Groups of copies, named by the hash of their sorted members."""
    members = F.array_sort(F.collect_list("node"))
    return components.groupBy("component").agg(F.count("*").alias("members"), F.max("node").alias("last"), F.sha1(F.concat_ws("|", F.transform(members, lambda x: x.cast("string")))).alias("group_id"))


def q_components_all(spark, d):
    """The components of the links of every row."""
    return connected_components(_edges(spark, d))


def q_provenance_all(spark, d):
    """Size and smallest member of each component of all rows' copy edges."""
    return _sizes(connected_components(_edges(spark, d)))


def q_answered(spark, d):
    o, li = read_table(spark, d, "orders"), read_table(spark, d, "lineitem")
    return o.join(li.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi").groupBy("o_orderstatus").agg(F.count("*").alias("answered"))


def q_unpicked(spark, d):
    o, li = read_table(spark, d, "orders"), read_table(spark, d, "lineitem")
    return o.join(li.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti").select("o_orderkey", "o_orderstatus")


def _scored(spark, d):
    docs = read_table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(read_table(spark, d, "labels"), "doc_id").withColumn("guess", (F.col("n_chars") >= 400).cast("int"))


def q_prf(spark, d):
    return ev.prf(_scored(spark, d), ["lang"], F.col("guess"), F.col("quality"))


def q_prf_strata(spark, d):
    """Per language and source, per language, and over all."""
    g = _scored(spark, d).withColumn("tp", F.col("guess") * F.col("quality"))
    c = g.rollup("lang", "source").agg(F.sum("tp").alias("tp"), F.sum("guess").alias("predicted"), F.sum("quality").alias("actual"))
    return c.withColumn("recall_e4", ratio_e4(F.col("tp"), F.col("actual")))


def q_confusion(spark, d):
    return _scored(spark, d).groupBy("quality", "toxic", "guess").agg(F.count("*").alias("n"))


def q_quantiles(spark, d):
    x = read_table(spark, d, "events").select("event_type", F.floor(F.col("value") * 100).cast("long").alias("v"))
    return ev.quantiles(x, ["event_type"], "v", [(5, 100), (50, 100), (90, 100), (99, 100)])


def q_tiers(spark, d):
    t = F.when(F.col("n_chars") >= 3000, "verified").when(F.col("n_chars") >= 1500, "likely").otherwise("possible")
    return ev.tier_ladder(_scored(spark, d).withColumn("tier", t), [], "tier", F.col("quality"), ["verified", "likely", "possible"])


def q_isotonic(spark, d):
    b = _scored(spark, d).withColumn("bin", F.least(F.expr("n_chars div 300"), F.lit(20))).groupBy("lang", "bin").agg(F.sum("quality").alias("good"), F.count("*").alias("total"))
    return ev.isotonic(b, ["lang"], "bin", "good", "total")


def q_segment_scores(spark, d):
    """Views against clicks, the label of either being its user's hour of day."""
    k = ["user_id", "label", "s", "e"]
    hour = F.expr(f"s div {HOUR} % 24")
    p = supports(spark, d, HOUR, ["view", "error"]).withColumn("label", F.col("event_type")).select(*k)
    t = supports(spark, d, HOUR, ["view", "error"]).where("event_id % 3 <> 0").withColumn("label", F.when(hour % 5 == 0, "view").otherwise(F.col("event_type"))).select(*k)
    return ev.segment_confusion(p, t, ["user_id"], "label", "s", "e")


def q_ledger(spark, d):
    li = read_table(spark, d, "lineitem")
    event = F.when(F.col("l_linestatus") == "O", "prepared").otherwise("resolved")
    outcome = F.when(F.col("l_returnflag") == "R", "billed").otherwise("free")
    x = li.select(F.col("l_orderkey").alias("attempt"), event.alias("event"), outcome.alias("outcome"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("unit"), F.col("l_shipdate").alias("at"))
    return ev.ledger_fold(x, "attempt", "event", "outcome", "unit", "at")


def q_resume(spark, d):
    """What to do with each order's query, by its latest line as an attempt."""
    li = read_table(spark, d, "lineitem")
    ordinal = (F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_partkey")).alias("ordinal")
    outcome = F.when(F.col("l_linestatus") == "O", F.lit(None).cast("string")).otherwise(F.when(F.col("l_returnflag") == "R", "error").otherwise("match"))
    x = li.select("l_orderkey", ordinal, (F.col("l_quantity") > 10).alias("dispatched"), outcome.alias("outcome"), (F.col("l_discount") > 0.02).alias("reusable"))
    out = ev.resume(x, ["l_orderkey"], "ordinal", "dispatched", "outcome", "reusable", ["match"])
    return read_table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey")).join(out, "l_orderkey", "left").select("l_orderkey", F.coalesce("action", F.lit("fresh")).alias("action"))


def q_usage(spark, d):
    """Requests and billed cents per provider, egress and UTC day."""
    li = read_table(spark, d, "lineitem")
    unit = F.round(F.col("l_extendedprice") * 100).cast("long")
    return li.groupBy("l_suppkey", (F.col("l_partkey") % 4).alias("egress"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("requests"), F.sum(F.when(F.col("l_returnflag") == "R", unit).otherwise(0)).alias("billed"))


def q_depth(spark, d):
    return ev.zero_filled(read_table(spark, d, "orders").select("o_orderpriority", F.col("o_orderstatus").alias("state")), ["o_orderpriority"], "state", ["F", "O", "P", "X"])


def q_settlement(spark, d):
    """One row an invocation: money as the running maximum, the rest from its last update."""
    c = F.round(F.col("l_extendedprice") * 100).cast("long")
    x = read_table(spark, d, "lineitem").select("l_orderkey", (F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_partkey")).alias("seq"), "l_returnflag", c.alias("reserved"), (c - F.col("l_partkey") * 100).alias("spent"))
    return ev.settled(x, ["l_orderkey"], "seq", ["reserved", "spent"], ["l_returnflag"])


def q_breaker(spark, d):
    """Failures of each user's trailing day, as of a provider's and egress's calls."""
    x = supports(spark, d).select("user_id", "event_id", "s", "event_type")
    out = ev.failure_windows(x, ["user_id"], "s", F.col("event_type") == "error", 24 * HOUR, 4, 30)
    return out.select("event_id", "samples", "failures", "trips")


def q_heard(spark, d):
    return ev.heard_shares(read_table(spark, d, "embeddings"), "vec_id", "embedding")


def q_rounding(spark, d):
    li = read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.col("l_extendedprice") * 100).cast("long").alias("c"), F.col("l_quantity").cast("long").alias("q"))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", half_up(F.col("c") - 3_000_000, F.col("q")).alias("unit"), ratio_e4(F.col("q"), F.lit(37).cast("long")).alias("share_e4"))


def q_near_spelling(spark, d):
    """Pairs of part-name words one edit apart: candidates share a word with one
    letter left out, so no all-pairs comparison."""
    w = read_table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("w")).union(read_table(spark, d, "nation").select(F.lower("n_name"))).where("length(w) >= 4").distinct()
    keys = F.array_union(F.array("w"), F.transform(F.sequence(F.lit(1), F.length("w")), lambda i: F.concat(F.substring("w", F.lit(1), i - 1), F.substring("w", i + 1, F.length("w")))))
    k = w.select("w", F.explode(keys).alias("k"))
    p = k.withColumnRenamed("w", "a").join(k.withColumnRenamed("w", "b"), "k").where("a < b").select("a", "b").distinct()
    return p.where(lb.near_spelling(F.col("a"), F.col("b")))


def q_reply_parent(spark, d):
    """Each assistant turn with the nearest earlier user turn of its conversation
    at most three turns back (a sure reply), else with the only user who is
    mentioned, being another turn's first word (a likely one)."""
    c = read_table(spark, d, "conversations").groupBy("conv_id", "turn").agg(F.max("role").alias("role"), F.max("text").alias("text"))
    p = F.expr("max(case when role = 'user' then turn end) over (partition by conv_id order by turn range between 3 preceding and 1 preceding)")
    said = F.lower(F.regexp_extract("text", r"^([a-zA-Z]+)", 1))
    r = c.withColumns({"parent": p, "_w": said})
    users = r.where("role = 'user' and _w <> ''").select("conv_id", F.col("turn").alias("_t"), F.col("_w").alias("_u"))
    open_ = r.where("role = 'assistant' and parent is null").select("conv_id", "turn", "_w")
    only = open_.join(users, "conv_id").where("_w = _u and _t < turn").groupBy("conv_id", "turn").agg(F.count("*").alias("n"), F.min("_t").alias("_p")).where("n = 1")
    out = r.where("role = 'assistant'").join(only, ["conv_id", "turn"], "left")
    sure = F.when(F.col("parent").isNotNull(), 9500).when(F.col("_p").isNotNull(), 8000).otherwise(0)
    return out.select("conv_id", "turn", F.coalesce("parent", "_p", F.lit(-1).cast("long")).alias("parent"), sure.alias("confidence"))


def q_words(spark, d):
    """Shared words of part names and brands' types, in ten-thousandths."""
    p = read_table(spark, d, "part").select("p_partkey", F.split(lb.ascii_fold(F.col("p_name")), " ").alias("a"), F.split(lb.ascii_fold(F.col("p_type")), " ").alias("b"))
    return p.select("p_partkey", lb.jaccard_e4(F.col("a"), F.col("b")).alias("jaccard_e4"))


def q_theil_sen(spark, d):
    """A line through each user's values over minutes."""
    x = read_table(spark, d, "events").select("user_id", F.expr("unix_micros(ts) div 60000000").alias("t"), "value")
    r = ev.theil_sen(x, ["user_id"], "t", "value")
    return r.select("user_id", F.round("slope", 9).alias("slope"), F.round("intercept", 2).alias("intercept"), F.round("residual", 2).alias("residual"))


def q_clopper(spark, d):
    n = _scored(spark, d).groupBy("lang").agg(F.sum("quality").alias("k"), F.count("*").alias("n"))
    return n.select("lang", "k", "n", ev.clopper_pearson_e4(F.col("k"), F.col("n")).alias("lower_e4"))


def q_fold(spark, d):
    return read_table(spark, d, "nation").select("n_nationkey", lb.display_fold("n_name").alias("shown"), lb.score_fold("n_name").alias("scored"))


QUERIES = {
    "majority_trial_selection": q_majority,
    "trial_hulls": q_hulls,
    "second_engine_discount": q_discounted,
    "connected_components_all": q_components_all,
    "provenance_groups_all": q_provenance_all,
    "answered_windows": q_answered,
    "unpicked_windows": q_unpicked,
    "precision_recall": q_prf,
    "precision_recall_strata": q_prf_strata,
    "confusion": q_confusion,
    "order_statistics": q_quantiles,
    "tier_ladder": q_tiers,
    "isotonic_bins": q_isotonic,
    "segment_tp_fp_fn": q_segment_scores,
    "ledger_fold": q_ledger,
    "resume_action": q_resume,
    "provider_usage": q_usage,
    "queue_depth_zero_filled": q_depth,
    "monotonic_settlement": q_settlement,
    "breaker_window_counts": q_breaker,
    "heard_shares_fusion": q_heard,
    "exact_rounding": q_rounding,
    "near_spelling_pairs": q_near_spelling,
    "reply_parent": q_reply_parent,
    "word_set_match": q_words,
    "theil_sen": q_theil_sen,
    "clopper_pearson": q_clopper,
    "label_folding": q_fold,
}

_R4 = lambda n, d: f"CASE WHEN {d} > 0 THEN least(10000, ({n} * 20000 + {d}) // (2 * {d})) ELSE 0 END"
_SC = "(SELECT doc_id, lang, source, n_chars, quality, toxic, CASE WHEN n_chars >= 400 THEN 1 ELSE 0 END AS guess FROM documents JOIN labels USING (doc_id))"
def _at(index: str) -> str:
    return f"min(CASE WHEN k > ({index}) THEN v END)"


ORACLE_SQL = {
    "majority_trial_selection": """WITH n AS (SELECT l_suppkey, l_linenumber AS candidate, count(*) AS votes FROM lineitem GROUP BY 1, 2)
 SELECT l_suppkey, candidate, votes, CAST(total AS BIGINT) AS total FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY votes DESC, candidate) AS r, sum(votes) OVER (PARTITION BY l_suppkey) AS total FROM n) WHERE r = 1""",
    "trial_hulls": f"""SELECT user_id, s // {HOUR} AS trial, min(s) AS s, max(e) AS e, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS providers FROM ({_sp(600_000_000)}) GROUP BY user_id, s // {HOUR}""",
    "second_engine_discount": "SELECT user_id, event_type, votes FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, event_type) AS r FROM (SELECT user_id, event_type, count(*) AS votes FROM events WHERE event_type IN ('click', 'purchase', 'view') GROUP BY 1, 2)) WHERE r > 1",
    "answered_windows": "SELECT o_orderstatus, count(*) AS answered FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) GROUP BY 1",
    "unpicked_windows": "SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)",
    "precision_recall": f"""SELECT lang, CAST(tp AS BIGINT) AS tp, CAST(p AS BIGINT) AS predicted, CAST(t AS BIGINT) AS actual, CAST({_R4("tp", "p")} AS BIGINT) AS precision_e4, CAST({_R4("tp", "t")} AS BIGINT) AS recall_e4, CAST({_R4("2 * tp", "(p + t)")} AS BIGINT) AS f1_e4
 FROM (SELECT lang, sum(guess * quality) AS tp, sum(guess) AS p, sum(quality) AS t FROM {_SC} GROUP BY lang)""",
    "precision_recall_strata": f"""SELECT lang, source, CAST(tp AS BIGINT) AS tp, CAST(p AS BIGINT) AS predicted, CAST(t AS BIGINT) AS actual, CAST({_R4("tp", "t")} AS BIGINT) AS recall_e4
 FROM (SELECT lang, source, sum(guess * quality) AS tp, sum(guess) AS p, sum(quality) AS t FROM {_SC} GROUP BY ROLLUP (lang, source))""",
    "confusion": f"SELECT quality, toxic, guess, count(*) AS n FROM {_SC} GROUP BY 1, 2, 3",
    "order_statistics": f"""WITH x AS (SELECT event_type, CAST(floor(value * 100) AS BIGINT) AS v FROM events), o AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY v) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM x)
 SELECT event_type, max(n) AS n, {", ".join(f"{_at(f'greatest((n * {p} + 99) // 100 - 1, 0)')} AS nr_{p}, {_at(f'least(n - 1, n * {p} // 100)')} AS tr_{p}" for p in (5, 50, 90, 99))},
 {_at("(n - 1) // 2")} AS median_low, {_at("(n - 1) // 2")} + {_at("n // 2")} AS median_x2 FROM o GROUP BY event_type""",
    "tier_ladder": f"""WITH t AS (SELECT CASE WHEN n_chars >= 3000 THEN 1 WHEN n_chars >= 1500 THEN 2 ELSE 3 END AS l, quality FROM {_SC}), c AS (SELECT m, sum(quality) AS k, count(*) AS n FROM t, (SELECT unnest([1, 2, 3]) AS m) WHERE l <= m GROUP BY m)
 SELECT ['verified', 'likely', 'possible'][m] AS tier, CAST(k AS BIGINT) AS correct, n AS total, CAST({_R4("k", "n")} AS BIGINT) AS precision_e4 FROM c""",
    "isotonic_bins": f"""WITH b AS (SELECT lang, least(n_chars // 300, 20) AS bin, sum(quality) AS g, count(*) AS t FROM {_SC} GROUP BY 1, 2),
 m AS (SELECT lo.lang, lo.bin AS l, hi.bin AS h, (SELECT sum(g) / sum(t) FROM b WHERE b.lang = lo.lang AND b.bin BETWEEN lo.bin AND hi.bin) AS m FROM b lo JOIN b hi ON lo.lang = hi.lang AND lo.bin <= hi.bin)
 SELECT lang, bin, CAST(floor(max(x) * 10000 + 1e-9) AS BIGINT) AS fit_e4 FROM (SELECT b.lang, b.bin, l, min(m) AS x FROM b JOIN m ON b.lang = m.lang AND l <= b.bin AND h >= b.bin GROUP BY ALL) GROUP BY lang, bin""",
    "segment_tp_fp_fn": f"""WITH v AS ({_sp(HOUR, "event_type IN ('view', 'error')")}), p AS (SELECT user_id, event_type AS label, s, e FROM v), q AS (SELECT user_id, CASE WHEN s // {HOUR} % 24 % 5 = 0 THEN 'view' ELSE event_type END AS label, s, e FROM v WHERE event_id % 3 <> 0),
 ev AS (SELECT user_id, label, s AS t, 1 AS l, 0 AS r FROM p UNION ALL SELECT user_id, label, e, -1, 0 FROM p UNION ALL SELECT user_id, label, s, 0, 1 FROM q UNION ALL SELECT user_id, label, e, 0, -1 FROM q),
 g AS (SELECT user_id, label, t, sum(l) AS l, sum(r) AS r FROM ev GROUP BY ALL), x AS (SELECT user_id, lead(t) OVER w - t AS n, sum(l) OVER w AS l, sum(r) OVER w AS r FROM g WINDOW w AS (PARTITION BY user_id, label ORDER BY t))
 SELECT user_id, CAST(sum(CASE WHEN l > 0 AND r > 0 THEN n ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN l > 0 AND r = 0 THEN n ELSE 0 END) AS BIGINT) AS fp, CAST(sum(CASE WHEN l = 0 AND r > 0 THEN n ELSE 0 END) AS BIGINT) AS fn FROM x GROUP BY user_id""",
    "ledger_fold": """WITH x AS (SELECT DISTINCT l_orderkey AS attempt, CASE WHEN l_linestatus = 'O' THEN 'prepared' ELSE 'resolved' END AS event, CASE WHEN l_returnflag = 'R' THEN 'billed' ELSE 'free' END AS outcome, CAST(round(l_extendedprice * 100) AS BIGINT) AS unit, l_shipdate FROM lineitem),
 p AS (SELECT attempt, event, count(*) AS n, max(outcome) AS outcome, max(unit) AS unit FROM x GROUP BY 1, 2)
 SELECT attempt, bool_or(event <> 'prepared') AS dispatched, max(CASE WHEN event = 'resolved' THEN outcome END) AS outcome, max(CASE WHEN event = 'resolved' AND outcome = 'billed' THEN unit ELSE 0 END) AS spent, max(n) > 1 AS conflict FROM p GROUP BY attempt""",
    "resume_action": """WITH x AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey AS ordinal, l_quantity > 10 AS d, CASE WHEN l_linestatus = 'O' THEN NULL WHEN l_returnflag = 'R' THEN 'error' ELSE 'match' END AS o, l_discount > 0.02 AS r FROM lineitem),
 l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY ordinal DESC, d, coalesce(o, '') DESC, r) AS k FROM x) WHERE k = 1)
 SELECT o_orderkey AS l_orderkey, CASE WHEN ordinal IS NULL THEN 'fresh' WHEN NOT d THEN 'reissue' WHEN o IS NULL THEN 'ambiguous' WHEN o <> 'match' THEN 'retry' WHEN r THEN 'reuse' ELSE 'settled' END AS action FROM orders LEFT JOIN l ON o_orderkey = l_orderkey""",
    "provider_usage": "SELECT l_suppkey, l_partkey % 4 AS egress, strftime(l_shipdate, '%Y-%m-%d') AS day, count(*) AS requests, CAST(sum(CASE WHEN l_returnflag = 'R' THEN CAST(round(l_extendedprice * 100) AS BIGINT) ELSE 0 END) AS BIGINT) AS billed FROM lineitem GROUP BY 1, 2, 3",
    "queue_depth_zero_filled": """SELECT p AS o_orderpriority, s AS state, count(o_orderkey) AS depth FROM (SELECT DISTINCT o_orderpriority AS p FROM orders) CROSS JOIN (SELECT unnest(['F', 'O', 'P', 'X']) AS s) LEFT JOIN orders ON o_orderpriority = p AND o_orderstatus = s GROUP BY 1, 2""",
    "monotonic_settlement": """WITH x AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey AS seq, l_returnflag, CAST(round(l_extendedprice * 100) AS BIGINT) AS c, l_partkey FROM lineitem)
 SELECT l_orderkey, max(c) AS reserved, greatest(max(c - l_partkey * 100), 0) AS spent, arg_max(l_returnflag, (seq, l_returnflag)) AS l_returnflag, count(*) AS updates FROM x GROUP BY l_orderkey""",
    "breaker_window_counts": f"""SELECT event_id, samples, CAST(failures AS BIGINT) AS failures, samples >= 4 AND failures * 100 > samples * 30 AS trips FROM (SELECT event_id, count(*) OVER w AS samples, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER w AS failures
 FROM (SELECT *, epoch_us(ts) AS s FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY s RANGE BETWEEN {24 * HOUR - 1} PRECEDING AND CURRENT ROW))""",
    "heard_shares_fusion": """WITH q AS (SELECT vec_id, list_transform(embedding, lambda x: least(1.0::DOUBLE, greatest(0.0::DOUBLE, x::DOUBLE)) ** 2) AS q FROM embeddings), h AS (SELECT vec_id, q, list_sum(q) AS s FROM q),
 r AS (SELECT vec_id, list_transform(q, lambda x: round(x / s, 9)) AS h FROM h WHERE s > 0) SELECT vec_id, list_max(h) AS top, CAST(list_position(h, list_max(h)) - 1 AS BIGINT) AS place, CAST(len(list_filter(h, lambda x: x >= 0.1)) AS BIGINT) AS heard FROM r""",
    "exact_rounding": """WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(round(l_extendedprice * 100) AS BIGINT) - 3000000 AS c, CAST(l_quantity AS BIGINT) AS q FROM lineitem)
 SELECT l_orderkey, l_linenumber, l_partkey, CAST(sign(c) * ((2 * abs(c) + q) // (2 * q)) AS BIGINT) AS unit, CAST(least(10000, (q * 20000 + 37) // 74) AS BIGINT) AS share_e4 FROM x""",
    "near_spelling_pairs": """WITH w AS (SELECT DISTINCT w FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part UNION ALL SELECT lower(n_name) FROM nation) WHERE length(w) >= 4)
 SELECT x.w AS a, y.w AS b FROM w x JOIN w y ON x.w < y.w AND levenshtein(x.w, y.w) <= 1""",
    "theil_sen": """WITH x AS (SELECT user_id, event_id, epoch_us(ts) // 60000000 AS t, value AS y FROM events), s AS (SELECT a.user_id, median((b.y - a.y) / (b.t - a.t)) AS m FROM x a JOIN x b ON a.user_id = b.user_id AND a.event_id < b.event_id AND a.t <> b.t GROUP BY 1),
 i AS (SELECT user_id, m, median(y - m * t) AS c FROM x JOIN s USING (user_id) GROUP BY ALL) SELECT user_id, round(m, 9) AS slope, round(c, 2) AS intercept, round(max(abs(y - m * t - c)), 2) AS residual FROM x JOIN i USING (user_id) GROUP BY user_id, m, c""",
    "reply_parent": """WITH c AS (SELECT conv_id, turn, max(role) AS role, max(text) AS text FROM conversations GROUP BY 1, 2),
 r AS (SELECT *, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING) AS parent, lower(regexp_extract(text, '^([a-zA-Z]+)', 1)) AS w FROM c),
 o AS (SELECT a.conv_id, a.turn, min(u.turn) AS p FROM r a JOIN r u ON a.conv_id = u.conv_id AND a.w = u.w AND u.turn < a.turn WHERE a.role = 'assistant' AND a.parent IS NULL AND u.role = 'user' AND u.w <> '' GROUP BY 1, 2 HAVING count(*) = 1)
 SELECT r.conv_id, r.turn, coalesce(parent, p, -1) AS parent, CASE WHEN parent IS NOT NULL THEN 9500 WHEN p IS NOT NULL THEN 8000 ELSE 0 END AS confidence FROM r LEFT JOIN o ON r.conv_id = o.conv_id AND r.turn = o.turn WHERE role = 'assistant'""",
    "word_set_match": f"""WITH p AS (SELECT p_partkey, list_distinct(string_split(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')), ' ')) AS a, list_distinct(string_split(trim(regexp_replace(lower(p_type), '[^a-z0-9]+', ' ', 'g')), ' ')) AS b FROM part),
 n AS (SELECT p_partkey, len(list_intersect(a, b)) AS i, len(list_distinct(list_concat(a, b))) AS u FROM p) SELECT p_partkey, CAST({_R4("i", "u")} AS BIGINT) AS jaccard_e4 FROM n""",
}
