"""Queries over row rules and small aggregates."""

from __future__ import annotations


from pyspark.sql import functions as F

from tidemark.operators import rules as rl
from tidemark.operators import schedule as sc
from tidemark.plans.evidence import _SC, _scored
from tidemark.plans.intervals import HOUR, _sp, supports
from tidemark.runtime import read_table


def q_badges(spark, d):
    """Badges by tiers of work and version, and the scores of both tiers."""
    n = F.col("n_chars")
    tier = F.when(n >= 3000, "verified").when(n >= 1500, "likely").when(n >= 400, "possible").otherwise("unclear")
    x = _scored(spark, d).select(tier.alias("work"), F.when(F.col("quality") == 1, "verified").otherwise("possible").alias("version"))
    return x.groupBy("work", rl.badge(F.col("work"), F.col("version")).alias("badge"), rl.tier_score(F.col("work")).alias("score")).agg(F.count("*").alias("n"))


def q_run_status(spark, d):
    o = read_table(spark, d, "orders")
    li = read_table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("planned"), F.count(F.when(F.col("l_linestatus") == "F", 1)).alias("resolved"), F.max(F.col("l_returnflag") == "R").alias("failed"))
    s = rl.run_status(F.col("failed"), F.col("o_orderstatus") == "P", rl.achieved(F.col("resolved"), F.col("planned"), 50), F.col("planned") >= 3)
    return o.join(li, "o_orderkey").groupBy(s.alias("status")).agg(F.count("*").alias("orders"))


def q_retention(spark, d):
    x = read_table(spark, d, "orders").select("o_custkey", F.when(F.col("o_orderstatus") != "P", F.unix_micros("o_orderdate")).alias("due_us"))
    return rl.retention(x, ["o_custkey"], "due_us").withColumn("due", F.coalesce("due", F.lit(-1)))


def q_parent_share(spark, d):
    c = read_table(spark, d, "customer").join(read_table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rl.parent_share(c.select("c_mktsegment", "n_regionkey", F.lit(1).cast("long").alias("w")), ["c_mktsegment"], "n_regionkey", "w")


def q_separate(spark, d):
    return rl.separate_playing(supports(spark, d), supports(spark, d), ["user_id"], "event_type", "event_id", "s", "e")


def q_hosts(spark, d):
    return read_table(spark, d, "pages").groupBy(rl.host(F.col("url")).alias("host")).agg(F.count("*").alias("pages"))


def q_redacted(spark, d):
    t = read_table(spark, d, "documents").select("doc_id", "text")
    r = rl.redact(F.col("text"))
    return t.select("doc_id", (r != F.col("text")).alias("changed"), F.sha2(r, 256).alias("digest"))


def q_region_keys(spark, d):
    x = supports(spark, d, HOUR).select("user_id", "event_type", F.expr(f"s div {6 * HOUR}").alias("slot"))
    return x.withColumn("key", rl.region_key(F.col("user_id"), F.col("event_type"), F.col("slot"))).dropDuplicates(["key"])


def q_capacity(spark, d):
    x = supports(spark, d).groupBy("user_id").agg(F.expr("(max(s) - min(s)) div 1000").alias("ms"), F.count("*").alias("n"))
    clips, r = sc.capacity(F.col("ms"), 2), sc.reserved(F.col("n"), F.lit(5000).cast("long"), F.lit(40).cast("long"))
    return x.select("user_id", clips.alias("clips"), sc.reserve(clips, 1500).alias("held"), r["cents"].alias("cents"), r["allowed"].alias("allowed"))


def q_macro(spark, d):
    """Half-up mean over languages of recall in ten-thousandths."""
    from tidemark.functions.exact import half_up, ratio_e4

    r = _scored(spark, d).groupBy("lang").agg(F.sum(F.col("guess") * F.col("quality")).alias("tp"), F.sum("quality").alias("t"))
    r = r.select(ratio_e4(F.col("tp"), F.col("t")).alias("r"))
    return r.agg(half_up(F.sum("r"), F.count("*")).alias("macro_e4"))


def q_star(spark, d):
    """Revenue by region and segment through the star's joins."""
    li = read_table(spark, d, "lineitem").select("l_orderkey", (F.round(F.col("l_extendedprice") * 100).cast("long")).alias("c"))
    o, c = read_table(spark, d, "orders").select("o_orderkey", "o_custkey"), read_table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n, r = read_table(spark, d, "nation").select("n_nationkey", "n_regionkey"), read_table(spark, d, "region")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name", "c_mktsegment").agg(F.sum("c").alias("cents"), F.count("*").alias("lines"))


QUERIES = {
    "badge_cap": q_badges,
    "run_status": q_run_status,
    "retention_fold": q_retention,
    "parent_share": q_parent_share,
    "separate_playing": q_separate,
    "url_hosts": q_hosts,
    "redacted_documents": q_redacted,
    "region_keys": q_region_keys,
    "capacity_reservation": q_capacity,
    "macro_recall": q_macro,
    "star_join": q_star,
}

def _redact_sql(x: str) -> str:
    """Addresses parameter by parameter, then quoted and plain assignments."""
    q = lambda t: "'" + t.replace("'", "''") + "'"
    part = lambda u, k: f"regexp_extract({u}, {q(rl._PARTS)}, {k})"
    name = "regexp_replace(regexp_replace(lower(url_decode(split_part(p, '=', 1))), '[^a-z0-9]+', '_', 'g'), '^_|_$', '', 'g')"
    secret = f"contains(p, '=') AND ({name} IN ({', '.join(map(q, rl.QUERY_SECRETS))}) OR {' OR '.join(f'ends_with({name}, {q(e)})' for e in rl.QUERY_ENDINGS)})"
    query = f"list_transform(string_split(substr({part('u', 4)}, 2), '&'), lambda p: CASE WHEN {secret} THEN split_part(p, '=', 1) || '={rl._MARK}' ELSE p END)"
    url = f"CASE WHEN {part('u', 2)} = '' THEN u ELSE {part('u', 1)} || regexp_replace({part('u', 2)}, '^.*@', '') || {part('u', 3)} || CASE WHEN {part('u', 4)} = '' THEN '' ELSE '?' || array_to_string({query}, '&') END || {part('u', 5)} END"
    urls = f"list_transform(regexp_extract_all({x}, {q(rl.ADDRESS)}), lambda u: {url})"
    joined = f"array_to_string(list_transform(list_zip(regexp_split_to_array({x}, {q(rl.ADDRESS)}), {urls}), lambda z: z[1] || coalesce(z[2], '')), '')"
    quoted = f"regexp_replace({joined}, {q(rl.QUOTED)}, '\\1\"{rl._MARK}\"', 'g')"
    return f"replace(regexp_replace({quoted}, {q(rl.PLAIN)}, '\\1\\2{rl._MARK}', 'g'), '{rl._MARK}', '{rl.HIDDEN}')"


ORACLE_SQL = {
    "badge_cap": f"""WITH x AS (SELECT CASE WHEN n_chars >= 3000 THEN 'verified' WHEN n_chars >= 1500 THEN 'likely' WHEN n_chars >= 400 THEN 'possible' ELSE 'unclear' END AS work, quality FROM {_SC})
 SELECT work, CASE WHEN work = 'verified' AND quality <> 1 THEN 'likely' ELSE work END AS badge, map {{'likely': 8000, 'possible': 6000, 'unclear': 2500}}[work] AS score, count(*) AS n FROM x GROUP BY ALL""",
    "run_status": """WITH l AS (SELECT l_orderkey, count(*) AS p, count(*) FILTER (l_linestatus = 'F') AS r, bool_or(l_returnflag = 'R') AS f FROM lineitem GROUP BY 1)
 SELECT CASE WHEN f THEN 'partial (provider)' WHEN o_orderstatus = 'P' THEN 'partial (reservation)' WHEN r * 100 < 50 * p THEN 'partial (primary)' WHEN p < 3 THEN 'degraded' ELSE 'complete' END AS status, count(*) AS orders
 FROM orders JOIN l ON o_orderkey = l_orderkey GROUP BY 1""",
    "retention_fold": "SELECT o_custkey, CASE WHEN bool_or(o_orderstatus = 'P') THEN -1 ELSE max(epoch_us(o_orderdate)) END AS due, count(*) AS runs FROM orders GROUP BY 1",
    "parent_share": """WITH s AS (SELECT c_mktsegment, n_regionkey, count(*) AS w FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)
 SELECT c_mktsegment, n_regionkey, w AS weight, CAST(t AS BIGINT) AS total FROM (SELECT *, sum(w) OVER (PARTITION BY c_mktsegment) AS t, row_number() OVER (PARTITION BY c_mktsegment ORDER BY w DESC, n_regionkey) AS r FROM s) WHERE r = 1""",
    "separate_playing": f"""WITH x AS ({_sp(600_000_000)}) SELECT user_id, event_type, event_id FROM x a WHERE NOT EXISTS (SELECT 1 FROM x b WHERE b.user_id = a.user_id AND b.event_type = a.event_type AND b.event_id <> a.event_id
 AND NOT EXISTS (SELECT 1 FROM x c WHERE c.user_id = a.user_id AND c.event_type <> a.event_type AND ((b.s >= a.e AND c.s >= a.e AND c.e <= b.s) OR (a.s >= b.e AND c.s >= b.e AND c.e <= a.s))))""",
    "url_hosts": "SELECT regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://(?:[^/@]*@)?([^/:?#]+)', 1)), '^www\\.', '') AS host, count(*) AS pages FROM pages GROUP BY 1",
    "redacted_documents": f"WITH r AS (SELECT doc_id, text, {_redact_sql('text')} AS t FROM documents) SELECT doc_id, t <> text AS changed, sha256(t) AS digest FROM r",
    "region_keys": f"""SELECT DISTINCT user_id, event_type, slot, substr(sha256(concat_ws('|', user_id, event_type, slot)), 1, 16) AS key FROM (SELECT user_id, event_type, s // {6 * HOUR} AS slot FROM ({_sp(HOUR)}))""",
    "capacity_reservation": """WITH x AS (SELECT user_id, (max(epoch_us(ts)) - min(epoch_us(ts))) // 1000 AS ms, count(*) AS n FROM events GROUP BY 1), c AS (SELECT user_id, (ms * 2 + 59999) // 60000 AS clips, (n * 5000 * 105 + 99) // 100 AS e6 FROM x)
 SELECT user_id, clips, clips * 1500 // 10000 AS held, (e6 + 9999) // 10000 AS cents, (e6 + 9999) // 10000 <= 40 AS allowed FROM c""",
    "macro_recall": f"""WITH r AS (SELECT lang, least(10000, (sum(guess * quality) * 20000 + sum(quality)) // (2 * sum(quality))) AS r FROM {_SC} GROUP BY lang) SELECT CAST((2 * sum(r) + count(*)) // (2 * count(*)) AS BIGINT) AS macro_e4 FROM r""",
    "star_join": """SELECT r_name, c_mktsegment, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents, count(*) AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
 JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""",
}
