"""Queries over identity, scores, targets and projection."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.exact import iou_e4
from tidemark.operators import admission as adm
from tidemark.operators import evidence as ev
from tidemark.operators import identity as idn
from tidemark.operators import projection as pj
from tidemark.operators import scoring as sco
from tidemark.operators import targeting as tg
from tidemark.plans import episodes as pe
from tidemark.plans.evidence import _SC, _scored
from tidemark.runtime import read_table

HOUR = pe.HOUR


def _assertions(spark, d):
    """Every line as an assertion that its part and its supplier's node are one recording."""
    li = read_table(spark, d, "lineitem")
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.col("l_partkey").alias("a"),
        (F.col("l_suppkey") + 1_000_000_000).alias("b"),
        F.when(F.col("l_returnflag") == "A", "same_work").otherwise("same_recording").alias("relation"),
        (F.col("l_linenumber") % 3).alias("independent_of"),
        (F.col("l_discount") > 0.09).alias("audited"),
    )


def q_eligible(spark, d):
    return idn.eligible_links(_assertions(spark, d), F.col("a") % 4 != 0, F.col("audited"))


def _members(spark, d):
    c = read_table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("node"), (F.expr("c_custkey div 7")).alias("component"), F.expr("c_custkey div 7 % 40").alias("work"))


def _conflicts(spark, d):
    return read_table(spark, d, "orders").select(F.col("o_custkey").alias("a"), (F.col("o_custkey") + F.col("o_orderkey") % 9 - 4).alias("b")).where("a <> b").distinct()


def q_candidates(spark, d):
    bad = _conflicts(spark, d).where("a % 5 = 0")
    return idn.candidates(_members(spark, d), bad).withColumn("alternatives", F.concat_ws(",", F.transform("alternatives", lambda x: x.cast("string"))))


def q_contested(spark, d):
    return idn.contested(_members(spark, d), _conflicts(spark, d).where("a % 5 = 0"))


def q_fallback(spark, d):
    """Each order's preferred part: that of a returned line, else of any, else none known."""
    li = read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_returnflag")
    best = li.where("l_returnflag = 'R'").groupBy("o_orderkey").agg(F.min("l_partkey").alias("node"))
    any_ = li.groupBy("o_orderkey").agg(F.min("l_partkey").alias("node"))
    o = read_table(spark, d, "orders").select("o_orderkey")
    return idn.first_known(o, "o_orderkey", [best, any_, o.select("o_orderkey", (-F.col("o_orderkey")).alias("node"))], "node")


def q_supported(spark, d):
    li = read_table(spark, d, "lineitem")
    members = li.groupBy(F.col("l_orderkey").alias("candidate"), F.col("l_partkey").alias("node")).agg((F.max("l_quantity") > 30).alias("recording"), (F.max("l_tax") > 0.075).alias("contested"))
    sources = li.select(F.col("l_partkey").alias("node"), (F.col("l_suppkey") % 3).alias("source")).where("source > 0")
    return idn.recording_supported(members, sources)


def q_solid(spark, d):
    c = read_table(spark, d, "documents").select("doc_id", F.explode(F.split("source", "[^a-z0-9]+")).alias("name")).where("name <> ''")
    return idn.solid_names(c.select("name", F.col("doc_id").alias("work")))


def _labels(spark, d):
    """Parts' labels as works, and as hints with letters lost at times."""
    p = read_table(spark, d, "part")
    k = F.col("p_partkey")
    lower = F.array_sort(F.array_distinct(F.split(F.lower(F.concat_ws(" ", "p_name", F.regexp_replace("p_brand", "[^A-Za-z0-9]", ""), "p_type")), " ")))
    works = p.groupBy(lower.alias("words")).agg(F.min(k).alias("work"))
    first = F.get("_w", F.lit(0))
    h = F.col("hint")
    cut = F.when(h % 3 == 0, F.substring(first, F.lit(1), F.length(first) - 1)).when(h % 3 == 1, F.concat(first, F.lit("s"))).otherwise(first)
    h = p.where(k % 2 == 0).select(k.alias("hint"), lower.alias("_w")).select("hint", F.array_distinct(F.concat(F.array(cut), F.slice("_w", F.lit(2), F.size("_w")))).alias("words"))
    return h, works


def q_label_match(spark, d):
    return idn.named_works(*_labels(spark, d))


def q_mutual(spark, d):
    li = read_table(spark, d, "lineitem").where("l_quantity >= 45").select(F.col("l_partkey").alias("a"), F.col("l_orderkey").alias("b")).distinct()
    return idn.mutual(li)


def _truth(spark, d):
    w = pe.windows(spark, d).select("media", "work", "id", "s", "e")
    return w.where("id % 2 = 0"), w.where("id % 2 = 1").withColumns({"s": F.col("s") + HOUR, "e": F.col("e") + HOUR})


def q_associate(spark, d):
    return sco.associate(*_truth(spark, d), ["media", "work"], 30 * pe.MIN)


def q_closest(spark, d):
    p = read_table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("key"), F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ").alias("words"))
    return sco.closest_label(p.where("id % 5 = 0"), p.where("id % 5 <> 0"))


def q_pairwise(spark, d):
    e = read_table(spark, d, "events")
    f = e.select(F.col("event_type").alias("engine"), F.col("user_id").alias("set"), F.floor("value").alias("work"))
    return sco.pairwise_agreement(f, f.select("engine").distinct())


def _votes(spark, d):
    i = F.col("event_id")
    return read_table(spark, d, "events").select("user_id", F.element_at(F.array(*map(F.lit, ("alpha", "beta", "gamma"))), (i * 7 % 11 % 3 + 1).cast("int")).alias("provider"), (i % 4).alias("transform"), F.when(i % 5 != 0, F.floor("value").cast("long")).alias("score"), F.floor(F.col("user_id") / 3).alias("g"), F.dayofmonth("ts").alias("day"))


def q_features(spark, d):
    return sco.vote_features(_votes(spark, d), ["user_id", "day"], "provider", "transform", "score", ["beta", "gamma"]).withColumn("median_score", F.coalesce("median_score", F.lit(-1)))


def q_indices(spark, d):
    e = pe._episodes(spark, d)
    hint, agree = F.when(F.col("hints") > 0, 10_000).otherwise(0), F.when(F.col("agreements") > 0, 10_000).otherwise(0)
    span, rival = F.expr("(e - s) div 1000"), F.col("rivals") > 0
    w = sco.work_index(F.col("trials_e4"), span, hint, agree, F.col("aligned"), rival)
    v = sco.version_index(w, F.col("direct"), rival)
    b = sco.boundary_index(F.col("aligned"), F.expr("on_air div 10000"), F.col("votes"))
    return e.select(*pe.ep.PLAY, w.alias("work_index"), v.alias("version_index"), b.alias("boundary_index"))


def q_thresholds(spark, d):
    b = _scored(spark, d).withColumn("bin", F.least(F.expr("n_chars div 300"), F.lit(20))).groupBy("lang", "bin").agg(F.sum("quality").alias("good"), F.count("*").alias("total"))
    t = sco.tier_thresholds(ev.isotonic(b.where("lang = 'en'"), ["lang"], "bin", "good", "total"), "bin", "fit_e4")
    return t.fillna(-1, ["min_index", "achieved_e4"])


def _bounds(spark, d):
    """Lines as intervals of cents: proved, predicted and true."""
    c = F.round(F.col("l_extendedprice") * 100).cast("long")
    li = read_table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", c.alias("proved"), (c - F.col("l_suppkey") * 100).alias("lo"), (c + F.col("l_partkey")).alias("hi"), (c + F.col("l_partkey") * 3 - 2000).alias("t_lo"), (c + F.col("l_partkey") * 3).alias("t_hi"))


def q_winkler(spark, d):
    b = _bounds(spark, d)
    v = sco.interval_scores(F.col("lo"), F.col("hi"), F.col("t_lo"), F.col("t_hi"), 9000)
    b = b.select("l_returnflag", v.alias("v"), iou_e4(F.col("lo"), F.col("hi"), F.col("t_lo"), F.col("t_hi")).alias("iou"))
    return b.groupBy("l_returnflag").agg(F.count_if("v.covered").alias("covered"), F.sum("v.width").alias("width"), F.sum("v.winkler").alias("winkler"), F.sum("iou").alias("iou_e4"))


def q_residuals(spark, d):
    return sco.residual_interval(_bounds(spark, d), ["l_returnflag"], "proved", "t_lo", "t_hi")


def q_latency(spark, d):
    e = read_table(spark, d, "events")
    return sco.latency_curve(e.select(F.col("user_id").alias("position"), (F.floor("value") % 10).alias("duration"), (F.col("event_type") == "purchase").alias("success")))


def _ranked(spark, d):
    w = pe.windows(spark, d).select("media", "id", "s", "e", (F.col("id") * 31 % 97).alias("energy"))
    c = read_table(spark, d, "events").where("event_id % 6 = 0").select(F.col("user_id").alias("media"), F.col("event_id").alias("cand"), F.expr("unix_micros(ts) div 1000").alias("cs"), F.element_at(F.array(*map(F.lit, tg.PRIORITY)), (F.col("event_id") % 4 + 1).cast("int")).alias("class"))
    c = c.withColumn("ce", F.col("cs") + HOUR * (6 + F.col("cand") % 20))
    return tg.ranked_windows(w, c, 10 * pe.MIN, pe.BUCKET)


def q_ranked(spark, d):
    return _ranked(spark, d).select("media", "cand", "id", "rank")


def q_allocate(spark, d):
    return tg.allocate(_ranked(spark, d).withColumn("quota", F.lit(12)), "quota")


def q_confirm(spark, d):
    w = pe.windows(spark, d).select("media", "id", "s", "e")
    x = w.where("id % 10 = 0").select("media", F.col("id").alias("disc"), F.col("s").alias("ds"), F.col("e").alias("de"), (F.col("s") - 20 * HOUR).alias("bs"), (F.col("e") + 20 * HOUR).alias("be"), F.col("id").alias("probe"), F.lit(5).alias("reserve"))
    return tg.confirmations(x, w, "reserve", 24 * HOUR, 12 * HOUR, HOUR)


def q_discoveries(spark, d):
    w = pe.windows(spark, d).withColumn("key", F.concat_ws("|", "candidate", "provider"))
    return tg.new_identities(w.where("status = 'match'"), w.where("id % 20 = 0").select("media", "key")).select("media", "key", "id", "s")


def q_unplanned(spark, d):
    slot = F.expr(f"s div {HOUR} * {HOUR}").alias("start")
    w = pe.windows(spark, d)
    of = lambda x: x.select("media", slot, F.lit(HOUR).alias("length"))
    return tg.unplanned(of(w), of(w.where("provider = 'alpha'")))


def q_transforms(spark, d):
    li = read_table(spark, d, "lineitem")
    rate = (F.lit(10_000) + F.col("l_partkey") % 2000 - 1000).alias("rate")
    r = li.select(rate).distinct()
    return r.select("rate", tg.source_span(F.lit(12_000).cast("long"), F.col("rate")).alias("span_ms"), tg.source_samples(F.lit(12_000).cast("long"), F.col("rate")).alias("samples"))


def _rows(episodes, keep, shift):
    """Episodes as rows of one pass."""
    e = episodes.where(keep)
    label = F.concat_ws("-", "work", F.when(F.col("votes") > 3, "x").otherwise("y"))
    return e.select("media", F.concat_ws("/", "candidate", "occurrence").alias("id"), "work", label.alias("label"), (F.col("s") + shift).alias("s"), (F.col("e") + shift).alias("e"), "tier", (F.col("on_air") >= 12 * HOUR).alias("listed"), F.when(F.col("hints") > 0, F.array(F.col("hints") % 3)).otherwise(F.array().cast("array<bigint>")).alias("hints"))


def q_merge(spark, d):
    e = pe._episodes(spark, d)
    return pj.additive_merge(_rows(e, "occurrence % 2 = 0", 0), _rows(e, "occurrence % 2 = 1 or candidate in ('view', 'error')", -HOUR))


def _entries(spark, d):
    x = read_table(spark, d, "events").where("event_id % 3 = 0")
    start = F.expr("(unix_micros(ts) - 1704067200000000) div 100000000")
    return x.select(F.col("user_id").alias("media"), F.when(F.col("event_id") % 5 == 0, "id").otherwise("track").alias("kind"), F.col("event_type").alias("artist"), F.concat_ws('"', F.lit("T"), F.col("event_id").cast("string")).alias("title"), (start * 271).alias("s"), (start * 271 + 90_000).alias("e"))


def q_cue(spark, d):
    return pj.cue_sheet(_entries(spark, d))


def q_m3u(spark, d):
    return pj.m3u_list(_entries(spark, d), F.concat(F.lit("mix-"), F.col("media").cast("string")))


def q_covered(spark, d):
    """Covered time and share of each recording by listed episodes' supports, as shown."""
    from tidemark.functions.exact import ratio_e4
    from tidemark.operators import intervals as iv

    w = pe.windows(spark, d)
    total = w.groupBy("media").agg((F.max("e") - F.min("s")).alias("total"))
    listed = iv.islands(pe.ep.final_matches(w), ["media"], "s", "e").groupBy("media").agg(F.sum(F.col("e") - F.col("s")).alias("covered"), F.count("*").alias("runs"))
    return total.join(listed, "media").select("media", "covered", "runs", ratio_e4(F.col("covered"), F.col("total")).alias("share_e4"))


LIMIT, LIMIT_MS = 2, 12 * HOUR
#: Seconds and counts of the breaker over events: window, samples, per cent, cooldown, opens to latch, samples a day.
BREAKER = {"window_s": 10_800, "least": 3, "percent": 30, "cooldown_s": 7200, "latch": 3, "daily": 40}


def q_ip_limit(spark, d):
    """Which of a user's events a limit of two in twelve hours admits, refused
    ones not counting, and how long the others would have to wait."""
    e = read_table(spark, d, "events").select("user_id", "event_id", F.expr("unix_micros(ts) div 1000").alias("t"))
    return adm.limited(e, ["user_id"], "t", "event_id", LIMIT, LIMIT_MS).select("event_id", "admitted", "wait")


def q_breaker_states(spark, d):
    """What ten breakers do as users' events arrive, low values being failures."""
    e = read_table(spark, d, "events").select((F.col("user_id") % 10).alias("egress"), "event_id", F.expr("unix_micros(ts) div 1000000").alias("t"), (F.col("value") < 20).alias("failed"))
    return adm.breakers(e, ["egress"], "t", "event_id", "failed", **BREAKER).where("opened is not null or over_budget").select("event_id", "opened", "over_budget")


QUERIES = {
    "eligible_links": q_eligible,
    "identity_candidates": q_candidates,
    "contested_components": q_contested,
    "first_known_node": q_fallback,
    "recording_support": q_supported,
    "solid_names": q_solid,
    "label_match": q_label_match,
    "mutual_pairs": q_mutual,
    "truth_association": q_associate,
    "closest_labels": q_closest,
    "pairwise_agreement": q_pairwise,
    "vote_features": q_features,
    "ordering_indices": q_indices,
    "tier_thresholds": q_thresholds,
    "interval_scores": q_winkler,
    "residual_intervals": q_residuals,
    "latency_curve": q_latency,
    "ranked_windows": q_ranked,
    "secondary_allocation": q_allocate,
    "confirmation_windows": q_confirm,
    "new_identities": q_discoveries,
    "unplanned_windows": q_unplanned,
    "transform_spans": q_transforms,
    "additive_merge": q_merge,
    "cue_sheets": q_cue,
    "m3u_lists": q_m3u,
    "covered_time": q_covered,
    "sliding_limit": q_ip_limit,
    "breaker_states": q_breaker_states,
}

_R4 = lambda n, d: f"CASE WHEN {d} > 0 THEN least(10000, ({n} * 20000 + {d}) // (2 * {d})) ELSE 0 END"
_MEM = "mb AS (SELECT c_custkey AS node, c_custkey // 7 AS component, c_custkey // 7 % 40 AS work FROM customer), cf AS (SELECT DISTINCT o_custkey AS a, o_custkey + o_orderkey % 9 - 4 AS b FROM orders WHERE o_orderkey % 9 <> 4 AND o_custkey % 5 = 0), bad AS (SELECT DISTINCT x.component FROM cf JOIN mb x ON x.node = cf.a JOIN mb y ON y.node = cf.b WHERE x.component = y.component)"
_LOW = "list_sort(list_distinct(string_split(lower(p_name || ' ' || regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g') || ' ' || p_type), ' ')))"
_NEAR = "(x <> y AND ((length(x) >= 4 AND length(y) >= 4 AND levenshtein(x, y) <= 1) OR (regexp_full_match(x, '\\p{L}+') AND regexp_full_match(y, '\\p{L}+') AND ((length(x) >= 2 AND length(y) = length(x) + 1 AND starts_with(y, x)) OR (length(y) >= 2 AND length(x) = length(y) + 1 AND starts_with(x, y))))))"
_LI = "SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag, CAST(round(l_extendedprice * 100) AS BIGINT) AS proved, CAST(round(l_extendedprice * 100) AS BIGINT) - l_suppkey * 100 AS lo, CAST(round(l_extendedprice * 100) AS BIGINT) + l_partkey AS hi, CAST(round(l_extendedprice * 100) AS BIGINT) + l_partkey * 3 - 2000 AS t_lo, CAST(round(l_extendedprice * 100) AS BIGINT) + l_partkey * 3 AS t_hi FROM lineitem"
_ENT = "SELECT user_id AS media, CASE WHEN event_id % 5 = 0 THEN 'id' ELSE 'track' END AS kind, event_type AS artist, 'T\"' || event_id AS title, (epoch_us(ts) - 1704067200000000) // 100000000 * 271 AS s FROM events WHERE event_id % 3 = 0"
_Q = lambda x: f"'\"' || replace({x}, '\"', '''') || '\"'"
_T2 = lambda x: f"lpad(CAST({x} AS VARCHAR), 2, '0')"


def _merge_rows(keep: str, shift: int) -> str:
    return f"SELECT media, candidate || '/' || occurrence AS id, work, work || CASE WHEN votes > 3 THEN '-x' ELSE '-y' END AS label, s + {shift} AS s, e + {shift} AS e, list_position(['unclear', 'possible', 'likely', 'verified'], tier) AS tier, on_air >= {12 * HOUR} AS listed, CASE WHEN hints > 0 THEN [hints % 3] ELSE [] END AS hints FROM ep WHERE {keep}"


ORACLE_SQL = {
    "eligible_links": """WITH x AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey AS a, l_suppkey + 1000000000 AS b, l_linenumber % 3 AS src, l_discount > 0.09 AS p FROM lineitem WHERE l_returnflag <> 'A')
 SELECT min(id) AS id, a, b FROM x GROUP BY a, b HAVING bool_or(p) OR (a % 4 <> 0 AND count(DISTINCT src) >= 2)""",
    "identity_candidates": f"""WITH {_MEM}, c AS (SELECT component, min(node) AS canonical, count(*) AS nodes, min(work) AS work FROM mb GROUP BY 1)
 SELECT c.component, c.work, c.canonical, c.nodes, coalesce((SELECT string_agg(CAST(o.canonical AS VARCHAR), ',' ORDER BY o.canonical) FROM c o WHERE o.work = c.work AND o.canonical <> c.canonical), '') AS alternatives, c.component IN (SELECT component FROM bad) AS contested FROM c""",
    "contested_components": f"WITH {_MEM} SELECT component FROM bad",
    "first_known_node": "SELECT o_orderkey, coalesce(min(l_partkey) FILTER (l_returnflag = 'R'), min(l_partkey), -o_orderkey) AS node FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey",
    "recording_support": """WITH m AS (SELECT l_orderkey AS candidate, l_partkey AS node, max(l_quantity) > 30 AS r, max(l_tax) > 0.075 AS c FROM lineitem GROUP BY 1, 2), s AS (SELECT l_partkey AS node, count(DISTINCT l_suppkey % 3) AS n FROM lineitem WHERE l_suppkey % 3 > 0 GROUP BY 1)
 SELECT candidate, NOT bool_or(c) AND (count(*) FILTER (r) >= 2 OR max(coalesce(n, 0)) >= 2) AS supported FROM m LEFT JOIN s USING (node) GROUP BY 1""",
    "solid_names": "SELECT name, count(DISTINCT doc_id) AS works FROM (SELECT doc_id, unnest(regexp_split_to_array(source, '[^a-z0-9]+')) AS name FROM documents) WHERE name <> '' GROUP BY 1 HAVING works >= 2",
    "label_match": f"""WITH k AS (SELECT {_LOW} AS kw, min(p_partkey) AS work FROM part GROUP BY 1), h0 AS (SELECT p_partkey AS hint, {_LOW} AS w FROM part WHERE p_partkey % 2 = 0),
 h AS (SELECT hint, list_distinct(list_prepend(CASE hint % 3 WHEN 0 THEN w[1][1:-2] WHEN 1 THEN w[1] || 's' ELSE w[1] END, w[2:])) AS hw FROM h0),
 p AS (SELECT hint, work, hw, kw, list_filter(hw, lambda q: NOT list_contains(kw, q)) AS oh, list_filter(kw, lambda q: NOT list_contains(hw, q)) AS ok FROM h JOIN k ON list_has_any(hw, kw)),
 f AS (SELECT hint, work, len(oh) AS nh, len(ok) AS nk, oh[1] AS x, ok[1] AS y, len(hw) AS lh, len(kw) AS lk FROM p)
 SELECT hint, min(work) AS work FROM f WHERE least(lh, lk) >= 2 AND (nh = 0 OR nk = 0 OR (nh = 1 AND nk = 1 AND {_NEAR})) GROUP BY hint HAVING count(*) = 1""",
    "mutual_pairs": "WITH p AS (SELECT DISTINCT l_partkey AS a, l_orderkey AS b FROM lineitem WHERE l_quantity >= 45) SELECT a, b FROM (SELECT a, b, count(*) OVER (PARTITION BY a) AS n, count(*) OVER (PARTITION BY b) AS m FROM p) WHERE n = 1 AND m = 1",
    "closest_labels": """WITH p AS (SELECT p_partkey AS id, p_brand AS key, list_distinct(string_split(lower(p_name || ' ' || p_type), ' ')) AS w FROM part),
 j AS (SELECT l.id AS "left", r.id AS "right", len(list_filter(l.w, lambda x: NOT list_contains(r.w, x))) + len(list_filter(r.w, lambda x: NOT list_contains(l.w, x))) AS apart FROM p l JOIN p r USING (key) WHERE l.id % 5 = 0 AND r.id % 5 <> 0)
 SELECT "left", "right", CAST(apart AS INTEGER) AS apart FROM (SELECT *, row_number() OVER (PARTITION BY "left" ORDER BY apart, "right") AS k FROM j) WHERE k = 1""",
    "pairwise_agreement": """WITH f AS (SELECT DISTINCT event_type AS g, user_id AS u, floor(value) AS w FROM events), n AS (SELECT g, count(*) AS n FROM f GROUP BY 1), b AS (SELECT x.g AS a, y.g AS b, count(*) AS k FROM f x JOIN f y ON x.u = y.u AND x.w = y.w AND x.g < y.g GROUP BY 1, 2)
 SELECT x.g AS a, y.g AS b, coalesce(k, 0) * 10000 // (x.n + y.n - coalesce(k, 0)) AS agreement_e4 FROM n x JOIN n y ON x.g < y.g LEFT JOIN b ON b.a = x.g AND b.b = y.g""",
    "vote_features": f"""WITH v AS (SELECT user_id, dayofmonth(ts) AS day, ['alpha', 'beta', 'gamma'][event_id * 7 % 11 % 3 + 1] AS p, event_id % 4 AS t, CASE WHEN event_id % 5 <> 0 THEN CAST(floor(value) AS BIGINT) END AS sc FROM events),
 n AS (SELECT user_id, day, p, count(*) AS n FROM v GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY n DESC, p) AS r, p <> 'alpha' AND row_number() OVER (PARTITION BY user_id, day, p <> 'alpha' ORDER BY n DESC, p) > 1 AS cheap FROM n),
 e AS (SELECT user_id, day, count(*) AS providers, coalesce(bool_and(cheap) FILTER (r > 1), false) AS every FROM r GROUP BY ALL), m AS (SELECT user_id, day, max(n) AS m, sum(n) AS n FROM (SELECT user_id, day, t, count(*) AS n FROM v GROUP BY ALL) GROUP BY ALL),
 s AS (SELECT user_id, day, count(sc) AS n_scores, CAST(floor(median(sc)) AS BIGINT) AS median_score FROM v GROUP BY ALL)
 SELECT user_id, day, providers, CASE WHEN providers <= 1 THEN 0 WHEN every THEN 5000 ELSE 10000 END AS engine_agreement_e4, CAST({_R4('m', 'n')} AS BIGINT) AS transform_consistency_e4, n_scores, coalesce(median_score, -1) AS median_score FROM e JOIN m USING (user_id, day) JOIN s USING (user_id, day)""",
    "ordering_indices": f"""{pe._EP}, wi AS (SELECT *, trials_e4 + least((e - s) // 1000, 120000) * 10000 // 120000 + CASE WHEN hints > 0 THEN 2500 ELSE 0 END + CASE WHEN agreements > 0 THEN 2500 ELSE 0 END + CASE WHEN aligned THEN 10000 ELSE 0 END - CASE WHEN rivals > 0 THEN 20000 ELSE 0 END AS work_index FROM ep)
 SELECT media, candidate, occurrence, work_index, work_index + CASE WHEN direct AND rivals = 0 THEN 30000 ELSE 0 END - CASE WHEN rivals > 0 THEN 40000 ELSE 0 END AS version_index, CASE WHEN aligned THEN 20000 ELSE 0 END + 10000 - least(on_air // 10000, 10000) + least(votes, 4) * 1000 AS boundary_index FROM wi""",
    "tier_thresholds": f"""WITH b AS (SELECT least(n_chars // 300, 20) AS bin, sum(quality) AS g, count(*) AS t FROM {_SC} WHERE lang = 'en' GROUP BY 1), m AS (SELECT lo.bin AS l, hi.bin AS h, (SELECT sum(g) / sum(t) FROM b WHERE bin BETWEEN lo.bin AND hi.bin) AS m FROM b lo JOIN b hi ON lo.bin <= hi.bin),
 f AS (SELECT bin, CAST(floor(max(x) * 10000 + 1e-9) AS BIGINT) AS fit FROM (SELECT b.bin, l, min(m) AS x FROM b JOIN m ON l <= b.bin AND h >= b.bin GROUP BY b.bin, l) GROUP BY bin)
 SELECT tier, target AS target_e4, coalesce(min(bin), -1) AS min_index, coalesce(arg_min(fit, bin), -1) AS achieved_e4 FROM (VALUES ('possible', 7000::BIGINT), ('likely', 9000), ('verified', 9900)) AS t(tier, target) LEFT JOIN f ON fit >= target GROUP BY ALL""",
    "interval_scores": f"""WITH x AS (SELECT *, hi - lo AS w, greatest(t_lo - hi, lo - t_hi, 0) AS away, greatest(0, least(hi, t_hi) - greatest(lo, t_lo)) AS i FROM ({_LI}))
 SELECT l_returnflag, count(*) FILTER (lo <= t_hi AND hi >= t_lo) AS covered, CAST(sum(w) AS BIGINT) AS width, CAST(sum(w + (20000 * away + 500) // 1000) AS BIGINT) AS winkler, CAST(sum({_R4('i', '(w + 2000 - i)')}) AS BIGINT) AS iou_e4 FROM x GROUP BY 1""",
    "residual_intervals": f"""WITH x AS (SELECT *, t_lo - proved AS r FROM ({_LI})), o AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY r) - 1 AS i, count(*) OVER (PARTITION BY l_returnflag) AS n FROM x),
 q AS (SELECT l_returnflag, max(n) AS n, min(r) FILTER (i = least(n - 1, n * 5 // 100)) AS q_lo, min(r) FILTER (i = least(n - 1, n * 95 // 100)) AS q_hi FROM o GROUP BY 1),
 k AS (SELECT l_returnflag, q_lo, q_hi, n, count(*) FILTER (greatest(0, proved + q_lo) <= t_hi AND greatest(greatest(0, proved + q_lo), proved + q_hi) >= t_lo) AS k FROM x JOIN q USING (l_returnflag) GROUP BY ALL)
 SELECT l_returnflag, q_lo, q_hi, n, CAST({_R4('k', 'n')} AS BIGINT) AS coverage_e4 FROM k""",
    "latency_curve": f"""WITH c AS (SELECT user_id AS p, CAST(floor(value) AS BIGINT) % 10 AS d, event_type = 'purchase' AS ok FROM events), f AS (SELECT p, min(d) FILTER (ok) AS t FROM c GROUP BY 1), n AS (SELECT count(*) AS n FROM f), k AS (SELECT d, (SELECT count(*) FROM f WHERE t <= d) AS k FROM (SELECT DISTINCT d FROM c))
 SELECT d AS duration, n AS positions, n - k AS censored, CAST({_R4('k', 'n')} AS BIGINT) AS recognised_e4 FROM k, n""",
    "ranked_windows": f"""WITH w AS (SELECT user_id AS media, event_id AS id, epoch_us(ts) // 1000 AS s, epoch_us(ts) // 1000 + {pe.W} AS e, event_id * 31 % 97 AS energy FROM events), c AS (SELECT user_id AS media, event_id AS cand, epoch_us(ts) // 1000 AS cs, epoch_us(ts) // 1000 + {HOUR} * (6 + event_id % 20) AS ce FROM events WHERE event_id % 6 = 0)
 SELECT media, cand, id, CAST(row_number() OVER (PARTITION BY media, cand ORDER BY least(e, ce) - greatest(s, cs) DESC, energy DESC, s, id) AS INTEGER) AS rank FROM w JOIN c USING (media) WHERE least(e, ce) - greatest(s, cs) >= {10 * pe.MIN}""",
    "new_identities": f"""WITH {pe._W}, k AS (SELECT *, candidate || '|' || provider AS key FROM w) SELECT media, key, id, s FROM (SELECT *, row_number() OVER (PARTITION BY media, key ORDER BY s, e, id) AS r FROM k WHERE status = 'match' AND NOT EXISTS (SELECT 1 FROM k o WHERE o.id % 20 = 0 AND o.media = k.media AND o.key = k.key)) WHERE r = 1""",
    "unplanned_windows": f"WITH {pe._W} SELECT DISTINCT media, s // {HOUR} * {HOUR} AS start, {HOUR} AS length FROM w a WHERE NOT EXISTS (SELECT 1 FROM w b WHERE provider = 'alpha' AND b.media = a.media AND b.s // {HOUR} = a.s // {HOUR})",
    "transform_spans": "SELECT rate, (2 * 120000000 + rate) // (2 * rate) AS span_ms, (2 * 1920000000000 + rate * 1000) // (2 * rate * 1000) AS samples FROM (SELECT DISTINCT 10000 + l_partkey % 2000 - 1000 AS rate FROM lineitem)",
    "additive_merge": f"""{pe._EP}, f AS ({_merge_rows('occurrence % 2 = 0', 0)}), p AS ({_merge_rows("(occurrence % 2 = 1 OR candidate IN ('view', 'error'))", -HOUR)}),
 j AS (SELECT p.media, p.id, f.id AS fid, (NOT f.listed OR (p.listed AND p.label = f.label)) AND p.tier >= f.tier AND len(list_filter(f.hints, lambda x: NOT list_contains(p.hints, x))) = 0 AS ok FROM p JOIN f ON p.media = f.media AND p.work = f.work AND p.s <= f.e AND f.s <= p.e),
 mm AS (SELECT media, id, bool_and(ok) AS ok FROM j GROUP BY ALL), k AS (SELECT p.media, p.id, CASE WHEN ok IS NULL THEN 'added' WHEN ok THEN 'confirmed' END AS why FROM p LEFT JOIN mm USING (media, id)), g AS (SELECT DISTINCT j.media, j.fid AS id FROM j JOIN k USING (media, id) WHERE why = 'confirmed')
 SELECT media, id, 'free' AS origin, 'kept' AS why FROM f ANTI JOIN g USING (media, id) UNION ALL SELECT media, id, 'paid', why FROM k WHERE why IS NOT NULL""",
    "cue_sheets": f"""WITH x AS (SELECT *, row_number() OVER (PARTITION BY media ORDER BY s, title, artist) AS no, CAST(round_even(s * 75::DECIMAL(12,0) / 1000, 0) AS BIGINT) AS fr FROM ({_ENT}))
 SELECT media, 'TITLE "DJ set"' || chr(10) || 'FILE "audio" WAVE' || chr(10) || string_agg('  TRACK ' || {_T2('no')} || ' AUDIO' || chr(10) || '    TITLE ' || {_Q("CASE WHEN kind = 'id' THEN 'ID' ELSE title END")} || chr(10) || '    PERFORMER ' || {_Q("CASE WHEN kind = 'id' THEN 'ID' ELSE artist END")} || chr(10) || '    INDEX 01 ' || CASE WHEN fr // 4500 < 100 THEN {_T2('fr // 4500')} ELSE CAST(fr // 4500 AS VARCHAR) END || ':' || {_T2('fr % 4500 // 75')} || ':' || {_T2('fr % 75')}, chr(10) ORDER BY no) || chr(10) AS sheet FROM x GROUP BY media""",
    "m3u_lists": f"""WITH x AS (SELECT *, row_number() OVER (PARTITION BY media ORDER BY s, title, artist) AS no, (s + 90000) // 1000 AS z FROM ({_ENT}))
 SELECT media, '#EXTM3U' || chr(10) || string_agg('#EXTINF:-1,' || CASE WHEN kind = 'id' THEN 'ID - no evidence through ' || CASE WHEN z >= 3600 THEN z // 3600 || ':' || {_T2('z % 3600 // 60')} ELSE CAST(z // 60 AS VARCHAR) END || ':' || {_T2('z % 60')} ELSE artist || ' - ' || title END || chr(10) || '#EXTVLCOPT:start-time=' || s // 1000 || chr(10) || 'mix-' || media, chr(10) ORDER BY no) || chr(10) AS sheet FROM x GROUP BY media""",
    "covered_time": f"""WITH {pe._W}, t AS (SELECT media, max(e) - min(s) AS total FROM w GROUP BY 1), i AS ({pe._islands('SELECT * FROM m', 'media')}), c AS (SELECT media, CAST(sum(e - s) AS BIGINT) AS covered, count(*) AS runs FROM i GROUP BY 1)
 SELECT media, covered, runs, CAST({_R4('covered', 'total')} AS BIGINT) AS share_e4 FROM t JOIN c USING (media)""",
    "sliding_limit": f"""WITH RECURSIVE x AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS i FROM events),
 r AS (SELECT user_id, event_id, i, t, [t] AS held, true AS admitted, 0::BIGINT AS wait FROM x WHERE i = 1 UNION ALL
 SELECT user_id, event_id, i, t, CASE WHEN len(w) < {LIMIT} THEN list_append(w, t) ELSE w END, len(w) < {LIMIT}, CASE WHEN len(w) < {LIMIT} THEN 0 ELSE greatest(1, w[len(w) - {LIMIT - 1}] + {LIMIT_MS} - t) END
  FROM (SELECT x.user_id, x.event_id, x.i, x.t, list_filter(r.held, lambda h: h > x.t - {LIMIT_MS}) AS w FROM r JOIN x ON x.user_id = r.user_id AND x.i = r.i + 1))
 SELECT event_id, admitted, wait FROM r""",
    "breaker_states": f"""WITH RECURSIVE x AS (SELECT user_id % 10 AS k, event_id, epoch_us(ts) // 1000000 AS t, CAST(value < 20 AS INT) AS f, row_number() OVER (PARTITION BY user_id % 10 ORDER BY epoch_us(ts) // 1000000, event_id) AS i FROM events),
 r AS (SELECT k, 0::BIGINT AS event_id, 0::BIGINT AS i, []::STRUCT(t BIGINT, f INT)[] AS w, 0::BIGINT AS until, -1::BIGINT AS day, 0 AS opens, 0 AS seen, NULL::VARCHAR AS opened, false AS over_budget FROM (SELECT DISTINCT k FROM x) UNION ALL
 SELECT k, event_id, i, CASE WHEN trips THEN [] ELSE w END, CASE WHEN trips THEN t + {BREAKER["cooldown_s"]} ELSE until END, t // 86400, opens + CAST(trips AS INT), seen, CASE WHEN trips THEN CASE WHEN opens + 1 >= {BREAKER["latch"]} THEN 'latched' ELSE 'open' END END, seen = {BREAKER["daily"]} + 1
  FROM (SELECT *, NOT quiet AND len(w) >= {BREAKER["least"]} AND list_sum(list_transform(w, lambda z: z.f)) * 100 > {BREAKER["percent"]} * len(w) AS trips
   FROM (SELECT *, CASE WHEN quiet THEN h ELSE list_filter(list_append(h, struct_pack(t := t, f := f)), lambda z: z.t > t - {BREAKER["window_s"]}) END AS w
    FROM (SELECT *, opens >= {BREAKER["latch"]} OR t < until AS quiet
     FROM (SELECT x.k, x.event_id, x.i, x.t, x.f, r.w AS h, r.until, CASE WHEN x.t // 86400 = r.day THEN r.opens ELSE 0 END AS opens, CASE WHEN x.t // 86400 = r.day THEN r.seen ELSE 0 END + 1 AS seen FROM r JOIN x ON x.k = r.k AND x.i = r.i + 1)))))
 SELECT event_id, opened, over_budget FROM r WHERE opened IS NOT NULL OR over_budget""",
}
