"""Queries over loops, copies and calibrated tiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import evidence as ev
from tidemark.operators import intervals as iv
from tidemark.operators import loops as lp
from tidemark.operators import schedule as sc
from tidemark.operators import scoring as sco
from tidemark.plans import episodes as pe
from tidemark.plans.evidence import _SC, _scored
from tidemark.runtime import read_table


def q_urls(spark, d):
    p = read_table(spark, d, "pages").select("page_id", "url")
    odd = F.when(F.col("page_id") % 4 == 0, F.concat(F.upper("url"), F.lit("/?utm_source=a&b=1#x"))).when(F.col("page_id") % 4 == 1, F.concat("url", F.lit("?si=1"))).when(F.col("page_id") % 4 == 2, F.lit("ftp://x/y")).otherwise(F.col("url"))
    return p.select("page_id", F.coalesce(lp.canonical_url(odd), F.lit("")).alias("url"))


def q_tiers(spark, d):
    """Tiers of documents by thresholds that were fitted on the labelled ones."""
    b = _scored(spark, d).withColumn("bin", F.least(F.expr("n_chars div 300"), F.lit(20))).where("lang = 'en'").groupBy("lang", "bin").agg(F.sum("quality").alias("good"), F.count("*").alias("total"))
    t = sco.tier_thresholds(ev.isotonic(b, ["lang"], "bin", "good", "total"), "bin", "fit_e4")
    x = read_table(spark, d, "documents").select("doc_id", F.least(F.expr("n_chars div 300"), F.lit(20)).alias("bin"))
    return lp.calibrated_tiers(x, "bin", t).groupBy("tier").agg(F.count("*").alias("n"))


def _said(spark, d):
    h = pe.hints(spark, d).where("s is not null")
    name = F.element_at(F.array(*map(F.lit, ("Alpha Bravo", "Alpha Brave", "Charlie", "Delta"))), (F.col("id") % 4 + 1).cast("int"))
    return h.select("media", "id", F.element_at(F.array(*map(F.lit, ("one", "two"))), (F.expr("id div 4") % 2 + 1).cast("int")).alias("connector"), F.concat_ws("|", F.lower(name), "work").alias("key"), name.alias("artist"), F.col("work").alias("title"), F.col("s").alias("at"))


def q_copies(spark, d):
    return lp.copies(_said(spark, d), 12 * pe.HOUR)


def q_mirrors(spark, d):
    h = _said(spark, d).withColumn("grp", F.expr("id div 8"))
    return lp.mirror_agreements(h.where("connector = 'one'"), h.where("connector = 'two'"), 12 * pe.HOUR)


def q_hint_only(spark, d):
    listed = pe._listed(spark, d)
    c = pe._clusters(spark, d, listed).withColumn("e", F.col("s") + pe.HOUR)
    listed = listed.select("media", "work", "s", "e")
    return lp.hint_only(c, listed, listed)


def q_generations(spark, d):
    """Episodes after two rescans: windows that had an error are asked again."""
    w = pe.windows(spark, d)

    def fuse(rows):
        return pe.ep.hulls(pe.ep.supports(pe.ep.plays(pe.ep.final_matches(rows), pe.GAP)))

    def plan(fused, rows, left):
        done = rows.where("status = 'match'").select("media", "trial").distinct()
        return rows.where("status = 'error'").join(done, ["media", "trial"], "left_anti").join(fused.select("media").distinct(), "media", "left_semi")

    def recognise(windows):
        return windows.withColumns({"status": F.lit("match"), "id": -F.col("id"), "is_final": F.lit(True)})

    fused, evidence, why = lp.generations(w, fuse, plan, recognise, 3, 1_000_000)
    return fused.groupBy("candidate").agg(F.count("*").alias("plays"), F.sum("on_air").alias("on_air")).withColumn("stopped", F.lit(why))


def q_trigger_windows(spark, d):
    """Windows of requests in milliseconds, by triggers in turn."""
    names = ("gap", "question_cluster", "contested", "hint_cluster", "edge", "novelty", "long_episode")
    w = pe.windows(spark, d).where("id % 9 = 0")
    r = w.select("id", F.element_at(F.array(*map(F.lit, names)), (F.col("id") % 7 + 1).cast("int")).alias("trigger"), "s", (F.col("s") + (1 + F.col("id") % 40) * 1000).alias("e"))
    return sc.trigger_windows(r)


def q_clipped(spark, d):
    w = pe.windows(spark, d).select("media", "id", (F.col("s") % 90_000_000 - 20_000_000).alias("s"))
    return iv.clipped(w.withColumn("e", F.col("s") + 15_000_000), "s", "e", F.lit(60_000_000).cast("long"))


def q_midpoints(spark, d):
    w = pe.windows(spark, d)
    pieces = iv.elementary_segments(w, ["media"], "s", "e").select("media", "s", "e")
    m = iv.midpoint_labels(pieces, pe.ep.final_matches(w).select("media", "s", "e", "work"), ["media"], "s", "e", "work", pe.W)
    return m.select("media", "s", "e", F.concat_ws(",", "labels").alias("labels"))


def q_fused(spark, d):
    """Vectors as style probabilities, and a lookup that names two places of some."""
    v = read_table(spark, d, "embeddings")
    i = F.col("vec_id")
    lookup = F.when((i % 3 != 0) & (i % 64 != i * 7 % 64), F.map_from_arrays(F.array((i % 64).cast("int"), (i * 7 % 64).cast("int")), F.array(F.lit(0.6), F.lit(0.4))))
    return ev.fused_shares(v.withColumn("lookup", lookup), "vec_id", "embedding", "lookup", 0.8, 0.05)


QUERIES = {
    "trigger_windows": q_trigger_windows,
    "clipped_spans": q_clipped,
    "midpoint_labels": q_midpoints,
    "fused_shares": q_fused,
    "canonical_urls": q_urls,
    "calibrated_tiers": q_tiers,
    "hint_copies": q_copies,
    "mirror_agreements": q_mirrors,
    "hint_only_rows": q_hint_only,
    "generation_loop": q_generations,
}

_P = r"(?i)^(https?)://([^/?#@]*@)?([^/?#:]+)(:[0-9]+)?([^?#]*)(\?[^#]*)?(#.*)?$"
_U = lambda i: f"regexp_extract(u, '{_P}', {i})"
_PLAYS = f"""v AS (SELECT *, CAST(sum(CASE WHEN s - pe > {pe.GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY media, candidate ORDER BY s, e, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS occurrence FROM (
 SELECT *, max(e) OVER (PARTITION BY media, candidate ORDER BY s, e, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM m2))"""

ORACLE_SQL = {
    "trigger_windows": """WITH r AS (SELECT event_id AS id, ['gap', 'question_cluster', 'contested', 'hint_cluster', 'edge', 'novelty', 'long_episode'][event_id % 7 + 1] AS trigger, epoch_us(ts) // 1000 AS s, epoch_us(ts) // 1000 + (1 + event_id % 40) * 1000 AS e FROM events WHERE event_id % 9 = 0),
 g AS (SELECT *, least(CASE WHEN trigger IN ('gap', 'question_cluster', 'hint_cluster') THEN 8000 WHEN trigger IN ('edge', 'novelty') THEN 6000 ELSE 12000 END, e - s) AS length, CASE WHEN trigger IN ('gap', 'question_cluster', 'hint_cluster') THEN 4000 WHEN trigger IN ('edge', 'novelty') THEN 3000 ELSE 9000 END AS hop, CASE WHEN trigger IN ('gap', 'question_cluster', 'hint_cluster') THEN 2000 ELSE 0 END AS phase FROM r)
 SELECT id, trigger, s, e, start, length FROM (SELECT *, unnest(range(s + phase, e - length + 1, hop)) AS start FROM g) UNION SELECT id, trigger, s, e, e - length, length FROM g""",
    "clipped_spans": "SELECT * FROM (SELECT user_id AS media, event_id AS id, greatest(epoch_us(ts) // 1000 % 90000000 - 20000000, 0) AS s, least(epoch_us(ts) // 1000 % 90000000 - 5000000, 60000000) AS e FROM events) WHERE e > s",
    "midpoint_labels": f"""WITH {pe._W}, t AS (SELECT media, s AS t, 1 AS d FROM w UNION ALL SELECT media, e, -1 FROM w), g AS (SELECT media, t, sum(d) AS d FROM t GROUP BY ALL), p AS (SELECT media, t AS s, lead(t) OVER x AS e, sum(d) OVER x AS n FROM g WINDOW x AS (PARTITION BY media ORDER BY t))
 SELECT p.media, p.s, p.e, coalesce(string_agg(DISTINCT m.work, ',' ORDER BY m.work), '') AS labels FROM p LEFT JOIN m ON m.media = p.media AND (p.s + p.e) // 2 >= m.s AND (p.s + p.e) // 2 < m.e WHERE p.e IS NOT NULL AND n > 0 GROUP BY p.media, p.s, p.e""",
    "fused_shares": """WITH v AS (SELECT vec_id, embedding AS e, list_transform(embedding, lambda x: least(1.0::DOUBLE, greatest(0.0::DOUBLE, x::DOUBLE)) ** 2) AS q, vec_id % 64 AS a, vec_id * 7 % 64 AS b, vec_id % 3 <> 0 AND vec_id % 64 <> vec_id * 7 % 64 AS has FROM embeddings),
 h AS (SELECT *, CASE WHEN list_sum(q) > 0 THEN list_transform(q, lambda x: x / list_sum(q)) ELSE q END AS h, CASE WHEN has AND e[a + 1]::DOUBLE >= 0.05 THEN 0.6::DOUBLE ELSE 0.0::DOUBLE END AS wa, CASE WHEN has AND e[b + 1]::DOUBLE >= 0.05 THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END AS wb FROM v),
 n AS (SELECT *, CASE WHEN wa + wb > 0 THEN wa / (wa + wb) ELSE 0.0::DOUBLE END AS sa, CASE WHEN wa + wb > 0 THEN wb / (wa + wb) ELSE 0.0::DOUBLE END AS sb, CASE WHEN wa + wb > 0 THEN 0.8::DOUBLE ELSE 0.0::DOUBLE END AS w FROM h),
 f AS (SELECT *, list_transform(range(64), lambda i: round((h[i + 1] + w * (CASE WHEN i = a THEN sa WHEN i = b THEN sb ELSE 0.0::DOUBLE END)) / (1 + w), 9)) AS f, list_transform(h, lambda x: round(x, 9)) AS hr FROM n),
 t AS (SELECT *, list_position(hr, list_max(hr)) - 1 AS heard, CASE WHEN round(sa, 9) >= round(sb, 9) THEN a ELSE b END AS best FROM f)
 SELECT vec_id, CAST(list_position(f, list_max(f)) - 1 AS INTEGER) AS top, list_max(f) AS share, CASE WHEN w = 0 THEN 'heard-only' WHEN best = heard THEN 'agree' WHEN (heard = a AND sa > 0) OR (heard = b AND sb > 0) THEN 'partial' ELSE 'disagree' END AS agreement FROM t""",
    "canonical_urls": f"""WITH u AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN upper(url) || '/?utm_source=a&b=1#x' WHEN 1 THEN url || '?si=1' WHEN 2 THEN 'ftp://x/y' ELSE url END AS u FROM pages),
 q AS (SELECT *, list_filter(string_split(substr({_U(6)}, 2), '&'), lambda q: q <> '' AND NOT regexp_matches(q, '(?i)^(utm_[a-z]+|fbclid|gclid|si|feature)(=|$)')) AS q FROM u)
 SELECT page_id, CASE WHEN regexp_matches(u, '{_P}') THEN lower({_U(1)}) || '://' || lower({_U(3)}) || CASE WHEN (lower({_U(1)}) = 'http' AND {_U(4)} = ':80') OR (lower({_U(1)}) = 'https' AND {_U(4)} = ':443') THEN '' ELSE {_U(4)} END || regexp_replace({_U(5)}, '/+$', '') || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END ELSE '' END AS url FROM q""",
    "calibrated_tiers": f"""WITH b AS (SELECT least(n_chars // 300, 20) AS bin, sum(quality) AS g, count(*) AS t FROM {_SC} WHERE lang = 'en' GROUP BY 1), m AS (SELECT lo.bin AS l, hi.bin AS h, (SELECT sum(g) / sum(t) FROM b WHERE bin BETWEEN lo.bin AND hi.bin) AS m FROM b lo JOIN b hi ON lo.bin <= hi.bin),
 f AS (SELECT bin, CAST(floor(max(x) * 10000 + 1e-9) AS BIGINT) AS fit FROM (SELECT b.bin, l, min(m) AS x FROM b JOIN m ON l <= b.bin AND h >= b.bin GROUP BY b.bin, l) GROUP BY bin),
 t AS (SELECT (SELECT min(bin) FROM f WHERE fit >= 7000) AS p, (SELECT min(bin) FROM f WHERE fit >= 9000) AS l, (SELECT min(bin) FROM f WHERE fit >= 9900) AS v)
 SELECT CASE WHEN least(n_chars // 300, 20) >= v THEN 'verified' WHEN least(n_chars // 300, 20) >= l THEN 'likely' WHEN least(n_chars // 300, 20) >= p THEN 'possible' ELSE 'unclear' END AS tier, count(*) AS n FROM documents, t GROUP BY 1""",
    "generation_loop": f"""WITH {pe._W}, r AS (SELECT * FROM w UNION ALL SELECT * REPLACE (-id AS id, true AS is_final, 'match' AS status) FROM w a WHERE status = 'error' AND NOT EXISTS (SELECT 1 FROM w b WHERE b.status = 'match' AND b.media = a.media AND b.trial = a.trial) AND EXISTS (SELECT 1 FROM m WHERE m.media = a.media)),
 m2 AS (SELECT * FROM r WHERE is_final AND status = 'match'), {_PLAYS}, sup AS ({pe._islands('SELECT * FROM v', 'media, candidate, occurrence')})
 SELECT candidate, count(DISTINCT (media, occurrence)) AS plays, CAST(sum(e - s) AS BIGINT) AS on_air, 'no_requests' AS stopped FROM sup GROUP BY 1""",
}
