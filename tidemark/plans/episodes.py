"""Queries over votes, hints and episodes; events stand in for windows, their
answers and listeners' hints, users for recordings. Times are milliseconds."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import episodes as ep
from tidemark.runtime import read_table, table

MIN = 60_000
HOUR = 60 * MIN
#: Width of a support, what parts two plays, and the limits of tiers and hints.
W, GAP, FLOOR, APART, LIKELY, POSSIBLE, LEAD, TRAIL = 8 * HOUR, 24 * HOUR, 2 * HOUR, 12 * HOUR, 20 * HOUR, 12 * HOUR, 3 * HOUR, 90 * MIN
BUCKET = 12 * HOUR
#: Holes of a run, what an unbroken core and a scattered hull last, and what an
#: answer at an episode's edge may reach into.
RUN_GAP, CORE, SCATTER, EDGE, EDGE_LEAST = 6 * HOUR, 12 * HOUR, 40 * HOUR, HOUR, 16 * HOUR
#: Questions of a cluster, and how far apart.
ASKED, REACH = 3, 24 * HOUR
#: Milliseconds of a recording in one of its anchors', and of a reference.
ANCHOR, REFERENCE = 20_000, 100_000
COMMERCIAL = ["beta", "gamma"]


def windows(spark, d):
    """Every event as a window with its answer."""
    i, kind = F.col("event_id"), F.col("event_type")
    s = F.expr("unix_micros(ts) div 1000")
    provider = F.element_at(F.array(*map(F.lit, ("alpha", "beta", "gamma"))), (i % 3 + 1).cast("int"))
    return read_table(spark, d, "events").select(
        F.col("user_id").alias("media"),
        kind.alias("candidate"),
        F.when(kind.isin("view", "click"), "browse").when(kind.isin("purchase", "signup"), "buy").otherwise("fault").alias("work"),
        i.alias("id"),
        provider.alias("provider"),
        F.when(i % 3 == 0, "A").when(i % 3 == 1, "B").otherwise("C").alias("family"),
        s.alias("s"),
        (s + W).alias("e"),
        F.expr(f"(unix_micros(ts) div 1000) div {4 * HOUR}").alias("trial"),
        (i % 7 != 0).alias("is_final"),
        F.when(i % 9 == 0, "no_match").when(i % 11 == 0, "error").otherwise("match").alias("status"),
        (i % 5 != 0).alias("reliable"),
        ((i % 3 == 0) | (i % 5 == 0)).alias("vague"),
        F.expr(f"unix_micros(ts) div {1000 * ANCHOR}").alias("mix"),
        # a few anchors are off by seven seconds
        (F.expr(f"unix_micros(ts) div {1000 * ANCHOR} % {REFERENCE}") + F.when(i % 31 == 0, 7000).otherwise(0)).alias("ref"),
        F.lit(10_000).cast("long").alias("rate"),
    )


def hints(spark, d):
    """Every fourth event as a hint a while after it; some have no position."""
    i = F.col("event_id")
    s = F.expr("unix_micros(ts) div 1000")
    kinds = F.array(*map(F.lit, ("tracklist_line", "answer", "question", "correction")))
    placed = i % 19 != 0
    return read_table(spark, d, "events").where("event_id % 4 = 1").select(
        F.col("user_id").alias("media"),
        F.when(i % 3 == 0, "browse").when(i % 3 == 1, "buy").otherwise("fault").alias("work"),
        i.alias("id"),
        F.element_at(kinds, (F.expr("event_id div 4") % 4 + 1).cast("int")).alias("kind"),
        (i % 10 != 3).alias("verified"),
        (i % 17 == 0).alias("id_unknown"),
        F.when(placed, s + 2 * HOUR).alias("s"),
        F.when(placed, s + 3 * HOUR).alias("e"),
        F.expr("event_id div 4 % 6").alias("group"),
        (i % 29 == 0).alias("trusted"),
        (5000 + i % 4000).alias("confidence"),
    )


def _aligned(spark, d):
    """Votes with their plays, and the plays' lines."""
    return ep.aligned_plays(ep.final_matches(windows(spark, d)), "mix", "mix", "ref", "rate", BUCKET)


def _supported(aligned):
    """(votes, lines, supports), these written once: each step reads them anew."""
    return *aligned, table(ep.supports(aligned[0]), "supports")


def _played(spark, d):
    return _aligned(spark, d)[0]


def _identity(spark, d):
    """Recordings that two services name are supported; some views are contested."""
    m = ep.final_matches(windows(spark, d)).groupBy("media", "candidate").agg((F.countDistinct("provider") >= 2).alias("supported"))
    return m.withColumn("contested", (F.col("media") % 13 == 0) & (F.col("candidate") == "view"))


def _fused(spark, d, votes, lines, sup):
    return ep.episodes(votes, lines, hints(spark, d), _identity(spark, d), COMMERCIAL, FLOOR, APART, LIKELY, POSSIBLE, LEAD, TRAIL, RUN_GAP, CORE, BUCKET, sup)


def _episodes(spark, d):
    """Written once: what follows reads it from several sides."""
    return table(_fused(spark, d, *_supported(_aligned(spark, d))), "episodes")


def _judged(spark, d, supported=None):
    """(episodes with why they aren't listed, supports), of one alignment."""
    supported = supported or _supported(_aligned(spark, d))
    answers = hints(spark, d).where("kind in ('answer', 'correction') and verified and not id_unknown")
    sup = supported[2]
    return ep.suppressed(table(_fused(spark, d, *supported), "episodes"), sup, answers, RUN_GAP, CORE, SCATTER, 2, EDGE, EDGE_LEAST, BUCKET), sup


def _suppressed(spark, d):
    return _judged(spark, d)[0]


def _named(df):
    return df.withColumn("id", F.concat_ws("/", "candidate", "occurrence"))


def _listed(spark, d):
    return table(_named(_suppressed(spark, d).where("suppressed is null")), "suppressed")


def q_final(spark, d):
    w = windows(spark, d)
    a, b = (f(w).groupBy("media", "provider").agg(F.count("*").alias(n)) for f, n in ((ep.final_matches, "matches"), (ep.anchored, "anchored")))
    return a.join(b, ["media", "provider"], "left").select("media", "provider", "matches", F.coalesce("anchored", F.lit(0)).alias("anchored"))


def q_ambiguous(spark, d):
    """Lines of an order as the recordings that an answer lists."""
    li = read_table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("listed"), F.array(F.max("l_partkey"), F.min("l_suppkey")).alias("reported"), (F.max("l_quantity") > 49).alias("reliable"))
    li = li.withColumn("reported", F.when(F.col("l_orderkey") % 2 == 0, F.array(F.lit(-1).cast("long"))).otherwise(F.col("reported")))
    return li.select("l_orderkey", ep.ambiguous(F.col("listed"), F.col("reported"), F.col("reliable")).alias("ambiguous"))


def q_confident(spark, d):
    e = _episodes(spark, d)
    flag = lambda c, n: F.when(c, F.lit(n))
    flags = F.array_compact(F.array(flag(F.col("hints") > 0, "hint_supported"), flag(F.col("agreements") > 0, "engine_corroborated"), flag(F.col("rivals") > 0, "competing")))
    return e.groupBy("tier", ep.confident(F.col("tier"), flags).alias("confident")).agg(F.count("*").alias("n"))


def q_hidden(spark, d):
    e = _suppressed(spark, d)
    why = ep.hidden_reason(F.lit("track"), F.col("suppressed"), F.col("tier"), (F.col("hints") > 0) | F.col("separated"), F.col("on_air"), 10 * HOUR)
    return e.groupBy(F.coalesce(why, F.lit("listed")).alias("reason")).agg(F.count("*").alias("n"), F.sum("on_air").alias("on_air"))


def q_strata(spark, d):
    s = F.element_at(F.array(*map(F.lit, (" Hard-ID", "long-blend", "controlled", "Reference-Pool ", "synth"))), (F.col("n_nationkey") % 5 + 1).cast("int"))
    return read_table(spark, d, "nation").select("n_nationkey", ep.certifiable(s).alias("certifiable"))


def q_eligible(spark, d):
    return ep.eligible(hints(spark, d)).groupBy("kind").agg(F.count("*").alias("n"))


def q_bounds(spark, d):
    return ep.proved_bounds(_played(spark, d), ep.PLAY, "s", "e")


def q_overlaps(spark, d):
    h = ep.hulls(ep.supports(_played(spark, d))).withColumn("id", F.concat_ws("/", "candidate", "occurrence"))
    return ep.hull_overlaps(h, BUCKET).select("media", "id", F.concat_ws(",", "overlaps").alias("overlaps"))


def q_agreements(spark, d):
    return ep.work_agreements(ep.final_matches(windows(spark, d)), FLOOR, BUCKET)


def q_backed(spark, d):
    return ep.backed_plays(hints(spark, d), ep.supports(_played(spark, d)), LEAD, TRAIL)


def _shown(df):
    return df.withColumn("flags", F.concat_ws(",", "flags"))


def q_episodes(spark, d):
    return _shown(_fused(spark, d, *_supported(_aligned(spark, d))))


def q_suppressed(spark, d):
    return _suppressed(spark, d).select(*ep.PLAY, "suppressed")


def _gapped(spark, d, supported=None):
    """(listed episodes, gaps), of one alignment."""
    judged, sup = _judged(spark, d, supported)
    judged = table(_named(judged), "suppressed")
    unclear = sup.join(judged.where("badge = 'unclear'").select(*ep.PLAY).hint("merge"), ep.PLAY)
    listed = judged.where("suppressed is null")
    return listed, ep.gaps(windows(spark, d), listed, hints(spark, d), unclear, _points(spark, d), HOUR, BUCKET)


def q_gaps(spark, d):
    return _gapped(spark, d)[1]


def _points(spark, d):
    """Events of high value as change points, and their recording's last end."""
    w = windows(spark, d)
    last = w.groupBy("media").agg(F.max("e").alias("duration"))
    p = read_table(spark, d, "events").where("value >= 90").select(F.col("user_id").alias("media"), F.expr("unix_micros(ts) div 1000").alias("at"))
    return p.join(last, "media")


def q_novelty(spark, d):
    return ep.novelty_regions(_points(spark, d), ["media"], "at", "duration", HOUR)


def _requests(spark, d):
    supported = _supported(_aligned(spark, d))
    used = ep.backed_plays(hints(spark, d), supported[2], LEAD, TRAIL).select("media", F.col("hint").alias("id"))
    loose = ep.eligible(hints(spark, d)).join(used, ["media", "id"], "left_anti")
    listed, gaps = _gapped(spark, d, supported)
    return ep.rescan_requests(listed, gaps, q_novelty(spark, d), loose, ep.question_clusters(hints(spark, d), REACH, ASKED), 20 * MIN, 30 * HOUR)


def q_alignment(spark, d):
    """How each anchor continues its candidate's line."""
    a = ep.anchored(windows(spark, d))
    return ep.tl.align(a, ["media", "candidate"], "id", "mix", "ref", "rate").withColumn("segment", F.coalesce("segment", F.lit(-1)))


def q_requests(spark, d):
    return _requests(spark, d)


def q_unscanned(spark, d):
    """Requests on a grid of ten minutes, without the windows that began there."""
    ten = 10 * MIN
    grid = lambda c: F.expr(f"{c} div {ten} * {ten}")
    r = _requests(spark, d).where("trigger <> 'gap'").select("media", "trigger", grid("s").alias("s"), grid("e").alias("e")).distinct()
    seen = windows(spark, d).select("media", grid("s").alias("at"))
    return ep.unscanned(r, 2 * ten, ten, seen)


def _clusters(spark, d, listed):
    c = ep.hint_clusters(hints(spark, d), listed.where("tier = 'likely'"), BUCKET)
    return ep.ranked_works(c, ["media", "cluster"])


def q_clusters(spark, d):
    return _clusters(spark, d, _listed(spark, d))


QUERIES = {
    "final_and_anchored": q_final,
    "ambiguous_votes": q_ambiguous,
    "confident_episodes": q_confident,
    "hidden_reasons": q_hidden,
    "certification_strata": q_strata,
    "eligible_hints": q_eligible,
    "proved_bounds": q_bounds,
    "hull_overlaps": q_overlaps,
    "work_agreements": q_agreements,
    "hint_backed_plays": q_backed,
    "episodes": q_episodes,
    "alignment_segments": q_alignment,
    "episode_suppression": q_suppressed,
    "episode_gaps": q_gaps,
    "novelty_regions": q_novelty,
    "rescan_requests": q_requests,
    "unscanned_requests": q_unscanned,
    "ranked_crowd_works": q_clusters,
}


def _islands(src: str, keys: str, gap: int = 0) -> str:
    return f"""SELECT {keys}, min(s) AS s, max(e) AS e FROM (SELECT *, sum(CASE WHEN pe IS NULL OR s - pe > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS isl
 FROM (SELECT *, max(e) OVER (PARTITION BY {keys} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM ({src}))) GROUP BY {keys}, isl"""


_P = "media, candidate, occurrence"
_W = f"""w AS (SELECT user_id AS media, event_type AS candidate, CASE WHEN event_type IN ('view', 'click') THEN 'browse' WHEN event_type IN ('purchase', 'signup') THEN 'buy' ELSE 'fault' END AS work, event_id AS id,
 ['alpha', 'beta', 'gamma'][event_id % 3 + 1] AS provider, ['A', 'B', 'C'][event_id % 3 + 1] AS family, epoch_us(ts) // 1000 AS s, epoch_us(ts) // 1000 + {W} AS e, epoch_us(ts) // 1000 // {4 * HOUR} AS trial, event_id % 7 <> 0 AS is_final,
 CASE WHEN event_id % 9 = 0 THEN 'no_match' WHEN event_id % 11 = 0 THEN 'error' ELSE 'match' END AS status, event_id % 5 <> 0 AS reliable,
 epoch_us(ts) // {1000 * ANCHOR} AS mix, epoch_us(ts) // {1000 * ANCHOR} % {REFERENCE} + CASE WHEN event_id % 31 = 0 THEN 7000 ELSE 0 END AS ref, event_id % 3 = 0 OR event_id % 5 = 0 AS vague FROM events),
 m AS (SELECT * FROM w WHERE is_final AND status = 'match'),
 h AS (SELECT user_id AS media, ['browse', 'buy', 'fault'][event_id % 3 + 1] AS work, event_id AS id, ['tracklist_line', 'answer', 'question', 'correction'][event_id // 4 % 4 + 1] AS kind, event_id % 10 <> 3 AS verified, event_id % 17 = 0 AS id_unknown,
 CASE WHEN event_id % 19 <> 0 THEN epoch_us(ts) // 1000 + {2 * HOUR} END AS s, CASE WHEN event_id % 19 <> 0 THEN epoch_us(ts) // 1000 + {3 * HOUR} END AS e, event_id // 4 % 6 AS grp, event_id % 29 = 0 AS trusted, 5000 + event_id % 4000 AS confidence FROM events WHERE event_id % 4 = 1),
 he AS (SELECT * FROM h WHERE kind IN ('tracklist_line', 'answer', 'correction') AND verified AND NOT id_unknown)"""
#: Anchors as the query makes them lie on lines of rate one, so `off` tells the line; no window of three has another rate.
_ALIGN = f"""pa AS (SELECT *, mix - ref AS off, row_number() OVER x AS i, lead(mix - ref) OVER x AS noff, mix - lag(mix) OVER x AS gap FROM m WHERE reliable WINDOW x AS (PARTITION BY media, candidate ORDER BY mix, id)),
 st AS (SELECT media, candidate, i, id, off AS line, ref AS low, ref AS high, 0::BIGINT AS play, 0::BIGINT AS segment, 'start' AS decision FROM pa WHERE i = 1 UNION ALL
 SELECT media, candidate, i, id, CASE WHEN stays THEN line ELSE off END, CASE WHEN decision = 'continuation' THEN least(low, ref) WHEN decision = 'outlier' THEN low ELSE ref END, CASE WHEN decision = 'continuation' THEN greatest(high, ref) WHEN decision = 'outlier' THEN high ELSE ref END,
  play + CAST(decision = 'replay' AS BIGINT), segment + CAST(NOT stays AS BIGINT), decision FROM (SELECT *, decision IN ('continuation', 'outlier') AS stays FROM (SELECT *, CASE WHEN fits AND gap <= 120000 AND (gap <= 30000 OR NOT again) THEN 'continuation'
   WHEN again AND high - ref > 2000 AND gap <= 30000 THEN 'loop' WHEN abs(ref) <= 5000 AND high > 7000 THEN 'reset' WHEN gap > 30000 AND (again OR NOT fits) THEN 'replay' WHEN NOT fits AND noff = off THEN 'jump' WHEN noff = line THEN 'outlier' ELSE 'pending' END AS decision
   FROM (SELECT pa.*, st.line, st.low, st.high, st.play, st.segment, pa.off = st.line AS fits, pa.ref BETWEEN st.low - 1500 AND st.high + 1500 AS again FROM st JOIN pa ON pa.media = st.media AND pa.candidate = st.candidate AND pa.i = st.i + 1))))"""
_V = f"""{_W}, {_ALIGN}, ap AS (SELECT pa.media, pa.candidate, pa.id, pa.trial, pa.s, pa.e, pa.mix, st.play, st.segment, st.decision FROM pa JOIN st USING (media, candidate, i)),
 v AS (SELECT m.*, coalesce((SELECT max(play) FROM ap WHERE ap.media = m.media AND ap.candidate = m.candidate AND ap.id = m.id), (SELECT max(play) FROM ap WHERE ap.media = m.media AND ap.candidate = m.candidate AND ap.trial = m.trial),
  (SELECT arg_min(play, (abs(ap.mix - m.mix), play)) FROM ap WHERE ap.media = m.media AND ap.candidate = m.candidate), 0) AS occurrence FROM m),
 sup AS ({_islands('SELECT * FROM v', f'{_P}, work')}),
 hull AS (SELECT {_P}, work, min(s) AS s, max(e) AS e, CAST(sum(e - s) AS BIGINT) AS on_air, list({{'s': s, 'e': e}} ORDER BY s) AS spans FROM sup GROUP BY ALL)"""
_AG = f"""ag AS (SELECT DISTINCT a.media, a.work, greatest(a.s, b.s) AS s, least(a.e, b.e) AS e FROM m a JOIN m b ON a.media = b.media AND a.work = b.work AND a.family < b.family AND a.s < b.e AND b.s < a.e WHERE least(a.e, b.e) - greatest(a.s, b.s) >= {FLOOR})"""
_BK = f"""bj AS (SELECT hull.*, he.id AS hint, he.s AS hs, he.e AS he, list_sum(list_transform(spans, lambda x: greatest(0, least(he.e, x.e) - greatest(he.s, x.s)))) AS ov FROM he JOIN hull ON he.media = hull.media AND he.work = hull.work WHERE he.s IS NOT NULL),
 br AS (SELECT *, row_number() OVER (PARTITION BY media, hint ORDER BY CASE WHEN ov > 0 THEN 0 ELSE 1 END, CASE WHEN ov > 0 THEN -ov WHEN least(he, e) > greatest(hs, s) THEN 0 ELSE 1 END, -on_air, CASE WHEN ov > 0 THEN 0 ELSE least(abs(s - he), abs(hs - e)) END, s, candidate, occurrence) AS r
 FROM bj WHERE ov > 0 OR least(he, e + {TRAIL}) > greatest(hs, s - {LEAD})),
 bk AS (SELECT media, hint, candidate, occurrence, ov > 0 AS direct FROM br WHERE r = 1 UNION ALL
 SELECT he.media, he.id, candidate, occurrence, false FROM he JOIN (SELECT media, work, min(candidate) AS candidate, min(occurrence) AS occurrence FROM hull GROUP BY media, work HAVING count(*) = 1) AS o ON he.media = o.media AND he.work = o.work WHERE he.s IS NULL)"""


def _tier(t: str) -> str:
    return f"CASE WHEN {t} >= 40000 AND e - s >= {LIKELY} AND rivals = 0 AND aligned THEN 'likely' WHEN {t} >= 20000 AND e - s >= {POSSIBLE} AND rivals = 0 THEN 'possible' ELSE 'unclear' END"


_EP = f"""WITH RECURSIVE {_V}, {_AG}, {_BK},
 own AS (SELECT {_P}, min(e) AS start_bound, max(s) AS end_bound, count(*) AS votes, 2 * count(*) FILTER (vague) > count(*) AS half FROM v GROUP BY ALL),
 wh AS (SELECT media, candidate, sum(e - s) AS n FROM ({_islands('SELECT * FROM ap', 'media, candidate')}) GROUP BY ALL), sg AS (SELECT media, candidate, segment, sum(e - s) AS n FROM ({_islands("SELECT * FROM ap WHERE decision <> 'outlier'", 'media, candidate, segment')}) GROUP BY ALL),
 ln AS (SELECT a.media, a.candidate, a.play AS occurrence, coalesce(max(least(10000, (sg.n * 20000 + wh.n) // (2 * wh.n))) FILTER (decision <> 'outlier'), 0) >= 8000 AS aligned, count(DISTINCT a.segment) FILTER (decision <> 'outlier') AS segments, count(*) FILTER (decision = 'outlier') AS outliers FROM ap a JOIN wh USING (media, candidate) LEFT JOIN sg ON sg.media = a.media AND sg.candidate = a.candidate AND sg.segment = a.segment AND decision <> 'outlier' GROUP BY ALL),
 cl AS (SELECT DISTINCT {_P} FROM ({_islands('SELECT * FROM v WHERE NOT vague', _P, RUN_GAP - 1)}) WHERE e - s >= {CORE}),
 ide AS (SELECT media, candidate, count(DISTINCT provider) >= 2 AS supported, media % 13 = 0 AND candidate = 'view' AS contested FROM m GROUP BY ALL),
 pv AS (SELECT {_P}, provider, row_number() OVER (PARTITION BY {_P} ORDER BY count(*) DESC, provider) AS r FROM v WHERE provider IN ('beta', 'gamma') GROUP BY {_P}, provider),
 th AS (SELECT *, row_number() OVER (PARTITION BY {_P} ORDER BY e, s, trial) AS r FROM (SELECT v.media, v.candidate, v.occurrence, trial, min(s) AS s, max(e) AS e, CASE WHEN bool_and(coalesce(pv.r > 1, false)) THEN 5000 ELSE 10000 END AS wt FROM v LEFT JOIN pv ON v.media = pv.media AND v.candidate = pv.candidate AND v.occurrence = pv.occurrence AND v.provider = pv.provider GROUP BY ALL)),
 tg AS (SELECT {_P}, 1::BIGINT AS r FROM th WHERE r = 1 UNION ALL SELECT * FROM (SELECT g.media, g.candidate, g.occurrence, (SELECT min(n.r) FROM th n WHERE n.media = g.media AND n.candidate = g.candidate AND n.occurrence = g.occurrence AND n.s >= c.e) AS r FROM tg g JOIN th c ON c.media = g.media AND c.candidate = g.candidate AND c.occurrence = g.occurrence AND c.r = g.r) WHERE r IS NOT NULL),
 tr AS (SELECT {_P}, CAST(sum(wt) AS BIGINT) AS trials_e4 FROM tg JOIN th USING (media, candidate, occurrence, r) GROUP BY ALL),
 al AS ({_islands('SELECT * FROM v', 'media, candidate')}),
 ro AS (SELECT sup.media, sup.candidate, sup.occurrence, al.candidate AS o, sum(least(sup.e, al.e) - greatest(sup.s, al.s)) AS n FROM sup JOIN al ON sup.media = al.media AND sup.candidate <> al.candidate AND sup.s < al.e AND al.s < sup.e GROUP BY ALL),
 rv AS (SELECT ro.media, ro.candidate, ro.occurrence, count(*) AS rivals FROM ro JOIN hull ON ro.media = hull.media AND ro.candidate = hull.candidate AND ro.occurrence = hull.occurrence WHERE 2 * n >= on_air GROUP BY ALL),
 mt AS (SELECT {_P}, count(*) AS agreements, count(*) >= 2 AND max(gs) - min(gs) >= {APART} AS separated FROM (SELECT DISTINCT sup.media, sup.candidate, sup.occurrence, ag.s AS gs, ag.e AS ge FROM sup JOIN ag ON sup.media = ag.media AND sup.work = ag.work AND sup.s < ag.e AND ag.s < sup.e) GROUP BY ALL),
 bn AS (SELECT {_P}, count(*) AS hints, bool_or(direct) AS direct FROM bk GROUP BY ALL),
 e0 AS (SELECT {_P}, work, s, e, on_air, start_bound, end_bound, votes, trials_e4, coalesce(aligned, false) AS aligned, coalesce(segments, 0) AS segments, coalesce(outliers, 0) AS outliers, half AND cl.media IS NULL AS ambiguous, supported, contested, coalesce(rivals, 0) AS rivals, coalesce(agreements, 0) AS agreements, coalesce(separated, false) AS separated, coalesce(hints, 0) AS hints, coalesce(direct, false) AS direct
 FROM hull JOIN own USING ({_P}) JOIN tr USING ({_P}) LEFT JOIN rv USING ({_P}) LEFT JOIN mt USING ({_P}) LEFT JOIN bn USING ({_P}) LEFT JOIN ln USING ({_P}) LEFT JOIN cl USING ({_P}) JOIN ide USING (media, candidate)),
 e1 AS (SELECT *, {_tier('trials_e4')} AS audio_tier, {_tier('(trials_e4 + CASE WHEN hints > 0 THEN 10000 ELSE 0 END)')} AS tier FROM e0),
 e2 AS (SELECT *, CASE WHEN supported AND NOT contested THEN audio_tier ELSE 'unclear' END AS version_tier, CASE WHEN aligned THEN 'possible' ELSE 'unclear' END AS boundary_tier,
  concat_ws(',', CASE WHEN contested THEN 'contested_identity' END, CASE WHEN outliers > 0 THEN 'alignment_outlier' END, CASE WHEN hints > 0 THEN 'hint_supported' END, CASE WHEN agreements > 0 THEN 'engine_corroborated' END, CASE WHEN separated THEN 'engine_corroborated_separated' END, CASE WHEN ambiguous THEN 'ambiguous_evidence' END) AS flags FROM e1),
 ep AS (SELECT * EXCLUDE (ambiguous, supported, contested), CASE WHEN contested THEN 'contested' WHEN version_tier = 'verified' THEN 'verified' ELSE 'unverified' END AS version_status, CASE WHEN tier = 'verified' AND version_tier <> 'verified' THEN 'likely' ELSE tier END AS badge FROM e2)"""
_SU = f"""{_EP}, lc AS (SELECT {_P}, max(e - s) AS core FROM sup GROUP BY ALL),
 fa AS (SELECT ep.*, core, e - s >= {SCATTER} AND e - s >= 2 * on_air AS scattered, CASE WHEN on_air >= {EDGE_LEAST} THEN {EDGE} ELSE 0 END AS cut, contains(flags, 'ambiguous_evidence') AND hints = 0 AND agreements = 0 AS vague FROM ep JOIN lc USING ({_P})),
 fb AS (SELECT *, CASE WHEN scattered THEN 'scatter' WHEN EXISTS (SELECT 1 FROM he WHERE he.kind IN ('answer', 'correction') AND he.s IS NOT NULL AND he.media = fa.media AND he.work <> fa.work AND ((he.kind = 'correction' AND he.e > fa.s AND he.s < fa.e) OR (he.e > fa.s + cut AND he.s < fa.e - cut AND fa.s + cut < fa.e - cut))) THEN 'contradicted' END AS fault FROM fa),
 im AS (SELECT *, (tier = 'likely' AND NOT (hints > 0 AND NOT direct AND audio_tier <> 'likely') AND (core >= {CORE} OR NOT scattered)) OR separated OR (hints > 0 AND (direct OR fault IS NULL)) AS immune FROM fb), ru AS ({_islands('SELECT * FROM sup', _P, RUN_GAP - 1)}),
 cv AS (SELECT ru.media, ru.s AS rs, ru.e AS re, im.s AS os, im.e AS oe FROM ru JOIN im USING ({_P}) WHERE immune AND NOT vague),
 pt AS (SELECT im.media, im.candidate, im.occurrence, greatest(im.s, rs) AS s, least(im.e, re) AS e FROM im JOIN cv ON im.media = cv.media AND im.s < re AND rs < im.e AND (im.s <> os OR im.e <> oe) WHERE NOT immune),
 hd AS (SELECT {_P}, sum(e - s) AS hid FROM ({_islands('SELECT * FROM pt', _P)}) GROUP BY ALL),
 su AS (SELECT im.*, CASE WHEN vague THEN 'ambiguous' WHEN NOT immune THEN coalesce(fault, CASE WHEN 10 * hid >= 6 * (e - s) THEN 'buried' END) END AS suppressed FROM im LEFT JOIN hd USING ({_P})),
 li AS (SELECT *, candidate || '/' || occurrence AS id FROM su WHERE suppressed IS NULL)"""
_GP = f"""{_SU}, ev AS (SELECT media, s AS t, 1 AS l, 0 AS r FROM w UNION ALL SELECT media, e, -1, 0 FROM w UNION ALL SELECT media, s, 0, 1 FROM li UNION ALL SELECT media, e, 0, -1 FROM li),
 eg AS (SELECT media, t, sum(l) AS l, sum(r) AS r FROM ev GROUP BY ALL), es AS (SELECT media, t AS s, lead(t) OVER x AS e, sum(l) OVER x AS l, sum(r) OVER x AS r FROM eg WINDOW x AS (PARTITION BY media ORDER BY t)),
 g0 AS (SELECT * FROM ({_islands('SELECT media, s, e FROM es WHERE e IS NOT NULL AND l > 0 AND r = 0', 'media')}) WHERE e - s >= {HOUR}),
 gp AS (SELECT g.*, (SELECT arg_min(id, (-li.e, id)) FROM li WHERE li.media = g.media AND li.e <= g.s) AS prior, (SELECT arg_min(id, (li.s, id)) FROM li WHERE li.media = g.media AND li.s >= g.e) AS next,
 (SELECT count(*) FROM w WHERE w.media = g.media AND w.s < g.e AND g.s < w.e) AS n_windows, (SELECT count(*) FROM w WHERE w.media = g.media AND w.s < g.e AND g.s < w.e AND status = 'no_match') AS n_no_match,
 (SELECT count(*) FROM w WHERE w.media = g.media AND w.s < g.e AND g.s < w.e AND status = 'error') AS n_error, (SELECT count(*) FROM h WHERE h.media = g.media AND h.s < g.e AND g.s < h.e) AS n_hints,
 (SELECT count(DISTINCT (u.candidate, u.occurrence)) FROM (SELECT sup.* FROM sup JOIN su USING ({_P}) WHERE badge = 'unclear') AS u WHERE u.media = g.media AND u.s < g.e AND g.s < u.e) AS n_unclear,
 (SELECT count(DISTINCT epoch_us(ts) // 1000) FROM events WHERE value >= 90 AND user_id = g.media AND epoch_us(ts) // 1000 BETWEEN g.s AND g.e) AS n_novelty FROM g0 g)"""
_QC = f"""qu AS (SELECT *, row_number() OVER (PARTITION BY media ORDER BY tp, id) AS r FROM (SELECT media, id, s, e, (s + e) // 2 AS tp FROM h WHERE kind = 'question' AND verified AND s IS NOT NULL)), qh AS (SELECT *, max(r) OVER (PARTITION BY media ORDER BY tp RANGE BETWEEN CURRENT ROW AND {REACH} FOLLOWING) AS hi FROM qu),
 qg AS (SELECT media, 1::BIGINT AS r FROM qh WHERE r = 1 UNION ALL SELECT qh.media, CASE WHEN hi - qh.r >= {ASKED - 1} THEN hi + 1 ELSE qh.r + 1 END FROM qg JOIN qh ON qh.media = qg.media AND qh.r = qg.r),
 qc AS (SELECT a.media, min(b.s) AS s, max(b.e) AS e FROM qg JOIN qh a ON a.media = qg.media AND a.r = qg.r AND a.hi - a.r >= {ASKED - 1} JOIN qu b ON b.media = a.media AND b.r BETWEEN a.r AND a.hi GROUP BY a.media, a.r)"""
_NV = f"""pt0 AS (SELECT user_id AS media, epoch_us(ts) // 1000 AS tp FROM events WHERE value >= 90), nv AS ({_islands(f"SELECT pt0.media, greatest(tp - {HOUR}, 0) AS s, least(tp + {HOUR}, (SELECT max(e) FROM w WHERE w.media = pt0.media)) AS e FROM pt0", 'media')})"""
_RQ = f"""{_GP}, {_NV}, {_QC}, rq AS (SELECT media, 'gap' AS trigger, s, e FROM gp UNION SELECT media, 'question_cluster', s, e FROM qc UNION SELECT media, 'contested', s, e FROM li WHERE contains(flags, 'contested_identity') UNION SELECT media, 'edge', greatest(start_bound - {20 * MIN}, 0), start_bound + {20 * MIN} FROM li UNION SELECT media, 'edge', greatest(end_bound - {20 * MIN}, 0), end_bound + {20 * MIN} FROM li
 UNION SELECT media, 'long_episode', s, e FROM li WHERE e - s > {30 * HOUR} UNION SELECT media, 'novelty', s, e FROM nv UNION SELECT media, 'hint_cluster', s, e FROM he WHERE s IS NOT NULL AND NOT EXISTS (SELECT 1 FROM bk WHERE bk.media = he.media AND bk.hint = he.id))"""
_T = 10 * MIN

ORACLE_SQL = {
    "final_and_anchored": f"WITH {_W} SELECT media, provider, count(*) AS matches, count(*) FILTER (reliable) AS anchored FROM m GROUP BY ALL",
    "ambiguous_votes": "SELECT l_orderkey, NOT max(l_quantity) > 49 AND count(DISTINCT l_partkey) >= 2 AND NOT CASE WHEN l_orderkey % 2 = 0 THEN false ELSE list_has_any(list(DISTINCT l_partkey), [max(l_partkey), min(l_suppkey)]) END AS ambiguous FROM lineitem GROUP BY l_orderkey",
    "confident_episodes": f"{_EP} SELECT tier, tier IN ('likely', 'verified') OR hints > 0 OR agreements > 0 AS confident, count(*) AS n FROM ep GROUP BY ALL",
    "hidden_reasons": f"{_SU} SELECT coalesce(suppressed, CASE WHEN tier <> 'likely' AND hints = 0 AND NOT separated AND on_air < {10 * HOUR} THEN 'short' END, 'listed') AS reason, count(*) AS n, CAST(sum(on_air) AS BIGINT) AS on_air FROM su GROUP BY 1",
    "certification_strata": "SELECT n_nationkey, n_nationkey % 5 IN (0, 1, 3) AS certifiable FROM nation",
    "eligible_hints": f"WITH {_W} SELECT kind, count(*) AS n FROM he GROUP BY 1",
    "proved_bounds": f"WITH RECURSIVE {_V} SELECT {_P}, min(e) AS start_bound, max(s) AS end_bound FROM v GROUP BY ALL",
    "hull_overlaps": f"WITH RECURSIVE {_V}, i AS (SELECT *, candidate || '/' || occurrence AS id FROM hull) SELECT a.media, a.id, array_to_string(list_sort(list(b.id)), ',') AS overlaps FROM i a JOIN i b ON a.media = b.media AND a.id <> b.id AND a.s < b.e AND b.s < a.e GROUP BY a.media, a.id",
    "work_agreements": f"WITH {_W}, {_AG} SELECT * FROM ag",
    "hint_backed_plays": f"WITH RECURSIVE {_V}, {_BK} SELECT * FROM bk",
    "episodes": f"{_EP} SELECT * FROM ep",
    "alignment_segments": f"WITH RECURSIVE {_W}, {_ALIGN} SELECT media, candidate, id, decision, play, CASE WHEN decision = 'outlier' THEN -1 ELSE segment END AS segment FROM st",
    "episode_suppression": f"{_SU} SELECT {_P}, suppressed FROM su",
    "episode_gaps": f"{_GP} SELECT * FROM gp",
    "novelty_regions": f"WITH {_W}, {_NV} SELECT * FROM nv",
    "rescan_requests": f"{_RQ} SELECT * FROM rq",
    "unscanned_requests": f"""{_RQ}, r AS (SELECT DISTINCT media, trigger, s // {_T} * {_T} AS s, e // {_T} * {_T} AS e FROM rq WHERE trigger <> 'gap'), p AS (SELECT *, unnest(range(s, e - {2 * _T} + 1, {_T})) AS tp FROM r WHERE e - s >= {2 * _T}),
 z AS (SELECT DISTINCT media, s // {_T} * {_T} AS tp FROM w) SELECT media, trigger, s, e, count(*) AS planned FROM p ANTI JOIN z USING (media, tp) GROUP BY ALL""",
    "ranked_crowd_works": f"""{_SU}, a AS (SELECT * FROM he WHERE kind <> 'tracklist_line' AND e > s AND NOT EXISTS (SELECT 1 FROM li WHERE li.tier = 'likely' AND li.media = he.media AND li.s < he.e AND he.s < li.e)),
 b AS (SELECT *, max(e) OVER (PARTITION BY media ORDER BY s, e, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM a), c AS (SELECT *, CAST(sum(CASE WHEN s >= pe THEN 1 ELSE 0 END) OVER (PARTITION BY media ORDER BY s, e, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cluster FROM b),
 n AS (SELECT media, cluster, work, count(DISTINCT grp) AS groups, max(CAST(trusted AS INTEGER)) AS trusted, max(confidence) AS confidence, min(s) AS s FROM c GROUP BY ALL)
 SELECT *, row_number() OVER (PARTITION BY media, cluster ORDER BY groups DESC, trusted DESC, confidence DESC, s, work) AS rank FROM n""",
}
