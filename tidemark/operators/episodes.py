"""From votes to episodes: plays with their bounds, trials, rivals and
agreements, hints that back them, tiers, suppression, gaps and rescan requests.

Votes are final matches: `(media, candidate, work, id, provider, trial, s, e)`.
Every step keys on the recording (`media`), so recordings fuse side by side.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.exact import overlap_length
from tidemark.operators import evidence as ev
from tidemark.operators import intervals as iv
from tidemark.operators import schedule as sc
from tidemark.operators import timeline as tl
from tidemark.operators.admission import in_whole_groups
from tidemark.operators.rules import badge
from tidemark.runtime import table

PLAY = ["media", "candidate", "occurrence"]
#: What makes a vote a point of its candidate's line.
ANCHORED = "is_final and status = 'match' and reliable"


def final_matches(df: DataFrame) -> DataFrame:
    return df.where("is_final and status = 'match'")


def anchored(df: DataFrame) -> DataFrame:
    """Final matches that an alignment can use: those with a reliable anchor."""
    return df.where(ANCHORED)


def ambiguous(recordings: Column, reported: Column, reliable: Column) -> Column:
    """A vote without a reliable anchor that lists two recordings or more, none
    of them a reported one."""
    return ~reliable & (F.size(recordings) >= 2) & ~F.arrays_overlap(recordings, reported)


def confident(badge: Column, flags: Column) -> Column:
    """A badge of likely or better, or a flag that says that others agree."""
    trusted = F.array(*map(F.lit, ("hint_supported", "hint_only", "engine_corroborated")))
    return badge.isin("likely", "verified") | F.coalesce(F.arrays_overlap(flags, trusted), F.lit(False))


def hidden_reason(kind: Column, suppressed: Column, badge: Column, exempt: Column, on_air: Column, least: int) -> Column:
    """Why a row isn't listed: its suppression, else `short`; null if it is.
    Only tracks are hidden; strong badges and exempt rows are never short."""
    short = F.lit(least > 0) & ~badge.isin("likely", "verified") & ~exempt & (F.coalesce(on_air, F.lit(0)) < least)
    return F.when(kind == "track", F.coalesce(suppressed, F.when(short, "short")))


def certifiable(stratum: Column) -> Column:
    """Whether a stratum is one of the real mixes that certify (fixed values)."""
    return F.lower(F.trim(stratum)).isin("catalogue-covered", "reference-pool", "hard-id", "long-blend", "transition-heavy")


def eligible(hints: DataFrame) -> DataFrame:
    """Hints that may back a play: tracklist lines, answers and corrections of
    verified timelines that name something."""
    return hints.where("kind in ('tracklist_line', 'answer', 'correction') and verified and not id_unknown")


def plays(votes: DataFrame, gap: int) -> DataFrame:
    """Votes with `occurrence` (from 0): a candidate's next play begins over `gap`
    after all its votes so far ended."""
    w = Window.partitionBy("media", "candidate").orderBy("s", "e", "id")
    reach = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = votes.withColumn("_new", F.when(F.col("s") - reach > gap, 1).otherwise(0))
    return d.withColumn("occurrence", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def aligned_plays(votes: DataFrame, centre: str, mix: str, ref: str, rate: str, width: int) -> tuple[DataFrame, DataFrame]:
    """(votes with `occurrence`, lines): plays by the alignment of a candidate's
    anchors. A replay begins a play; a vote without an anchor goes to the last play
    with an anchor of its trial, else to that of the anchor nearest to its `centre`
    (the earlier play of two); a candidate without anchors has one play.

    A candidate's votes pass together, so neither its anchors nor their supports
    are joined back to them; they are written once.

    `lines` are `(media, candidate, occurrence, aligned, segments, outliers)`: a
    play is aligned if a segment of it covers 8,000 ten-thousandths of what all
    anchors of the candidate support."""
    new = T.StructType([T.StructField(n, t) for n, t in (("occurrence", T.LongType()), ("_segment", T.LongType()), ("_outlier", T.BooleanType()), ("_covered", T.LongType()))])
    read = {"_point": F.coalesce(F.expr(f"{ANCHORED} and media is not null and candidate is not null and id is not null and {mix} is not null and {ref} is not null and {rate} is not null"), F.lit(False)), "_centre": F.col(centre)}
    read |= {f"_{n}": F.col(c).cast("long") for n, c in (("mix", mix), ("ref", ref), ("rate", rate))}
    d = in_whole_groups(votes.withColumns(read), ["media", "candidate"], ["_mix", "id"], [*read, "trial", "s", "e"], new, _placed)
    d = table(d.drop(*read), "played")
    lines = d.where("_outlier is not null").groupBy(*PLAY).agg((F.coalesce(F.max("_covered"), F.lit(0)) >= 8000).alias("aligned"), F.countDistinct("_segment").alias("segments"), F.count_if("_outlier").alias("outliers"))
    return d.drop(*new.names[1:]), lines


def _placed(votes: list[tuple]) -> Iterator[tuple]:
    """(occurrence, segment, outlier, covered_e4 of the segment) of a candidate's
    votes (point, centre, mix, ref, rate, trial, s, e), which are in order of mix;
    the last three are null for votes without an anchor."""
    points = [v for v in votes if v[0]]
    decided = list(tl._decided(*zip(*(v[2:5] for v in points), strict=True))) if points else []
    trials: dict[int, int] = {}
    at: list[int] = []
    plays: list[int] = []
    for (_, _, mix, _, _, trial, _, _), (_, play, _) in zip(points, decided, strict=True):
        if trial is not None:
            trials[trial] = max(play, trials.get(trial, play))
        if not at or at[-1] != mix:
            at.append(mix)
            plays.append(play)
    whole = _covered((v[6:8] for v in points))
    parts: dict[int, list[tuple]] = {}
    for v, (_, _, segment) in zip(points, decided, strict=True):
        if segment is not None:
            parts.setdefault(segment, []).append(v[6:8])
    share = {k: min(10_000, (n * 20_000 + whole) // (2 * whole)) for k, x in parts.items() if (n := _covered(x))}
    known = iter(decided)
    for point, centre, _, _, _, trial, _, _ in votes:
        if point:
            what, play, segment = next(known)
            yield play, segment, what == "outlier", share.get(segment)
            continue
        play = trials.get(trial)
        if play is None and at:
            i = bisect_left(at, centre) if centre is not None else 0
            near = [k for k in (i, i - 1) if 0 <= k < len(at)]
            play = min((abs(at[k] - centre), plays[k]) for k in near)[1] if centre is not None else plays[0]
        yield play or 0, None, None, None


def _covered(spans: Iterable[tuple]) -> int:
    """How much time spans cover; those without ends, empty and reversed ones none."""
    total, reach = 0, None
    for s, e in sorted(x for x in spans if None not in x and x[1] > x[0]):
        reach = s if reach is None else max(reach, s)
        total += max(0, e - reach)
        reach = max(reach, e)
    return total


def proved_bounds(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """The latest that each group can have begun and the earliest that it can
    have ended; for a single span the two cross, which is meant."""
    return df.groupBy(*keys).agg(F.min(end).alias("start_bound"), F.max(start).alias("end_bound"))


def supports(played: DataFrame) -> DataFrame:
    """The covered time of each play, as islands, with its work."""
    return iv.islands(played, [*PLAY, "work"], "s", "e").drop("n")


def hulls(sup: DataFrame) -> DataFrame:
    return sup.groupBy(*PLAY, "work").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.sum(F.col("e") - F.col("s")).cast("long").alias("on_air"))


def hull_overlaps(hull: DataFrame, width: int) -> DataFrame:
    """Each episode with the sorted ids of those of its recording whose hulls
    overlap its own, both ways; `hull` is `(media, id, s, e)`."""
    a = hull.select("media", F.col("id").alias("id"), F.col("s").alias("_as"), F.col("e").alias("_ae"))
    b = hull.select("media", F.col("id").alias("other"), F.col("s").alias("_bs"), F.col("e").alias("_be"))
    j = iv.overlap_join(a, b, ["media"], "_as", "_ae", "_bs", "_be", width).where("id <> other")
    return j.groupBy("media", "id").agg(F.array_sort(F.collect_set("other")).alias("overlaps"))


def work_agreements(votes: DataFrame, floor: int, width: int) -> DataFrame:
    """Distinct overlaps of at least `floor` between votes of one work by two
    families: `(media, work, s, e)`."""
    a = votes.select("media", "work", F.col("family").alias("_fa"), F.col("s").alias("_as"), F.col("e").alias("_ae")).distinct()
    b = votes.select("media", "work", F.col("family").alias("_fb"), F.col("s").alias("_bs"), F.col("e").alias("_be")).distinct()
    j = iv.overlap_join(a, b, ["media", "work"], "_as", "_ae", "_bs", "_be", width).where("_fa < _fb")
    o = j.select("media", "work", F.greatest("_as", "_bs").alias("s"), F.least("_ae", "_be").alias("e"))
    return o.where(F.col("e") - F.col("s") >= floor).distinct()


def backed_plays(hints: DataFrame, sup: DataFrame, lead: int, trail: int) -> DataFrame:
    """`(media, hint, candidate, occurrence, direct)`: the one play of its work
    that each eligible hint backs.

    On a play's own time it is direct: the play it overlaps most, then more
    covered time, earlier, smaller key. Else, of plays from `lead` before to
    `trail` after whose hull it lies, one that it lies inside of, then more covered
    time, nearer, earlier, smaller key. Without a position it backs its work's
    play if there is just one."""
    h = eligible(hints).select("media", "work", F.col("id").alias("hint"), F.col("s").alias("_hs"), F.col("e").alias("_he"))
    key = [*PLAY, "work"]
    spans = F.array_sort(F.collect_list(F.struct("s", "e")))
    p = sup.groupBy(*key).agg(F.min("s").alias("_s"), F.max("e").alias("_e"), F.sum(F.col("e") - F.col("s")).cast("long").alias("_air"), spans.alias("_spans"))
    j = h.where("_hs is not null").join(p, ["media", "work"])
    shared = F.aggregate("_spans", F.lit(0).cast("long"), lambda a, x: a + overlap_length(F.col("_hs"), F.col("_he"), x["s"], x["e"]))
    j = j.withColumn("_over", shared)
    strict = lambda s, e: F.least("_he", e) > F.greatest("_hs", s)
    j = j.where((F.col("_over") > 0) | strict(F.col("_s") - lead, F.col("_e") + trail))
    on = F.col("_over") > 0
    away = F.least(F.abs(F.col("_s") - F.col("_he")), F.abs(F.col("_hs") - F.col("_e")))
    rank = F.struct(
        F.when(on, 0).otherwise(1).alias("a"),
        F.when(on, -F.col("_over")).otherwise(F.when(strict(F.col("_s"), F.col("_e")), 0).otherwise(1)).alias("b"),
        (-F.col("_air")).alias("c"),
        F.when(on, 0).otherwise(away).alias("d"),
        F.col("_s").alias("e"),
        "candidate",
        "occurrence",
    )
    best = j.groupBy("media", "hint").agg(F.min(rank).alias("_b"))
    placed = best.select("media", "hint", F.col("_b.candidate").alias("candidate"), F.col("_b.occurrence").alias("occurrence"), (F.col("_b.a") == 0).alias("direct"))
    only = p.groupBy("media", "work").agg(F.count("*").alias("_n"), F.first("candidate").alias("candidate"), F.first("occurrence").alias("occurrence")).where("_n = 1")
    loose = h.where("_hs is null").join(only, ["media", "work"]).select("media", "hint", "candidate", "occurrence", F.lit(False).alias("direct"))
    return placed.unionByName(loose)


def tier(trials_e4: Column, span: Column, rivals: Column, aligned: Column, likely: int, possible: int) -> Column:
    """`likely` from four trials over a span of `likely`, aligned; `possible` from
    two over `possible`; neither with a rival; else `unclear`."""
    free = F.coalesce(rivals, F.lit(0)) == 0
    return F.when((trials_e4 >= 40_000) & (span >= likely) & free & aligned, "likely").when((trials_e4 >= 20_000) & (span >= possible) & free, "possible").otherwise("unclear")


def unbroken(played: DataFrame, run_gap: int, core: int) -> DataFrame:
    """The plays of which a run of votes that aren't `vague`, with holes under
    `run_gap`, lasts for `core`."""
    runs = iv.islands(played.where("not vague"), PLAY, "s", "e", gap=run_gap - 1)
    return runs.where(F.col("e") - F.col("s") >= core).select(*PLAY).distinct()


def episodes(votes: DataFrame, lines: DataFrame, hints: DataFrame, identity: DataFrame, commercial: list[str], floor: int, apart: int, likely: int, possible: int, lead: int, trail: int, run_gap: int, core: int, width: int, sup: DataFrame | None = None) -> DataFrame:
    """One row a play: hull, covered time, proved bounds, votes, trials, rivals,
    agreements, hints, tiers of work (of the audio alone, and with one trial more
    for hints), version and boundary, the badge, and flags.

    `votes` have their play (aligned_plays); `identity` tells for `(media,
    candidate)` whether its recording is `supported` and whether it is `contested`.
    A version is as sure as the audio where the recording is supported and not
    contested, a boundary possible where the play is aligned. `sup` are the votes'
    supports, if they are at hand."""
    v = votes
    sup = supports(v) if sup is None else sup
    hull = hulls(sup)
    own = v.groupBy(*PLAY).agg(F.min("e").alias("start_bound"), F.max("s").alias("end_bound"), F.count("*").alias("votes"), (2 * F.count_if("vague") > F.count("*")).alias("_half"))
    light = ev.discounted(v.groupBy(*PLAY, "provider").agg(F.count("*").alias("n")), PLAY, "provider", "n", commercial).select(*PLAY, "provider", F.lit(True).alias("light"))
    trials = sc.independent_trials(v.join(light, [*PLAY, "provider"], "left").withColumn("light", F.coalesce("light", F.lit(False))), PLAY, "trial", "provider", "s", "e", "light")
    rivals = _rivals(sup, width)
    agree = work_agreements(v, floor, width)
    a = sup.select(*PLAY, "work", F.col("s").alias("_as"), F.col("e").alias("_ae"))
    met = iv.overlap_join(a, agree.select("media", "work", F.col("s").alias("_bs"), F.col("e").alias("_be")), ["media", "work"], "_as", "_ae", "_bs", "_be", width)
    met = met.select(*PLAY, "_bs", "_be").distinct().groupBy(*PLAY)
    met = met.agg(F.count("*").alias("agreements"), ((F.count("*") >= 2) & (F.max("_bs") - F.min("_bs") >= apart)).alias("separated"))
    back = backed_plays(hints, sup, lead, trail).groupBy(*PLAY).agg(F.count("*").alias("hints"), F.max("direct").alias("direct"))
    # the tables are a row a play or more, however small their few columns look
    d = hull.join(own.hint("merge"), PLAY).join(trials.hint("merge"), PLAY)
    sure = unbroken(v, run_gap, core).withColumn("_sure", F.lit(True))
    for more in (lines, rivals, met, back, sure):
        d = d.join(more.hint("merge"), PLAY, "left")
    d = d.join(identity, ["media", "candidate"], "left").withColumn("ambiguous", F.col("_half") & F.col("_sure").isNull()).drop("_half", "_sure")
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("rivals", "agreements", "hints", "segments", "outliers")}
    d = d.withColumns(zero | {c: F.coalesce(c, F.lit(False)) for c in ("aligned", "separated", "direct", "ambiguous", "supported", "contested")})
    span = F.col("e") - F.col("s")
    with_hint = F.col("trials_e4") + F.when(F.col("hints") > 0, 10_000).otherwise(0)
    tiers = {n: tier(t, span, F.col("rivals"), F.col("aligned"), likely, possible) for n, t in (("audio_tier", F.col("trials_e4")), ("tier", with_hint))}
    d = d.withColumns(tiers)
    d = d.withColumn("version_tier", F.when(F.col("supported") & ~F.col("contested"), F.col("audio_tier")).otherwise("unclear")).withColumn("boundary_tier", F.when(F.col("aligned"), "possible").otherwise("unclear"))
    said = {"contested_identity": "contested", "alignment_outlier": "outliers > 0", "hint_supported": "hints > 0", "engine_corroborated": "agreements > 0", "engine_corroborated_separated": "separated", "ambiguous_evidence": "ambiguous"}
    flags = F.array_compact(F.array(*(F.when(F.expr(c), f) for f, c in said.items())))
    status = F.when(F.col("contested"), "contested").when(F.col("version_tier") == "verified", "verified").otherwise("unverified")
    return d.withColumns({"flags": flags, "version_status": status, "badge": badge(F.col("tier"), F.col("version_tier"))}).drop("ambiguous", "supported", "contested")


def _rivals(sup: DataFrame, width: int) -> DataFrame:
    """Per play the number of other candidates that cover half of its time."""
    own = sup.groupBy(*PLAY).agg(F.sum(F.col("e") - F.col("s")).alias("_own"))
    every = iv.islands(sup, ["media", "candidate"], "s", "e").select("media", F.col("candidate").alias("_other"), F.col("s").alias("_bs"), F.col("e").alias("_be"))
    a = sup.select(*PLAY, F.col("s").alias("_as"), F.col("e").alias("_ae"))
    j = iv.overlap_join(a, every, ["media"], "_as", "_ae", "_bs", "_be", width).where("candidate <> _other")
    n = j.groupBy(*PLAY, "_other").agg(F.sum(F.least("_ae", "_be") - F.greatest("_as", "_bs")).alias("_n"))
    return n.join(own.hint("merge"), PLAY).where("2 * _n >= _own").groupBy(*PLAY).agg(F.count("*").alias("rivals"))


def suppressed(ep: DataFrame, sup: DataFrame, answers: DataFrame, run_gap: int, core: int, scatter: int, times: int, edge: int, edge_least: int, width: int) -> DataFrame:
    """`ep` with `suppressed`: `ambiguous` where mostly ambiguous votes have neither
    hint nor agreement, whatever the tier; `scatter` where a hull of `scatter` or
    more is `times` the covered time; `contradicted` where an answer names another
    work inside the hull (of `edge_least` covered time or more: less `edge` on
    either side, but for corrections); `buried` where the runs of immune episodes of
    other hulls cover three fifths of it; else null.

    Immune are strong tiers not owed to a hint beside the play (scattered ones only
    with an unbroken `core`), separated agreement, direct hints, and other hints on
    a play without a fault of its own. A run is covered time with holes under
    `run_gap`."""
    span = F.col("e") - F.col("s")
    has = lambda flag: F.array_contains("flags", flag)
    longest = sup.groupBy(*PLAY).agg(F.max(F.col("e") - F.col("s")).alias("_core"))
    me = ep.select(*PLAY, "work", "on_air", F.col("s").alias("_s"), F.col("e").alias("_e"))
    cut = F.when(F.col("on_air") >= edge_least, edge).otherwise(0)
    said = answers.where("s is not null").select("media", F.col("work").alias("_w"), F.col("s").alias("_as"), F.col("e").alias("_ae"), (F.col("kind") == "correction").alias("_corr"))
    met = iv.overlap_join(me, said, ["media"], "_s", "_e", "_as", "_ae", width).where("work <> _w")
    inner = (F.col("_ae") > F.col("_s") + cut) & (F.col("_as") < F.col("_e") - cut) & (F.col("_s") + cut < F.col("_e") - cut)
    other = met.where(F.col("_corr") | inner).select(*PLAY).distinct().withColumn("_no", F.lit(True))
    d = ep.join(longest.hint("merge"), PLAY, "left").join(other, PLAY, "left")
    scattered = (span >= scatter) & (span >= times * F.col("on_air"))
    d = d.withColumn("_fault", F.when(scattered, "scatter").when(F.col("_no"), "contradicted"))
    owed = (F.col("hints") > 0) & ~F.col("direct") & (F.col("audio_tier") != "likely")
    strong = (F.col("tier") == "likely") & ~owed & ((F.col("_core") >= core) | ~scattered)
    hinted = (F.col("hints") > 0) & (F.col("direct") | F.col("_fault").isNull())
    vague = has("ambiguous_evidence") & ~has("hint_supported") & ~has("engine_corroborated")
    d = table(d.withColumns({"_immune": strong | F.col("separated") | hinted, "_vague": vague}), "judged")
    # a written table's few columns look small enough to broadcast, but are a row a play
    runs = iv.islands(sup, PLAY, "s", "e", gap=run_gap - 1).select(*PLAY, F.col("s").alias("_rs"), F.col("e").alias("_re"))
    cover = runs.join(d.where("_immune and not _vague").select(*PLAY, F.col("s").alias("_os"), F.col("e").alias("_oe")).hint("merge"), PLAY).select("media", "_rs", "_re", "_os", "_oe")
    open_ = d.where("not _immune and not _vague and _fault is null").select(*PLAY, F.col("s").alias("_s"), F.col("e").alias("_e"))
    j = iv.overlap_join(open_, cover, ["media"], "_s", "_e", "_rs", "_re", width).where("_s <> _os or _e <> _oe")
    part = j.select(*PLAY, F.greatest("_s", "_rs").alias("s"), F.least("_e", "_re").alias("e"))
    hid = iv.islands(part, PLAY, "s", "e").groupBy(*PLAY).agg(F.sum(F.col("e") - F.col("s")).alias("_hid"))
    d = d.join(hid, PLAY, "left")
    why = F.when(F.col("_vague"), "ambiguous").when(~F.col("_immune"), F.coalesce("_fault", F.when(10 * F.col("_hid") >= 6 * span, "buried")))
    return d.withColumn("suppressed", why).drop("_immune", "_hid", "_no", "_fault", "_core", "_vague")


def gaps(windows: DataFrame, listed: DataFrame, hints: DataFrame, unclear: DataFrame, novelty: DataFrame, least: int, width: int) -> DataFrame:
    """`(media, s, e, prior, next, n_windows, n_no_match, n_error, n_hints,
    n_unclear, n_novelty)`: the scanned time that no listed episode's hull covers,
    of `least` or more, with the episodes that end last before and begin first
    after it, and what lies in it; of `unclear` plays' supports the plays, of
    `novelty` the distinct points, ends included."""
    hull = listed.select("media", "id", "s", "e")
    g = iv.subtract(windows.select("media", "s", "e"), hull.select("media", "s", "e"), ["media"], "s", "e")
    g = g.where(F.col("e") - F.col("s") >= least)
    g = iv.asof(g, hull.select("media", F.col("e").alias("_t"), "id"), ["media"], "s", "_t", "id", out="prior")
    g = iv.asof(g, hull.select("media", F.col("s").alias("_t"), "id"), ["media"], "e", "_t", "id", forward=True, out="next").drop("prior_t", "next_t")

    def inside(rows: DataFrame, *counts: Column) -> DataFrame:
        """The gaps with counts over the rows that overlap them."""
        r = rows.withColumnsRenamed({"s": "_rs", "e": "_re"})
        hit = iv.overlap_join(g.select("media", "s", "e"), r, ["media"], "s", "e", "_rs", "_re", width)
        return hit.groupBy("media", "s", "e").agg(*counts)

    w = inside(windows.select("media", "s", "e", "status"), F.count("*").alias("n_windows"), F.count_if(F.col("status") == "no_match").alias("n_no_match"), F.count_if(F.col("status") == "error").alias("n_error"))
    h = inside(hints.where("s is not null").select("media", "s", "e"), F.count("*").alias("n_hints"))
    u = inside(unclear.select("media", "s", "e", *PLAY[1:]), F.countDistinct(*PLAY[1:]).alias("n_unclear"))
    n = inside(novelty.select("media", F.col("at").alias("s"), (F.col("at") + 1).alias("e")).distinct(), F.count("*").alias("n_novelty"))
    edge = g.join(novelty.select("media", F.col("at").alias("e")).distinct(), ["media", "e"]).select("media", "s", "e", F.lit(1).alias("_at_end"))
    for more in (w, h, u, n, edge):
        g = g.join(more, ["media", "s", "e"], "left")
    counts = ("n_windows", "n_no_match", "n_error", "n_hints", "n_unclear", "n_novelty")
    g = g.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in counts})
    return g.withColumn("n_novelty", F.col("n_novelty") + F.coalesce("_at_end", F.lit(0))).drop("_at_end")


def novelty_regions(points: DataFrame, keys: list[str], at: str, duration: str, pad: int) -> DataFrame:
    """Change points padded on both sides, clipped to the recording, and merged."""
    p = points.select(*keys, F.greatest(F.col(at) - pad, F.lit(0)).alias("s"), F.least(F.col(at) + pad, F.col(duration)).alias("e"))
    return iv.islands(p, keys, "s", "e").drop("n")


def question_clusters(hints: DataFrame, reach: int, least: int) -> DataFrame:
    """`(media, s, e)` of `least` or more questions whose middles lie at most
    `reach` after the first one's."""
    q = hints.where("kind = 'question' and verified and s is not null").select("media", "s", "e", F.expr("(s + e) div 2").alias("at"))
    c = tl.bursts(q, ["media"], "at", reach, least).select("media", F.col("first").alias("_a"), F.col("last").alias("_z"))
    met = iv.points_in_spans(q, c.withColumn("_y", F.col("_z") + 1), ["media"], "at", "_a", "_y", reach)
    return met.groupBy("media", "_a", "_z").agg(F.min("s").alias("s"), F.max("e").alias("e")).select("media", "s", "e")


def rescan_requests(ep: DataFrame, gap_rows: DataFrame, novelty: DataFrame, loose_hints: DataFrame, questions: DataFrame, edge: int, long: int) -> DataFrame:
    """`(media, trigger, s, e)`, distinct: gaps, both edges of each episode, whole
    long ones and those of a contested identity, novelty regions, hints that back
    nothing, and clusters of questions."""
    around = lambda c: (F.greatest(F.col(c) - edge, F.lit(0)).alias("s"), (F.col(c) + edge).alias("e"))
    of = lambda d, name, s=F.col("s"), e=F.col("e"): d.select("media", F.lit(name).alias("trigger"), s, e)
    parts = [
        of(gap_rows, "gap"),
        of(ep.where(F.array_contains("flags", "contested_identity")), "contested"),
        of(ep, "edge", *around("start_bound")),
        of(ep, "edge", *around("end_bound")),
        of(ep.where(F.col("e") - F.col("s") > long), "long_episode"),
        of(novelty, "novelty"),
        of(loose_hints.where("s is not null"), "hint_cluster"),
        of(questions, "question_cluster"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("e > s").distinct()


def unscanned(requests: DataFrame, window: int, hop: int, scanned: DataFrame) -> DataFrame:
    """Requests with at least one planned window that was not scanned yet, and how
    many: windows begin every `hop` from a request's start while they fit, and one
    ends with it (see schedule.sliding_windows); `scanned` are `(media, at)`.

    Windows are counted, not listed: of the scanned starts as many lie on a
    request's grid as there are up to its last window less those before its first."""
    r = table(requests.where(F.col("e") - F.col("s") >= window).groupBy("media", "trigger", "s", "e").agg(F.count("*").alias("_times")), "requests")
    spans = r.select("media", "s", "e").distinct().withColumns({"_last": F.col("e") - window, "_res": F.pmod("s", F.lit(hop))}).withColumn("_first", F.col("s") - 1)
    seen = scanned.where("media is not null and at is not null").select("media", "at").distinct()
    up = Window.partitionBy("media", "_res").orderBy("at")
    ranked = seen.withColumn("_res", F.pmod("at", F.lit(hop))).withColumn("_no", F.row_number().over(up))
    for end, out in (("_first", "_under"), ("_last", "_upto")):
        spans = iv.asof(spans, ranked, ["media", "_res"], end, "at", "_no", out=out)
    spans = spans.join(seen.select("media", F.col("at").alias("_last"), F.lit(1).alias("_end")), ["media", "_last"], "left")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    tail = (F.col("_last") - F.col("s")) % hop != 0
    n = F.expr(f"(_last - s) div {hop}") + 1 + tail.cast("long")
    hits = count("_upto") - count("_under") + F.when(tail, count("_end")).otherwise(F.lit(0).cast("long"))
    left = spans.select("media", "s", "e", (n - hits).alias("_left")).where("_left > 0")
    return r.join(left.hint("merge"), ["media", "s", "e"]).select("media", "trigger", "s", "e", (F.col("_times") * F.col("_left")).alias("planned"))


def ranked_works(clustered: DataFrame, keys: list[str]) -> DataFrame:
    """The works that a cluster's answers name with `rank` from 1: by the number
    of independent groups, a trusted voice, the strongest parse, the earliest
    position, the work."""
    n = clustered.groupBy(*keys, "work").agg(F.countDistinct("group").alias("groups"), F.max(F.col("trusted").cast("int")).alias("trusted"), F.max("confidence").alias("confidence"), F.min("s").alias("s"))
    w = Window.partitionBy(*keys).orderBy(F.col("groups").desc(), F.col("trusted").desc(), F.col("confidence").desc(), "s", "work")
    return n.withColumn("rank", F.row_number().over(w))


def hint_clusters(hints: DataFrame, listed: DataFrame, width: int) -> DataFrame:
    """Answers that no listed span covers, with `cluster` (from 0): those whose
    positions overlap, one way or another, share one."""
    a = hints.where("kind in ('answer', 'correction') and verified and not id_unknown and e > s")
    spans = listed.select("media", F.col("s").alias("_ls"), F.col("e").alias("_le"))
    covered = iv.overlap_join(a.select("media", "id", "s", "e"), spans, ["media"], "s", "e", "_ls", "_le", width).select("media", "id").distinct()
    a = a.join(covered, ["media", "id"], "left_anti")
    w = Window.partitionBy("media").orderBy("s", "e", "id")
    reach = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    a = a.withColumn("_new", F.when(F.col("s") >= reach, 1).otherwise(0))
    return a.withColumn("cluster", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
