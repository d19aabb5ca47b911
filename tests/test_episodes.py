from pyspark.sql import functions as F

from tidemark.operators import episodes as ep

VOTE = "media string, candidate string, work string, id long, provider string, family string, trial long, s long, e long, is_final boolean, status string, reliable boolean, vague boolean, mix long, ref long, rate long"


def vote(i, mix, ref, candidate="a", trial=None, reliable=True, vague=False, s=None, provider="p"):
    s = mix if s is None else s
    return ("m", candidate, f"w{candidate}", i, provider, "A", i if trial is None else trial, s, s + 10_000, True, "match", reliable, vague, mix, ref if reliable else None, 10_000)


def test_plays_by_alignment(spark):
    rows = [vote(i, 10_000 * i, 10_000 * i) for i in range(6)]
    # the same part again two minutes later: a replay begins a play
    rows += [vote(10 + i, 200_000 + 10_000 * i, 10_000 * (i + 1)) for i in range(3)]
    rows += [vote(20, 205_000, None, reliable=False, trial=11), vote(21, 90_000, None, reliable=False), vote(22, 140_000, None, reliable=False), vote(23, 1, None, reliable=False, candidate="b")]
    rows += [vote(30, 220_500, 99_000, trial=99)]  # off every line, and nothing after it
    d = spark.createDataFrame(rows, VOTE)
    votes, lines = ep.aligned_plays(d, "mix", "mix", "ref", "rate", 50_000)
    got = {r.id: r.occurrence for r in votes.collect()}
    assert len(got) == len(rows)
    assert all(got[i] == 0 for i in range(6)) and all(got[10 + i] == 1 for i in range(3))
    assert (got[20], got[21], got[22], got[23]) == (1, 0, 1, 0)  # by trial; nearest to 50 s and to 200 s; no anchors
    found = {r.occurrence: (r.aligned, r.segments) for r in lines.collect()}
    assert set(found) == {0, 1} and not any(a for a, _ in found.values())
    one = spark.createDataFrame(rows[:6], VOTE)
    votes, lines = ep.aligned_plays(one, "mix", "mix", "ref", "rate", 50_000)
    assert [(r.occurrence, r.aligned, r.segments, r.outliers) for r in lines.collect()] == [(0, True, 1, 0)]
    votes, lines = ep.aligned_plays(one.where("false"), "mix", "mix", "ref", "rate", 50_000)
    assert votes.count() == lines.count() == 0


def fused(spark, rows, identity=(True, False), hints=()):
    d = spark.createDataFrame(rows, VOTE)
    h = spark.createDataFrame(list(hints), "media string, work string, id long, kind string, verified boolean, id_unknown boolean, s long, e long")
    i = spark.createDataFrame([("m", c, *identity) for c in "ab"], "media string, candidate string, supported boolean, contested boolean")
    votes, lines = ep.aligned_plays(d, "mix", "mix", "ref", "rate", 50_000)
    out = ep.episodes(votes, lines, h, i, [], 2000, 30_000, 40_000, 20_000, 60_000, 30_000, 30_000, 40_000, 50_000)
    return out, votes, h


def suppressed(out, votes, h):
    said = ep.eligible(h).where("kind <> 'tracklist_line'")
    return {r.candidate: r.suppressed for r in ep.suppressed(out, ep.supports(votes), said, 30_000, 40_000, 180_000, 3, 20_000, 120_000, 50_000).collect()}


def test_tiers_versions_and_flags(spark):
    rows = [vote(i, 10_000 * i, 10_000 * i) for i in range(8)]
    out, votes, h = fused(spark, rows)
    r = out.first()
    assert (r.aligned, r.tier, r.version_tier, r.boundary_tier, r.badge, r.version_status, r.flags) == (True, "likely", "likely", "possible", "likely", "unverified", [])
    r = fused(spark, rows, (False, False))[0].first()
    assert (r.tier, r.version_tier) == ("likely", "unclear")
    r = fused(spark, rows, (True, True), [("m", "wa", 1, "answer", True, False, 0, 5000)])[0].first()
    assert (r.version_tier, r.version_status, r.flags, r.direct) == ("unclear", "contested", ["contested_identity", "hint_supported"], True)
    # without anchors nothing is aligned, so the work is no better than possible
    r = fused(spark, [vote(i, 10_000 * i, None, reliable=False) for i in range(8)])[0].first()
    assert (r.aligned, r.tier, r.boundary_tier) == (False, "possible", "unclear")


def test_suppression(spark):
    vague = [vote(i, 10_000 * i, 10_000 * i, vague=i > 0) for i in range(8)]
    out, votes, h = fused(spark, vague)
    assert "ambiguous_evidence" in out.first().flags and suppressed(out, votes, h) == {"a": "ambiguous"}
    out, votes, h = fused(spark, vague, hints=[("m", "wa", 1, "answer", True, False, None, None)])
    assert suppressed(out, votes, h) == {"a": None}  # somebody names it
    core = [vote(i, 10_000 * i, 10_000 * i, vague=i >= 5) for i in range(11)]
    assert "ambiguous_evidence" not in fused(spark, core)[0].first().flags  # 50 s without a doubt
    # an answer that names another work only at the edge of a long play says nothing; a correction does
    long = [vote(i, 10_000 * i, 10_000 * i, provider="x") for i in range(3)] + [vote(10 + i, 30_000 + 10_000 * i, None, reliable=False, trial=1) for i in range(10)]
    for kind, want in (("answer", None), ("correction", "contradicted")):
        out, votes, h = fused(spark, long, hints=[("m", "wz", 1, kind, True, False, 0, 5000)])
        assert suppressed(out, votes, h)["a"] == want
    out, votes, h = fused(spark, [vote(0, 0, 0), vote(1, 200_000, 200_000)])
    assert suppressed(out, votes, h) == {"a": "scatter"}


def test_question_clusters(spark):
    q = [("m", i, "question", True, t, t + 10) for i, t in enumerate((0, 40, 90, 300, 350, 1000))] + [("m", 9, "answer", True, 50, 60), ("m", 10, "question", False, 60, 70), ("m", 11, "question", True, None, None)]
    d = spark.createDataFrame(q, "media string, id long, kind string, verified boolean, s long, e long")
    assert [tuple(r) for r in ep.question_clusters(d, 90, 3).collect()] == [("m", 0, 100)]
    assert ep.question_clusters(d.where("false"), 90, 3).count() == 0


def test_triggers(spark):
    e = spark.createDataFrame([("m", 100, 200, 120, 180, ["contested_identity"])], "media string, s long, e long, start_bound long, end_bound long, flags array<string>")
    none = spark.createDataFrame([], "media string, s long, e long")
    qs = spark.createDataFrame([("m", 5, 9)], "media string, s long, e long")
    got = {(r.trigger, r.s, r.e) for r in ep.rescan_requests(e, none, none, none, qs, 20, 1000).collect()}
    assert got == {("contested", 100, 200), ("edge", 100, 140), ("edge", 160, 200), ("question_cluster", 5, 9)}


def test_gap_counts(spark):
    w = spark.createDataFrame([("m", 0, 100, "no_match")], "media string, s long, e long, status string")
    listed = spark.createDataFrame([("m", "x", 40, 60)], "media string, id string, s long, e long")
    h = spark.createDataFrame([("m", 5, 6)], "media string, s long, e long")
    u = spark.createDataFrame([("m", "a", 0, 10, 20), ("m", "a", 0, 25, 30), ("m", "b", 1, 70, 80)], "media string, candidate string, occurrence long, s long, e long")
    n = spark.createDataFrame([("m", 0), ("m", 40), ("m", 40), ("m", 41), ("m", 100)], "media string, at long")
    got = {r.s: (r.n_hints, r.n_unclear, r.n_novelty) for r in ep.gaps(w, listed, h, u, n.withColumn("x", F.lit(1)), 1, 50).collect()}
    assert got == {0: (1, 1, 2), 60: (0, 1, 1)}
