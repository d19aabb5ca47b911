"""What must not grow with copies, repeats or long groups."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import episodes as ep
from tidemark.operators import evidence as ev
from tidemark.operators import identity as idn
from tidemark.operators import intervals as iv
from tidemark.operators import loops as lp
from tidemark.operators import schedule as sc
from tidemark.operators import scoring as sco
from tidemark.operators import targeting as tg
from tidemark.operators import timeline as tl
from tidemark.plans import decisions as pd_
from tidemark.plans import episodes as pe
from tidemark.plans import intervals as pi
from tidemark.plans import loops as pl
from tidemark.plans import text as pt

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_recent_orders_compares_no_order_with_all(spark):
    plan = pt.q_recent(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_closest_label_of_many_copies(spark):
    words = "array(cast(id % 3 as string), 'x', 'x')"
    left = spark.range(30_000).selectExpr("id", "'k' as key", f"{words} as words")
    right = spark.range(30_000).selectExpr("id + 100000 as id", "'k' as key", f"if(id % 3 = 2, array('x', '7'), {words}) as words")
    t = time.time()
    got = {(r.left % 3, r.right, r.apart) for r in sco.closest_label(left, right).collect()}
    assert got == {(0, 100_000, 0), (1, 100_001, 0), (2, 100_000, 2)} and time.time() - t < 40


def test_named_works_of_many_copies(spark):
    hints = spark.range(30_000).selectExpr("id as hint", "array('x', 'common', concat('word', id % 2)) as words")
    works = spark.createDataFrame([(i, ["x", "common", f"other{i}"]) for i in range(3000)] + [(9000, ["word0", "common", "x"])], "work long, words array<string>")
    t = time.time()
    got = {(r.hint % 2, r.work) for r in idn.named_works(hints, works).collect()}
    # both spellings fit the one work: equal, and an edit apart
    assert got == {(0, 9000), (1, 9000)} and time.time() - t < 40


def test_named_works_of_two_words(spark):
    hints = spark.createDataFrame([(1, ["blue", "light"]), (2, ["blue"]), (3, ["blue", "lights", "extra"]), (4, ["blues", "dark"])], "hint long, words array<string>")
    works = spark.createDataFrame([(7, ["blue", "lights"]), (8, ["dark", "blues"]), (8, ["dark", "blue"]), (9, ["blue"])], "work long, words array<string>")
    assert dict(idn.named_works(hints, works).collect()) == {1: 7, 3: 7}


def test_alignment_of_a_long_candidate():
    mix = np.arange(20_000) * 7 + 85_000_000
    t = time.time()
    got = list(tl._decided(mix, mix % 100_000 + np.where(np.arange(20_000) % 31 == 30, 7000, 0), np.full(20_000, 10_000)))
    assert time.time() - t < 20
    assert [d[0] for d in got[:31]] == ["start"] + ["continuation"] * 29 + ["outlier"]
    assert [i for i, d in enumerate(got) if d[0] not in ("start", "continuation", "outlier")] == [14286]


def test_slopes_of_a_play_are_all_of_them():
    r = np.random.default_rng(4)
    mix, ref = np.sort(r.integers(0, 400, 60)), np.arange(60) * 3
    line = tl._begun(int(mix[0]), int(ref[0]), 10_000)
    for n in range(1, 60):
        line = (line if isinstance(line, tl._Play) else tl._Play(mix[:n], ref[:n], np.full(n, 10_000))).grown(int(mix[n]), int(ref[n]), 10_000)
    i, j = np.triu_indices(60, 1)
    i, j = i[mix[i] != mix[j]], j[mix[i] != mix[j]]
    assert line.often.sum() == len(i) and line._middle() == np.median((ref[j] - ref[i]) * 10_000 / (mix[j] - mix[i]))


def alignments(monkeypatch, query, spark):
    """How often a query aligns all votes."""
    made, real = [], ep.aligned_plays
    monkeypatch.setattr(ep, "aligned_plays", lambda *a: made.append(1) or real(*a))
    query(spark, SF)
    return len(made)


def test_merged_passes_share_their_episodes(spark, monkeypatch):
    assert alignments(monkeypatch, pd_.q_merge, spark) == 1


def test_requests_share_their_alignment(spark, monkeypatch):
    assert alignments(monkeypatch, pe.q_requests, spark) == 1


def test_budget_makes_no_frame_a_customer(spark):
    assert "InPandas" not in plan_of(pi.q_budget(spark, SF))


def test_admission_of_very_many_groups(spark):
    d = spark.range(200_000).selectExpr("id div 2 as k", "id as o", "3L as cost", "4L as all")
    t = time.time()
    assert sc.admit(d, ["k"], ["o"], "cost", "all").where("admitted").agg(F.count("*"), F.max("o")).first()[:] == (100_000, 199_998)
    assert time.time() - t < 40


def test_offset_mode_gathers_no_group(spark):
    assert "collect_list" not in plan_of(pi.q_offset_mode(spark, SF))


def test_offsets_of_a_long_group(spark):
    d = spark.range(60_000).selectExpr("1 as k", "case when id < 40000 then id % 101 else 1000 + id end as v")
    t = time.time()
    assert iv.offset_cluster(d, ["k"], "v", 100, 7, 20).first()[:] == (1, 43, 50, 40_000, 60_000) and time.time() - t < 40


def test_association_of_a_long_work(spark):
    pred = spark.range(30_000).selectExpr("1 as k", "id", "id * 10 as s", "id * 10 + 1 as e")
    truth = spark.range(30_000).selectExpr("1 as k", "id", "400000 + id as s", "400001 + id as e")
    t = time.time()
    assert sco.associate(pred, truth, ["k"], 3).count() == 0 and time.time() - t < 20
    assert "InPandas" not in plan_of(pd_.q_associate(spark, SF))


def test_confirmations_read_no_frame_of_windows(spark):
    assert "InPandas" not in plan_of(pd_.q_confirm(spark, SF))


def test_confirmations_of_a_long_recording(spark):
    w = spark.range(20_000).selectExpr("'m' as media", "id", "id * 10 as s", "id * 10 + 12 as e")
    x = spark.range(20_000).selectExpr("'m' as media", "id as disc", "id * 10 as ds", "id * 10 + 12 as de", "0 as bs", "900000 as be", "id as probe", "9000 as reserve")
    t = time.time()
    got = tg.confirmations(x, w, "reserve", 300, 400, 6)
    assert got.count() == got.select("id").distinct().count() == 9000 and time.time() - t < 30


def test_allocation_makes_no_frame_a_candidate(spark):
    assert "InPandas" not in plan_of(pd_.q_allocate(spark, SF))


def test_allocation_of_many_candidates(spark):
    d = spark.range(200_000).selectExpr("'m' as media", "id div 100 as cand", "0L as cs", "1 + id div 100 as ce", "'blank' as class", "id % 50000 as id", "cast(id % 100 as int) as rank", "60000L as quota")
    t = time.time()
    got = tg.allocate(d, "quota")
    assert got.count() == got.select("id").distinct().count() == 50_000 and time.time() - t < 30


def test_quantiles_sort_ranges_not_keys(spark, monkeypatch):
    r = np.random.default_rng(3)
    rows = [(k, int(v)) for k, n in (("a", 501), ("b", 1), (None, 40), ("c", 200)) for v in (r.integers(-9, 9, n) ** 5 if k != "c" else np.full(n, 7))]
    d = spark.createDataFrame(rows, "k string, v long")
    monkeypatch.setattr(ev, "_BINS", 5)
    q = ev.quantiles(d, ["k"], "v", [(5, 100), (50, 100), (100, 100)])
    for x in q.collect():
        v = sorted(b for a, b in rows if a == x.k)
        n = len(v)
        assert (x.n, x.median_low, x.median_x2) == (n, v[(n - 1) // 2], v[(n - 1) // 2] + v[n // 2])
        assert all((x[f"nr_{p}"], x[f"tr_{p}"]) == (v[max(-(-n * p // 100) - 1, 0)], v[min(n - 1, n * p // 100)]) for p in (5, 50, 100))
    assert q.count() == 4


def test_alternatives_of_a_large_work(spark):
    members = spark.range(6000).selectExpr("id as node", "id div 2 as component", "0 as work")
    bad = spark.createDataFrame([(0, 1), (2, 5)], "a long, b long")
    d = idn.candidates(members, bad)
    assert "array_except" not in plan_of(d)
    got = d.selectExpr("component", "contested", "size(alternatives) as n", "alternatives[0] as first", "array_contains(alternatives, canonical) as own").collect()
    assert len(got) == 3000 and {r.n for r in got} == {2999} and not any(r.own for r in got)
    assert [r.component for r in got if r.contested] == [0] and {r.first for r in got} == {0, 2}
    # a work's components are met by many tasks
    assert d.groupBy(F.spark_partition_id()).count().count() > 8


def test_comments_are_read_by_all_cores(spark):
    assert pt._comments(spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_spread_spans_are_not_broadcast(spark, tmp_path):
    for n, c in (("a", "a"), ("b", "b")):
        spark.range(500).selectExpr("id % 5 as k", f"id as {c}s", f"id + 400 as {c}e").write.parquet(f"{tmp_path}/{n}")
    a, b = (spark.read.parquet(f"{tmp_path}/{n}") for n in "ab")
    j = iv.overlap_join(a, b, ["k"], "as", "ae", "bs", "be", 10)
    p = iv.points_in_spans(a, b, ["k"], "as", "bs", "be", 10)
    assert j.count() == sum(abs(x - y) < 400 for x in range(500) for y in range(500) if x % 5 == y % 5)
    assert "Broadcast" not in plan_of(j) and "Broadcast" not in plan_of(p)


def test_vetoed_merges_pass_one_by_one(spark):
    links = spark.range(60_000).selectExpr("id", "id % 300 as a", "1000 + id % 200 as b")
    merged = tl.merge_with_veto(links, spark.createDataFrame([(0, 1000)], "a long, b long"))
    assert "InPandas" not in plan_of(merged)
    got = dict(merged.collect())
    assert len(got) == 500 and got[0] != got[1000] and len(set(got.values())) == 101


def test_alignment_of_very_many_candidates(spark):
    # forty thousand candidates of three anchors: the third is off, then on the line
    d = spark.range(120_000).selectExpr("id div 3 as media", "'c' as candidate", "id", "id % 3 * 9000 as mix", "20000 + id % 3 * 9000 + if(id % 6 = 4, 400000, 0) as ref", "10000 as rate")
    t = time.time()
    a = tl.align(d, ["media", "candidate"], "id", "mix", "ref", "rate")
    assert "InPandas" not in plan_of(a)
    assert dict(a.groupBy("decision").count().collect()) == {"start": 40_000, "continuation": 60_000, "outlier": 20_000}
    assert time.time() - t < 30


def test_hint_only_shares_its_episodes(spark, monkeypatch):
    assert alignments(monkeypatch, pl.q_hint_only, spark) == 1


def test_hint_only_of_many_and_of_long_recordings(spark):
    # a recording of 20,000 clusters and 4,000 short ones; only walls let a cluster in
    c = spark.range(20_000).selectExpr("0L as media", "id as cluster", "'a' as work", "1 as rank", "id * 10 as s", "id * 10 + 2 as e")
    c = c.unionByName(spark.range(8000).selectExpr("1 + id div 2 as media", "id % 2 as cluster", "'a' as work", "1 as rank", "id % 2 * 10 as s", "id % 2 * 10 + 2 as e"))
    z = spark.range(10_000).selectExpr("0L as media", "'b' as work", "id * 20 + 5 as s", "id * 20 + 6 as e")
    t = time.time()
    got = lp.hint_only(c, z.where("false"), z)
    assert "InPandas" not in plan_of(got)
    n = dict(got.groupBy(F.col("media") > 0).count().collect())
    assert n == {False: 10_001, True: 4000} and time.time() - t < 30


def test_hint_only_against_all_spans():
    r = np.random.default_rng(5)
    for _ in range(200):
        on, walls = lp._Spans(), [(int(s), int(s + n), w) for s, n, w in zip(r.integers(0, 60, 8), r.integers(1, 6, 8), r.choice(list("ab"), 8), strict=True)]
        spans = []
        for s, n in zip(r.integers(0, 60, 4), r.integers(1, 30, 4), strict=True):
            on.add(int(s), int(s + n))
            spans.append((s, s + n))
        for s in range(0, 60, 3):
            e = s + 2
            want = all(not (a < e and s < b) and any(w != "a" and (e if a >= e else b) <= x and y <= (a if a >= e else s) for x, y, w in walls) for a, b in spans)
            before, after = on.around(e)
            between = lp._Walls(walls)
            assert want == ((before <= s and between.other("a", before, s) if before is not None else True) and (after is None or between.other("a", e, after)))


def test_mirrors_make_no_frame_a_recording(spark):
    assert "InPandas" not in plan_of(pl.q_mirrors(spark, SF))


def test_bursts_make_no_frame_a_recording(spark):
    d = spark.range(120_000).selectExpr("id div 6 as k", "id % 6 * 10 + if(id % 6 > 3, 900, 0) as t")
    t = time.time()
    got = tl.bursts(d, ["k"], "t", 25, 2)
    assert "InPandas" not in plan_of(got)
    assert sorted(got.where("k = 19999").collect()) == [(19_999, 0, 20, 3), (19_999, 940, 950, 2)]
    assert got.count() == 40_000 and time.time() - t < 30


def test_votes_are_placed_without_joins(spark):
    votes, _ = ep.aligned_plays(ep.final_matches(pe.windows(spark, SF)), "mix", "mix", "ref", "rate", 1)
    assert "Join" not in plan_of(votes) and "Window" not in plan_of(votes)


def test_votes_of_a_candidate_over_many_batches(spark):
    # three candidates of 25,000 votes, every tenth without an anchor; one play each
    d = spark.range(75_000).selectExpr("'m' as media", "id div 25000 as candidate", "id", "id as trial", "id % 25000 * 10 as mix", "if(id % 10 = 3, null, id % 25000 * 10) as ref", "10000 as rate", "id % 25000 as s", "id % 25000 + 5 as e", "true as is_final", "'match' as status", "true as reliable")
    votes, lines = ep.aligned_plays(d, "mix", "mix", "ref", "rate", 1)
    assert votes.groupBy("candidate").agg(F.count("*"), F.countDistinct("id"), F.max("occurrence")).orderBy("candidate").collect() == [(k, 25_000, 25_000, 0) for k in range(3)]
    assert [(r.aligned, r.segments, r.outliers) for r in lines.collect()] == [(True, 1, 0)] * 3


def test_unscanned_windows_are_counted_not_listed(spark):
    # regions of up to a year of ten-minute windows, off the grid and with a tail
    r = spark.range(2000).selectExpr("id % 3 as media", "'x' as trigger", "id * 7 as s", "id * 7 + if(id % 2 = 0, 50, 52000 * id) as e")
    seen = spark.range(60_000).selectExpr("id % 2 as media", "id * 13 as at")
    t = time.time()
    got = {(x.media, x.s, x.e): x.planned for x in ep.unscanned(r, 20, 10, seen).collect()}
    assert time.time() - t < 30
    at = {(i % 2, i * 13) for i in range(60_000)}
    for i in [*range(0, 2000, 2), 1, 3]:
        m, s, e = i % 3, i * 7, i * 7 + (50 if i % 2 == 0 else 52_000 * i)
        starts = {*range(s, e - 19, 10), e - 20}
        assert got.get((m, s, e), 0) == sum((m, x) not in at for x in starts), i


def test_links_that_are_conflicts_are_read_once(spark):
    links = spark.createDataFrame([(1, 1, 2), (2, 2, 3), (2, 2, 3), (3, 1, 3), (4, 7, 8), (5, 9, 9), (6, 2, None)], "id long, a long, b long")
    bad = spark.createDataFrame([(1, 3), (7, 8), (2, None), (None, 1), (50, 60)], "a long, b long")
    merged = tl.merge_with_veto(links, bad)
    # pairs and conflicts meet in one aggregate, partial and final, not in one each
    assert plan_of(merged).count("keys=[a#") == 2
    assert dict(merged.collect()) == {1: 1, 2: 1, 3: 3, 7: 7, 8: 8, 9: 9}
