import math
from collections import defaultdict

from tidemark.llm import mixing
from tidemark.llm.q_mix import op7_mixing

S = "doc_id long, text string, source string, lang string"


def by_hand(sizes: dict, weights=(3, 1, 2)):
    """Targets by resharing the excess until none is above its cap."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            out |= share
            break
        for s in over:
            out[s] = 2 * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def check(rows, per_source_slack=None):
    total, taken, target, src = defaultdict(int), defaultdict(int), {}, {}
    for r in rows:
        total[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        src[r.source] = r.source_size
        assert 0 <= r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
    want = by_hand(total)
    for s in total:
        assert src[s] == total[s]
        assert abs(target[s] - want[s]) < 1e-6 * max(1, want[s])
        assert abs(taken[s] - target[s]) <= max(0.01 * target[s], per_source_slack or 3), (s, taken[s], target[s])


def test_query_meets_targets_and_repeats(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source")
    out = op7_mixing(spark, "/root/testdata/sf0.01")
    rows = out.join(docs, "doc_id").collect()
    assert len(rows) == 1000
    check(rows)
    again = op7_mixing(spark, "/root/testdata/sf0.01").collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in rows)


def test_odd_rows(spark):
    rows = [(1, None, "a", "x"), (2, "", None, "x"), (3, "one two", None, None), (4, "w " * 500, "b", "x"), (5, "w " * 500, "b", "x"), (5, "w " * 500, "b", "x"), (None, "q r s", "c", "x"), (7, "k", "a", "x")]
    d = spark.createDataFrame(rows, S).withColumnRenamed("lang", "size")
    out = mixing.mix(d).collect()
    assert len(out) == len(rows)
    assert all(0 <= r.copies <= 2 for r in out)
    assert {r.copies for r in out if r.size == 0} == {1}
    assert mixing.mix(d.where("false")).count() == 0
    assert mixing.mix(spark.createDataFrame([(1, None, None, None)], S)).first().copies == 1


def test_many_equal_sizes(spark):
    rows = [(i, "w x y z", "hot", None) for i in range(4000)] + [(10_000 + i, "v " * (i % 40 + 1), f"s{i % 5}", None) for i in range(400)]
    out = mixing.mix(spark.createDataFrame(rows, S)).collect()
    taken, target = defaultdict(int), {}
    for r in out:
        taken[r.source] += r.copies * r.size
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 5 for s in taken)


def test_rates_are_the_exponential_tilt(spark):
    """Multipliers by bisection, without the operator's steps: from the longest
    texts down, each size takes within one copy what its rate and the words owed
    so far say, of at most two a document."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source")
    rows = defaultdict(list)
    for r in op7_mixing(spark, "/root/testdata/sf0.01").join(docs, "doc_id").collect():
        rows[r.source].append(r)
    tilted = 0
    for own in rows.values():
        total, target = sum(r.size for r in own), own[0].target
        mean = total / len(own)
        rate = lambda lam, size: 2 / (1 + math.exp(-max(-700.0, min(700.0, lam * size / mean))))  # noqa: E731, B023
        lo, hi = -1e4, 1e4
        for _ in range(200):
            lam = (lo + hi) / 2
            if sum(r.size * rate(lam, r.size) for r in own) < target:  # noqa: B023
                lo = lam
            else:
                hi = lam
        capped = target >= 2 * total * (1 - 1e-9)
        tilted += not capped
        taken = expected = 0.0
        cells = defaultdict(list)
        for r in own:
            cells[r.size].append(r)
        for size in sorted(cells, reverse=True):
            if size:
                n, own_taken = len(cells[size]), sum(r.taken for r in cells[size])
                expected += n * size * (2 if capped else rate(lam, size))
                copies = min(max((expected - taken) / size, 0), 2 * n)
                assert abs(own_taken - copies * size) <= size
                taken += own_taken
    assert tilted > 3
