import random

import pyarrow as pa

from tidemark import plans
from tidemark.operators import graph
from tidemark.operators.graph import connected_components

SF = "/root/testdata/sf0.001"


def test_components(spark):
    links = [(5, 4), (4, 3), (3, 2), (9, 8), (8, 9), (7, 7), (2, 1), (None, 1), (20, 30), (30, 25)]
    got = dict(connected_components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8, 7: 7, 20: 20, 25: 20, 30: 20}


def test_empty_and_long_chain(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    got = dict(connected_components(spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")).collect())
    assert set(got.values()) == {0} and len(got) == 61


def union_find(links):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    return {n: root(n) for n in list(up)}


def test_queries_link_every_row(spark):
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_partkey", "l_suppkey").collect()
    want = union_find((p, s + 1_000_000_000) for p, s in rows)
    queries = plans.queries()
    assert dict(queries["connected_components_all"](spark, SF).collect()) == want
    groups = {}
    for n, c in want.items():
        groups.setdefault(c, []).append(n)
    got = {r.component: (r.members, r.last) for r in queries["provenance_groups_all"](spark, SF).collect()}
    assert got == {c: (len(m), max(m)) for c, m in groups.items()}


def test_veto_query_takes_every_row(spark):
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag").collect()
    links = sorted((o, p, s + 1_000_000_000) for o, p, s, _ in rows)
    foes = {}
    for _, p, s, r in rows:
        if r == "R":
            foes.setdefault(p, set()).add(s + 1_000_000_000)
            foes.setdefault(s + 1_000_000_000, set()).add(p)
    group = {}
    for _, a, b in links:
        x, y = group.setdefault(a, {a}), group.setdefault(b, {b})
        if x is not y and not any(foes.get(m, set()) & y for m in x):
            x |= y
            group.update(dict.fromkeys(y, x))
    got = dict(plans.queries()["recording_merge_veto"](spark, SF).collect())
    assert got == {n: min(m) for n, m in group.items()}


def test_dense_links_are_contracted_before_the_rounds(spark, monkeypatch):
    links = spark.read.parquet(f"{SF}/lineitem.parquet").selectExpr("l_partkey as a", "l_suppkey + 1000000000 as b").distinct()
    sizes, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda d: (sizes.append(d.count()), cut(d))[1])
    want = union_find((r.a, r.b) for r in links.collect())
    assert dict(connected_components(links).collect()) == want
    # before, the rounds began with every distinct link
    assert sizes[0] < links.count() / 2


def test_contracted_links_reach_the_same_nodes(monkeypatch):
    rng = random.Random(3)
    for batch in (1, 40, 10_000):
        monkeypatch.setattr(graph, "BATCH", batch)
        links = [(rng.randrange(-50, 400), rng.randrange(-50, 400)) for _ in range(250)] + [(k, k + 1) for k in range(600, 660)] + [(900, 900), (901, 901)]
        rng.shuffle(links)
        parts = [pa.RecordBatch.from_pylist([{"u": u, "v": v} for u, v in links[i : i + 30]]) for i in range(0, len(links), 30)]
        got = [(r["u"], r["v"]) for b in graph._contracted(iter([*parts, parts[0].slice(0, 0)])) for r in b.to_pylist()]
        assert union_find(got) == union_find(links)
        if batch == 10_000:
            assert len(got) == len(dict(got)) <= len(union_find(links))
    assert list(graph._contracted(iter([]))) == []
