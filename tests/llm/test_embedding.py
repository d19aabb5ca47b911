import numpy as np

from tidemark.llm import embedding_dedup
from tidemark.llm.q_embed import op2_embedding


def brute(rows, threshold=0.95):
    """{id: (links, component)} of rows (id, vector)."""
    good = [(i, np.array(v, float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n, up = {i: 0 for i, _ in rows}, {i: i for i, _ in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, (i, u) in enumerate(good):
        for j, v in good[a + 1 :]:
            if len(u) == len(v) and u @ v / np.sqrt((u @ u) * (v @ v)) >= threshold:
                n[i] += 1
                n[j] += 1
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return {i: (n[i], root(i)) for i in n}


def test_planted(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = []
    for c in range(40):
        base = rng.normal(size=16)
        for _ in range(rng.integers(1, 9)):
            rows.append((len(rows), (base + rng.normal(size=16) * rng.choice([0, 0.05, 0.15, 0.25])).tolist()))
    rows += [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] + [1.0] * 15), (1003, [float("inf")] + [1.0] * 15), (1004, [None] + [1.0] * 15), (1005, [1.0] * 15), (1006, [2.0] * 15), (1007, [1e30] * 16), (1008, [1.0] * 16), (1009, [])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as n_links")
    want = brute(rows)
    for block, how in ((1024, {}), (8, {"cells": 6, "margin": "sure"}), (8, {"cells": 1})):
        monkeypatch.setattr(embedding_dedup, "BLOCK", block)
        got = embedding_dedup.near_duplicates(d, **how).collect()
        assert {r.id: (r.n_links, r.component_id) for r in got} == want, how
        assert all(r.kept == (r.id == r.component_id) for r in got) and len(got) == len(rows)
    assert embedding_dedup.near_duplicates(d.where("false")).count() == 0
    assert embedding_dedup.near_duplicates(d.where("vec_id in (1000, 1001)")).count() == 2


def test_rows_that_share_an_id(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.0, 1.0]), (None, [1.0, 0.0]), (4, [-1.0, 0.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as no", "2 as n", "3 as component")
    got = sorted(((r.id or 0, r.n_links, r.component_id or 0) for r in embedding_dedup.near_duplicates(d).collect()))
    assert got == [(0, 0, 0), (1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 0, 4)]


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.1"
    x = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").toPandas().sort_values("vec_id")
    v = np.array(x["embedding"].tolist(), float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    hit = v @ v.T >= 0.95
    got = op2_embedding(spark, sf).toPandas().sort_values("vec_id")
    assert got["vec_id"].tolist() == x["vec_id"].tolist()
    assert got["n_links"].tolist() == (hit.sum(axis=1) - 1).tolist()
