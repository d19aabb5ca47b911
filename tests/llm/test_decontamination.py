import hashlib
import random
import re

import duckdb
import numpy as np
import pytest

from tidemark.llm import decontamination as dc
from tidemark.llm.q_decon import ORACLE_SQL, op11_decontamination

_AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return [(m.group(), m.start(), m.end()) for m in re.finditer(dc.WORD, (t or "").translate(_AZ))]


def by_hand(docs, items, window=10):
    """Per text: words, covered word numbers, items; every window is compared."""
    wins = []
    for i, t in items:
        w = [x[0] for x in words(t)]
        n = min(len(w), window)
        wins += [(i, tuple(w[k : k + n])) for k in range(len(w) - n + 1) if n]
    out = []
    for t in docs:
        w = [x[0] for x in words(t)]
        hit, met = set(), set()
        for i, x in wins:
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k : k + len(x)]) == x:
                    hit |= set(range(k, k + len(x)))
                    if i is not None:
                        met.add(str(i))
        out.append((len(w), hit, sorted(met)))
    return out


def rows_of(docs, found):
    return sorted(((i, n, len(h), len(m), hashlib.sha256(",".join(m).encode()).hexdigest(), bool(h)) for (i, _), (n, h, m) in zip(docs, found, strict=True)), key=str)


P = "alpha Bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november"
ITEMS = [(1, P), (2, "Kilo, lima! mike."), (3, ""), (4, None), (5, "ÀB été 中文 x"), (6, P.split(" ", 1)[1]), (None, "red green blue"), (10, "one"), (1, "papa quebec romeo"), (7, " ".join(f"w{k}" for k in range(40)))]
DOCS = [
    (1, P), (2, "x " + P.upper().replace(" ", "\n-- ") + " y"), (3, " ".join(P.split()[:9])), (4, " ".join(P.split()[:10])), (5, None), (6, ""), (7, "kilo lima MIKE kilo lima"),
    (8, "Àb été 中文 X; àb été"), (9, "red  green blue one two one"), (10, "... !!"), (11, " ".join(f"w{k}" for k in range(5, 33))), (12, "papa quebec romeo"), (12, "papa quebec romeo"),
    (None, "one"), (13, "kilo lima mikes"), (14, "é" * 4000 + " one"), (15, ("kilo lima mike " * 50)),
]


@pytest.mark.parametrize("chunk, slice_bytes", [(1_000_000, 32_000_000), (7, 60), (200, 120)])
def test_odd_rows_small_chunks_and_slices(spark, monkeypatch, chunk, slice_bytes):
    monkeypatch.setattr(dc, "PIECE", 3 if chunk == 7 else 20_000)
    d = spark.createDataFrame([(i, t, "x") for i, t in DOCS], "doc_id long, text string, items string")
    b = spark.createDataFrame(ITEMS, "item_id long, text string")
    out = dc.contamination(d, b, slice_bytes=slice_bytes)
    got = sorted(((r.doc_id, r.n_words, sum(s.end_word - s.first_word for s in r.spans), r.items) for r in out.collect()), key=str)
    assert got == sorted(((i, n, len(h), m) for (i, _), (n, h, m) in zip(DOCS, by_hand([t for _, t in DOCS], ITEMS), strict=True)), key=str)
    for i, t in DOCS:  # chunks of a few words give the same windows
        monkeypatch.setattr(dc, "CHUNK", chunk)
        w = dc.Words([(t or "").encode(), b"tail words"])
        assert [w.text(k, 1).decode() for k in range(len(w.first))] == [x[0] for x in words(t)] + ["tail", "words"]
        for n in (1, 2, 10):
            at = np.concatenate([a for a, _ in w.windows(n)] or [np.zeros(0, int)])
            assert at.tolist() == [k for k in range(len(w.first) - n + 1) if w.owner[k] == w.owner[k + n - 1]]


def test_random_texts(spark):
    rng = random.Random(3)
    text = lambda n, v: " ".join(rng.choice(v) + rng.choice(["", "", ",", "."]) for _ in range(n))
    some = ["a", "B", "c", "é", "9"]
    items = [(k, text(rng.randint(1, 14), some)) for k in range(30)]
    docs = [(k, text(rng.randint(0, 60), some)) for k in range(60)]
    b, d = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_words, {k for s in r.spans for k in range(s.first_word, s.end_word)}, r.items) for r in dc.contamination(d, b, window=4).collect()), key=str)
    assert got == sorted(((i, *f) for (i, _), f in zip(docs, by_hand([t for _, t in docs], items, 4), strict=True)), key=str)


def test_texts_without_spans_and_documents(spark):
    d = spark.createDataFrame([(i, t, "kept", "too") for i, t in DOCS], "doc_id long, text string, spans string, `a.b` string")
    b = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = []
    for i, t in DOCS:
        hit = by_hand([t], ITEMS)[0][1]
        runs = [k for k in hit if k - 1 not in hit]
        cut, w = t, words(t)
        for k in reversed(sorted(runs)):
            e = k
            while e + 1 in hit:
                e += 1
            cut = cut[: w[k][1]] + cut[w[e][2] :]
        want.append((i, cut, "kept", "too"))
    assert sorted(map(tuple, dc.decontaminate(d, b).collect()), key=str) == sorted(want, key=str)
    clean = [(i, t, "kept", "too") for i, t in DOCS if not by_hand([t], ITEMS)[0][1]]
    assert sorted(map(tuple, dc.decontaminate(d, b, "documents").collect()), key=str) == sorted(clean, key=str)
    assert dc.decontaminate(d, b.where("false")).count() == len(DOCS)
    assert dc.decontaminate(d.where("false"), b).count() == 0
    with pytest.raises(ValueError):
        dc.decontaminate(d, b, "words")


def test_equal_hashes_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(dc, "_mixed", lambda h: np.zeros_like(h))
    pool = dc.pool_of([("1", "a b c"), ("2", "d e f"), ("3", "a b c")], window=2)
    w = dc.Words([b"x a b", b"e f"])
    change, items = dc._hits(w, [pool])
    assert np.cumsum(change)[:-1].tolist() == [0, 1, 1, 1, 1] and items == [{"1", "3"}, {"2"}]


def test_query_and_sql(spark, tmp_path):
    own = f"{tmp_path}/own"
    spark.createDataFrame(DOCS, "doc_id long, text string").repartition(3).write.parquet(f"{own}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{own}/benchmark.parquet")
    for sf, files in (("/root/testdata/sf0.001", ""), (own, "/*.parquet")):
        docs, items = ([tuple(r) for r in spark.read.parquet(f"{sf}/{t}.parquet").select(k, "text").collect()] for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
        got = sorted(map(tuple, op11_decontamination(spark, sf).collect()), key=str)
        c = duckdb.connect()
        for t in ("documents", "benchmark"):
            c.sql(f"CREATE VIEW {t} AS FROM '{sf}/{t}.parquet{files}'")
        assert sorted(c.sql(ORACLE_SQL["op11_decontamination"]).fetchall(), key=str) == got
        if files:
            assert got == rows_of(docs, by_hand([t for _, t in docs], items))
        else:
            assert any(r[5] for r in got)
