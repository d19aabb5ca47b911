import random

import xxhash

from tidemark.llm import simhash
from tidemark.llm.q_simhash import op9_simhash

M = (1 << 64) - 1


def plain(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    hs = [xxhash.xxh64(" ".join(words[i : i + 4]).encode(), seed=42).intdigest() for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups(fps: dict[int, int], k=4):
    up = {i: i for i in fps}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(fps)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            if (fps[i] ^ fps[j]).bit_count() <= k:
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: root(i) for i in fps}


def test_query_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    fps = {r.doc_id: plain(r.text) for r in docs}
    want = groups(fps)
    got = op9_simhash(spark, "/root/testdata/sf0.01").collect()
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {r.doc_id: r.component_id for r in got} == want


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_links_of_planted_fingerprints(spark):
    rng = random.Random(5)
    fps = {}
    for g in range(25):
        base = rng.getrandbits(64)
        for m in range(rng.choice([1, 2, 5, 30, 150])):
            x = base
            for b in rng.sample(range(64), rng.randint(0, 3)):
                x ^= 1 << b
            fps[1000 * g + m] = x
    fps |= {99_000 + i: rng.getrandbits(64) for i in range(300)}
    fps[98_000], fps[98_001] = 0, M
    distinct = {}
    for i in sorted(fps):
        distinct.setdefault(fps[i], i)
    want = groups({i: f for f, i in distinct.items()})
    points = spark.createDataFrame([(i, signed(f)) for f, i in distinct.items()], "id long, fp long")
    for how in ({}, {"block": 16}, {"groups": 5}, {"groups": 8, "block": 50}):
        links = simhash.close_links(points, **how)
        found = {r.node: r.component for r in simhash.connected_components(links).collect()}
        assert {i: found.get(i, i) for i in want} == want, how
    assert links.count() < 12 * len(distinct) * 70


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (3, "a b"), (None, "a b"), (5, "A\tB"), (6, "word " * 50_000)]
    out = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == 7
    by = {}
    for r in out:
        by.setdefault(r.id, set()).add((r.fp, r.component_id))
    assert by[1] == by[2] == {(0, 1)} and by[5] == by[None] and all(c == 3 for _, c in by[5])
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
