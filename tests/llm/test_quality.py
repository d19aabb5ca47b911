import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import quality_classifier, quality_rules
from tidemark.llm.q_text import op1_quality, op3_quality_rules

SF = "/root/testdata/sf0.01"
WORD = re.compile("[^\x20\x09-\x0d]+")


def stats(text):
    text = text or ""
    w = WORD.findall(text)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(tri)
    hit = {j for i, t in enumerate(tri) if n[t] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), failed


ODD = [None, "", " \n\t", "a", "a b", "a b c", "a b c a b c", "x x x x", "l\nl\n\nl\n \n ", "é # $$ |é|<>&%*", "w " * 30_000, "a b c d\x0ba b c\x0cd a b c", "  　"]


def test_base_statistics(spark):
    d = spark.createDataFrame(list(enumerate(ODD)), "i long, text string").withColumnRenamed("i", "n_words")
    d = d.selectExpr("n_words as i", "text", "'clash' as n_symbols")
    for r in quality_rules.base_stats(d).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == stats(r.text), r.text


FEATURES = ["f_len", "f_symbol", "f_dup", "f_repeat", "f_upper"]
NOISE = np.diag([0.55**2 / 50, 0.25 / 50, 0.25 * 12 / 50, 0.75 / 50, 0.25 / 250])


def least(x):
    """The estimate of least determinant: (vectors, place, spread)."""
    med = np.median(x, 0)
    mad = 1.4826 * np.median(abs(x - med), 0)
    best = None
    for m, c in ((med, np.diag(mad**2)), (x.mean(0), np.cov(x.T, bias=True).reshape(5, 5)), (med, np.zeros((5, 5)))):
        c, last = c + NOISE, None
        while True:
            d2 = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
            bins = np.floor(np.log1p(d2) * 64)
            near = bins <= np.sort(bins)[(len(bins) + 1) // 2 - 1]
            m = x[near].mean(0)
            s = np.cov(x[near].T, bias=True).reshape(5, 5)
            c = 1.9122080587911052 * s + NOISE
            det = round(np.linalg.slogdet(c)[1], 8)
            if det == last:
                break
            last = det
        if best is None or det < best[0] - 1e-7:
            best = (det, near.sum(), m, s)
    return best[1:]


def by_hand(rows):
    """Squared distance of every row (lang, source, vector in thousandths)."""
    x = np.array([r[2] for r in rows], float)
    q = np.array([[int(abs(v) / 10 + 0.5) * (1 if v >= 0 else -1) for v in r[2]] for r in rows]) / 100
    lean = lambda a, b: (a[0] / (a[0] + 50) * a[1] + 50 / (a[0] + 50) * b[0], a[0] / (a[0] + 50) * a[2] + 50 / (a[0] + 50) * b[1])
    every, out = least(q)[1:], np.zeros(len(rows))
    for lang in {r[0] for r in rows}:
        i = [k for k, r in enumerate(rows) if r[0] == lang]
        of_lang = lean(least(q[i]), every)
        for source in {rows[k][1] for k in i}:
            j = [k for k in i if rows[k][1] == source]
            m, s = lean(least(q[j]), of_lang)
            z = x[j] / 1000 - m
            out[j] = np.einsum("ij,jk,ik->i", z, np.linalg.inv(1.9122080587911052 * s + NOISE), z)
    return out


def test_rules_query(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = op3_quality_rules(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == stats(docs[r.doc_id].text)
        assert not (r.base_failed and r.kept)
    vec = {r.doc_id: r for r in quality_rules.vectors(quality_rules.base_stats(spark.read.parquet(f"{SF}/documents.parquet"))).collect()}
    fine = [r for r in got if not r.base_failed]
    want = by_hand([(docs[r.doc_id].lang, docs[r.doc_id].source, [vec[r.doc_id][f] for f in FEATURES]) for r in fine])
    assert np.allclose([r.distance for r in fine], want, rtol=1e-6, atol=1e-6)
    assert [r.kept for r in fine] == (want <= 25.744832).tolist()
    rest = [r for r in fine if r.doc_id in labels]
    assert sum(r.kept == (labels[r.doc_id] == 1) for r in rest) >= 0.995 * len(rest)


def test_outliers_in_groups_and_small_tables(spark):
    rng = random.Random(1)
    line = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(12))
    clean = [(i, "\n".join(line() for _ in range(rng.randint(6, 30))), "en", f"s{i % 2}" if i % 7 else None) for i in range(400)]
    junk = [(1000 + i, "\n".join(line().replace(" ", "### ") for _ in range(9)), "en", "s0") for i in range(60)]
    few = [(2000 + i, "\n".join(line() for _ in range(8)), None, f"t{i}") for i in range(3)] + [(3000, None, "en", "empty"), (3001, "", "xx", "s0")]
    d = spark.createDataFrame(clean + junk + few + few[:1], "doc_id long, text string, lang string, source string")
    d = d.selectExpr("*", "1 as level", "2 as g_lang", "'x' as _jl", "3 as n", "4 as distance")
    vec = quality_rules.vectors(quality_rules.base_stats(d))
    got = quality_rules.judge(vec, quality_rules.estimates(vec)).collect()
    assert len(got) == 466 and all(r.level == 1 and r.g_lang == 2 and r.n == 3 for r in got)
    assert all(r.kept == (r.doc_id < 1000 or 2000 <= r.doc_id < 3000) for r in got)
    assert all((r.distance is None) == (r.doc_id >= 3000) for r in got)
    alone = vec.where("doc_id < 5")
    assert all(r.kept and r.distance < 10 for r in quality_rules.judge(alone, quality_rules.estimates(alone)).collect())
    none = vec.where("false")
    assert quality_rules.judge(none, quality_rules.estimates(none)).count() == 0


def test_classifier_on_held_out(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = op1_quality(spark, SF).collect()
    assert len(got) == 1000 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in labels]
    good, bad = ([r.score for r in held if labels[r.doc_id] == y] for y in (1, 0))
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert auc >= 0.95
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= 0.93 * len(held)


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, 1), (2, 0)], [(1, None), (None, 0)]])
def test_classifier_with_few_labels(spark, labels):
    """Too little text for a dictionary: every score is the share of label 1."""
    d = spark.createDataFrame([(1, "good text here"), (2, "### bad"), (2, "### bad"), (3, None), (None, ""), (5, "z" * 300_000)], "doc_id long, text string")
    m = quality_classifier.fit(d, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert not m.good and not m.bad
    got = quality_classifier.score(d.selectExpr("doc_id", "text", "'x' as score"), m).collect()
    want = {0: 0.5, 1: 0.75, 2: 0.5}[sum(y is not None and i is not None for i, y in labels)]
    assert len(got) == 6 and all(abs(r.score - want) < 1e-12 for r in got)
    assert quality_classifier.score(d.where("false"), m).count() == 0


def test_classifier_takes_one_text_an_id(spark, monkeypatch):
    rng = random.Random(2)
    word = lambda s: "".join(rng.choice(s) for _ in range(rng.randint(3, 7)))
    rows = [(i, " ".join(word("abcde" if i % 2 else "vwxyz") for _ in range(200))) for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int")
    m = quality_classifier.fit(d, labels)
    # repeats of a labelled row, and a longer text of its id, change nothing
    more = d.unionByName(spark.createDataFrame([rows[4]] * 50 + [(4, "~" + rows[4][1] * 9)], d.schema))
    assert quality_classifier.fit(more, labels) == m and m.good and m.bad
    got = {r.doc_id: r.score for r in quality_classifier.score(d, m).collect()}
    assert all((got[i] >= 0.5) == (i % 2 == 1) for i in got)
    # bounded samples
    monkeypatch.setattr(quality_classifier, "DICT_PIECES", 60)
    few = quality_classifier.fit(d, labels)
    assert len(few.good) <= 60 * 1024 and few.slope > 0
