import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tidemark.operators import crowd
from tests import label_rules as tt
from tests.test_text_functions import TOLERANCES


def labels(spark, rows):
    d = spark.createDataFrame(rows, "id long, artist string, title string")
    return crowd.labels_of(d, "id", "artist", "title")


def pairs(found, ls):
    ids = {r.label: r.ids for r in ls.collect()}
    return {(x, y): r for r in found.collect() for x in ids[r.a] for y in ids[r.b]}


@pytest.mark.parametrize("case", TOLERANCES)
def test_cases(spark, case):
    a, t, b, u, want = case
    ls = labels(spark, [(1, a, t), (2, b, u)])
    got = pairs(crowd.tolerant_pairs(ls), ls)
    found = {r.tolerance for r in got.values()}
    if ls.count() == 2:
        assert found == ({",".join(want)} if want is not None else set())
    else:
        assert want in ([], None) and not found


def test_pairs_against_every_pair(spark):
    rng = random.Random(6)
    artists = ["Jonathan", "Jonathen", "LCD", "Less Cool Disco", "A & B", "Tiësto", "Tiesto"]
    titles = ["Sun Rise", "Sunrise", "Sunrize", "I think Sun Rise", "Running Man", "Runn Man", "Deep Water", "Deep Water Live Take", "One / Two", "Two (Mix)", "Phone Kall", "Fone Call", "Up", "Us"]
    rows = [(i, rng.choice(artists), rng.choice(titles)) for i in range(150)]
    ls = labels(spark, rows)
    got = {tuple(sorted(k)): r.tolerance for k, r in pairs(crowd.tolerant_pairs(ls), ls).items()}
    same = {i: r.label for r in ls.collect() for i in r.ids}
    seen = set()
    for (i, a, t), (j, b, u) in combinations(rows, 2):
        if same[i] == same[j]:
            continue
        want = tt.label_tolerances(a, t, b, u)
        have = got.get((i, j))
        assert have == (None if want is None else ",".join(want)), (a, t, b, u)
        seen.add(have)
    assert len(seen - {None}) >= 9


def test_words_fold(spark):
    d = spark.createDataFrame([("Ün & Déux feat. N.E.R.D. a. x.y Ǻ Øre Łódź",)], "t string")
    assert d.select(crowd.label_words(F.col("t"))).first()[0] == ["un", "deux", "nerd", "a", "x", "y", "a", "øre", "łodz"]


def brute_links(rows):
    """All pairs of distinct word lists, components and mutual partners by hand."""
    words = {i: (tt.label_words(a), tt.label_words(t)) for i, a, t in rows}
    every = {i: set(a + t) for i, (a, t) in words.items()}

    def near(x, y):
        return tt._near(x, y) and x != y or (x.isalpha() and y.isalpha() and (y[:-1] == x or x[:-1] == y) and min(len(x), len(y)) >= 2)

    def corroborates(i, j):
        x, y = every[i] - every[j], every[j] - every[i]
        return min(len(every[i]), len(every[j])) >= 2 and (not x or not y or (len(x) == len(y) == 1 and bool(every[i] & every[j]) and near(*x, *y)))

    raw = {i: (a, t) for i, a, t in rows}
    sure = {p for p in combinations(sorted(raw), 2) if corroborates(*p) or words[p[0]] == words[p[1]] or words[p[0]] == words[p[1]][::-1]}
    group = {i: i for i in raw}
    while (moved := {(i, j) for i, j in sure if group[i] != group[j]}):
        for i, j in moved:
            old, new = max(group[i], group[j]), min(group[i], group[j])
            group = {k: new if g == old else g for k, g in group.items()}
    loose = {(i, j): ",".join(w) for i, j in combinations(sorted(raw), 2) if (w := tt.label_tolerances(*raw[i], *raw[j])) and group[i] != group[j]}
    partner = {g: {group[b] if group[a] == g else group[a] for a, b in loose if g in (group[a], group[b])} for g in set(group.values())}
    kept = {p: w for p, w in loose.items() if partner[group[p[0]]] == {group[p[1]]} and partner[group[p[1]]] == {group[p[0]]}}
    return {p: (6000, "") for p in sure} | {p: (5500, w) for p, w in kept.items()}


def test_crowd_links_against_every_pair(spark):
    rows = [(1, "Alex Anderson", "Song"), (2, "Alex Andersson", "Song"), (3, "Entasia", "Satalite"), (4, "Satalite", "Entasia"), (5, "Entasia", "Satalites"), (6, "Mall Grab", "Sun Rise"), (7, "Mall Grab", "Sunrise"), (8, "X", "Up"), (9, "X", "Us"), (10, "LCD", "Tune"), (11, "Less Cool Disco", "Tune"), (12, "Lone Cat Duo", "Tune"), (13, "Effy", "Pitched"), (14, "Effy", "Clubgrls")]
    rows += [(20 + i, f"Artist {'abcdefghij'[i]}", f"Common {'qrstuvwxyz'[i]} words") for i in range(10)]
    ls = labels(spark, rows)
    got = {tuple(sorted(k)): (r.confidence, r.tolerance) for k, r in pairs(crowd.crowd_links(ls), ls).items()}
    assert got == brute_links(rows)
    assert got[6, 7] == (5500, "spaced") and (10, 11) not in got and (8, 9) not in got and got[3, 4][0] == 6000
    assert crowd.crowd_links(ls.where("false")).count() == 0
