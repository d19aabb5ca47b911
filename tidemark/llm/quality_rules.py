"""Quality rules: base statistics of a text, and robust multivariate outliers.

Statistic vectors are compared within their language and source. A
minimum-covariance-determinant estimate of place and spread is found for every
group by concentration steps from several starts; small groups lean on their
language's estimate, and languages on that of all; a vector far from its group
by Mahalanobis distance is rejected. All of it is DataFrame code.
"""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, WORD, once, text_of
from tidemark.runtime import table

FEATURES = ("f_len", "f_symbol", "f_dup", "f_repeat", "f_upper")
P = len(FEATURES)
#: Features are kept as whole thousandths; estimates are made on counts of
#: vectors rounded to hundredths (STEP thousandths), so sums don't depend on order.
UNIT, STEP = 1000, 10
#: Words of the shortest text that passes the base rules, with its lines at 12
#: words and its letters at 5 a word: what its vector may differ by by chance
#: (half over root of the count, for square roots of shares; repeated words come
#: in threes; the log of a mean length by 0.55 over root) is added to any spread.
WORDS = 50
NOISE = (0.55 / sqrt(WORDS), 0.5 / sqrt(WORDS), 0.5 / sqrt(WORDS / 12), 0.5 * sqrt(3 / WORDS), 0.5 / sqrt(5 * WORDS))
#: For P = 5: what the spread of the inner half of normal vectors is scaled by,
#: and the chi-square value that one in ten thousand of them exceeds.
CONSISTENT, CUTOFF = 1.9122080587911052, 25.744832
#: Vectors that a wider group's estimate counts as in a narrower one's.
PRIOR = 50
#: Concentration steps at most; they end when no group's determinant falls.
STEPS = 30


def base_stats(df: DataFrame, text: str = "text") -> DataFrame:
    """`df` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed and the helper columns of the method's vector (`_lines`,
    `_upper`). A null text counts as empty: all zero, base_failed true.

    Three-word windows are compared by 64-bit hashes of their words, sorted
    within the row only where one repeats."""
    d = df.withColumn("_t", text_of(df, text))
    d = d.withColumn("_w", F.filter(F.split("_t", SPACE + "+"), lambda w: w != ""))
    n = F.size("_w")
    more = F.greatest(n - 2, F.lit(0))
    zipped = F.arrays_zip(*(F.slice("_w", k, more).alias(f"w{k}") for k in (1, 2, 3)))
    windows = F.transform(zipped, lambda z: F.xxhash64(z["w1"], z["w2"], z["w3"]))
    d = d.withColumn("n_words", n.cast("long")).withColumn("_h", windows)
    # (window, place) in order, for rows where a window repeats
    d = d.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.array_sort(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    same = lambda e, j: F.coalesce(e["h"] == F.get("_s", j)["h"], F.lit(False))
    d = d.withColumn("_p", F.sort_array(F.transform(F.filter("_s", lambda e, j: same(e, j - 1) | same(e, j + 1)), lambda e: e["i"])))
    width = F.transform("_p", lambda p, j: F.least(F.lit(3), F.coalesce(F.get("_p", j + 1) - p, F.lit(3))))
    d = d.withColumn("n_repeat_words", F.coalesce(F.aggregate(width, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"))
    d = d.withColumn("_l", F.filter(F.split("_t", "\n"), lambda x: x.rlike(WORD)))
    without = lambda chars: F.length(F.translate("_t", chars, ""))
    made = {
        "n_words": F.col("n_words"),
        "word_chars": without(" \t\n\x0b\x0c\r").cast("long"),
        "n_symbols": (F.length("_t") - without("#*$%&|<>")).cast("long"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        "n_repeat_words": F.col("n_repeat_words"),
        "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        "_upper": (F.length("_t") - without("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).cast("long"),
        "_lines": F.size("_l").cast("long"),
    }
    own = [c for c in df.columns if c not in made]
    d = once(d, "_made", F.struct(*(c.alias(k) for k, c in made.items())))
    return d.select(*own, "_made.*")


def vectors(stats: DataFrame) -> DataFrame:
    """The transformed vector: logarithm of the mean word length, square roots
    of the shares of symbols, repeated lines, repeated words and capitals, in
    whole thousandths (a text without words has zeros)."""
    w, c = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    f = (F.log(c / w), F.sqrt(F.col("n_symbols") / w), F.sqrt(F.col("n_dup_lines") / F.greatest("_lines", F.lit(1))), F.sqrt(F.col("n_repeat_words") / w), F.sqrt(F.col("_upper") / c))
    return stats.withColumns({name: F.round(x * UNIT).cast("long") for name, x in zip(FEATURES, f, strict=True)})


_PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
_KEY = ["level", "g_lang", "g_source"]
_PLACE = [f"m_{i}" for i in range(P)]
_SPREAD = [f"s_{i}_{j}" for i, j in _PAIRS]
_FACTOR = [f"l_{i}_{j}" for i, j in _PAIRS]


# Long formulas are written as SQL text, which is parsed once; Column by Column
# they would take the driver longer than the steps take the cluster.


def _cholesky(d: DataFrame, scale: float = CONSISTENT) -> DataFrame:
    """`d` with l_i_j, the Cholesky factor of the scaled spread and the noise."""
    rest = lambda i, j: " ".join([f"{scale} * s_{i}_{j}", *(f"- l_{i}_{k} * l_{j}_{k}" for k in range(j))])
    for j in range(P):
        d = d.withColumn(f"l_{j}_{j}", F.expr(f"sqrt(greatest({rest(j, j)} + {NOISE[j] ** 2}D, 1e-12D))"))
        if j + 1 < P:
            d = d.withColumns({f"l_{i}_{j}": F.expr(f"({rest(i, j)}) / l_{j}_{j}") for i in range(j + 1, P)})
    return d


def _distance(vector: list[str], prefix: str = "") -> str:
    """Squared Mahalanobis distance by forward substitution."""
    z: list[str] = []
    for i, v in enumerate(vector):
        part = " ".join([f"{v} - {prefix}m_{i}", *(f"- {prefix}l_{i}_{k} * {z[k]}" for k in range(i))])
        z.append(f"(({part}) / {prefix}l_{i}_{i})")
    return " + ".join(f"{x} * {x}" for x in z)


_VECTOR = [f"v_{i}" for i in range(P)]


_TOTALS = ["n", *(f"a_{i}" for i in range(P)), *(f"q_{i}_{j}" for i, j in _PAIRS)]


def _sums() -> list[Column]:
    """Whole sums of counted vectors: number, sums, sums of products."""
    first = [f"sum(n * {v}) AS a_{i}" for i, v in enumerate(_VECTOR)]
    return [*map(F.expr, ["sum(n) AS n", *first, *(f"sum(n * v_{i} * v_{j}) AS q_{i}_{j}" for i, j in _PAIRS)])]


def _moments(e: DataFrame) -> DataFrame:
    """`e` with place and spread from its sums in their stead."""
    unit = f"{STEP / UNIT}D"
    e = e.withColumns({f"m_{i}": F.expr(f"a_{i} / n * {unit}") for i in range(P)})
    spread = {f"s_{i}_{j}": F.expr(f"q_{i}_{j} / n * {unit} * {unit} - m_{i} * m_{j}") for i, j in _PAIRS}
    return e.withColumns(spread).drop(*_TOTALS[1:])


def _starts(x: DataFrame) -> DataFrame:
    """Three starts a group: medians with median absolute deviations, mean with
    covariance, and medians with the noise alone. Medians are of counted values,
    of which a feature has some hundreds, merged before they are shuffled."""
    med = table(x.groupBy(*_KEY).agg(*(F.expr(f"percentile({v}, 0.5D, n) AS c_{i}") for i, v in enumerate(_VECTOR))), "medians")
    off = [F.expr(f"percentile(abs({v} - c_{i}), 0.5D, n) AS d_{i}") for i, v in enumerate(_VECTOR)]
    both = x.join(med, _KEY).groupBy(*_KEY).agg(*(F.expr(f"first(c_{i}) AS c_{i}") for i in range(P)), *off)
    place = [f"c_{i} * {STEP / UNIT}D AS m_{i}" for i in range(P)]
    spread = lambda f: [f"{f.format(i) if i == j else '0.0D'} AS s_{i}_{j}" for i, j in _PAIRS]
    mads = both.selectExpr(*_KEY, "0 AS start", *place, *spread(f"power(1.4826D * d_{{}} * {STEP / UNIT}D, 2)"))
    noise = both.selectExpr(*_KEY, "2 AS start", *place, *spread("0.0D"))
    mean = _moments(x.groupBy(*_KEY).agg(*_sums())).select(*_KEY, F.lit(1).alias("start"), *_PLACE, *_SPREAD)
    return _cholesky(mads.unionByName(mean).unionByName(noise), 1.0).select(*_KEY, "start", *_PLACE, *_FACTOR)


def _name(col: str) -> Column:
    """A group's name, never null and never that of no group."""
    return F.coalesce(F.concat(F.lit("="), F.col(col).cast("string")), F.lit("null"))


def _least(x: DataFrame) -> DataFrame:
    """The estimate of least determinant of each group, over its starts.

    A step sums vectors by bins of their distance; the inner half is the bins up
    to the one with the median, so it is found from a row a bin."""
    starts = table(_starts(x), "starts")
    states, key, before = starts, [*_KEY, "start"], None
    of = Window.partitionBy(*key)
    inside = F.sum("n").over(of.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    for _ in range(STEPS):
        d = x.join(states.select(*key, *_PLACE, *_FACTOR), _KEY)
        d2 = _distance([f"{v} * {STEP / UNIT}D" for v in _VECTOR])
        bins = d.withColumn("bin", F.expr(f"least(floor(log1p({d2}) * 64), 4000)")).groupBy(*key, "bin").agg(*_sums())
        half = bins.withColumns({"_in": inside, "_all": F.sum("n").over(of)}).where("2 * _in < _all")
        half = _moments(half.groupBy(*key).agg(*(F.sum(c).alias(c) for c in _TOTALS)))
        states = table(_cholesky(half).withColumn("logdet", F.expr(" + ".join(f"2 * ln(l_{i}_{i})" for i in range(P)))), "step")
        now = states.agg(F.sum("logdet")).first()[0]
        if now is None or (before is not None and now >= before - 1e-7):
            break
        before = now
    best = states.groupBy(*_KEY).agg(F.min(F.struct(F.round("logdet", 9).alias("logdet"), "start", "n", *_PLACE, *_SPREAD)).alias("b"))
    return table(best.select(*_KEY, "b.n", *(f"b.{c}" for c in (*_PLACE, *_SPREAD))), "least")


def _leaning(narrow: DataFrame, wide: DataFrame, on: list[str]) -> DataFrame:
    """Narrow groups' estimates, each with PRIOR vectors of its wide group's."""
    cols = [*_PLACE, *_SPREAD]
    wide = wide.selectExpr(*on, *(f"{c} AS w_{c}" for c in cols))
    both = narrow.join(wide, on) if on else narrow.join(F.broadcast(wide.limit(1)))
    return both.select(*_KEY, "n", *(F.expr(f"(n * {c} + {PRIOR} * w_{c}) / (n + {PRIOR}) AS {c}") for c in cols))


def estimates(vec: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Place and Cholesky factor per (g_lang, g_source), of the vectors that
    passed the base rules; nulls are values of their own.

    Vectors meet as counts of rounded vectors, by group, by language and over
    all. Each of these takes, over three starts and steps until no determinant
    falls, the inner half (up to the bin of the median distance) of least
    determinant. A group's estimate is pooled with PRIOR vectors of its
    language's, and that with PRIOR vectors of all, so one without many vectors
    of its own is judged as its language is, without a limit in between."""
    ok = vec.where("not base_failed")
    rounded = [F.round(F.col(f) / STEP).cast("long").alias(f"v_{i}") for i, f in enumerate(FEATURES)]
    cells = ok.select(_name(lang).alias("jl"), _name(source).alias("js"), *rounded)
    cells = table(cells.groupBy("jl", "js", *_VECTOR).agg(F.count("*").alias("n")), "cells")
    none = F.lit("")
    at = lambda level, a, b: cells.select(F.lit(level).alias("level"), a.alias("g_lang"), b.alias("g_source"), *_VECTOR, "n")
    wide = at(1, F.col("jl"), none).unionByName(at(0, none, none)).groupBy(*_KEY, *_VECTOR).agg(F.sum("n").alias("n"))
    least = _least(table(at(2, F.col("jl"), F.col("js")).unionByName(wide), "groups"))
    level = lambda k: least.where(F.col("level") == k)
    langs = _leaning(level(1), level(0), [])
    own = _leaning(level(2), langs, ["g_lang"])
    return table(_cholesky(own).select("g_lang", "g_source", *_PLACE, *_FACTOR), "estimates")


def judge(vec: DataFrame, est: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """`vec` with `distance` (squared, from its group; null where no vector of
    the group passed the base rules) and `kept`: false where the base rules
    failed or the distance is over CUTOFF. Rows aren't lost or repeated; columns
    of these two names are replaced."""
    e = est.select(F.col("g_lang").alias("_jl"), F.col("g_source").alias("_js"), *(F.expr(f"{c} AS _e_{c}") for c in (*_PLACE, *_FACTOR)))
    d = vec.withColumns({"_jl": _name(lang), "_js": _name(source)}).join(e, ["_jl", "_js"], "left")
    d = d.withColumn("distance", F.expr(_distance([f"{f} / {UNIT}D" for f in FEATURES], "_e_")))
    d = d.drop("_jl", "_js", *(f"_e_{c}" for c in (*_PLACE, *_FACTOR)))
    return d.withColumn("kept", ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= CUTOFF))
