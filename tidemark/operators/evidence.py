"""Votes, corroboration, scores, ledgers."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exact import ratio_e4, whole


def majority(df: DataFrame, keys: list[str], candidate: str) -> DataFrame:
    """The most frequent candidate of each group, ties to the smallest, with
    its votes and all votes."""
    n = df.where(F.col(candidate).isNotNull()).groupBy(*keys, candidate).agg(F.count("*").alias("votes"))
    best = n.groupBy(*keys).agg(F.min(F.struct((-F.col("votes")).alias("v"), F.col(candidate).alias("c"))).alias("b"), F.sum("votes").alias("total"))
    return best.select(*keys, F.col("b.c").alias(candidate), (-F.col("b.v")).alias("votes"), "total")


def trial_hulls(df: DataFrame, keys: list[str], trial: str, provider: str, start: str, end: str) -> DataFrame:
    """One row a trial: its hull and its sorted providers."""
    return df.groupBy(*keys, trial).agg(F.min(start).alias(start), F.max(end).alias(end), F.sort_array(F.collect_set(provider)).alias("providers"))


def discounted(df: DataFrame, keys: list[str], name: str, votes: str, commercial: list[str]) -> DataFrame:
    """Of the commercial engines of each group, all but the one of most votes
    (ties by name)."""
    w = Window.partitionBy(*keys).orderBy(F.col(votes).desc(), name)
    return df.where(F.col(name).isin(commercial)).withColumn("_r", F.row_number().over(w)).where("_r > 1").drop("_r")


def prf(df: DataFrame, keys: list[str], predicted: Column, truth: Column) -> DataFrame:
    """Precision, recall and F1 in ten-thousandths from pooled counts."""
    d = df.select(*keys, predicted.cast("long").alias("p"), truth.cast("long").alias("t"))
    c = d.groupBy(*keys) if keys else d
    n = c.agg(F.sum(F.col("p") * F.col("t")).alias("tp"), F.sum("p").alias("predicted"), F.sum("t").alias("actual"))
    return n.withColumns({"precision_e4": ratio_e4(F.col("tp"), F.col("predicted")), "recall_e4": ratio_e4(F.col("tp"), F.col("actual")), "f1_e4": ratio_e4(2 * F.col("tp"), F.col("predicted") + F.col("actual"))})


#: Ranges of a key's values that are counted before any is sorted.
_BINS = 4096


def quantiles(df: DataFrame, keys: list[str], value: str, points: Sequence[tuple[int, int]]) -> DataFrame:
    """Exact order statistics of whole values per key: for p/q the nearest rank
    (index ceil(n p / q) - 1) as nr_p and the truncating one (index
    min(n - 1, p n div q)) as tr_p, the lower median and twice the median.

    Works on counts of distinct values. Equal ranges of a key's values, `_BINS` at
    most, are counted first; only those that hold a wanted index are sorted, each
    by itself, so no task sorts a key."""
    c = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    own = [f"_k{i}" for i in range(len(keys))]
    c = c.withColumnsRenamed(dict(zip(keys, own, strict=True)))
    again = lambda d: d.withColumnsRenamed({k: f"_r{k}" for k in own})
    same = lambda: [F.col(k).eqNullSafe(F.col(f"_r{k}")) for k in own]
    wide = c.groupBy(*own).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_n").alias("_all"))
    c = c.join(again(wide), same()).withColumn("_bin", F.expr(f"(_v - _lo) div ((_hi - _lo) div {_BINS} + 1)"))
    up = Window.partitionBy(*own).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = c.groupBy(*own, "_bin", "_all").agg(F.sum("_n").alias("_m")).withColumn("_upto", F.sum("_m").over(up)).withColumn("_before", F.col("_upto") - F.col("_m"))
    index = {f"nr_{p}": f"greatest((_all * {p} + {q} - 1) div {q} - 1, 0)" for p, q in points} | {f"tr_{p}": f"least(_all - 1, _all * {p} div {q})" for p, q in points}
    wanted = [*index.values(), "(_all - 1) div 2", "_all div 2"]
    held = bins.where(" or ".join(f"_before <= ({i}) and _upto > ({i})" for i in wanted)).select(*own, F.col("_bin").alias("_held"), "_before")
    c = c.drop(*(f"_r{k}" for k in own)).join(again(held), [*same(), F.col("_bin") == F.col("_held")])
    inner = Window.partitionBy(*own, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    c = c.withColumn("_to", F.col("_before") + F.sum("_n").over(inner))

    def at(index: str) -> Column:
        return F.min(F.when(F.expr(f"_to > ({index})"), F.col("_v")))

    picks = {n: at(index[n]) for p, _ in points for n in (f"nr_{p}", f"tr_{p}")}
    picks["median_low"] = at("(_all - 1) div 2")
    picks["median_x2"] = at("(_all - 1) div 2") + at("_all div 2")
    out = c.groupBy(*own).agg(F.max("_all").alias("n"), *(x.alias(k) for k, x in picks.items()))
    return out.withColumnsRenamed(dict(zip(own, keys, strict=True)))


def tier_ladder(df: DataFrame, keys: list[str], tier: str, correct: Column, tiers: Sequence[str]) -> DataFrame:
    """For each tier, rows of that tier or a better one, and how many are correct."""
    level = F.array_position(F.array(*map(F.lit, tiers)), F.col(tier))
    d = df.withColumn("_l", F.explode(F.sequence(level, F.lit(len(tiers)).cast("long"))))
    names = F.element_at(F.array(*map(F.lit, tiers)), F.col("_l").cast("int"))
    out = d.groupBy(*keys, "_l").agg(F.sum(correct.cast("long")).alias("correct"), F.count("*").alias("total"))
    return out.select(*keys, names.alias(tier), "correct", "total", ratio_e4(F.col("correct"), F.col("total")).alias("precision_e4"))


def isotonic(bins: DataFrame, keys: list[str], x: str, good: str, total: str) -> DataFrame:
    """`(keys, x, fit_e4)`: the non-decreasing fit of good / total over bins in
    the order of `x`, in ten-thousandths, rounded down. Adjacent bins that fall
    are pooled in one pass over a stack of (good, total, bins), compared by cross
    multiplication, in the engine; a group is a table of bins."""
    block = lambda g, t, n: F.struct(g.alias("g"), t.alias("t"), n.alias("n"))
    rows = F.array_sort(F.collect_list(F.struct(F.col(x).alias("x"), F.col(good).cast("long").alias("g"), F.col(total).cast("long").alias("t"))))
    one = F.lit(1).cast("long")
    empty = F.array().cast("array<struct<g:bigint,t:bigint,n:bigint>>")

    def add(stack: Column, r: Column) -> Column:
        # how many blocks from the top have a mean above what is pooled above them
        pooled = F.aggregate(
            F.reverse(stack),
            F.struct(r["g"].alias("g"), r["t"].alias("t"), one.alias("n"), F.lit(0).alias("k"), F.lit(False).alias("done")),
            lambda s, b: F.when(s["done"] | (b["g"] * s["t"] <= s["g"] * b["t"]), F.struct(s["g"].alias("g"), s["t"].alias("t"), s["n"].alias("n"), s["k"].alias("k"), F.lit(True).alias("done"))).otherwise(
                F.struct((s["g"] + b["g"]).alias("g"), (s["t"] + b["t"]).alias("t"), (s["n"] + b["n"]).alias("n"), (s["k"] + 1).alias("k"), F.lit(False).alias("done"))
            ),
        )
        return F.transform(F.array(pooled), lambda q: F.concat(F.slice(stack, F.lit(1), F.size(stack) - q["k"]), F.array(block(q["g"], q["t"], q["n"]))))[0]

    d = bins.groupBy(*keys).agg(rows.alias("_r")).withColumn("_b", F.aggregate("_r", empty, add))
    fits = F.flatten(F.transform("_b", lambda b: F.array_repeat(F.when(b["t"] > 0, whole(b["g"] * 10_000, b["t"])).otherwise(F.lit(0).cast("long")), b["n"].cast("int"))))
    z = F.explode(F.arrays_zip(F.transform("_r", lambda r: r["x"]).alias("x"), fits.alias("fit_e4")))
    return d.select(*keys, z.alias("_z")).select(*keys, F.col("_z.x").alias(x), F.col("_z.fit_e4").alias("fit_e4"))


def ledger_fold(df: DataFrame, attempt: str, event: str, outcome: str, unit: str, at: str) -> DataFrame:
    """One row an attempt from its events: `dispatched` (any event but
    prepared), the outcome of the resolved event, and what it spent if billed.
    Equal copies of an event count once; copies of an event that differ are
    marked as a conflict."""
    e = df.select(attempt, event, outcome, unit, at).distinct()
    per = e.groupBy(attempt, event).agg(F.count("*").alias("copies"), F.max(outcome).alias(outcome), F.max(unit).alias(unit))
    done = F.max(F.when(F.col(event) == "resolved", F.col(outcome)))
    return per.groupBy(attempt).agg(
        F.max(F.col(event) != "prepared").alias("dispatched"),
        done.alias(outcome),
        F.max(F.when((F.col(event) == "resolved") & (F.col(outcome) == "billed"), F.col(unit)).otherwise(0)).alias("spent"),
        (F.max("copies") > 1).alias("conflict"),
    )


def resume(df: DataFrame, keys: list[str], ordinal: str, dispatched: str, outcome: str, reusable: str, good: list[str]) -> DataFrame:
    """`(keys, action)` by the attempt of largest ordinal: `reissue` if it was
    never dispatched, `ambiguous` if it was but has no outcome, `retry` after an
    outcome that isn't good, `reuse` of a good one whose answer still counts, else
    `settled`. A query without attempts is `fresh`, which is the caller's join."""
    last = F.max_by(F.struct(F.col(dispatched).alias("d"), F.col(outcome).alias("o"), F.col(reusable).alias("r")), F.struct(F.col(ordinal), ~F.col(dispatched), F.coalesce(F.col(outcome), F.lit("")), ~F.col(reusable)))
    act = F.when(~F.col("l.d"), "reissue").when(F.col("l.o").isNull(), "ambiguous").when(~F.col("l.o").isin(good), "retry").when(F.col("l.r"), "reuse").otherwise("settled")
    return df.groupBy(*keys).agg(last.alias("l")).select(*keys, act.alias("action"))


def settled(df: DataFrame, keys: list[str], seq: str, money: list[str], rest: list[str]) -> DataFrame:
    """One row a key of its updates: money columns never fall (the largest seen,
    at least 0), the others are of the update of largest `seq`, with their number."""
    last = F.max(F.struct(seq, *rest))
    return df.groupBy(*keys).agg(*(F.greatest(F.max(m), F.lit(0).cast("long")).alias(m) for m in money), last.alias("_l"), F.count("*").alias("updates")).select("*", *(F.col(f"_l.{c}") for c in rest)).drop("_l")


def zero_filled(df: DataFrame, keys: Sequence[str], state: str, states: Sequence[str]) -> DataFrame:
    """Counts per state, states without rows included."""
    every = df.sparkSession.createDataFrame([(s,) for s in states], f"{state} string")
    n = df.groupBy(*keys, state).agg(F.count("*").alias("depth"))
    if keys:
        every = n.select(*keys).distinct().crossJoin(F.broadcast(every))
    return every.join(n, [*keys, state], "left").withColumn("depth", F.coalesce("depth", F.lit(0)))


def failure_windows(df: DataFrame, keys: list[str], at: str, failed: Column, width: int, least: int, percent: int) -> DataFrame:
    """Each row with the samples and failures of the trailing window (at - width,
    at], and whether the window trips the breaker."""
    w = Window.partitionBy(*keys).orderBy(at).rangeBetween(-width + 1, 0)
    d = df.withColumns({"samples": F.count("*").over(w), "failures": F.sum(failed.cast("long")).over(w)})
    return d.withColumn("trips", (F.col("samples") >= least) & (F.col("failures") * 100 > F.col("samples") * percent))


def segment_confusion(pred: DataFrame, truth: DataFrame, keys: list[str], label: str, start: str, end: str) -> DataFrame:
    """Time-weighted true and false positives and false negatives: per label,
    the time that both, only the prediction, or only the truth covers."""
    from tidemark.operators.intervals import coverage

    k = [*keys, label]
    seg = coverage(pred.select(*k, start, end), truth.select(*k, start, end), k, start, end).withColumn("_n", F.col(end) - F.col(start))
    pick = lambda c: F.coalesce(F.sum(F.when(c, F.col("_n"))), F.lit(0))
    return seg.groupBy(*keys).agg(pick(F.col("in_left") & F.col("in_right")).alias("tp"), pick(F.col("in_left") & ~F.col("in_right")).alias("fp"), pick(~F.col("in_left") & F.col("in_right")).alias("fn"))


def heard_shares(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """Squared shares p^2 / sum p^2 of each vector clipped to [0, 1]: the largest
    share, its place, and the number of shares of at least a tenth."""
    p = F.transform(vector, lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x.cast("double"))))
    d = df.select(id_col, p.alias("_p")).withColumn("_q", F.transform("_p", lambda x: x * x))
    d = d.withColumn("_s", F.aggregate("_q", F.lit(0.0), lambda a, x: a + x)).where("_s > 0")
    share = F.transform("_q", lambda x: F.round(x / F.col("_s"), 9))
    d = d.withColumn("_h", share)
    return d.select(id_col, F.array_max("_h").alias("top"), (F.array_position("_h", F.array_max("_h")) - 1).alias("place"), F.size(F.filter("_h", lambda x: x >= 0.1)).cast("long").alias("heard"))


def fused_shares(df: DataFrame, id_col: str, vector: str, lookup: str, weight: float, least: float) -> DataFrame:
    """`(id, top, share, agreement)`: heard shares (squares of a clipped vector
    over their sum) and the shares of a lookup, a map from places to shares, whose
    entries count only where the vector has `least` or more, weighed together. The
    agreement is `agree` where both name one place, `partial` where the lookup has
    some of the heard one, `disagree`, or `heard-only` without a lookup."""
    p = F.transform(vector, lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x.cast("double"))))
    sum_ = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    d = df.withColumn("_q", F.transform(p, lambda x: x * x))
    total = sum_("_q")
    d = d.withColumn("_h", F.when(total > 0, F.transform("_q", lambda x: x / total)).otherwise(F.col("_q")))
    entries = F.filter(F.map_entries(lookup), lambda e: F.get(vector, e["key"].cast("int")).cast("double") >= least)
    d = d.withColumn("_e", F.coalesce(entries, F.array().cast("array<struct<key:int,value:double>>")))
    sure = sum_(F.transform("_e", lambda e: e["value"]))
    d = d.withColumn("_e", F.when(sure > 0, F.transform("_e", lambda e: F.struct(e["key"].alias("key"), (e["value"] / sure).alias("value")))).otherwise(F.array().cast("array<struct<key:int,value:double>>")))
    w = F.when(F.size("_e") > 0, F.lit(weight)).otherwise(0.0)
    at = lambda i: F.coalesce(F.get(F.filter("_e", lambda e: e["key"] == i), F.lit(0))["value"], F.lit(0.0))
    d = d.withColumn("_f", F.transform("_h", lambda h, i: F.round((h + w * at(i)) / (1 + w), 9)))
    place = lambda a: (F.array_position(a, F.array_max(a)) - 1).cast("int")
    best = F.array_max(F.transform("_e", lambda e: F.struct(F.round(e["value"], 9).alias("v"), (-e["key"]).alias("k"))))
    heard = place(F.transform("_h", lambda h: F.round(h, 9)))
    kind = F.when(F.size("_e") == 0, "heard-only").when(-best["k"] == heard, "agree").when(at(heard) > 0, "partial").otherwise("disagree")
    return d.select(id_col, place(F.col("_f")).alias("top"), F.array_max("_f").alias("share"), kind.alias("agreement"))


def theil_sen(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Median of pairwise slopes, median intercept, largest residual per group
    (of up to a few thousand points: a group is one recording's anchors)."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        a, b = g[x].to_numpy(float), g[y].to_numpy(float)
        i, j = np.triu_indices(len(a), 1)
        ok = a[i] != a[j]
        if not ok.any():
            return pd.DataFrame(columns=[*keys, "slope", "intercept", "residual"])
        slope = float(np.median((b[j] - b[i])[ok] / (a[j] - a[i])[ok]))
        inter = float(np.median(b - slope * a))
        return pd.DataFrame([[*(g[k].iloc[0] for k in keys), slope, inter, float(np.abs(b - slope * a - inter).max())]], columns=[*keys, "slope", "intercept", "residual"])

    types = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(*keys, x, y).groupBy(*keys).applyInPandas(run, f"{types}, slope double, intercept double, residual double")


def clopper_pearson_e4(k: Column, n: Column, alpha: float = 0.05) -> Column:
    """One-sided lower bound of a share, by 80 halvings on the binomial tail,
    floored to ten-thousandths."""
    from math import exp, lgamma, log

    @F.pandas_udf("long")
    def bound(ks: pd.Series, ns: pd.Series) -> pd.Series:
        def one(k: int, n: int) -> int:
            if n <= 0 or k <= 0:
                return 0
            c = [lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) for i in range(k, n + 1)]
            lo, hi = 0.0, 1.0
            for _ in range(80):
                p = (lo + hi) / 2
                tail = sum(exp(c[i - k] + i * log(p) + ((n - i) * log(1 - p) if i < n else 0)) for i in range(k, n + 1)) if 0 < p < 1 else p
                lo, hi = (p, hi) if tail < alpha else (lo, p)
            return int(lo * 10000 + 1e-9)

        return pd.Series([one(int(a), int(b)) for a, b in zip(ks, ns, strict=True)])

    return bound(k, n)
