"""Scores: matching predictions to truth, agreement, features and indices,
intervals."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.exact import ratio_e4, whole
from tidemark.operators.admission import in_groups

#: What a tier must reach, in ten-thousandths (fixed values).
TARGETS = {"possible": 7000, "likely": 9000, "verified": 9900}


def associate(pred: DataFrame, truth: DataFrame, keys: list[str], slack: int) -> DataFrame:
    """`(keys, pred, truth)`: truths in the order of start and id each take the
    first unused prediction of the same keys (a set and a work) whose hull comes
    within `slack` of theirs. Rows are `(keys, id, s, e)`; the order makes a
    group one task, and a group is one work's occurrences in one recording."""
    both = pred.select(*keys, "id", "s", "e", F.lit(0).alias("side")).unionByName(truth.select(*keys, "id", "s", "e", F.lit(1).alias("side"))).where("s is not null and e is not null")
    n = len(keys)

    def run(g: Iterator[tuple]) -> Iterator[tuple]:
        free, truths = deque(), []
        for r in g:
            (truths if r[-1] else free).append(r)
        for t in truths:
            # starts rise: what ended too early for one truth did for all later ones
            while free and free[0][n + 2] < t[n + 1] - slack:
                free.popleft()
            if free and free[0][n + 1] <= t[n + 2] + slack:
                yield *t[:n], free.popleft()[n], t[n]

    out = T.StructType([*(T.StructField(k, pred.schema[k].dataType) for k in keys), T.StructField("pred", T.LongType()), T.StructField("truth", T.LongType())])
    return in_groups(both, keys, ["s", "id"], run, out)


def closest_label(left: DataFrame, right: DataFrame) -> DataFrame:
    """`(left, right, apart)`: for every left label the right one of the same key
    that differs in fewest words, ties by id. Rows are `(id, key, words)`.

    Labels of the same words are one before they are compared, so what meets are
    a key's distinct sets of words."""
    bag = F.array_sort(F.array_distinct("words"))
    l_ = left.select(F.col("id").alias("left"), "key", bag.alias("_l"))
    r_ = right.select(F.col("id").alias("right"), "key", bag.alias("_r")).groupBy("key", "_r").agg(F.min("right").alias("right"))
    j = l_.select("key", "_l").distinct().join(r_, "key")
    apart = F.size(F.array_except("_l", "_r")) + F.size(F.array_except("_r", "_l"))
    near = j.groupBy("key", "_l").agg(F.min(F.struct(apart.alias("apart"), "right")).alias("b"))
    near = near.withColumnsRenamed({"key": "_k", "_l": "_m"})
    best = l_.join(near, (F.col("key") == F.col("_k")) & F.col("_l").eqNullSafe(F.col("_m"))).groupBy("left").agg(F.min("b").alias("b"))
    return best.select("left", "b.right", "b.apart")


def pairwise_agreement(found: DataFrame, universe: DataFrame) -> DataFrame:
    """`(a, b, agreement_e4)` of every two engines: works both found over works
    either found, summed over sets, rounded down; 10000 if neither found any.
    `found` is `(engine, set, work)`, `universe` `(engine)`, which are few."""
    f = found.select("engine", "set", "work").distinct()
    n = universe.join(f.groupBy("engine").agg(F.count("*").alias("n")), "engine", "left").select("engine", F.coalesce("n", F.lit(0)).alias("n"))
    both = f.withColumnRenamed("engine", "a").join(f.withColumnRenamed("engine", "b"), ["set", "work"]).where("a < b").groupBy("a", "b").agg(F.count("*").alias("k"))
    pairs = n.select(F.col("engine").alias("a"), F.col("n").alias("na")).join(n.select(F.col("engine").alias("b"), F.col("n").alias("nb")), F.col("a") < F.col("b"))
    d = pairs.join(both, ["a", "b"], "left").withColumn("k", F.coalesce("k", F.lit(0)))
    any_ = F.col("na") + F.col("nb") - F.col("k")
    return d.select("a", "b", F.when(any_ == 0, F.lit(10_000).cast("long")).otherwise(whole(F.col("k") * 10_000, any_)).alias("agreement_e4"))


def vote_features(votes: DataFrame, keys: list[str], provider: str, transform: str, score: str, commercial: list[str]) -> DataFrame:
    """Per group: providers, engine agreement (10000 if a second engine voted,
    half of it if all others are discounted), the modal share of transforms (half
    up), and the number and median of raw scores (rounded down)."""
    n = votes.groupBy(*keys, provider).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys)
    rank = F.row_number().over(w.orderBy(F.col("n").desc(), provider))
    sold = F.col(provider).isin(commercial)
    lead = F.row_number().over(Window.partitionBy(*keys, sold).orderBy(F.col("n").desc(), provider))
    n = n.withColumns({"_r": rank, "_cheap": sold & (lead > 1)})
    e = n.groupBy(*keys).agg(F.count("*").alias("providers"), F.coalesce(F.min(F.when(F.col("_r") > 1, F.col("_cheap"))), F.lit(False)).alias("_all"))
    agree = F.when(F.col("providers") <= 1, 0).when(F.col("_all"), 5000).otherwise(10_000)
    modal = votes.groupBy(*keys, transform).agg(F.count("*").alias("n")).groupBy(*keys).agg(F.max("n").alias("_m"), F.sum("n").alias("_n"))
    raw = votes.groupBy(*keys).agg(F.count(score).alias("n_scores"), F.floor(F.percentile(score, 0.5)).cast("long").alias("median_score"))
    d = e.join(modal, keys).join(raw, keys)
    return d.select(*keys, "providers", agree.cast("long").alias("engine_agreement_e4"), ratio_e4(F.col("_m"), F.col("_n")).alias("transform_consistency_e4"), "n_scores", "median_score")


def work_index(trials: Column, span: Column, hint: Column, agreement: Column, aligned: Column, competing: Column) -> Column:
    flag = lambda c, n: F.when(c, n).otherwise(0)
    part = whole(F.least(span, F.lit(120_000)) * 10_000, F.lit(120_000))
    return trials + part + whole(hint, F.lit(4)) + whole(agreement, F.lit(4)) + flag(aligned, 10_000) - flag(competing, 20_000)


def version_index(work: Column, supported: Column, contested: Column) -> Column:
    return work + F.when(supported & ~contested, 30_000).otherwise(0) - F.when(contested, 40_000).otherwise(0)


def boundary_index(aligned: Column, residual: Column, segments: Column) -> Column:
    return F.when(aligned, 20_000).otherwise(0) + (10_000 - F.least(residual, F.lit(10_000))) + F.least(segments, F.lit(4)) * 1000


def tier_thresholds(fit: DataFrame, x: str, score: str) -> DataFrame:
    """`(tier, target_e4, min_index, achieved_e4)`: the least index whose fitted
    share reaches each tier's target; nulls where none does."""
    spark = fit.sparkSession
    t = spark.createDataFrame(list(TARGETS.items()), "tier string, target_e4 long")
    hit = fit.join(F.broadcast(t), F.col(score) >= F.col("target_e4")).groupBy("tier").agg(F.min(F.struct(F.col(x).alias("x"), F.col(score).alias("y"))).alias("b"))
    return t.join(hit, "tier", "left").select("tier", "target_e4", F.col("b.x").alias("min_index"), F.col("b.y").alias("achieved_e4"))


def interval_scores(lo: Column, hi: Column, truth_lo: Column, truth_hi: Column, coverage_e4: int) -> Column:
    """(covered, width, winkler) of a predicted interval against a range of
    truth; a miss costs twice its distance over what coverage leaves, half up."""
    alpha, width = max(1, 10_000 - coverage_e4), hi - lo
    away = F.greatest(truth_lo - hi, lo - truth_hi, F.lit(0))
    cost = whole(20_000 * away + (10_000 - coverage_e4) // 2, F.lit(alpha)) if coverage_e4 < 10_000 else away * 20_000
    return F.struct(((lo <= truth_hi) & (hi >= truth_lo)).alias("covered"), width.alias("width"), (width + cost).alias("winkler"))


def residual_interval(df: DataFrame, keys: list[str], proved: str, truth_lo: str, truth_hi: str) -> DataFrame:
    """Per group the 5 and 95 per cent truncating quantiles of truth less proved
    and the share of ranges that the interval around proved meets."""
    from tidemark.operators.evidence import quantiles

    d = df.withColumn("_r", F.col(truth_lo) - F.col(proved))
    q = quantiles(d, keys, "_r", [(5, 100), (95, 100)]).select(*keys, F.col("tr_5").alias("q_lo"), F.col("tr_95").alias("q_hi"))
    # a row a group, of which a calibration has few
    j = d.join(F.broadcast(q), keys)
    lo = F.greatest(F.lit(0), F.col(proved) + F.col("q_lo"))
    hi = F.greatest(lo, F.col(proved) + F.col("q_hi"))
    ok = (lo <= F.col(truth_hi)) & (hi >= F.col(truth_lo))
    n = j.groupBy(*keys, "q_lo", "q_hi").agg(F.count("*").alias("n"), F.count_if(ok).alias("_k"))
    return n.select(*keys, "q_lo", "q_hi", "n", ratio_e4(F.col("_k"), F.col("n")).alias("coverage_e4"))


def latency_curve(cases: DataFrame) -> DataFrame:
    """`(duration, positions, censored, recognised_e4)`: of all insertion
    positions, the share recognised within each tested duration; a position is
    recognised at its shortest success, and censored until then.
    `cases` are `(position, duration, success)`."""
    first = cases.groupBy("position").agg(F.min(F.when(F.col("success"), F.col("duration"))).alias("t"))
    total = first.agg(F.count("*").alias("positions"))
    at = first.where("t is not null").groupBy(F.col("t").alias("duration")).agg(F.count("*").alias("k"))
    # a row a tested duration, of which a grid has few
    w = Window.orderBy("duration").rowsBetween(Window.unboundedPreceding, 0)
    d = cases.select("duration").distinct().join(at, "duration", "left").withColumn("k", F.coalesce(F.sum("k").over(w), F.lit(0)))
    d = d.crossJoin(F.broadcast(total))
    return d.select("duration", "positions", (F.col("positions") - F.col("k")).alias("censored"), ratio_e4(F.col("k"), F.col("positions")).alias("recognised_e4"))
