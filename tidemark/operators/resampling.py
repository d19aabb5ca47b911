"""Bootstrap bounds of pooled measures, clusters (recordings) being resampled.

A replicate gives each cluster a weight that a hash of (seed, replicate, cluster)
draws from the Poisson distribution of mean one, the limit of drawing as many
clusters as there are with replacement. No task needs to know how many clusters
there are or in which order they come, so all replicates are one aggregation, and
the arms of a paired comparison share their draws. Weights depend on nothing but
the three values, so results don't depend on partitions.
"""

from __future__ import annotations

from itertools import count
from math import exp, factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exact import whole

REPLICATES, SEED = 2000, 7
#: The bound is the value at this place of all replicates, in per cent.
LOWER = 5


def thresholds() -> list[int]:
    """Where the weight rises by one, of 2^32 hash values: the Poisson
    distribution of mean one, up to what 32 bits can tell apart."""
    out, total = [], 0.0
    for k in count():
        total += exp(-1) / factorial(k)
        at = int(total * (1 << 32))
        if at >= (1 << 32) - 1:
            return out
        out.append(at)


def weight(replicate: Column, cluster: Column, seed: int = SEED) -> Column:
    """How often a replicate takes a cluster."""
    text = F.concat_ws("|", F.lit(str(seed)), replicate.cast("string"), F.coalesce(cluster.cast("string"), F.lit("\0")))
    h = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
    out = F.lit(0).cast("long")
    for at in thresholds():
        out = out + (h >= at).cast("long")
    return out


def _share_e4(num: Column, den: Column) -> Column:
    """num of den in ten-thousandths, down to the whole; 0 of nothing."""
    return F.when(den > 0, whole(num * 10_000, den)).otherwise(F.lit(0).cast("long"))


def _place(percent: int, n: int) -> int:
    """Place (from 0) of a percentile among n sorted values, by nearest rank."""
    return max(0, -(-n * percent // 100) - 1)


def _low(value: Column, replicates: int) -> Column:
    """The value at the place of LOWER among a group's replicates, of which it
    has no more than were drawn."""
    return F.get(F.array_sort(F.collect_list(value)), F.lit(_place(LOWER, replicates)))


def replicated(df: DataFrame, cluster: str, sums: list[str], keys: list[str] = [], replicates: int = REPLICATES, seed: int = SEED) -> DataFrame:  # noqa: B006
    """`(keys, replicate, sums)`: weighted sums over clusters. Clusters are summed
    first; every replicate has a row, also where it takes no cluster."""
    own = df.groupBy(*keys, F.col(cluster).alias("_c")).agg(*(F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0)).alias(c) for c in sums))
    each = own.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("_w", weight(F.col("replicate"), F.col("_c"), seed))
    return each.groupBy(*keys, "replicate").agg(*(F.sum(F.col("_w") * F.col(c)).alias(c) for c in sums))


def share_bounds(df: DataFrame, cluster: str, shares: dict[str, tuple[str, str]], keys: list[str] = [], replicates: int = REPLICATES, seed: int = SEED) -> DataFrame:  # noqa: B006
    """For each group of `keys` and each named share (good, all): its pooled value
    `{name}_e4` and lower bound `{name}_lower_e4`, and `clusters`.

    Counts are summed before any ratio is taken. An empty table without keys, and
    a share of nothing, give 0."""
    sums = sorted({c for pair in shares.values() for c in pair})
    r = replicated(df, cluster, sums, keys, replicates, seed)
    lows = r.groupBy(*keys).agg(*(_low(_share_e4(F.col(a), F.col(b)), replicates).alias(f"{n}_lower_e4") for n, (a, b) in shares.items()))
    total = df.groupBy(*keys).agg(F.countDistinct(F.coalesce(F.col(cluster).cast("string"), F.lit("\0"))).alias("clusters"), *(F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0)).alias(f"_{c}") for c in sums))
    pooled = total.select(*keys, "clusters", *(_share_e4(F.col(f"_{a}"), F.col(f"_{b}")).alias(f"{n}_e4") for n, (a, b) in shares.items()))
    keyed = keys or ["_one"]
    one = (lambda d: d) if keys else (lambda d: d.withColumn("_one", F.lit(1)))
    out = one(pooled).join(one(lows), keyed, "left").drop("_one")
    return out.withColumns({f"{n}_lower_e4": F.coalesce(f"{n}_lower_e4", F.lit(0)) for n in shares})


def paired_difference(df: DataFrame, cluster: str, base: tuple[str, str], other: tuple[str, str], margin_e4: int = 100, keys: list[str] = [], replicates: int = REPLICATES, seed: int = SEED) -> DataFrame:  # noqa: B006
    """`(keys, clusters, delta_e4, lower_bound_e4, no_worse)`: what the other share
    has over the base, its lower bound with the same draws for both, and whether
    that is no more than `margin_e4` below zero. Only clusters that have both."""
    sums = sorted({*base, *other})
    both = df.groupBy(*keys, F.col(cluster).alias("_c")).agg(*(F.sum(F.col(c).cast("long")).alias(c) for c in sums))
    both = both.where(f"`{base[1]}` is not null and `{other[1]}` is not null")
    gain = lambda c: _share_e4(c(other[0]), c(other[1])) - _share_e4(c(base[0]), c(base[1]))
    r = replicated(both, "_c", sums, keys, replicates, seed).groupBy(*keys).agg(_low(gain(F.col), replicates).alias("lower_bound_e4"))
    seen = both.groupBy(*keys).agg(F.count("*").alias("clusters"), *(F.sum(c).alias(c) for c in sums)).where("clusters > 0")
    keyed = keys or ["_one"]
    one = (lambda d: d) if keys else (lambda d: d.withColumn("_one", F.lit(1)))
    out = one(seen).join(one(r), keyed)
    return out.select(*keys, "clusters", gain(F.col).alias("delta_e4"), "lower_bound_e4", (F.col("lower_bound_e4") >= -margin_e4).alias("no_worse"))


def _pooled_percentile(values: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """`(keys, value)`: the percentile by nearest rank of values counted `n` times."""
    w = Window.partitionBy(*keys).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    all_of = Window.partitionBy(*keys)
    ranked = values.withColumn("_upto", F.sum("n").over(w)).withColumn("_total", F.sum("n").over(all_of))
    return ranked.where(100 * F.col("_upto") >= percent * F.col("_total")).where("_total > 0").groupBy(*keys).agg(F.min("value").alias("value"))


def paired_p90(base: DataFrame, other: DataFrame, cluster: str, error: str, replicates: int = REPLICATES, seed: int = SEED) -> DataFrame:
    """`(clusters, before, after, improvement_e4, lower_bound_e4)`: the 90th
    percentile of all errors under either arm, how much smaller it is under the
    other (in ten-thousandths of the base's, down to the whole; 0 if that is not
    positive), and the lower bound. Only clusters that have errors under both;
    without any there is no row. Errors count by value, so equal ones are one row."""
    counted = lambda d, arm: d.where(F.col(error).isNotNull()).groupBy(F.coalesce(F.col(cluster).cast("string"), F.lit("\0")).alias("_c"), F.col(error).cast("long").alias("value")).agg(F.count("*").alias("n")).withColumn("arm", F.lit(arm))
    a, b = counted(base, 0), counted(other, 1)
    shared = a.select("_c").distinct().join(b.select("_c").distinct(), "_c")
    both = a.unionByName(b).join(shared, "_c")
    draws = shared.withColumn("replicate", F.explode(F.sequence(F.lit(-1), F.lit(replicates - 1))))
    draws = draws.withColumn("w", F.when(F.col("replicate") < 0, 1).otherwise(weight(F.col("replicate"), F.col("_c"), seed))).where("w > 0")
    pooled = both.join(draws, "_c").groupBy("replicate", "arm", "value").agg(F.sum(F.col("n") * F.col("w")).alias("n"))
    p = _pooled_percentile(pooled, ["replicate", "arm"], 90).groupBy("replicate").agg(F.max(F.when(F.col("arm") == 0, F.col("value"))).alias("before"), F.max(F.when(F.col("arm") == 1, F.col("value"))).alias("after"))
    gain = (F.col("before") - F.col("after")) * 10_000
    floored = whole(gain - F.pmod(gain, F.col("before")), F.col("before"))
    p = p.withColumn("gain", F.when(F.col("before") > 0, floored).otherwise(F.lit(0).cast("long")))
    n = shared.agg(F.count("*").alias("clusters"))
    missing = F.lit(replicates) - F.count_if(F.col("replicate") >= 0)
    lows = p.agg(
        *(F.max(F.when(F.col("replicate") < 0, F.col(c))).alias(o) for c, o in (("before", "before"), ("after", "after"), ("gain", "improvement_e4"))),
        # a replicate that took no cluster improves nothing
        F.get(F.array_sort(F.concat(F.collect_list(F.when(F.col("replicate") >= 0, F.col("gain"))), F.array_repeat(F.lit(0).cast("long"), missing.cast("int")))), F.lit(_place(LOWER, replicates))).alias("lower_bound_e4"),
    )
    return n.withColumn("_one", F.lit(1)).join(lows.withColumn("_one", F.lit(1)), "_one").drop("_one").where("clusters > 0")


def event_bounds(events: DataFrame, cluster: str, kind: str, matched: str, predicted: str, truth: str, replicates: int = REPLICATES, seed: int = SEED) -> DataFrame:
    """Per kind of event: counts, precision and recall with their lower bounds;
    bounds of a kind without true events are 0."""
    shares = {"precision": (matched, predicted), "recall": (matched, truth)}
    b = share_bounds(events, cluster, shares, [kind], replicates, seed)
    n = events.groupBy(kind).agg(*(F.sum(F.col(c).cast("long")).alias(o) for c, o in ((truth, "n_truth"), (predicted, "n_predicted"), (matched, "n_matched"))))
    some = lambda c: F.when(F.col("n_truth") > 0, F.col(c)).otherwise(F.lit(0).cast("long")).alias(c)
    return n.join(b, kind).select(kind, "n_truth", "n_predicted", "n_matched", "precision_e4", "recall_e4", some("precision_lower_e4"), some("recall_lower_e4"))
