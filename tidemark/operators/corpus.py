"""Scores of sets of predictions against truth, and of a corpus of sets.

Every prediction, true episode, work and stretch of time becomes a fact with
counts; one aggregation over grouping sets sums them per set, per stratum, per
tier and over all, and ratios are taken of the sums only, so a set of forty
episodes weighs forty times one of a single one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exact import iou_e4, ratio_e4
from tidemark.operators.evidence import segment_confusion

#: Counts of facts: of works and occurrences what is right, predicted and true;
#: time that both, only the prediction, or only the truth has; and so on.
COUNTS = [
    *"work_correct work_predicted work_truth occurrence_correct occurrence_predicted occurrence_truth tp_ms fp_ms fn_ms".split(),
    *"start_violations end_violations iou_e4 repeat_correct repeat_truth overlap_correct overlap_truth".split(),
    *"performed_as_performed performed_as_component component_as_performed component_as_component".split(),
]
ERRORS = ["start_error", "end_error"]


def _facts(df: DataFrame, keys: list[str], tier: Column, **counts: Column) -> DataFrame:
    """Rows with every count and error, zero or null where not given."""
    own = {c: counts.get(c, F.lit(0)).cast("long") for c in COUNTS} | {c: counts.get(c, F.lit(None)).cast("long") for c in ERRORS}
    return df.select(*keys, tier.alias("tier"), *(v.alias(c) for c, v in own.items()))


def outside(at: Column, low: Column, high: Column) -> Column:
    """How far a time lies outside of a range."""
    return F.greatest(low - at, at - high, F.lit(0).cast("long"))


def facts(truth: DataFrame, predictions: DataFrame, pairs: DataFrame) -> DataFrame:
    """Facts of all sets. `truth` has `(set, stratum, id, work, s_lo, s_hi, e_lo,
    e_hi, repeat, overlapped, component)`, `predictions` `(set, stratum, id, work,
    tier, s, e, start_bound, end_bound, component)`, `pairs` `(set, pred, truth)`,
    one to one. A work counts once a set; a true episode that nothing matched has
    an overlap of zero."""
    keys = ["set", "stratum"]
    none = F.lit(None).cast("string")
    p = predictions.select(*keys, *(F.col(c).alias(f"p_{c}") for c in ("id", "work", "tier", "s", "e", "start_bound", "end_bound", "component")))
    t = truth.select("set", *(F.col(c).alias(f"t_{c}") for c in ("id", "s_lo", "s_hi", "e_lo", "e_hi", "repeat", "overlapped", "component")))
    j = p.join(pairs.select("set", F.col("pred").alias("p_id"), F.col("truth").alias("t_id")), ["set", "p_id"], "left").join(t, ["set", "t_id"], "left")
    hit = F.col("t_id").isNotNull()
    if_hit = lambda c: F.when(hit, c)
    kind = lambda a, b: (hit & (F.col("t_component") == F.lit(a)) & (F.col("p_component") == F.lit(b))).cast("long")
    each = _facts(
        j,
        keys,
        F.col("p_tier"),
        occurrence_predicted=F.lit(1),
        occurrence_correct=hit.cast("long"),
        start_violations=F.coalesce((hit & (F.col("p_start_bound") < F.col("t_s_lo"))).cast("long"), F.lit(0)),
        end_violations=F.coalesce((hit & (F.col("p_end_bound") > F.col("t_e_hi"))).cast("long"), F.lit(0)),
        iou_e4=F.coalesce(if_hit(iou_e4(F.col("p_s"), F.col("p_e"), F.col("t_s_lo"), F.col("t_e_hi"))), F.lit(0)),
        repeat_correct=F.coalesce((hit & F.col("t_repeat")).cast("long"), F.lit(0)),
        overlap_correct=F.coalesce((hit & F.col("t_overlapped")).cast("long"), F.lit(0)),
        start_error=if_hit(outside(F.col("p_s"), F.col("t_s_lo"), F.col("t_s_hi"))),
        end_error=if_hit(outside(F.col("p_e"), F.col("t_e_lo"), F.col("t_e_hi"))),
        **{f"{'component' if a else 'performed'}_as_{'component' if b else 'performed'}": F.coalesce(kind(a, b), F.lit(0)) for a in (False, True) for b in (False, True)},
    )
    true = _facts(truth, keys, none, occurrence_truth=F.lit(1), repeat_truth=F.col("repeat").cast("long"), overlap_truth=F.col("overlapped").cast("long"))
    works = j.groupBy(*keys, "p_work").agg(F.max(hit.cast("long")).alias("right"))
    said = _facts(works, keys, none, work_predicted=F.lit(1), work_correct=F.col("right"))
    named = _facts(truth.select(*keys, "work").distinct(), keys, none, work_truth=F.lit(1))
    span = lambda d, s, e: d.select(*keys, "work", F.col(s).alias("s"), F.col(e).alias("e"))
    time = segment_confusion(span(predictions, "s", "e"), span(truth, "s_lo", "e_hi"), keys, "work", "s", "e")
    time = _facts(time, keys, none, tp_ms=F.col("tp"), fp_ms=F.col("fp"), fn_ms=F.col("fn"))
    return reduce(DataFrame.unionByName, [each, true, said, named, time])


def scored(fact: DataFrame) -> DataFrame:
    """`(level, set, stratum, tier, counts, ratios, percentiles)`: a row a set,
    a stratum, a tier, and one over all (`overall`), by one aggregation.

    Ratios are in ten-thousandths, of nothing 0; a tier's rows have what belongs to
    predictions of the tier. Errors' percentiles are by nearest rank. Macro values
    are the mean over sets of their own ratio, down to the whole, and only overall
    and of strata. Without facts there is no row."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS]
    places = [F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {c})").alias(f"{c}_p{int(100 * p)}") for c in ERRORS for p in (0.5, 0.9)]
    cube = fact.groupingSets([["set", "stratum"], ["stratum"], ["tier"], []], "set", "stratum", "tier")
    d = cube.agg(F.grouping_id("set", "stratum", "tier").alias("_g"), *sums, *places)
    level = F.when(F.col("_g") == 1, "set").when(F.col("_g") == 5, "stratum").when(F.col("_g") == 6, "tier").otherwise("overall")
    d = d.withColumn("level", level).where("level <> 'tier' or tier is not null").drop("_g")

    def prf(name: str, right: Column, predicted: Column, true: Column) -> dict[str, Column]:
        p, r = ratio_e4(right, predicted), ratio_e4(right, true)
        return {f"{name}_precision_e4": p, f"{name}_recall_e4": r, f"{name}_f1_e4": ratio_e4(2 * right, predicted + true)}

    c = F.col
    d = d.withColumns(
        prf("work", c("work_correct"), c("work_predicted"), c("work_truth"))
        | prf("occurrence", c("occurrence_correct"), c("occurrence_predicted"), c("occurrence_truth"))
        | prf("segment", c("tp_ms"), c("tp_ms") + c("fp_ms"), c("tp_ms") + c("fn_ms"))
        | {"repeat_recall_e4": ratio_e4(c("repeat_correct"), c("repeat_truth")), "overlap_recall_e4": ratio_e4(c("overlap_correct"), c("overlap_truth"))}
        | {"mean_iou_e4": F.when(c("occurrence_truth") > 0, F.call_function("div", c("iou_e4"), c("occurrence_truth"))).otherwise(F.lit(0).cast("long"))}
    )
    own = d.where("level = 'set'").groupingSets([["stratum"], []], "stratum")
    mean = lambda m: F.call_function("div", F.sum(m), F.count("*"))
    macro = own.agg(F.grouping("stratum").alias("_all"), *(mean(f"segment_{m}_e4").alias(f"macro_segment_{m}_e4") for m in ("precision", "recall")))
    macro = macro.withColumn("level", F.when(c("_all") == 1, "overall").otherwise("stratum")).withColumnRenamed("stratum", "_s").drop("_all")
    met = (d["level"] == macro["level"]) & d["stratum"].eqNullSafe(macro["_s"])
    return d.join(macro, met, "left").drop(macro["level"]).drop("_s")
