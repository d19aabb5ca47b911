"""Algebra of half-open integer spans [start, end), per group of keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exact import half_up


def spans(df: DataFrame, start: str, end: str) -> DataFrame:
    """`df` without null, empty and reversed spans."""
    return df.where(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(end) > F.col(start)))


def clipped(df: DataFrame, start: str, end: str, limit: Column) -> DataFrame:
    """Spans cut to [0, limit), without those that this leaves empty."""
    return spans(df.withColumns({start: F.greatest(F.col(start), F.lit(0)), end: F.least(F.col(end), limit)}), start, end)


def midpoint_labels(pieces: DataFrame, labelled: DataFrame, keys: list[str], start: str, end: str, label: str, width: int) -> DataFrame:
    """Pieces with the sorted labels of the spans that hold their midpoint
    (rounded down), start included and end not; an empty array if none does."""
    p = pieces.withColumn("_at", F.floor((F.col(start) + F.col(end)) / 2).cast("long"))
    sp = labelled.select(*keys, F.col(start).alias("_ls"), F.col(end).alias("_le"), F.col(label).alias("_l"))
    hit = points_in_spans(p.select(*keys, start, end, "_at"), sp, keys, "_at", "_ls", "_le", width)
    names = hit.groupBy(*keys, start, end).agg(F.array_sort(F.collect_set("_l")).alias("labels"))
    return p.drop("_at").join(names, [*keys, start, end], "left").withColumn("labels", F.coalesce("labels", F.array().cast("array<string>")))


def _island_id(keys: list[str], start: str, end: str, gap: int | Column = 0, strict: bool = False) -> Column:
    order = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    far = F.col(start) - reach
    new = F.when(reach.isNull() | ((far >= gap) if strict else (far > gap)), 1).otherwise(0)
    return new


def islands(df: DataFrame, keys: list[str], start: str, end: str, gap: int = 0, slot: int | None = None) -> DataFrame:
    """Union of spans per key: `(keys, start, end, n)`. Touching spans join, as
    do spans at most `gap` apart; null, empty and reversed spans are ignored.

    With `slot` the spans that begin in one slot of that length are joined first,
    so a key of very many spans is sorted by many tasks, and only what a slot
    leaves meets in one; the result is the same."""

    def joined(d: DataFrame, by: list[str]) -> DataFrame:
        marked = d.withColumn("_new", _island_id(by, start, end, gap))
        order = Window.partitionBy(*by).orderBy(start, end).rowsBetween(Window.unboundedPreceding, 0)
        marked = marked.withColumn("_island", F.sum("_new").over(order))
        return marked.groupBy(*by, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.sum("n").alias("n")).drop("_island")

    d = spans(df, start, end).select(*keys, start, end, F.lit(1).cast("long").alias("n"))
    if slot:
        d = joined(d.withColumn("_slot", F.floor(F.col(start) / slot)), [*keys, "_slot"]).drop("_slot")
    return joined(d, keys)


def island_stats(df: DataFrame, keys: list[str], start: str, end: str, slot: int | None = None) -> DataFrame:
    """Covered length, number of islands and largest inner gap per key."""
    i = islands(df, keys, start, end, slot=slot)
    gap = F.col(start) - F.lag(end).over(Window.partitionBy(*keys).orderBy(start))
    return (
        i.withColumn("_gap", gap)
        .groupBy(*keys)
        .agg(F.sum(F.col(end) - F.col(start)).alias("covered"), F.count("*").alias("islands"), F.coalesce(F.max("_gap"), F.lit(0)).cast("long").alias("largest_gap"))
    )


def subtract(left: DataFrame, right: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Parts of the union of `left` that the union of `right` doesn't cover."""
    seg = coverage(left, right, keys, start, end)
    return islands(seg.where("in_left and not in_right"), keys, start, end).drop("n")


def intersect(left: DataFrame, right: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Parts that the unions of both cover."""
    seg = coverage(left, right, keys, start, end)
    return islands(seg.where("in_left and in_right"), keys, start, end).drop("n")


def coverage(left: DataFrame, right: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Elementary segments of both sides with `in_left` and `in_right`.

    One sweep over boundary events, sorted once per key: no side is joined with
    the other, so long groups stay linear."""

    def marks(df: DataFrame, a: int, b: int) -> DataFrame:
        df = spans(df, start, end)
        return df.select(*keys, F.explode(F.array(F.struct(F.col(start).alias("t"), F.lit(a).alias("l"), F.lit(b).alias("r")), F.struct(F.col(end).alias("t"), F.lit(-a).alias("l"), F.lit(-b).alias("r")))).alias("m")).select(*keys, "m.*")

    at = marks(left, 1, 0).unionByName(marks(right, 0, 1)).groupBy(*keys, "t").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    w = Window.partitionBy(*keys).orderBy("t")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    seg = at.select(*keys, F.col("t").alias(start), F.lead("t").over(w).alias(end), (F.sum("l").over(run) > 0).alias("in_left"), (F.sum("r").over(run) > 0).alias("in_right"))
    return seg.where(F.col(end).isNotNull() & (F.col("in_left") | F.col("in_right")))


def elementary_segments(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """`(keys, start, end, multiplicity)` between adjacent boundaries, where at
    least one span lies."""
    d = spans(df, start, end)
    ev = d.select(*keys, F.explode(F.array(F.struct(F.col(start).alias("t"), F.lit(1).alias("d")), F.struct(F.col(end).alias("t"), F.lit(-1).alias("d")))).alias("m")).groupBy(*keys, F.col("m.t").alias("t")).agg(F.sum("m.d").alias("d"))
    w = Window.partitionBy(*keys).orderBy("t")
    out = ev.select(*keys, F.col("t").alias(start), F.lead("t").over(w).alias(end), F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("multiplicity"))
    return out.where((F.col("multiplicity") > 0) & F.col(end).isNotNull())


def targets(df: DataFrame, keys: list[str], start: str, end: str, lo: Column, hi: Column, bridge: int, pad: int, least: int) -> DataFrame:
    """What the union leaves open of [lo, hi): covered pieces that are at most
    `bridge` apart join first, open pieces grow by `pad` on both sides (within
    the range), meet, and stay if at least `least` long."""
    i = islands(df, keys, start, end, gap=bridge)
    w = Window.partitionBy(*keys).orderBy(start)
    i = i.withColumns({"_lo": lo, "_hi": hi, "_next": F.lead(start).over(w), "_first": F.lag(end).over(w).isNull()})
    after = i.select(*keys, "_lo", "_hi", F.greatest(end, "_lo").alias("a"), F.least(F.coalesce("_next", "_hi"), F.col("_hi")).alias("b"))
    head = i.where("_first").select(*keys, "_lo", "_hi", F.col("_lo").alias("a"), F.least(start, "_hi").alias("b"))
    open_ = after.unionByName(head).where("b > a")
    grown = open_.select(*keys, F.greatest(F.col("a") - pad, "_lo").alias(start), F.least(F.col("b") + pad, "_hi").alias(end))
    return islands(grown, keys, start, end).drop("n").where(F.col(end) - F.col(start) >= least)


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], ls: str, le: str, rs: str, re: str, width: int) -> DataFrame:
    """Pairs whose spans overlap strictly, as an equi-join on time buckets of
    `width`: each span goes to all buckets that it touches and a pair is made in
    the bucket where its overlap begins, so once. A side is as large as its spans
    are long, which no estimate of its table tells, so none is broadcast."""
    bucket = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor((F.col(b) - 1) / width)))
    a = spans(left, ls, le).withColumn("_b", bucket(ls, le))
    b = spans(right, rs, re).withColumn("_b", bucket(rs, re))
    pairs = a.join(b.hint("merge"), [*keys, "_b"]).where((F.col(ls) < F.col(re)) & (F.col(rs) < F.col(le)))
    return pairs.where(F.col("_b") == F.floor(F.greatest(ls, rs) / width)).drop("_b")


def points_in_spans(points: DataFrame, sp: DataFrame, keys: list[str], at: str, start: str, end: str, width: int) -> DataFrame:
    """Points with the spans [start, end) that hold them."""
    b = spans(sp, start, end).withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))))
    p = points.withColumn("_b", F.floor(F.col(at) / width))
    return p.join(b.hint("merge"), [*keys, "_b"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_b")


def asof(left: DataFrame, right: DataFrame, keys: list[str], lt: str, rt: str, value: str, forward: bool = False, out: str = "asof") -> DataFrame:
    """`left` with the `value` of the last right row at or before its time (or
    the first at or after), least value of equal times; null if there is none.
    One sort of both sides together instead of a join."""
    l_ = left.withColumns({"_t": F.col(lt), "_side": F.lit(1), "_v": F.lit(None).cast(right.schema[value].dataType)})
    r_ = right.groupBy(*keys, F.col(rt).alias("_t")).agg(F.min(value).alias("_v")).withColumn("_side", F.lit(0))
    both = l_.unionByName(r_, allowMissingColumns=True)
    if forward:
        w = Window.partitionBy(*keys).orderBy(F.col("_t").desc(), "_side").rowsBetween(Window.unboundedPreceding, 0)
    else:
        w = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("_side") == 0, F.struct("_t", "_v")), ignorenulls=True).over(w)
    found = both.withColumn("_s", seen).where("_side = 1")
    return found.withColumns({out: F.col("_s._v"), f"{out}_t": F.col("_s._t")}).drop("_t", "_side", "_v", "_s")


def runs_with_core(df: DataFrame, keys: list[str], start: str, end: str, gap: int, core: int) -> DataFrame:
    """Runs of spans less than `gap` apart (strictly) that are `core` long."""
    marked = spans(df, start, end).withColumn("_new", _island_id(keys, start, end, gap, strict=True))
    order = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, 0)
    runs = marked.withColumn("_run", F.sum("_new").over(order)).groupBy(*keys, "_run").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n"))
    return runs.where(F.col(end) - F.col(start) >= core).drop("_run")


def offset_cluster(df: DataFrame, keys: list[str], value: str, width: int, bias: int = 0, least: int = 0) -> DataFrame:
    """`(keys, anchor, uncertainty, support, total)` of the largest group of
    offsets within `width` of its first, of equal ones the lowest; only if it
    holds at least half of all. The anchor is the group's median (half up) less
    the adapter's `bias`, the uncertainty the largest distance from the median,
    `least` at least. Works on counts of distinct values, sorted once."""
    c = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("long").alias("_v")).agg(F.count("*").alias("_n"))
    every = Window.partitionBy(*keys)
    up = every.orderBy("_v")
    c = c.withColumns({"_k": F.sum("_n").over(up.rangeBetween(0, width)), "_to": F.sum("_n").over(up.rowsBetween(Window.unboundedPreceding, 0)), "_all": F.sum("_n").over(every)})
    c = c.withColumn("_best", F.min(F.struct((-F.col("_k")).alias("k"), F.col("_v").alias("lo"), (F.col("_to") - F.col("_n")).alias("before"))).over(every))
    c = c.where((F.col("_v") >= F.col("_best.lo")) & (F.col("_v") <= F.col("_best.lo") + width)).withColumns({"_k": -F.col("_best.k"), "_to": F.col("_to") - F.col("_best.before")})
    at = lambda i: F.min(F.when(F.expr(f"_to > {i}"), F.col("_v")))
    d = c.groupBy(*keys, "_k", "_all").agg(at("(_k - 1) div 2").alias("_low"), at("_k div 2").alias("_high"), F.min("_v").alias("_a"), F.max("_v").alias("_z"))
    d = d.where("2 * _k >= _all").withColumn("_m", half_up(F.col("_low") + F.col("_high"), F.lit(2)))
    off = F.greatest(F.col("_m") - F.col("_a"), F.col("_z") - F.col("_m"))
    return d.select(*keys, (F.col("_m") - bias).alias("anchor"), F.greatest(off, F.lit(least).cast("long")).alias("uncertainty"), F.col("_k").alias("support"), F.col("_all").alias("total"))


def agreements(left: DataFrame, right: DataFrame, keys: list[str], ls: str, le: str, rs: str, re: str, floor: int, apart: int, width: int) -> DataFrame:
    """`(keys, agreements, separated)`: the distinct overlaps of at least `floor`
    between spans of two families, and whether two of them begin `apart`."""
    j = overlap_join(left, right, keys, ls, le, rs, re, width)
    o = j.select(*keys, F.greatest(ls, rs).alias("_s"), F.least(le, re).alias("_e")).where(F.col("_e") - F.col("_s") >= floor).distinct()
    return o.groupBy(*keys).agg(F.count("*").alias("agreements"), ((F.count("*") >= 2) & (F.max("_s") - F.min("_s") >= apart)).alias("separated"))


def competing(i: DataFrame, keys: list[str], candidate: str, start: str, end: str, width: int) -> DataFrame:
    """`(keys, candidate, own, competing)`: the covered time of each candidate,
    and the number of others of the same keys that cover at least half of it.
    `i` are islands; an overlap can't reach half of one that is more than twice
    as long as the other is in all, so such pairs aren't joined."""
    own = i.groupBy(*keys, candidate).agg(F.sum(F.col(end) - F.col(start)).cast("long").alias("own"))
    j = i.join(own, [*keys, candidate])
    a = j.select(*keys, F.col(candidate).alias("_a"), F.col("own").alias("_oa"), F.col(start).alias("_as"), F.col(end).alias("_ae"))
    b = j.select(*keys, F.col(candidate).alias("_b2"), F.col("own").alias("_ob"), F.col(start).alias("_bs"), F.col(end).alias("_be"))
    o = overlap_join(a, b, keys, "_as", "_ae", "_bs", "_be", width).where("_a <> _b2 and 2 * _ob >= _oa")
    o = o.groupBy(*keys, F.col("_a").alias(candidate), "_b2").agg(F.sum(F.least("_ae", "_be") - F.greatest("_as", "_bs")).alias("_n"), F.first("_oa").alias("_oa"))
    n = o.where("2 * _n >= _oa").groupBy(*keys, candidate).agg(F.count("*").alias("competing"))
    return own.join(n, [*keys, candidate], "left").select(*keys, candidate, "own", F.coalesce("competing", F.lit(0)).alias("competing"))
