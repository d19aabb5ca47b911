"""Window schedules, density limits, budgets and exact apportionment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.exact import ceiling, whole
from tidemark.operators.admission import in_order


def sliding_windows(df: DataFrame, duration: str, width: int, hop: int, phase: int = 0) -> DataFrame:
    """`df` with `(start, end, is_tail)` a window: starts phase, phase + hop, ...
    while the window fits, and a tail window that ends with the media unless one
    does already. Media no longer than `width` get one window over all of it."""
    d = F.col(duration)
    last = d - width
    regular = F.when((d > width) & (last >= phase), F.sequence(F.lit(phase).cast("long"), last, F.lit(hop).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    tail = F.when((d > width) & ((F.size(regular) == 0) | (F.element_at(F.concat(F.array(F.lit(-1).cast("long")), regular), -1) != last)), F.array(F.struct(last.alias("start"), d.alias("end"), F.lit(True).alias("is_tail"))))
    short = F.when((d > 0) & (d <= width), F.array(F.struct(F.lit(0).cast("long").alias("start"), d.alias("end"), F.lit(False).alias("is_tail"))))
    none = F.array().cast("array<struct<start:bigint,end:bigint,is_tail:boolean>>")
    body = F.transform(regular, lambda s: F.struct(s.alias("start"), (s + width).alias("end"), F.lit(False).alias("is_tail")))
    return df.withColumn("_w", F.explode(F.concat(F.coalesce(short, none), body, F.coalesce(tail, none)))).select("*", "_w.*").drop("_w")


def region_windows(df: DataFrame, start: str, end: str, width: int, hop: int, phase: int = 0) -> DataFrame:
    """sliding_windows() inside each region, counted from the region's start."""
    d = sliding_windows(df.withColumn("_d", F.col(end) - F.col(start)).withColumnsRenamed({start: "_rs", end: "_re"}), "_d", width, hop, phase)
    return d.withColumns({"w_start": F.col("_rs") + F.col("start"), "w_end": F.col("_rs") + F.col("end")}).drop("start", "end", "_d").withColumnsRenamed({"_rs": start, "_re": end})


#: Window, hop and phase of a rescan by its trigger in milliseconds; triggers
#: that aren't named use the base policy (fixed values).
TRIGGERS = {"gap": (8_000, 4_000, 2_000), "question_cluster": (8_000, 4_000, 2_000), "hint_cluster": (8_000, 4_000, 2_000), "edge": (6_000, 3_000, 0), "novelty": (6_000, 3_000, 0)}
BASE = (12_000, 9_000, 0)


def trigger_windows(requests: DataFrame, base: tuple[int, int, int] = BASE) -> DataFrame:
    """`requests` (trigger, s, e) with `(start, length)` of every window: from the
    region's start and the trigger's phase by its hop, and one that ends with the
    region; a region shorter than a window has one of its own length."""
    of = lambda k: F.coalesce(F.create_map(*(F.lit(x) for t, g in TRIGGERS.items() for x in (t, (min(g[0], base[0]), min(g[1], base[0]), g[2] % min(g[1], base[0]))[k])))[F.col("trigger")], F.lit(base[k])).cast("long")
    d = requests.where("e > s").withColumns({"_w": F.least(of(0), F.col("e") - F.col("s")), "_h": of(1), "_p": of(2)})
    first, last = F.col("s") + F.col("_p"), F.col("e") - F.col("_w")
    grid = F.when(first <= last, F.sequence(first, last, F.col("_h"))).otherwise(F.array().cast("array<bigint>"))
    starts = F.array_sort(F.array_distinct(F.concat(grid, F.array(last))))
    return d.withColumn("start", F.explode(starts)).withColumn("length", F.col("_w")).drop("_w", "_h", "_p")


def every_nth(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """Rows 0, n, 2n, ... of each group in order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where((F.col("_r") - 1) % n == 0).drop("_r")


def even_subsample(df: DataFrame, keys: list[str], order: list[str], budget: int) -> DataFrame:
    """Items int(i * len / budget), i < budget, of each group; all if fewer."""
    w = Window.partitionBy(*keys)
    d = df.withColumns({"_r": F.row_number().over(w.orderBy(*order)) - 1, "_n": F.count("*").over(w)})
    # row r is taken if some i has floor(i * n / budget) = r
    i = f"((_r * {budget} + _n - 1) div _n)"
    return d.where(F.expr(f"_n <= {budget} or ({i} < {budget} and {i} * _n div {budget} = _r)")).drop("_r", "_n")


def largest_remainder(df: DataFrame, weight: str, total: int, order: list[str], out: str = "seats") -> DataFrame:
    """Whole shares of `total` in proportion to `weight`: floors, then one more
    by largest remainder, ties by `order`. For tables of strata."""
    all_ = Window.partitionBy(F.lit(1))
    d = df.withColumn("_sum", F.sum(weight).over(all_).cast("long"))
    d = d.withColumns({"_floor": F.expr(f"{weight} * {total} div _sum"), "_rest": F.expr(f"{weight} * {total} % _sum")})
    d = d.withColumn("_left", total - F.sum("_floor").over(all_))
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.col("_rest").desc(), *order))
    return d.withColumn(out, (F.col("_floor") + (rank <= F.col("_left")).cast("long")).cast("long")).drop("_sum", "_floor", "_rest", "_left")


def admit(df: DataFrame, keys: list[str], order: list[str], cost: str, budget: str) -> DataFrame:
    """Admission by priority with skips: an item enters if its cost still fits
    what is left of its group's budget, later smaller ones may. A group's rows
    pass in order through what is left, so none is gathered."""

    def start():
        left = None

        def step(c: int | None, all_: int) -> tuple[bool]:
            nonlocal left
            left = int(all_) if left is None else left
            ok = c is not None and c <= left
            left -= c if ok else 0
            return (ok,)

        return step

    return in_order(df, keys, [F.col(o).asc_nulls_last() for o in order], [cost, budget], T.StructType([T.StructField("admitted", T.BooleanType())]), start)


def independent_trials(df: DataFrame, keys: list[str], trial: str, provider: str, start: str, end: str, discounted: str | None = None) -> DataFrame:
    """`(keys, trials_e4)`: how many trials fit without overlap, earliest finish
    first, in ten-thousandths. A trial's span is the hull of its rows; one whose
    rows are all of `discounted` providers (a flag) counts half.

    The hulls of a group fold in the engine over a sorted array: a group is one
    play's trials."""
    light = F.min(F.col(discounted).cast("int")) if discounted else F.lit(0)
    hull = df.where(F.col(end) > F.col(start)).groupBy(*keys, trial).agg(F.max(end).alias("e"), F.min(start).alias("s"), light.alias("half"))
    spans = F.array_sort(F.collect_list(F.struct("e", "s", F.col(trial).alias("t"), "half")))
    none = F.struct(F.lit(None).cast("long").alias("free"), F.lit(0).cast("long").alias("sum"))

    def take(state: Column, x: Column) -> Column:
        fits = state["free"].isNull() | (x["s"] >= state["free"])
        more = F.when(x["half"] == 1, 5000).otherwise(10_000)
        return F.struct(F.when(fits, x["e"].cast("long")).otherwise(state["free"]).alias("free"), F.when(fits, state["sum"] + more).otherwise(state["sum"]).alias("sum"))

    return hull.groupBy(*keys).agg(F.aggregate(spans, none, take, lambda st: st["sum"]).alias("trials_e4"))


def capacity(duration_ms: Column, clips_per_minute: int) -> Column:
    return ceiling(duration_ms * clips_per_minute, F.lit(60_000))


def reserve(clips: Column, share_e4: int) -> Column:
    """Clips held back of a capacity, rounded down."""
    return whole(clips * share_e4, F.lit(10_000))


def reservation_e6(planned: Column, unit_e6: Column) -> Column:
    """Micro-dollars to reserve: five per cent over, up to the next one."""
    return ceiling(planned * unit_e6 * 105, F.lit(100))


def reserved(planned: Column, unit_e6: Column, cap_e2: Column) -> Column:
    """(cents, allowed): what to reserve in whole cents, rounded up, and whether
    a cap of cents allows it."""
    cents = ceiling(reservation_e6(planned, unit_e6), F.lit(10_000))
    return F.struct(cents.alias("cents"), (cents <= cap_e2).alias("allowed"))
