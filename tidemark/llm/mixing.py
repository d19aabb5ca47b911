"""Mixing sources to target weights by entropy balancing.

Every source gets a token target; within a source the documents' rates are the
exponential tilt of rate 1 that meets the target with the least relative
entropy on [0, 2]: rate = 2 / (1 + exp(-lambda * size / mean size)). The one
multiplier of a source solves a convex dual by Newton iterations over counts of
(source, size); rates become whole copies by error feedback from the longest
texts to the shortest, so what a source takes ends within about half its
shortest text of the target.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import n_words, text_of
from tidemark.runtime import cut, table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """`(source, sid, source_size, weight, target)` from `(source, size, n)`.

    Sources in code-point order, null last, take the weights in turn and share
    `share` times all sizes; a target stops at `most` times its source's size,
    the excess being reshared by weight: target = min(cap, weight * level). The
    level is the largest that any set of stopped sources allows. One row per
    source meets in one task, never one per document.
    """
    s = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"))
    s = s.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long"))
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("sid") - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * most)
    order = Window.orderBy(F.col("cap") / F.col("weight"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy(F.lit(1))
    stopped, spent = F.coalesce(F.sum("cap").over(order), F.lit(0)), F.coalesce(F.sum("weight").over(order), F.lit(0))
    level = (F.sum("source_size").over(all_) * share - stopped) / (F.sum("weight").over(all_) - spent)
    s = s.withColumn("_level", level).withColumn("_level", F.max("_level").over(all_))
    return s.select("source", "sid", "source_size", "weight", F.least(F.col("cap").cast("double"), F.col("weight") * F.col("_level")).alias("target"))


def _rate(lam: Column, x: Column, most: int) -> Column:
    return most / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), lam * x))))


def multipliers(cells: DataFrame, targets: DataFrame, most: int = MOST, rounds: int = 60, close: float = 1e-9) -> DataFrame:
    """`(sid, lam)`: the dual multiplier of each source, by Newton steps that
    fall back to bisection where they leave the bracket. A source whose target
    is its cap has none and isn't returned, nor has one without words."""
    t = targets.where((F.col("source_size") > 0) & (F.col("target") < F.col("source_size") * most * (1 - 1e-12)))
    state = cut(t.select("sid", "target", F.lit(0.0).alias("lam"), F.lit(-1e4).alias("lo"), F.lit(1e4).alias("hi")))
    cells = cells.select("sid", "size", "n", "x")
    for _ in range(rounds):
        r = _rate(F.col("lam"), F.col("x"), most)
        g = (
            cells.join(state, "sid")
            .groupBy("sid")
            .agg(
                *(F.first(c).alias(c) for c in ("target", "lam", "lo", "hi")),
                F.sum(F.col("n") * F.col("size") * r).alias("have"),
                F.sum(F.col("n") * F.col("size") * F.col("x") * r * (1 - r / most)).alias("slope"),
            )
        )
        off = F.col("have") - F.col("target")
        g = g.withColumn("off", off / F.col("target"))
        g = g.withColumns({"lo": F.when(off < 0, F.col("lam")).otherwise(F.col("lo")), "hi": F.when(off > 0, F.col("lam")).otherwise(F.col("hi"))})
        step = F.col("lam") - F.when(F.col("slope") > 1e-300, off / F.col("slope")).otherwise(F.lit(1e9))
        step = F.when((step > F.col("lo")) & (step < F.col("hi")), step).otherwise((F.col("lo") + F.col("hi")) / 2)
        state = cut(g.select("sid", "target", F.when(F.abs("off") <= close, F.col("lam")).otherwise(step).alias("lam"), "lo", "hi", "off"))
        worst = state.agg(F.max(F.abs("off"))).first()[0]
        if worst is None or worst <= close:
            break
        state = state.drop("off")
    return state.select("sid", F.round("lam", 9).alias("lam"))


def _whole(cells: pd.DataFrame) -> pd.DataFrame:
    """Copies for the cells of one source, carrying the error in words."""
    cells = cells.sort_values("size", ascending=False)
    err, out = 0.0, []
    for size, n, rate, most in zip(cells["size"], cells["n"], cells["rate"], cells["most"], strict=True):
        if size == 0:
            out.append(n)
            continue
        want = rate * n * size + err
        k = min(max(round(want / size), 0), most * n)
        err = want - k * size
        out.append(int(k))
    return cells[["sid", "size", "n"]].assign(k=out)


def plan(slim: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The mix of `(source, size, h)` rows, h a hash that orders the documents
    of a cell: `(source, size, source_size, target, base, last)`; a document
    takes base copies, and one more if h <= last.

    The cells of one source (a row per distinct size, so as many as the longest
    text has words at most) are rounded in one task. Within a cell the ones to
    get an extra copy are those of smallest h, found from counts over 1,024
    ranges of h and by ranking the single range where the limit lies; documents
    of equal h are treated alike, so equal rows never push a cell above its
    share. Same input, same mix.
    """
    part = F.shiftrightunsigned("h", 54)
    ranged = cut(slim.groupBy("source", "size", part.alias("part")).agg(F.count("*").alias("n")))
    sizes = ranged.groupBy("source", "size").agg(F.sum("n").alias("n"))
    targets = cut(source_targets(sizes, weights, share, most))
    of_source = targets.withColumnRenamed("source", "_s")
    cells = sizes.join(of_source, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    of = Window.partitionBy("sid")
    mean = F.sum(F.col("n") * F.col("size")).over(of) / F.sum("n").over(of)
    cells = cut(cells.withColumn("x", F.when(F.col("source_size") > 0, F.col("size") / mean).otherwise(0.0)))
    lam = multipliers(cells, targets, most)
    rate = F.when(F.col("size") == 0, 1.0).when(F.col("lam").isNull(), float(most)).otherwise(F.round(_rate(F.col("lam"), F.col("x"), most), 12))
    rated = cells.join(lam, "sid", "left").select("sid", "size", "n", rate.alias("rate"), F.lit(most).alias("most"))
    whole = rated.groupBy("sid").applyInPandas(_whole, "sid long, size long, n long, k long")
    whole = whole.select("sid", "size", F.floor(F.col("k") / F.col("n")).alias("base"), (F.col("k") % F.col("n")).alias("more"))
    whole = cut(cells.join(whole, ["sid", "size"]).select("source", "sid", "size", "source_size", "target", "base", "more"))
    # where in a cell's order by h the last extra copy goes
    key = ["source", "size"]
    upto = F.sum("n").over(Window.partitionBy("sid", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
    tie = F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z"))
    some = whole.where("more > 0").select("sid", F.col("source").alias("_s"), F.col("size").alias("_z"), "more")
    edge = ranged.join(some, tie).select("sid", *key, "part", "n", "more").withColumn("upto", upto)
    edge = cut(edge.where("upto >= more and upto - n < more").select(*key, "sid", "part", (F.col("more") - F.col("upto") + F.col("n")).alias("local")))
    d = slim.select(*key, "h", part.alias("own"))
    to = edge.select("sid", F.col("source").alias("_s"), F.col("size").alias("_z"), "part", "local")
    near = d.join(to, tie & (F.col("own") == F.col("part"))).select("sid", "size", "h", "part", "local")
    seen = F.count("*").over(Window.partitionBy("sid", "size").orderBy("h").rangeBetween(Window.unboundedPreceding, 0))
    last = near.withColumn("seen", seen).where("seen <= local").groupBy("sid", "size").agg(F.max("h").alias("last"))
    ends = edge.select("sid", "size", "part").join(last, ["sid", "size"], "left")
    out = whole.join(ends, ["sid", "size"], "left")
    return cut(out.select(*key, "source_size", "target", F.col("base").cast("long").alias("base"), "part", "last"))


def extra(h: Column, part: Column, last: Column) -> Column:
    """1 for a document that takes one copy more than its cell's base: it lies
    below the range of h with the limit, or in it and not above the limit."""
    own = F.shiftrightunsigned(h, 54)
    return F.when(part.isNull(), 0).when(own < part, 1).when((own == part) & (h <= last), 1).otherwise(0)


def mix(df: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """Every row of `df` with `size`, `source_size`, `target` and `copies`.

    A null text has no words (size 0, one copy); a null source is a source of
    its own; repeated rows are mixed each; an empty table gives no rows. Columns
    of these names, and those starting with `_mix`, are replaced.
    """
    d = df.drop("size", "source_size", "target", "copies")
    t = text_of(d, text)
    d = d.withColumns({"size": n_words(t), "_mix_h": F.xxhash64(F.col(id_col), t), "_mix_s": F.col(source)})
    slim = table(d.select(F.col("_mix_s").alias("source"), "size", F.col("_mix_h").alias("h")), "sizes")
    p = plan(slim, **how).select(F.col("source").alias("_mix_p"), F.col("size").alias("_mix_size"), "source_size", "target", "base", F.col("part").alias("_mix_part"), F.col("last").alias("_mix_last"))
    out = d.join(p, d["_mix_s"].eqNullSafe(p["_mix_p"]) & (d["size"] == p["_mix_size"]))
    copies = (F.col("base") + extra(F.col("_mix_h"), F.col("_mix_part"), F.col("_mix_last"))).cast("int")
    return out.withColumn("copies", copies).drop("base", "_mix_h", "_mix_s", "_mix_p", "_mix_size", "_mix_part", "_mix_last")
