"""Identity: which assertions merge, candidates of components, support of a
recording, labels that name one work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.labels import words_corroborate


#: Parts of a work's components, and of what meets their lists.
_SPREAD = 96


def eligible_links(assertions: DataFrame, specific: Column, privileged: Column) -> DataFrame:
    """`(id, a, b)`, ends in order, of the same-recording assertions that may
    merge: their pair names a recording and two independent sources assert it, or
    a privileged source does. A pair counts with its first id."""
    d = assertions.where("relation = 'same_recording'")
    pair = d.select(F.least("a", "b").alias("_a"), F.greatest("a", "b").alias("_b"), "id", "independent_of", specific.alias("_s"), privileged.alias("_p"))
    n = pair.groupBy("_a", "_b").agg(F.min("id").alias("id"), F.countDistinct("independent_of").alias("_n"), F.max("_s").alias("_s"), F.max("_p").alias("_p"))
    return n.where("_p or (_s and _n >= 2)").select("id", F.col("_a").alias("a"), F.col("_b").alias("b"))


def contested(components: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Components that hold both ends of a conflict."""
    c = components.select("node", "component")
    j = conflicts.join(c.withColumnRenamed("node", "a"), "a").join(c.select(F.col("node").alias("b"), F.col("component").alias("_o")), "b")
    return j.where("component = _o").select("component").distinct()


def candidates(members: DataFrame, conflicts: DataFrame) -> DataFrame:
    """One row a component of `(node, component, work)`: its canonical (least)
    node, its number of nodes, the canonical nodes of the other components of its
    work, and whether it holds a conflict; a component's work is its least.

    A work's list is sorted once, and copied into `_SPREAD` parts, so that works of
    very many components fill as many tasks."""
    c = members.groupBy("component").agg(F.min("node").alias("canonical"), F.count("*").alias("nodes"), F.min("work").alias("work"))
    of = c.groupBy("work").agg(F.array_sort(F.collect_list("canonical")).alias("_all")).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(_SPREAD - 1))))
    bad = contested(members, conflicts).withColumn("_bad", F.lit(True))
    d = c.join(bad, "component", "left").withColumn("_part", F.pmod(F.xxhash64("component"), F.lit(_SPREAD)).cast("int")).repartition(_SPREAD, "work", "_part").join(of.hint("merge"), ["work", "_part"])
    return d.select("component", "work", "canonical", "nodes", F.array_remove("_all", F.col("canonical")).alias("alternatives"), F.coalesce("_bad", F.lit(False)).alias("contested"))


def first_known(rows: DataFrame, key: str, sources: list[DataFrame], value: str) -> DataFrame:
    """`rows` with `value` of the first source `(key, value)` that has the key."""
    for i, s in enumerate(sources):
        rows = rows.join(s.select(key, F.col(value).alias(f"_v{i}")), key, "left")
    return rows.withColumn(value, F.coalesce(*(F.col(f"_v{i}") for i in range(len(sources))))).drop(*(f"_v{i}" for i in range(len(sources))))


def recording_supported(members: DataFrame, sources: DataFrame) -> DataFrame:
    """`(candidate, supported)`: two recording nodes or more, or one that two
    sources assert; never if contested. `members` are `(candidate, node,
    recording, contested)`, `sources` `(node, source)`."""
    n = sources.groupBy("node").agg(F.countDistinct("source").alias("_n"))
    d = members.join(n, "node", "left").groupBy("candidate")
    return d.agg((~F.max("contested") & ((F.count_if("recording") >= 2) | (F.max(F.coalesce("_n", F.lit(0))) >= 2))).alias("supported"))


def solid_names(credits: DataFrame) -> DataFrame:
    """Names that two distinct works or more credit, of `(name, work)`."""
    return credits.groupBy("name").agg(F.countDistinct("work").alias("works")).where("works >= 2")


def named_works(hints: DataFrame, works: DataFrame) -> DataFrame:
    """`(hint, work)` where a hint's words name one work and no other. A label
    that fits two works or more names none. `words` are distinct.

    Labels of the same words are one before they meet. Two that differ in a word
    each are met by all their other words, a label of fewer words by its two
    rarest, which lie in the other; rare is what few distinct labels have."""
    bag = F.array_sort("words")
    h = hints.select("hint", bag.alias("_h"))
    k = works.select("work", bag.alias("_k")).groupBy("_k").agg(F.min("work").alias("work"), F.countDistinct("work").alias("_n"))
    sides = {"_h": h.select("_h").distinct().where("size(_h) >= 2"), "_k": k.select("_k").where("size(_k) >= 2")}
    at = lambda s: sides[s].select(s, F.explode(s).alias("w"))
    often = at("_h").select("w").unionByName(at("_k").select("w")).groupBy("w").agg(F.count("*").alias("n"))
    two = lambda ws: F.flatten(F.transform(ws, lambda x, i: F.transform(F.slice(ws, i + 2, F.size(ws)), lambda y: F.array(F.least(x, y), F.greatest(x, y)))))

    def rarest(s: str) -> DataFrame:
        r = at(s).join(often, "w").groupBy(s).agg(F.slice(F.array_sort(F.collect_list(F.struct("n", "w"))), 1, 2)["w"].alias("_r"))
        return r.select(s, F.array_sort("_r").alias("by"))

    pairs = lambda s: sides[s].select(s, F.explode(two(F.col(s))).alias("by"))
    others = lambda s: sides[s].select(s, F.explode(F.transform(s, lambda w: F.filter(s, lambda x: x != w))).alias("by"))
    fits = words_corroborate(F.col("_h"), F.col("_k"))
    same = sides["_h"].join(sides["_k"], F.col("_h") == F.col("_k"))
    near = others("_h").join(others("_k"), "by").where(F.col("_h") != F.col("_k")).where(fits)
    within = rarest("_h").join(pairs("_k"), "by").where("size(_h) < size(_k)").where(fits)
    around = pairs("_h").join(rarest("_k"), "by").where("size(_k) < size(_h)").where(fits)
    fit = same
    for more in (near, within, around):
        fit = fit.unionByName(more.select("_h", "_k"))
    one = fit.distinct().join(k, "_k").groupBy("_h").agg(F.min("work").alias("work"), F.sum("_n").alias("_n"))
    return h.distinct().join(one, "_h").groupBy("hint").agg(F.min("work").alias("work"), F.sum("_n").alias("_n")).where("_n = 1").drop("_n")


def mutual(pairs: DataFrame) -> DataFrame:
    """Pairs `(a, b)` of which either end has no other partner."""
    left = pairs.groupBy("a").agg(F.countDistinct("b").alias("n"), F.min("b").alias("b")).where("n = 1").select("a", "b")
    right = pairs.groupBy("b").agg(F.countDistinct("a").alias("n"), F.min("a").alias("a")).where("n = 1").select("a", "b")
    return left.join(right, ["a", "b"])
