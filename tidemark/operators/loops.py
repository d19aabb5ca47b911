"""What runs over generations and orders: the fuse-and-rescan loop, hint-only
rows, copies and mirrors of hints, calibrated tiers."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import DoubleType

from tidemark.operators.admission import in_groups
from tidemark.operators.intervals import overlap_join
from tidemark.runtime import table


def generations(evidence: DataFrame, fuse: Callable[[DataFrame], DataFrame], plan: Callable[[DataFrame, DataFrame, int], DataFrame], recognise: Callable[[DataFrame], DataFrame], most: int, budget: int) -> tuple[DataFrame, DataFrame, str]:
    """(fused, evidence, why it stopped): fuses all evidence, plans windows within
    what is left of the budget, has them recognised, and fuses the union anew, so
    late evidence counts as if it had been there from the start.

    It stops with `no_requests`, `no_evidence` (the new windows brought nothing),
    `budget` or `generations`. Each generation's evidence is written, so a
    generation doesn't redo those before it."""
    for generation in range(1, most + 1):
        fused = fuse(evidence)
        windows = table(plan(fused, evidence, budget), "windows")
        n = windows.count()
        if not n:
            return fused, evidence, "no_requests"
        if n > budget:
            return fused, evidence, "budget"
        budget -= n
        new = table(recognise(windows), "answers")
        if new.isEmpty():
            return fused, evidence, "no_evidence"
        evidence = table(evidence.unionByName(new), f"evidence_{generation}")
    return fuse(evidence), evidence, "generations"


def hint_only(clusters: DataFrame, spans: DataFrame, separators: DataFrame) -> DataFrame:
    """`(media, cluster, work, s, e)`: in the order of clusters the best-ranked
    work each names that isn't on already: every span of that work, those added
    by earlier clusters too, must have a separator (a listed span of another work)
    wholly between it and the cluster. `clusters` are `(media, cluster, work, rank,
    s, e)`, the others `(media, work, s, e)`; rows without ends are left out. What
    is added counts for what comes after, so one recording is one task, whose rows
    pass in order; of a work's spans only the nearest on either side are asked."""
    tag = lambda d, kind: d.select("media", F.lit(kind).alias("kind"), F.lit(0).cast("long").alias("cluster"), F.lit(0).alias("rank"), "work", "s", "e")
    named = clusters.select("media", F.lit(2).alias("kind"), F.col("cluster").cast("long"), F.col("rank").cast("int"), "work", "s", "e").where("cluster is not null")
    both = tag(spans.where("work is not null"), 0).unionByName(tag(separators, 1)).unionByName(named).where("s is not null and e is not null")

    def run(g: Iterator[tuple]) -> Iterator[tuple]:
        on: dict = {}
        walls: list[tuple] = []
        between, done = None, None
        for media, kind, cluster, _, work, s, e in g:
            if kind < 2:
                if kind:
                    walls.append((s, e, work))
                else:
                    on.setdefault(work, _Spans()).add(s, e)
                continue
            between = between or _Walls(walls)
            if cluster == done:
                continue
            own = on.setdefault(work, _Spans())
            before, after = own.around(e)
            if (before is None or (before <= s and between.other(work, before, s))) and (after is None or between.other(work, e, after)):
                own.add(s, e)
                done = cluster
                yield media, cluster, work, s, e

    kinds = clusters.schema
    out = T.StructType([T.StructField(c, T.LongType() if c in ("cluster", "s", "e") else kinds[c].dataType) for c in ("media", "cluster", "work", "s", "e")])
    return in_groups(both, ["media"], ["kind", "cluster", "rank", "work", "s", "e"], run, out)


class _Spans:
    """Spans of one work by their start, with the latest end so far of each."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.reach: list[int] = []

    def add(self, s: int, e: int) -> None:
        i = bisect_right(self.starts, s)
        self.starts.insert(i, s)
        self.reach.insert(i, max(e, self.reach[i - 1]) if i else e)
        for k in range(i + 1, len(self.reach)):
            if self.reach[k] >= e:
                break
            self.reach[k] = e

    def around(self, e: int) -> tuple[int | None, int | None]:
        """The latest end of those that begin before `e`, the next start from then on."""
        i = bisect_left(self.starts, e)
        return (self.reach[i - 1] if i else None), (self.starts[i] if i < len(self.starts) else None)


class _Walls:
    """Separators by their start, each with the two earliest ends, of unlike
    works, from there on."""

    def __init__(self, walls: list[tuple]) -> None:
        walls = sorted(walls, key=lambda x: x[0])
        self.starts = [x[0] for x in walls]
        self.first: list[tuple] = [()] * len(walls)
        best: tuple = ()
        for i in range(len(walls) - 1, -1, -1):
            _, e, w = walls[i]
            ends = sorted([(e, w), *best], key=lambda x: x[0])
            self.first[i] = best = tuple(x for k, x in enumerate(ends) if all(x[1] != y[1] for y in ends[:k]))[:2]

    def other(self, work, lo: int, hi: int) -> bool:
        """Whether one of another work lies within [lo, hi]."""
        i = bisect_left(self.starts, lo)
        return i < len(self.starts) and any(e <= hi for e, w in self.first[i] if w != work)


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


def copies(hints: DataFrame, near: int = 60_000, alike: float = 0.88) -> DataFrame:
    """`(media, a, b, confidence)`: hints of unlike connectors at most `near`
    apart that say the same: equal keys 9000, else artists and titles both alike
    7500. Hints are `(media, id, connector, key, artist, title, at)`; pairs are met
    in time buckets."""
    span = hints.where("key <> ''").withColumns({"_s": F.col("at"), "_e": F.col("at") + 1})
    a = span.select("media", *(F.col(c).alias(f"a_{c}") for c in ("id", "connector", "key", "artist", "title")), (F.col("at") - near).alias("as"), (F.col("at") + near + 1).alias("ae"))
    b = span.select("media", *(F.col(c).alias(f"b_{c}") for c in ("id", "connector", "key", "artist", "title")), F.col("_s").alias("bs"), F.col("_e").alias("be"))
    j = overlap_join(a, b, ["media"], "as", "ae", "bs", "be", 2 * near).where("a_id < b_id and a_connector <> b_connector")
    same = F.col("a_key") == F.col("b_key")
    fuzzy = j.where(~same & (F.least("a_artist", "b_artist", "a_title", "b_title") != ""))
    fuzzy = fuzzy.where((_ratio("a_artist", "b_artist") >= alike) & (_ratio("a_title", "b_title") >= alike))
    pick = lambda d, n: d.select("media", F.col("a_id").alias("a"), F.col("b_id").alias("b"), F.lit(n).alias("confidence"))
    return pick(j.where(same), 9000).unionByName(pick(fuzzy, 7500))


def mirror_agreements(source: DataFrame, mirror: DataFrame, near: int = 60_000) -> DataFrame:
    """`(media, agreements)`: how many hints of a mirrored timeline say what one
    of the source's says at most `near` away, in order, each provenance group and
    each mirror position used once. Hints are `(media, id, grp, key, at)`."""
    tag = lambda d, side: d.select("media", F.lit(side).alias("side"), "at", "key", "grp")
    both = tag(source, 0).unionByName(tag(mirror, 1))

    def run(g: Iterator[tuple]) -> Iterator[tuple]:
        used, places, n = set(), set(), 0
        said: dict = {}
        for media, side, at, key, grp in g:  # noqa: B007
            if at is None:
                continue
            if side == 0:
                said.setdefault(key, []).append((at, grp))
                continue
            src = said.get(key, [])
            near_by = range(bisect_left(src, at - near, key=lambda x: x[0]), bisect_right(src, at + near, key=lambda x: x[0]))
            hit = next((src[i][1] for i in near_by if src[i][1] not in used), used)
            if hit is not used and at not in places:
                used.add(hit)
                places.add(at)
                n += 1
        yield media, n

    out = T.StructType([T.StructField("media", source.schema["media"].dataType), T.StructField("agreements", T.LongType())])
    return in_groups(both, ["media"], ["side", "at", "key", "grp"], run, out)


def calibrated_tiers(rows: DataFrame, index: str, thresholds: DataFrame) -> DataFrame:
    """`rows` with `tier`: the best one whose least index a row reaches, else
    unclear. `thresholds` are of a few tiers."""
    order = F.array(*map(F.lit, ("unclear", "possible", "likely", "verified")))
    t = thresholds.where("min_index is not null").agg(F.collect_list(F.struct(F.array_position(order, F.col("tier")).alias("n"), F.col("min_index").alias("at"))).alias("_t"))
    d = rows.crossJoin(F.broadcast(t))
    reached = F.transform(F.filter("_t", lambda x: x["at"] <= F.col(index)), lambda x: x["n"])
    return d.withColumn("tier", F.element_at(order, F.coalesce(F.array_max(reached), F.lit(1)).cast("int"))).drop("_t")


def canonical_url(url: Column) -> Column:
    """An address without credentials, default port, fragment, tracking
    parameters and closing slash, its scheme and host in lower case; null for what
    isn't http(s)."""
    p = r"^(https?)://([^/?#@]*@)?([^/?#:]+)(:[0-9]+)?([^?#]*)(\?[^#]*)?(#.*)?$"
    part = lambda i: F.regexp_extract(F.regexp_replace(url, r"^([a-zA-Z]+)://", "$1://"), "(?i)" + p, i)
    scheme, port = F.lower(part(1)), part(4)
    keep = F.when(((scheme == "http") & (port == ":80")) | ((scheme == "https") & (port == ":443")), "").otherwise(port)
    query = F.filter(F.split(F.substring(part(6), F.lit(2), F.length(part(6))), "&"), lambda q: (q != "") & ~q.rlike(r"(?i)^(utm_[a-z]+|fbclid|gclid|si|feature)(=|$)"))
    tail = F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise("")
    return F.when(url.rlike("(?i)" + p), F.concat(scheme, F.lit("://"), F.lower(part(3)), keep, F.regexp_replace(part(5), "/+$", ""), tail))


def read_pcm(spark, path: str) -> DataFrame:
    """`(path, samples)`: 16-bit little-endian files as arrays, one row a file; an
    odd last byte is left out."""
    import numpy as np

    @F.pandas_udf("array<smallint>")
    def decoded(s: pd.Series) -> pd.Series:
        return s.map(lambda b: np.frombuffer(b[: len(b) // 2 * 2], "<i2"))

    return spark.read.format("binaryFile").load(path).select("path", decoded("content").alias("samples"))
