"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.runtime import cut

#: Links that a task contracts together.
BATCH = 1_000_000


def _stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some links, each with the smallest node that these reach;
    smallest nodes themselves only if nothing else points at them."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    low = np.arange(len(nodes))
    while (apart := a != b).any():
        high, a = np.maximum(a, b)[apart], np.minimum(a, b)[apart]
        np.minimum.at(low, high, a)
        while ((further := low[low]) != low).any():
            low = further
        a, b = low[a], low[high]
    keep = (low != np.arange(len(nodes))) | (np.bincount(low, minlength=len(nodes)) == 1)
    return nodes[keep], nodes[low[keep]]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v) as fewer ones that link the same nodes: what a task has read
    becomes stars, to which further links are added while these stay small."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def row(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    for b in batches:
        held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
        size += b.num_rows
        if size >= BATCH:
            u, v = _stars(*map(np.concatenate, zip(*held, strict=True)))
            held, size = [], 0
            if len(u) > BATCH // 2:
                yield row(u, v)
            else:
                held, size = [(u, v)], len(u)
    if held:
        yield row(*_stars(*map(np.concatenate, zip(*held, strict=True))))


def connected_components(links: DataFrame, left: str = "a", right: str = "b", max_rounds: int = 60) -> DataFrame:
    """`(node, component)` for every node of `links`; component is the smallest
    node reachable. Links are undirected; repeats, self-links and nulls are
    harmless (a node with only self-links is returned as its own component, a
    null end drops the link). An empty table gives an empty result.

    Tasks first contract the links that they read to stars, then the stars that
    hold the same nodes, so rounds of dense graphs see about as many links as
    nodes; a node is in a task's star once, so no node fills a task.

    Each round points every node's larger neighbours at the smallest node it
    knows (large star), then every node and its smaller neighbours at the
    smallest of them (small star). Minima are pre-aggregated before they are
    shuffled and hubs meet their minima in plain equi-joins, which adaptive
    execution splits, so no node's neighbour list is ever gathered.
    """
    e = links.select(F.col(left).cast("long").alias("u"), F.col(right).cast("long").alias("v")).where("u is not null and v is not null")
    e = e.mapInArrow(_contracted, "u long, v long").repartition("u")
    e = cut(e.mapInArrow(_contracted, "u long, v long"))
    loops = e.where("u = v").select(F.col("u").alias("node")).distinct()
    e = e.where("u <> v")
    before = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        e = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        e = (
            e.join(low, "u")
            .where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        e = cut(e)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    known = stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
    alone = loops.join(known, "node", "left_anti").select("node", F.col("node").alias("component"))
    return known.unionByName(alone)
