"""Structured Streaming: sessions, replay-safe ingest, a breaker with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.admission import Breaker, BreakerState


def sessions(events: DataFrame, key: str, at: str, gap: str, late: str) -> DataFrame:
    """Sessions of events at most `gap` apart per key; events later than `late`
    behind the newest are dropped."""
    return events.withWatermark(at, late).groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def hops(events: DataFrame, key: str, at: str, width: str, hop: str, late: str) -> DataFrame:
    """Counts in sliding windows of event time."""
    return events.withWatermark(at, late).groupBy(key, F.window(at, width, hop).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def ingest_once(events: DataFrame, ids: list[str], at: str, late: str) -> DataFrame:
    """Each id once however often it is sent again within `late`."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(ids)


def breaker(events: DataFrame, key: str, at: str, failed: str, window_s: int = 300, least: int = 20, percent: int = 30, cooldown_s: int = 1800, latch: int = 3, daily: int = 2000) -> DataFrame:
    """`(key, at, action)`: open, latched or over_budget, as events arrive.

    A key opens when more than `percent` of at least `least` samples of the last
    `window_s` seconds failed, stays shut to new opens for `cooldown_s`, latches
    at the `latch`-th open of a UTC day, and is over budget after `daily`
    samples a day. A window that tripped is emptied, so one incident trips once.
    State per key is at most one window of samples. Seconds since the epoch.
    """

    rule = Breaker(window_s, least, percent, cooldown_s, latch, daily)

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = BreakerState(*(list(x) if hasattr(x, "__len__") else x for x in state.get)) if state.exists else rule.start()
        out = []
        rows = pd.concat(list(batches)).sort_values(["_at"], kind="stable")
        for t, f in zip(rows["_at"].astype(int), rows["_failed"].astype(bool), strict=True):
            opened, over = rule.step(held, t, f)
            out += [(k[0], t, "over_budget")] * over + [(k[0], t, opened)] * bool(opened)
        state.update(tuple(held))
        yield pd.DataFrame(out, columns=[key, "at", "action"])

    kind = events.schema[key].dataType.simpleString()
    return (
        events.select(key, F.col(at).cast("long").alias("_at"), F.col(failed).alias("_failed"))
        .groupBy(key)
        .applyInPandasWithState(run, f"`{key}` {kind}, at long, action string", "times array<long>, fails array<long>, until long, day long, opens long, seen long", "append", GroupStateTimeout.NoTimeout)
    )
