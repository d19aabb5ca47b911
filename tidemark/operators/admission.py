"""Rules that decide event by event, each decision counting for the next ones:
sliding limits whose refused events don't count, and failure breakers.

A key's events pass in order through a small state, in Arrow batches sorted by
key and time; no group is gathered. A limit's state is empty after a quiet time,
so a busy key is cut there into parts of their own.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def in_order(df: DataFrame, keys: list[str], order: list[str | Column], read: list[str], new: T.StructType, start: Callable[[], Callable[..., tuple]]) -> DataFrame:
    """`df` with the columns `new`: what `start()`'s function returns for the
    columns `read` of each row, in the order of `order` within `keys`; a new one
    starts with each key. Columns of these names are replaced."""
    d = df.drop(*new.names).repartition(*keys).sortWithinPartitions(*keys, *order)
    names = d.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, step = None, None
        for b in batches:
            own = zip(*(b.column(names.index(k)).to_pylist() for k in keys), strict=True)
            rows = zip(*(b.column(names.index(c)).to_pylist() for c in read), strict=True)
            out = []
            for key, row in zip(own, rows, strict=True):
                if key != at:
                    at, step = key, start()
                out.append(step(*row))
            made = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], names=[*names, *new.names])

    kinds = [ARROW[f.dataType] for f in new]
    return d.mapInArrow(run, T.StructType([*d.schema.fields, *new.fields]))


#: Arrow types of what order-bound steps return.
ARROW = {T.BooleanType(): pa.bool_(), T.IntegerType(): pa.int32(), T.LongType(): pa.int64(), T.StringType(): pa.string()}


def in_groups(df: DataFrame, keys: list[str], order: list[str], run: Callable[[Iterator[tuple]], Iterable[tuple]], out: T.StructType) -> DataFrame:
    """What `run` returns, as rows of `out`, for each group's rows, which it gets
    one by one as tuples of all columns, in the order of `order` (nulls first).
    `keys` are the first columns. A task's groups follow each other in its Arrow
    batches, so a small group costs no frame or stream of its own."""
    d = df.select(*keys, *(c for c in df.columns if c not in keys)).repartition(*keys).sortWithinPartitions(*keys, *order)
    kinds, own = [ARROW.get(f.dataType) or to_arrow_type(f.dataType) for f in out], itemgetter(*range(len(keys)))

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=out.names)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        made: list[tuple] = []
        for _, g in groupby(rows, own):
            made += run(g)
            while len(made) >= 10_000:
                yield batch(made[:10_000])
                del made[:10_000]
        if made:
            yield batch(made)

    return d.mapInArrow(each, out)


def in_whole_groups(df: DataFrame, keys: list[str], order: list[str], read: list[str], new: T.StructType, run: Callable[[list[tuple]], Iterable[tuple]]) -> DataFrame:
    """`df` with the columns `new`: what `run` returns, a tuple a row, for all
    rows of one group (their columns `read`, in the order of `order`). The other
    columns stay in Arrow; a task holds the groups of a batch, and a group that
    goes on over further ones."""
    d = df.drop(*new.names).repartition(*keys).sortWithinPartitions(*keys, *order)
    names, types = d.columns, [to_arrow_type(f.dataType) for f in new]
    at, seen = [names.index(k) for k in keys], [names.index(c) for c in read]

    def rows(b: pa.RecordBatch, columns: list[int]) -> list[tuple]:
        return list(zip(*(b.column(i).to_pylist() for i in columns), strict=True))

    def done(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [k for b in parts for k in rows(b, at)]
        each = [r for b in parts for r in rows(b, seen)]
        made: list[tuple] = []
        for _, g in groupby(range(len(own)), own.__getitem__):
            made += run([each[i] for i in g])
        to = 0
        for b in parts:
            if b.num_rows:
                cols = zip(*made[to : to + b.num_rows], strict=True)
                yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=[*names, *new.names])
                to += b.num_rows

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            own = rows(b, at)
            if held and own[0] == last == own[-1]:
                held.append(b)
                continue
            last, cut = own[-1], len(own)
            while cut and own[cut - 1] == last:
                cut -= 1
            yield from done([*held, b.slice(0, cut)])
            held = [b.slice(cut)]
        yield from done(held)

    return d.mapInArrow(each, T.StructType([*d.schema.fields, *new.fields]))


def limited(df: DataFrame, keys: list[str], at: str, id_col: str, limit: int, window: int) -> DataFrame:
    """`df` with `admitted`, and `wait` until an event would have been (0 for one
    that was, at least 1 otherwise): fewer than `limit` admitted events of its
    keys lie less than `window` before it. Refused events don't count.

    Events of one time go by id; one without a time is refused without a wait
    and counts for nothing; null keys are a key like others."""

    def start():
        held: deque[int] = deque()

        def step(t: int | None) -> tuple[bool, int]:
            if t is None:
                return False, 0
            while held and held[0] <= t - window:
                held.popleft()
            if len(held) < limit:
                held.append(t)
                return True, 0
            return False, max(1, held[-limit] + window - t) if limit else window

        return step

    w = Window.partitionBy(*keys).orderBy(at, id_col)
    # over `window` after the last event nothing is held
    quiet = F.coalesce(F.col(at) - F.lag(at).over(w) >= window, F.lit(False))
    d = df.withColumn("_quiet", quiet.cast("int"))
    d = d.withColumn("_part", F.sum("_quiet").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    new = T.StructType([T.StructField("admitted", T.BooleanType()), T.StructField("wait", T.LongType())])
    return in_order(d, [*keys, "_part"], [at, id_col], [at], new, start).drop("_quiet", "_part")


@dataclass
class BreakerState:
    """Samples of the window, when it lets through again, and the day's counts."""

    times: list[int] = field(default_factory=list)
    fails: list[int] = field(default_factory=list)
    until: int = 0
    day: int = -1
    opens: int = 0
    seen: int = 0

    def __iter__(self):
        return iter((self.times, self.fails, self.until, self.day, self.opens, self.seen))


@dataclass(frozen=True)
class Breaker:
    """Opens when more than `percent` of at least `least` samples of the last
    `window_s` seconds failed; takes no samples for `cooldown_s` then; latches for
    the UTC day at its `latch`-th open; is over budget after `daily` samples a
    day. A window that tripped is emptied, so one incident trips once."""

    window_s: int = 300
    least: int = 20
    percent: int = 30
    cooldown_s: int = 1800
    latch: int = 3
    daily: int = 2000

    def start(self) -> BreakerState:
        return BreakerState()

    def step(self, s: BreakerState, t: int, failed: bool) -> tuple[str | None, bool]:
        """(open, latched or None; whether this sample is the first over budget)."""
        if t // 86_400 != s.day:
            s.day, s.opens, s.seen = t // 86_400, 0, 0
        s.seen += 1
        over = s.seen == self.daily + 1
        if s.opens >= self.latch or t < s.until:
            return None, over
        s.times.append(t)
        s.fails.append(int(failed))
        gone = next((i for i, x in enumerate(s.times) if x > t - self.window_s), len(s.times))
        del s.times[:gone], s.fails[:gone]
        if len(s.times) < self.least or sum(s.fails) * 100 <= self.percent * len(s.times):
            return None, over
        s.opens += 1
        s.until = t + self.cooldown_s
        s.times, s.fails = [], []
        return ("latched" if s.opens >= self.latch else "open"), over


def breakers(df: DataFrame, keys: list[str], at: str, id_col: str, failed: str, **limits: int) -> DataFrame:
    """`df` with `opened` (open, latched or null) and `over_budget` of a Breaker
    for each of `keys`, as its samples arrive in order of time (whole seconds since
    the epoch) and id. A sample without a time is passed over; one that doesn't
    say whether it failed didn't."""
    rule = Breaker(**limits)

    def start():
        state = rule.start()

        def step(t: int | None, f: bool | None) -> tuple[str | None, bool]:
            return (None, False) if t is None else rule.step(state, t, bool(f))

        return step

    new = T.StructType([T.StructField("opened", T.StringType()), T.StructField("over_budget", T.BooleanType())])
    return in_order(df, keys, [at, id_col], [at, failed], new, start)
