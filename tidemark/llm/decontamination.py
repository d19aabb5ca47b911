"""Benchmark decontamination: windows of benchmark words in a broadcast hash set,
met by the windows of every document, verified word by word.

Words are runs of ASCII letters (A-Z as a-z), digits and any other characters
but ASCII ones. A window is WINDOW words in a row of an item; an item of fewer
words is one window. The set is built of slices of bounded size, so that a
benchmark of any size is met by a few broadcasts at a time, in several passes
where it needs them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.runtime import table

WINDOW = 10
#: Bytes of benchmark words in a broadcast slice, slices in a pass, and windows
#: that begin in one piece of an item.
SLICE_BYTES, SLICES, PIECE = 32_000_000, 4, 20_000
#: Bytes of text that are hashed together; a longer word goes alone.
CHUNK = 1_000_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_UPPER, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWER = bytes.maketrans(_UPPER.encode(), _LOW.encode())
_IN_WORD = bytes(c >= 128 or chr(c).isalnum() for c in range(256))
_BLANK = bytes(c if _IN_WORD[c] else 32 for c in range(256))
#: Odd bases of the hashes of words and windows; any would do, for hits are verified.
_BASE, _STEP, _MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9


def words_of(text: Column) -> Column:
    """The words of a text in order; null has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOW), F.lit(WORD), F.lit(0))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(_MIX)
    return h ^ (h >> np.uint64(29))


class Words:
    """The words of many texts: `first` and `end` byte of each in `low`, the
    lower-cased texts, `owner` its text and `start[k]` text k's first word."""

    def __init__(self, texts: list[bytes]) -> None:
        self.low = b"\0".join(texts).translate(_LOWER) + b"\0"
        edge = np.diff(np.frombuffer(b"\0" + self.low.translate(_IN_WORD), np.int8))
        self.first, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        stop = np.cumsum([len(t) + 1 for t in texts])
        self.owner = np.searchsorted(stop, self.first, side="right")
        self.start = np.searchsorted(self.owner, np.arange(len(texts) + 1))

    def chunks(self, extra: int) -> Iterator[tuple[int, np.ndarray]]:
        """(first word, hashes of words) for runs of about CHUNK bytes, each
        followed by the `extra` words that windows reach into."""
        n = len(self.first)
        i = 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.first, self.first[i] + CHUNK)))
            k = min(j + extra, n)
            at = int(self.first[i])
            raw = np.frombuffer(self.low, np.uint8, int(self.end[k - 1]) - at, at).astype(np.uint64)
            sums = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum(raw * _powers(_BASE, len(raw)), out=sums[1:])
            first, end = self.first[i:k] - at, self.end[i:k] - at
            back = _powers(pow(_BASE, -1, 1 << 64), len(raw))
            yield i, _mixed((sums[end] - sums[first]) * back[first])
            i = j

    def windows(self, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(first words, hashes) of the windows of `n` words of one text each."""
        for i, h in self.chunks(n - 1):
            m = len(h) - n + 1
            if m <= 0:
                continue
            acc = np.zeros(m, np.uint64)
            for k in range(n):
                acc = acc * np.uint64(_STEP) + h[k : k + m]
            at = np.arange(i, i + m)
            fine = self.owner[at] == self.owner[at + n - 1]
            yield at[fine], _mixed(acc[fine])

    def text(self, i: int, n: int) -> bytes:
        """The words i to i + n, joined by spaces."""
        return b" ".join(self.low[self.first[i] : self.end[i + n - 1]].translate(_BLANK).split())


@dataclass
class Windows:
    """Distinct windows of `n` words of a slice: their hashes in order, their
    text as bytes first to end of `text`, and in a run of `items` the items."""

    n: int
    text: bytes
    hash: np.ndarray
    first: np.ndarray
    end: np.ndarray
    run: np.ndarray
    items: np.ndarray
    present: np.ndarray

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in h, first window of that hash) for hashes in the set."""
        shift = np.uint64(65 - len(self.present).bit_length())
        some = np.flatnonzero(self.present[h >> shift])
        g = np.minimum(np.searchsorted(self.hash, h[some]), len(self.hash) - 1)
        hit = self.hash[g] == h[some]
        return some[hit], g[hit]

    def same(self, g: int, text: bytes) -> int:
        """The window of the hash of window g that has this text, or -1."""
        h = self.hash[g]
        while g < len(self.hash) and self.hash[g] == h:
            if self.text[self.first[g] : self.end[g]] == text:
                return g
            g += 1
        return -1


@dataclass
class Pool:
    """A slice of the benchmark: names of items and their windows by length."""

    names: list[str | None]
    sets: list[Windows]


def pool_of(rows: list[tuple[str | None, str]], window: int = WINDOW) -> Pool:
    """The pool of (item, words joined by spaces) rows."""
    names = sorted({i for i, _ in rows}, key=lambda x: (x is None, x or ""))
    number = {x: k for k, x in enumerate(names)}
    item = np.array([number[i] for i, _ in rows], np.int64)
    w = Words([t.encode() for _, t in rows])
    size = np.diff(w.start)
    sets = []
    for n in sorted({min(int(x), window) for x in size if x}):
        found = [(at, h) for at, h in w.windows(n)]
        at, h = (np.concatenate(x) for x in zip(*found, strict=True))
        own = w.owner[at]
        fine = (size[own] == n) | (n == window)
        at, h, own = at[fine], h[fine], own[fine]
        order = np.lexsort((at, h))
        at, h, own = at[order], h[order], own[order]
        first, end = w.first[at], w.end[at + n - 1]
        group = _alike(w.low, h, first, end)
        order = np.lexsort((item[own], group))
        group, own, first, end, h = group[order], own[order], first[order], end[order], h[order]
        lead = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        new = np.r_[True, (group[1:] != group[:-1]) | (item[own][1:] != item[own][:-1])]
        run = np.r_[np.searchsorted(np.flatnonzero(new), lead), new.sum()]
        present = np.zeros(1 << max(10, (16 * len(lead)).bit_length()), bool)
        present[h[lead] >> np.uint64(65 - len(present).bit_length())] = True
        sets.append(Windows(n, w.low, h[lead], first[lead], end[lead], run, item[own][new], present))
    return Pool(names, sets)


def _alike(low: bytes, h: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Numbers of groups of equal text for windows in order of their hashes."""
    group = np.cumsum(np.r_[0, h[1:] != h[:-1]])
    lead = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])[group]
    unlike = [k for k in np.flatnonzero(lead != np.arange(len(h))).tolist() if low[first[k] : end[k]] != low[first[lead[k]] : end[lead[k]]]]
    if not unlike:
        return group
    # two texts of one hash: number all of them by hash and text
    texts = [low[a:b] for a, b in zip(first.tolist(), end.tolist(), strict=True)]
    known: dict[tuple[int, bytes], int] = {}
    return np.array([known.setdefault(k, len(known)) for k in zip(group.tolist(), texts, strict=True)])


def slices_of(items: DataFrame, id_col: str = "item_id", text: str = "text", window: int = WINDOW, slice_bytes: int = SLICE_BYTES) -> list[DataFrame]:
    """The benchmark's pieces `(item, words)` in slices of at most `slice_bytes`
    (a single larger piece is a slice of its own)."""
    w = items.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1)), F.lit(PIECE))
    at = w.select("item", "w", F.explode(starts).alias("s"))
    words = F.array_join(F.slice("w", F.col("s"), F.lit(PIECE + window - 1)), " ")
    pieces = table(at.select("item", words.alias("words"), F.xxhash64("item", "s").alias("h")).distinct(), "pieces")
    size = F.sum(F.octet_length("words") + 1)
    total, count = pieces.agg(size, F.count("*")).first()
    n = -(-(total or 0) // slice_bytes)
    part = lambda n: F.pmod("h", F.lit(n))
    while 1 < n < count and pieces.groupBy(part(n)).agg(size.alias("b")).agg(F.max("b")).first()[0] > slice_bytes:
        n *= 2
    return [pieces.where(part(n) == k).select("item", "words") for k in range(n)]


def _hits(w: Words, pools: list[Pool]) -> tuple[np.ndarray, list[set[str]]]:
    """Changes of the number of windows that cover each word, and the items met
    in each text."""
    change = np.zeros(len(w.first) + 1, np.int64)
    items: list[set[str]] = [set() for _ in range(len(w.start) - 1)]
    for pool in pools:
        for s in pool.sets:
            known: dict[int, list[str]] = {}
            for at, h in w.windows(s.n):
                where, g = s.find(h)
                for i, k in zip(at[where].tolist(), g.tolist(), strict=True):
                    k = s.same(k, w.text(i, s.n))
                    if k < 0:
                        continue
                    change[i] += 1
                    change[i + s.n] -= 1
                    if k not in known:
                        known[k] = [x for x in (pool.names[j] for j in s.items[s.run[k] : s.run[k + 1]]) if x is not None]
                    items[w.owner[i]].update(known[k])
    return change, items


_PLACES = "first_word", "end_word", "first_byte", "end_byte"
SPAN = T.StructType([T.StructField(n, T.LongType()) for n in _PLACES])
_SPAN = pa.struct([(n, pa.int64()) for n in _PLACES])


def _groups(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of about CHUNK bytes."""
    start = size = 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK:
            yield start, k + 1
            start, size = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _scan(df: DataFrame, text: str, shared: list[Broadcast]) -> DataFrame:
    """`df` with `n_words`, `spans` and `items` of the shared pools, added to
    those that it has."""

    def rows(texts: list[bytes], spans: list, items: list):
        w = Words(texts)
        change, met = _hits(w, [s.value for s in shared])
        for k, old in enumerate(spans):
            for x in old:
                change[w.start[k] + x["first_word"]] += 1
                change[w.start[k] + x["end_word"]] -= 1
        inside = np.cumsum(change)[:-1] > 0
        same = np.r_[False, w.owner[1:] == w.owner[:-1]] if len(inside) else inside
        before = np.r_[False, inside[:-1]] & same if len(inside) else inside
        after = np.r_[inside[1:] & same[1:], False] if len(inside) else inside
        a, b = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after)
        own = w.owner[a]
        at = np.cumsum([0, *(len(t) + 1 for t in texts)])[own]
        fields = [a - w.start[own], b + 1 - w.start[own], w.first[a] - at, w.end[b] - at]
        made = pa.StructArray.from_arrays([pa.array(f, pa.int64()) for f in fields], fields=list(_SPAN))
        offsets = pa.array(np.searchsorted(own, np.arange(len(texts) + 1)), pa.int32())
        all_items = [sorted(m | set(o)) for m, o in zip(met, items, strict=True)]
        return pa.array(np.diff(w.start), pa.int64()), pa.ListArray.from_arrays(offsets, made), pa.array(all_items, pa.list_(pa.string()))

    names = [*df.columns, *(c for c in ("n_words", "spans", "items") if c not in df.columns)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [(t or "").encode() for t in b.column(b.schema.get_field_index(text)).to_pylist()]
            empty = [[]] * len(texts)
            spans, items = (b.column(b.schema.get_field_index(c)).to_pylist() if c in b.schema.names else empty for c in ("spans", "items"))
            for lo, hi in _groups(texts):
                new = dict(zip(("n_words", "spans", "items"), rows(texts[lo:hi], spans[lo:hi], items[lo:hi]), strict=True))
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([new[c] if c in new else part.column(part.schema.get_field_index(c)) for c in names], names=names)

    types = {f.name: f.dataType for f in df.schema} | {"n_words": T.LongType(), "spans": T.ArrayType(SPAN), "items": T.ArrayType(T.StringType())}
    return df.mapInArrow(run, T.StructType([T.StructField(n, types[n]) for n in names]))


def contamination(df: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """`df` with `n_words`, `spans` (runs of words that windows of items cover, by
    word number and byte of the text) and `items` (ids, as strings in order, of
    the items of which a window occurs).

    Null texts have no words; repeated rows are scanned each; rows of items that
    share an id are one item; an item without an id marks words but isn't named;
    one without words has no window; without items nothing is marked; columns of
    the new names are replaced.

    A window's hash only proposes a hit; its words decide. What is broadcast is
    at most SLICES slices at a time; a larger benchmark takes more passes, each
    written before the next one."""
    df = df.drop("n_words", "spans", "items")
    sc = df.sparkSession.sparkContext
    parts = slices_of(items, item_id, item_text, window, slice_bytes) or [None]
    for k in range(0, len(parts), SLICES):
        pools = [pool_of([(r.item, r.words) for r in p.collect()] if p is not None else [], window) for p in parts[k : k + SLICES]]
        df = _scan(table(df, "scanned") if k else df, text, [sc.broadcast(p) for p in pools])
    return df


def n_hit(spans: Column) -> Column:
    """Words in the spans."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end_word"] - s["first_word"])


def without_spans(text: Column, spans: Column) -> Column:
    """The text without the bytes of its spans; null stays null."""
    raw = text.cast("binary")
    piece = lambda a, b: F.substring(raw, a + 1, b - a).cast("binary")
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["end_byte"]))
    ends = F.concat(F.transform(spans, lambda s: s["first_byte"]), F.array(F.octet_length(text).cast("long")))
    kept = F.zip_with(starts, ends, lambda a, b: piece(a.cast("int"), b.cast("int")).cast("string"))
    return F.when(F.size(spans) == 0, text).otherwise(F.array_join(kept, ""))


def decontaminate(df: DataFrame, items: DataFrame, remove: str = "spans", text: str = "text", **options) -> DataFrame:
    """`df` without contamination(): with `remove="spans"` the covered runs of
    words go from the texts, with "documents" the rows that have any. Other columns
    may have any name; `options` are contamination()'s."""
    if remove not in ("spans", "documents"):
        raise ValueError(f"remove: spans or documents, not {remove}")
    whole = df.select(F.col(text).alias("text"), F.struct(*(F.col(f"`{c}`") for c in df.columns if c != text)).alias("row"))
    found = contamination(whole, items, **options)
    if remove == "documents":
        found = found.where(F.size("spans") == 0)
    kept = without_spans(F.col("text"), F.col("spans"))
    return found.select(*((kept if c == text else F.col(f"row.`{c}`")).alias(c) for c in df.columns))
