"""Suffix dedup: removes bytes of long strings that an earlier document holds.

A byte goes if a 50-byte string that covers it also starts in a document of
smaller id. Every 50-byte window is filed under the least hash of its 20-byte
substrings, so equal windows share an anchor. Only anchors of two documents or
more can matter; for those the bytes around go to the anchor's block, where a
run-length index over the distinct strings is built, the strings are streamed
through it, and every window's least document comes back. Anchors of very many
chunks are no key: their windows are filed by a second anchor too, the greatest
hash, which equal windows share as well, so a common phrase's contexts spread
over all blocks.

Documents travel in chunks. A chunk sends an anchor once, however many of its
documents hold it, and a distinct string once, with the least id; so a passage
in a third of all documents makes a row a chunk, not a row a document.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.rindex import LENGTH, RunLengthIndex
from tidemark.llm.runs import bounds
from tidemark.runtime import table

GRAM = 20
#: Bytes of text in a chunk, windows of a text hashed at a time, bytes a block.
CHUNK, SEGMENT, BLOCK = 4_000_000, 32_000, 2_000_000
#: Windows in one string of an anchor at most (longer runs are cut, none lost).
RUN = 64
#: Chunks that an anchor is in above which its windows are filed by a second
#: anchor too, and bytes of these that are looked at together.
SPREAD, BATCH = 256, 1_000_000
_NONE = (1 << 63) - 1
#: Kept, because blobs are many and small.
_ZIP, _UNZIP = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(*arrays: np.ndarray) -> bytes:
    raw = [a.tobytes() for a in arrays]
    return _ZIP.compress(struct.pack(f"<{len(raw)}q", *map(len, raw)) + b"".join(raw))


def unpack(blob: bytes, *types: str) -> list[np.ndarray]:
    raw = _UNZIP.decompress(blob)
    size, at, out = struct.unpack_from(f"<{len(types)}q", raw), 8 * len(types), []
    for n, t in zip(size, types, strict=True):
        out.append(np.frombuffer(raw, t, n // np.dtype(t).itemsize, at))
        at += n
    return out


_DOCS = ("<i8", "<i8", "u1")


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    return x


def _anchors(b: np.ndarray, pick: np.ufunc = np.minimum) -> np.ndarray:
    """For each LENGTH-byte window the least hash of its GRAM-byte substrings (or
    the greatest)."""
    w = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(b, 8)).view("<u8").ravel()
    a, m, z = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
    h = _mixed(w[: len(b) - 19] * a + w[8 : len(b) - 11] * m + w[12:] * z)
    span, width = 1, LENGTH - GRAM + 1
    while 2 * span <= width:
        h = pick(h[:-span], h[span:])
        span *= 2
    rest = width - span
    return pick(h[:-rest], h[rest:]) if rest else h


def _finer(text: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows cut where their second anchor, the greatest hash, changes:
    (run, second anchor, first window, windows). Equal windows share it too."""
    size = n + LENGTH - 1
    out, i, upto = [], 0, np.cumsum(size)
    while i < len(n):
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + BATCH, side="right")))
        s, k, a = size[i:j], n[i:j], at[i:j]
        start = np.cumsum(s) - s
        own = text[np.repeat(a - start, s) + np.arange(int(s.sum()))]
        run = np.repeat(np.arange(j - i), k)
        w = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
        h = _anchors(own, np.maximum)[start[run] + w]
        first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (run[1:] != run[:-1])])
        out.append((run[first] + i, h[first], a[run[first]] + w[first], np.diff(np.r_[first, len(h)])))
        i = j
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def runs(size: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, ...]:
    """(hash, document number, first window, windows) of each run of windows of
    one document that share an anchor; windows are numbered in the whole text."""
    ends = np.cumsum(size)
    starts = ends - size
    # windows that a document's end cuts off, and the first one of each document
    edge = np.zeros(len(text) + 1, np.int8)
    np.add.at(edge, np.maximum(ends - LENGTH + 1, starts), 1)
    np.add.at(edge, ends, -1)
    whole = np.cumsum(edge[:-1], dtype=np.int8) == 0
    fresh = np.zeros(len(text), bool)
    fresh[starts[size >= LENGTH]] = True
    out: list[tuple[np.ndarray, ...]] = []
    for a in range(0, len(text), SEGMENT):
        b = text[a : a + SEGMENT + LENGTH - 1]
        if len(b) < LENGTH:
            break
        h = _anchors(b)
        ok = whole[a : a + len(h)]
        new = fresh[a : a + len(h)].copy()
        new[0] = True
        new[1:] |= (h[1:] != h[:-1]) | ~ok[:-1]
        stop = np.flatnonzero(new | ~ok)
        n = np.diff(np.r_[stop, len(h)])
        good = ok[stop]
        new, n = stop[good], n[good]
        if not len(new):
            continue
        where = np.searchsorted(ends, new + a, side="right")
        cuts = -(-n // RUN)
        first = np.repeat(new, cuts)
        k = np.arange(len(first)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        first += k * RUN
        n = np.minimum(np.repeat(n, cuts) - k * RUN, RUN)
        out.append((h[first], np.repeat(where, cuts), first + a, n))
    if not out:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z, z
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _several(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in order, and whether more than one document has each."""
    order = np.argsort(h)
    h, doc = h[order], doc[order]
    new = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
    if not len(new):
        return h, np.zeros(0, bool)
    return h[new], np.minimum.reduceat(doc, new) != np.maximum.reduceat(doc, new)


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each range, n numbers long, in one array."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents as chunk rows."""
    for b in batches:
        ids, raw, size = [], [], 0
        for i in range(b.num_rows):
            t = b.column(1)[i].as_py().encode()
            ids.append(b.column(0)[i].as_py())
            raw.append(t)
            size += len(t)
            if size >= CHUNK or i + 1 == b.num_rows:
                doc = np.array([_NONE if x is None else x for x in ids], "<i8")
                n = np.array([len(x) for x in raw], "<i8")
                blob = pack(doc, n, np.frombuffer(b"".join(raw), np.uint8))
                yield pa.RecordBatch.from_arrays([pa.array([blob], pa.binary()), pa.array([size], pa.int64())], names=["docs", "n_bytes"])
                ids, raw, size = [], [], 0


def _contexts(docs: bytes, wanted: list[bytes], blocks: int):
    """What a chunk sends: its distinct strings by block, with block, size and
    least document of each, and for every run that matters (string number,
    document number, first window, windows). The same for the same chunk and
    anchors."""
    doc, size, text = unpack(docs, *_DOCS)
    h, d, at, n = runs(size, text)
    known, several = _several(h, doc[d])
    told = [unpack(w, "<u8", "<u8") for w in wanted]
    keep = np.isin(h, np.concatenate([known[several], *(x for x, _ in told)]))
    h, d, at, n = h[keep], d[keep], at[keep], n[keep]
    hot = np.isin(h, np.concatenate([np.zeros(0, np.uint64), *(x for _, x in told)]))
    if hot.any():
        run, second, first, windows = _finer(text, at[hot], n[hot])
        cool = ~hot
        h = np.r_[h[cool], _mixed(h[hot][run] + second)]
        d, at, n = np.r_[d[cool], d[hot][run]], np.r_[at[cool], first], np.r_[n[cool], windows]
    block = (h % np.uint64(blocks)).astype(np.int64)
    order = np.argsort(block, kind="stable")
    block, d, at, n = block[order], d[order], at[order], n[order]
    raw = text.tobytes()
    # equal strings begin with the same window, so they are in one block
    number: dict[bytes, int] = {}
    stop = at + n + LENGTH - 1
    which = np.fromiter((number.setdefault(raw[s:e], len(number)) for s, e in zip(at.tolist(), stop.tolist(), strict=True)), np.int64, len(at))
    first = np.flatnonzero(np.diff(np.maximum.accumulate(which), prepend=-1))
    least = np.full(len(first), _NONE, np.int64)
    np.minimum.at(least, which, doc[d])
    return doc, size, raw, (list(number), block[first], (n + LENGTH - 1)[first], least), (which, d, at, n)


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """`(id, n_bytes, spans, kept)` for every row: its bytes in UTF-8, the
    maximal removed runs as (first, end) byte offsets, and the other bytes.

    A byte is removed if it lies in a 50-byte string of its document that also
    starts in a document of smaller id, judged on the input. A null text counts
    as empty; rows that share an id are no earlier documents of one another; a
    row without an id comes after all others; an empty table gives no rows.
    """
    source = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    chunks = source.mapInArrow(_chunks, "docs binary, n_bytes long")
    packed = table(chunks.withColumn("chunk", F.xxhash64("docs")), "chunks")
    total = packed.agg(F.sum("n_bytes")).first()[0] or 0
    blocks = max(8, total // BLOCK)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, docs in zip(b.column(0), b.column(1), strict=True):
                doc, size, raw = unpack(docs.as_py(), *_DOCS)
                h, d, _, _ = runs(size, raw)
                known, several = _several(h, doc[d])
                block = (known % np.uint64(blocks)).astype(np.int64)
                order = np.argsort(block, kind="stable")
                known, several, block = known[order], several[order], block[order]
                cut = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(block) else []
                parts = [(int(block[i]), k, s) for i, k, s in zip(cut, np.split(known, cut[1:]), np.split(several, cut[1:]), strict=True)] if len(block) else []
                blobs = [pack(k[~s].astype("<u8"), k[s].astype("<u8")) for _, k, s in parts]
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int64()), pa.array([chunk.as_py()] * len(parts), pa.int64()), pa.array(blobs, pa.binary())], names=["block", "chunk", "blob"])

    def shared(t: pa.Table) -> pa.Table:
        """For each chunk its anchors that another chunk has too, and which of
        its anchors very many have."""
        chunk = t.column("chunk").to_pylist()
        both = [unpack(x.as_py(), "<u8", "<u8") for x in t.column("blob")]
        seen, n = np.unique(np.concatenate([x for p in both for x in (p[0], p[1], p[1])]), return_counts=True)
        dup, hot = seen[n > 1], seen[n > SPREAD]
        of = lambda x, y: x[np.isin(x, y, assume_unique=True)]
        found = [(c, of(p[0], dup), of(np.r_[p[0], p[1]], hot)) for c, p in zip(chunk, both, strict=True)]
        found = [(c, x, y) for c, x, y in found if len(x) or len(y)]
        return pa.table({"chunk": pa.array([c for c, _, _ in found], pa.int64()), "blob": pa.array([pack(x, y) for _, x, y in found], pa.binary())})

    wide = packed.select("chunk", "docs").mapInArrow(anchors, "block long, chunk long, blob binary")
    survivors = table(wide.groupBy("block").applyInArrow(shared, "chunk long, blob binary"), "anchors")

    def send(docs: pa.Table, wanted: pa.Table) -> pa.Table:
        out: dict[str, list] = {"block": [], "chunk": [], "blob": []}
        for chunk in docs.column("chunk").to_pylist()[:1]:
            strings, block, size, least = _contexts(docs.column("docs")[0].as_py(), wanted.column("blob").to_pylist(), blocks)[3]
            start, count = bounds(block)
            for i, j in zip(start.tolist(), (start + count).tolist(), strict=True):
                out["block"].append(int(block[i]))
                out["chunk"].append(chunk)
                out["blob"].append(pack(least[i:j].astype("<i8"), size[i:j].astype("u1"), np.frombuffer(b"".join(strings[i:j]), np.uint8)))
        return pa.table(out, schema=pa.schema([("block", pa.int64()), ("chunk", pa.int64()), ("blob", pa.binary())]))

    def look_up(t: pa.Table) -> pa.Table:
        """The least document of every window of every string of a block."""
        number: dict[bytes, int] = {}
        owner, lists = [], []
        for x in t.column("blob"):
            own, size, raw = unpack(x.as_py(), "<i8", "u1", "u1")
            raw, stop = raw.tobytes(), np.cumsum(size, dtype=np.int64)
            lists.append(np.fromiter((number.setdefault(raw[s:e], len(number)) for s, e in zip((stop - size).tolist(), stop.tolist(), strict=True)), np.int64, len(size)))
            owner.append(own)
        least = np.full(len(number), _NONE, np.int64)
        np.minimum.at(least, np.concatenate(lists), np.concatenate(owner))
        index = RunLengthIndex(list(number), least, LENGTH + 1)
        found, n = index.windows(), index.size - LENGTH + 1
        start = np.cumsum(n) - n
        back = [pack(found[_ranges(start[k], n[k])].astype("<i8")) for k in lists]
        return pa.table({"chunk": t.column("chunk"), "block": t.column("block"), "blob": pa.array(back, pa.binary())})

    by_chunk = packed.select("chunk", "docs").groupBy("chunk")
    sent = by_chunk.cogroup(survivors.groupBy("chunk")).applyInArrow(send, "block long, chunk long, blob binary")
    found = sent.groupBy("block").applyInArrow(look_up, "chunk long, block long, blob binary")
    replies = survivors.select("chunk", F.lit(-1).cast("long").alias("block"), "blob").unionByName(found)

    def apply(docs: pa.Table, told: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        back = sorted(zip(told.column("block").to_pylist(), told.column("blob").to_pylist(), strict=True), key=lambda x: x[0]) if told.num_rows else []
        wanted = [x for b, x in back if b < 0]
        for blob in docs.column("docs").to_pylist():
            doc, size, raw, (_, _, long, _), (which, d, at, n) = _contexts(blob, wanted, blocks)
            # windows that an earlier document has
            hit = np.zeros(len(raw) + LENGTH, bool)
            if len(which):
                least = np.concatenate([unpack(x, "<i8")[0] for b, x in back if b >= 0])
                start = np.cumsum(long - LENGTH + 1) - (long - LENGTH + 1)
                hit[_ranges(at, n)] = least[_ranges(start[which], n)] < np.repeat(doc[d], n)
            covered = np.cumsum(hit, dtype=np.int32)
            covered[LENGTH:] -= covered[:-LENGTH].copy()
            covered = covered[: len(raw)] > 0
            text, end = np.frombuffer(raw, np.uint8), 0
            for i, m in zip(doc.tolist(), size.tolist(), strict=True):
                c = covered[end : end + m]
                edge = np.flatnonzero(np.diff(np.r_[False, c, False].astype(np.int8)))
                spans = [{"first": int(x), "end": int(y)} for x, y in edge.reshape(-1, 2)]
                rows.append((None if i == _NONE else i, m, spans, text[end : end + m][~c].tobytes()))
                end += m
        span = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
        cols = list(zip(*rows, strict=True)) or [[], [], [], []]
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), span, pa.binary()), strict=True)], names=["id", "n_bytes", "spans", "kept"])

    return by_chunk.cogroup(replies.groupBy("chunk")).applyInArrow(apply, "id long, n_bytes long, spans array<struct<first:long,end:long>>, kept binary")
