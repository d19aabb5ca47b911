"""Byte-pair encoding and decoding with a segment tree over adjacent pair ranks."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Public pre-tokenisation pattern of byte-level vocabularies (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Encoded pieces kept in a worker; the cache is emptied when it is full.
CACHE_PIECES = 400_000
#: Characters of text whose new pieces are merged together.
GROUP_CHARS = 2_000_000
#: Pieces of up to so many bytes are merged many at a time, longer ones alone.
SHORT = 64
#: Pieces merged at a time.
MANY = 8_000


def _byte_chars() -> dict[int, str]:
    """Byte -> the printable character that stands for it in the vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def merge_piece(ids: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """`ids` after all merges, each time the leftmost pair of lowest rank.

    A segment tree holds, for every position, rank * n + position of the pair
    that begins there (or infinity); its root is the next merge. A merge changes
    three leaves, each in logarithmic time, until the root is infinite.
    """
    n = len(ids)
    if n < 2:
        return ids
    size = 1 << (n - 1).bit_length()
    none = 1 << 62
    tree = [none] * (2 * size)
    sym, left, right = list(ids), list(range(-1, n - 1)), list(range(1, n + 1))
    for i in range(n - 1):
        m = merges.get((sym[i], sym[i + 1]))
        if m is not None:
            tree[size + i] = m[0] * n + i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b

    def put(i: int, value: int) -> None:
        k = size + i
        tree[k] = value
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            v = a if a < b else b
            if tree[k] == v:
                break
            tree[k] = v
            k >>= 1

    while tree[1] != none:
        i = tree[1] % n
        j = right[i]
        sym[i] = merges[sym[i], sym[j]][1]
        k = right[j]
        right[i] = k
        if k < n:
            left[k] = i
        put(j, none)
        m = merges.get((sym[i], sym[k])) if k < n else None
        put(i, none if m is None else m[0] * n + i)
        h = left[i]
        if h >= 0:
            m = merges.get((sym[h], sym[i]))
            put(h, none if m is None else m[0] * n + h)
    out, i = [], 0
    while i < n:
        out.append(sym[i])
        i = right[i]
    return out


class PairTable:
    """Ranks and results of merges, looked up for many pairs at once."""

    def __init__(self, merges: dict[tuple[int, int], tuple[int, int]]) -> None:
        keys = np.array([(a << 32) | b for a, b in merges], np.int64)
        rank = np.array([r for r, _ in merges.values()], np.int64)
        order = np.argsort(keys)
        self.keys, self.rank = np.append(keys[order], np.int64(1 << 62)), np.append(rank[order], 0)
        self.made = np.zeros(len(merges), np.int32)
        self.made[rank] = [m for _, m in merges.values()]

    def find(self, a: np.ndarray, b: np.ndarray, shift: int, at: np.ndarray) -> np.ndarray:
        """rank << shift | at for each pair, or _NONE."""
        want = (a.astype(np.int64) << 32) | (b.astype(np.int64) & 0xFFFFFFFF)
        i = np.searchsorted(self.keys, want)
        return np.where(self.keys[i] == want, (self.rank[i] << shift) | at, _NONE).astype(np.int32)


_NONE = np.int32(2**31 - 1)


def merge_many(ids: np.ndarray, start: np.ndarray, n: np.ndarray, width: int, pairs: PairTable) -> list[bytes]:
    """merge_piece() of many pieces, ids[start : start + n] each, of at most
    `width` (a power of two) ids, with one segment tree for each, all advanced
    one merge at a time."""
    shift, m = width.bit_length() - 1, len(n)
    inside = np.arange(width) < n[:, None]
    sym = np.full((m, width + 1), -1, np.int32)
    sym[:, :width][inside] = ids[(start[:, None] + np.arange(width))[inside]]
    right = np.tile(np.arange(1, width + 2, dtype=np.int32), (m, 1))
    right[np.arange(m), n - 1] = width
    left = np.tile(np.arange(-1, width, dtype=np.int32), (m, 1))
    alive = inside.copy()
    tree = np.full((m, 2 * width), _NONE, np.int32)
    tree[:, width:] = pairs.find(sym[:, :-1], sym[:, 1:], shift, np.arange(width))
    for level in range(shift - 1, -1, -1):
        lo = 1 << level
        tree[:, lo : 2 * lo] = np.minimum(tree[:, 2 * lo : 4 * lo : 2], tree[:, 2 * lo + 1 : 4 * lo : 2])
    row = np.flatnonzero(tree[:, 1] != _NONE)
    while len(row):
        root = tree[row, 1]
        i = root & (width - 1)
        new = pairs.made[root >> shift]
        j = right[row, i]
        k = right[row, j]
        sym[row, i] = new
        right[row, i] = k
        left[row, k] = i
        alive[row, j] = False
        tree[row, width + j] = _NONE
        tree[row, width + i] = pairs.find(new, sym[row, k], shift, i)
        h = left[row, i]
        has = h >= 0
        r, g = row[has], h[has]
        tree[r, width + g] = pairs.find(sym[r, g], new[has], shift, g)
        for leaf, rows in ((j, row), (i, row), (g, r)):
            at = (width + leaf) >> 1
            while at.size and at[0]:
                tree[rows, at] = np.minimum(tree[rows, 2 * at], tree[rows, 2 * at + 1])
                at >>= 1
        row = row[tree[row, 1] != _NONE]
    flat = sym[:, :width][alive].astype("<u4").tobytes()
    ends = np.cumsum(alive.sum(axis=1)) * 4
    return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


class Codec:
    """Encoder and decoder of one byte-level vocabulary file (JSON form)."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, chars = spec["model"]["vocab"], _byte_chars()
        back = {c: b for b, c in chars.items()}
        self.byte_ids = np.array([vocab[chars[b]] for b in range(256)], np.int32)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.pairs = PairTable(self.merges)
        self.tokens: dict[int, bytes] = {i: bytes(back[c] for c in t) for t, i in vocab.items() if t not in added}
        self.tokens |= {i: t.encode() for t, i in added.items()}
        self.special = {t: np.array([i], "<u4").tobytes() for t, i in added.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.mark = os.path.commonprefix(list(added))
        self.pieces = regex.compile(PATTERN)
        self.cache: dict[str, bytes] = {}

    def _merged(self, new: list[str]) -> dict[str, bytes]:
        """The packed ids of pieces that aren't in the cache."""
        raw = [p.encode() for p in new]
        n = np.fromiter(map(len, raw), np.int64, len(raw))
        start = np.cumsum(n) - n
        ids = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        out: dict[str, bytes] = {}
        for k in np.flatnonzero(n > SHORT).tolist():
            own = ids[start[k] : start[k] + n[k]].tolist()
            out[new[k]] = np.array(merge_piece(own, self.merges), "<u4").tobytes()
        least, width = 0, 2
        while width <= SHORT:
            some = np.flatnonzero((n > least) & (n <= width))
            for k in range(0, len(some), MANY):
                part = some[k : k + MANY]
                made = merge_many(ids, start[part], n[part], width, self.pairs)
                out.update(zip(map(new.__getitem__, part.tolist()), made, strict=True))
            least, width = width, 2 * width
        return out

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.cache) >= CACHE_PIECES:
            self.cache.clear()
        split = []
        for t in texts:
            found: list[str] = []
            for part in self.cut.split(t) if self.cut and self.mark in t else (t,):
                found += [part] if part in self.special else self.pieces.findall(part)
            split.append(found)
        new = set().union(*split) - self.cache.keys() - self.special.keys()
        made = self._merged(list(new)) | self.special
        self.cache.update((p, v) for p, v in made.items() if len(p) <= SHORT)
        if any(len(p) > SHORT for p in made):
            return [b"".join([made[p] if len(p) > SHORT else self.cache[p] for p in found]) for found in split]
        return [b"".join(map(self.cache.__getitem__, found)) for found in split]

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]

    def decode(self, packed: bytes) -> str:
        """Text of packed ids; bytes that are no UTF-8 become U+FFFD, ids that
        are not in the vocabulary are left out."""
        tokens, ids = self.tokens, np.frombuffer(packed, "<u4").tolist()
        try:
            out = b"".join([tokens[i] for i in ids])
        except KeyError:
            out = b"".join([tokens.get(i, b"") for i in ids])
        return out.decode("utf-8", "replace")


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The codec of a vocabulary file, loaded once in each process."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def _groups(column: pa.Array) -> Iterator[list]:
    """Values of a column, in lists of about GROUP_CHARS characters."""
    group, size = [], 0
    for v in column:
        v = v.as_py()
        group.append(v)
        size += len(v or "")
        if size >= GROUP_CHARS:
            yield group
            group, size = [], 0
    if group:
        yield group


def _mapped(df: DataFrame, source: str, new: tuple[tuple[str, str, pa.DataType], ...], rows_of) -> DataFrame:
    """`df` with columns computed from `source` by rows_of(), group by group."""
    names = [n for n, _, _ in new]
    df = df.drop(*[n for n in names if n != source])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = rows_of()
        for b in batches:
            at = 0
            for group in _groups(b.column(source)):
                part = b.slice(at, len(group))
                at += len(group)
                made = [pa.array(c, t) for c, (_, _, t) in zip(f(group), new, strict=True)]
                kept = {n: part.column(n) for n in b.schema.names} | dict(zip(names, made, strict=True))
                yield pa.RecordBatch.from_arrays(list(kept.values()), names=list(kept))

    fields = {f.name: f.dataType.simpleString() for f in df.schema} | {n: t for n, t, _ in new}
    return df.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in fields.items()))


def encode(df: DataFrame, path: str, text: str = "text", packed: str = "ids_le", n: str = "n_tokens") -> DataFrame:
    """`df` with the ids of `text` packed as little-endian unsigned 32-bit
    integers, and their number. Null counts as the empty text (no ids); columns
    of these names are replaced; all rows, repeats included, are kept; an empty
    table stays empty.

    A text is cut at the vocabulary's special tokens, then into pieces; each
    piece that the worker's bounded cache lacks is merged. Only whole rows are
    in memory, a batch at a time."""

    def rows_of():
        c = codec(path)

        def f(texts):
            ids = c.encode_many([t or "" for t in texts])
            return ids, [len(x) // 4 for x in ids]

        return f

    return _mapped(df, text, ((packed, "binary", pa.binary()), (n, "bigint", pa.int64())), rows_of)


def decode(df: DataFrame, path: str, packed: str = "ids_le", text: str = "decoded") -> DataFrame:
    """`df` with the text that packed ids stand for; null counts as no ids."""

    def rows_of():
        c = codec(path)
        return lambda ids: ([c.decode(x or b"") for x in ids],)

    return _mapped(df, packed, ((text, "string", pa.string()),), rows_of)


def encode_decode(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """encode() then decode() in one Python pass: `ids_le`, `n_tokens`, `decoded`."""

    def rows_of():
        c = codec(path)

        def f(texts):
            ids = c.encode_many([t or "" for t in texts])
            return ids, [len(x) // 4 for x in ids], [c.decode(x) for x in ids]

        return f

    return _mapped(df, text, (("ids_le", "binary", pa.binary()), ("n_tokens", "bigint", pa.int64()), ("decoded", "string", pa.string())), rows_of)
