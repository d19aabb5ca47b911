"""Alignment of two tokenizers' tokens over the same bytes by a dangling-suffix
transducer.

The transducer's state is which side leads and the bytes by which it leads (the
dangling suffix). The side that is behind takes its next token, which shortens
the suffix, uses it up, or turns the lead over to what is left of that token.
A transition depends on the state and the token alone, so each is worked out
once and kept; an empty suffix closes a group. Each transition that doesn't
open a group overlaps the token taken with the last one of the other side, so
a group of x and y tokens has x + y - 1 links.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import bpe

#: Transitions kept in a worker; a full memo is emptied.
MEMO = 2_000_000
#: Words whose walks and groups whose texts are kept in a worker, none of more
#: characters or links than LONG_WORD.
WORDS, GROUPS, LONG_WORD = 400_000, 200_000, 64
#: Characters of text that are encoded and aligned together.
CHARS = 1_000_000
#: Id pairs that are broadcast at most; more are joined by shuffle.
BROADCAST_PAIRS = 1_000_000
_WORD = re.compile(r" +[^ ]*(?:(?<=[^\S ]) +[^ ]*)*")


class PlainCodec(bpe.Codec):
    """A byte-level codec to which special tokens' strings are plain text."""

    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.cut, self.special = None, {}


def piece_bytes(model: sentencepiece.SentencePieceProcessor) -> list[bytes]:
    """The bytes of each piece: U+2581 is a space, a byte piece its byte."""
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]


class Mismatch(ValueError):
    """The bytes of the two sides differ."""


class Transducer:
    """Groups and links of two token sequences whose bytes are the same."""

    def __init__(self, a_bytes: dict[int, bytes] | list[bytes], b_bytes: dict[int, bytes] | list[bytes]) -> None:
        self.a, self.b = a_bytes, b_bytes
        self._reset()

    def _reset(self) -> None:
        #: State k > 0: side A leads by suffix[k]; -k: side B does; 0: neither.
        self.suffix: list[bytes] = [b""]
        self.number: dict[bytes, int] = {b"": 0}
        #: State and token -> state; A token and B token, from 0 -> state.
        self.memo: dict[tuple[int, int], int] = {}
        self.first: dict[int, int] = {}

    def _state(self, suffix: bytes, side: int) -> int:
        if suffix not in self.number:
            self.number[suffix] = len(self.suffix)
            self.suffix.append(suffix)
        return side * self.number[suffix]

    def move(self, state: int, token: int) -> int:
        """The state after the side that is behind (A if neither) takes `token`."""
        new = self.memo.get((state, token))
        if new is not None:
            return new
        ahead, taken = self.suffix[abs(state)], (self.b if state > 0 else self.a)[token]
        side = 1 if state > 0 else -1
        if len(taken) > len(ahead):
            ahead, taken, side = taken, ahead, -side
        if not ahead.startswith(taken):
            raise Mismatch
        new = self.memo[state, token] = self._state(ahead[len(taken) :], side)
        return new

    def _open(self, pair: int) -> int:
        """The state after both sides take a token, from the empty suffix."""
        new = self.first[pair] = self.move(self.move(0, pair >> 32), pair & 0xFFFFFFFF)
        return new

    def groups(self, a: list[int], b: list[int]) -> list[int | tuple[tuple[int, ...], tuple[int, ...]]]:
        """The groups in order: a << 32 | b for one of a token each, otherwise
        the tokens of both sides."""
        if len(self.memo) + len(self.first) >= MEMO:
            self._reset()
        known, move = self.first.get, self.move
        out: list[int | tuple[tuple[int, ...], tuple[int, ...]]] = []
        more_a, more_b = iter(a), iter(b)
        try:
            for x, y in zip(more_a, more_b, strict=True):
                pair = (x << 32) | y
                state = known(pair)
                if state is None:
                    state = self._open(pair)
                if not state:
                    out.append(pair)
                    continue
                own_a, own_b = [x], [y]
                while state:
                    if state > 0:
                        own_b.append(next(more_b))
                        state = move(state, own_b[-1])
                    else:
                        own_a.append(next(more_a))
                        state = move(state, own_a[-1])
                out.append((tuple(own_a), tuple(own_b)))
        except (StopIteration, ValueError):
            raise Mismatch from None
        return out

    def links(self, a: tuple[int, ...], b: tuple[int, ...]) -> list[int]:
        """The id pairs (a << 32 | b) of one group's overlapping tokens."""
        out: list[int] = []
        i = j = state = 0
        while i < len(a) or state:
            opens = not state
            if state > 0:
                token = b[j]
                j += 1
            else:
                token = a[i]
                i += 1
            state = self.move(state, token)
            if not opens:
                out.append((a[i - 1] << 32) | b[j - 1])
        return out


class Walk(NamedTuple):
    """A word's walk from empty suffix to empty suffix."""

    n_a: int
    n_b: int
    n_groups: int
    groups: str
    links: list[int]


class Aligner:
    """Encodes texts with a byte-level vocabulary (A, of a space and the text)
    and a piece model (B, which adds the space itself) and aligns their tokens.

    A word is spaces and what follows up to the next ones. A cuts there, but
    where other white space comes before them, and so does B if no piece of its
    has a space after another character. The suffix is then empty at the end of
    each word, whatever stands around it, so a word's walk is kept as one step;
    for a model of other pieces a text is one word."""

    def __init__(self, byte_vocabulary: str, piece_model: str) -> None:
        self.codec = PlainCodec(byte_vocabulary)
        self.model = sentencepiece.SentencePieceProcessor(model_file=piece_model)
        self.pieces = piece_bytes(self.model)
        self.space = self.model.piece_to_id("▁")
        self.by_word = self.space != self.model.unk_id() and not any(b" " in p.lstrip(b" ") for p in self.pieces)
        self.transducer = Transducer(self.codec.tokens, self.pieces)
        self.known: dict[str, Walk | None] = {}
        self.groups: dict[int | tuple, tuple[str, list[int]]] = {}

    def _walk(self, a: list[int], b: list[int]) -> Walk | None:
        """None where the tokens' bytes differ."""
        try:
            keys = self.transducer.groups(a, b)
        except Mismatch:
            return None
        text, links, known = [], [], self.groups.get
        for k in keys:
            g = known(k) or self._group(k)
            text.append(g[0])
            links += g[1]
        return Walk(len(a), len(b), len(keys), ";".join(text), links)

    def _group(self, key: int | tuple) -> tuple[str, list[int]]:
        """A group's text, and its links."""
        if isinstance(key, int):
            made = f"{key >> 32}|{key & 0xFFFFFFFF}", [key]
        else:
            made = ",".join(map(str, key[0])) + "|" + ",".join(map(str, key[1])), self.transducer.links(*key)
        if len(made[1]) <= LONG_WORD:
            if len(self.groups) >= GROUPS:
                self.groups.clear()
            self.groups[key] = made
        return made

    def _walks(self, words: set[str]) -> dict[str, Walk | None]:
        """The walks of all `words`; new ones are kept unless they are long."""
        if len(self.known) >= WORDS:
            self.known.clear()
        new = [w for w in words if w not in self.known]
        # the model adds the first space, but none to an empty text
        b_ids = self.model.encode([w[1:] for w in new], num_threads=1) if new else []
        packed = self.codec.encode_many(new)
        a_all, at = np.frombuffer(b"".join(packed), "<u4").tolist(), 0
        made: dict[str, Walk | None] = {}
        piece = self.pieces.__getitem__
        for w, p, b in zip(new, packed, b_ids, strict=True):
            b = b or [self.space]
            a, at = a_all[at : at + len(p) // 4], at + len(p) // 4
            made[w] = self._walk(a, b) if b"".join(map(piece, b)) == w.encode() else None
        self.known.update((w, v) for w, v in made.items() if len(w) <= LONG_WORD)
        return {w: made[w] if w in made else self.known[w] for w in words}

    def align(self, texts: list[str | None]) -> list[tuple[int, int, int, str, dict[int, int]]]:
        """For each text: numbers of A and B tokens and of groups, the groups'
        text, and how often each id pair (a << 32 | b) is linked."""
        split = [(_WORD.findall(" " + t) if self.by_word else [" " + t]) if t else [] for t in texts]
        walks = self._walks(set().union(*split))
        return [self._one(words, walks) for words in split]

    def _one(self, words: list[str], walks: dict[str, Walk | None]) -> tuple[int, int, int, str, dict[int, int]]:
        n_a = n_b = n_groups = 0
        links: dict[int, int] = {}
        for w, n in Counter(words).items():
            walk = walks[w]
            if walk is None:
                return 0, 0, 0, "", {}
            n_a += n * walk.n_a
            n_b += n * walk.n_b
            n_groups += n * walk.n_groups
            for pair in walk.links:
                links[pair] = links.get(pair, 0) + n
        return n_a, n_b, n_groups, ";".join([walks[w].groups for w in words]), links


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(byte_vocabulary: str, piece_model: str) -> Aligner:
    """The aligner of two vocabulary files, loaded once in each process."""
    key = byte_vocabulary, piece_model
    if key not in _ALIGNERS:
        _ALIGNERS[key] = Aligner(*key)
    return _ALIGNERS[key]


def _parts(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of about CHARS characters."""
    start = size = 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= CHARS:
            yield start, k + 1
            start, size = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


def align(df: DataFrame, byte_vocabulary: str, piece_model: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """`(id, n_a, n_b, n_groups, groups, pairs, times)` for every row of `df`.

    `groups` reads `a1,a2|b1;a3|b2,b3`: the ids of each group of A and of B.
    `pairs` are the linked id pairs (a << 32 | b) in ascending order, `times` how
    often each is linked. Null and empty texts, and texts whose joined A or B
    bytes aren't a space and the text, have no tokens: zeros, an empty `groups`
    and no pairs. Repeated rows and rows without an id are aligned each; an
    empty table gives none; other columns of `df` aren't read. A worker holds a
    million characters of text, their tokens and bounded memos.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(byte_vocabulary, piece_model)
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in _parts(texts):
                rows = both.align(texts[lo:hi])
                keys = [np.fromiter(r[4], np.int64, len(r[4])) for r in rows]
                order = [np.argsort(k) for k in keys]
                times = [np.fromiter(r[4].values(), np.int32, len(r[4])) for r in rows]
                at = pa.array(np.cumsum([0, *map(len, keys)]), pa.int32())
                flat = [np.concatenate([x[o] for x, o in zip(c, order, strict=True)]) for c in (keys, times)]
                cols = [pa.array([r[k] for r in rows], pa.string() if k == 3 else pa.int64()) for k in range(4)]
                cols += [pa.ListArray.from_arrays(at, pa.array(x)) for x in flat]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *cols], names=["id", "n_a", "n_b", "n_groups", "groups", "pairs", "times"])

    slim = df.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("t"))
    return slim.mapInArrow(run, "id long, n_a long, n_b long, n_groups long, groups string, pairs array<long>, times array<int>")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """`(pair, docs, best)`: how many rows of `aligned` link an id pair, and the
    most that any pair of its A id has. Counted with partial aggregation."""
    docs = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("docs"))
    best = docs.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("docs").alias("best"))
    return docs.join(best, F.shiftright("pair", 32) == F.col("a")).select("pair", "docs", "best")


def score_links(aligned: DataFrame, counts: DataFrame, most: int = BROADCAST_PAIRS) -> DataFrame:
    """`aligned` (with its columns `row`, of distinct values, `pairs` and `times`)
    and `n_links`, `n_best` (links whose pair has the most documents of its A
    id's pairs, ties included) and `count_sum` (documents of the pair, summed
    over links); `pairs` and `times` go.

    Up to `most` pairs are broadcast; beyond that the same join is a shuffle."""
    small = counts.count() <= most
    known = F.broadcast(counts) if small else counts
    each = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("_l")).select("row", F.col("_l.pairs").alias("pair"), F.col("_l.times").cast("long").alias("n"))
    best = F.when(F.col("docs") == F.col("best"), F.col("n")).otherwise(0)
    scores = each.join(known, "pair").groupBy("row").agg(F.sum("n").alias("n_links"), F.sum(best).alias("n_best"), F.sum(F.col("n") * F.col("docs")).alias("count_sum"))
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_links", "n_best", "count_sum")}
    return aligned.drop("pairs", "times").join(scores, "row", "left").withColumns(zero)
