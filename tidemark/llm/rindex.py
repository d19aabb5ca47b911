"""A run-length index: the Burrows-Wheeler transform of a set of byte strings,
kept as runs, with text positions sampled at run ends."""

from __future__ import annotations

import numpy as np

#: Symbols that a matching statistic counts up to.
LENGTH = 50
_FIRST = 7
#: Three ranks make one sort key as long as they are below this.
_TOP = 1 << 63


def _refine(order: np.ndarray, rank: np.ndarray, at: np.ndarray, k: int, times: int) -> np.ndarray:
    """Sorts ties (places `at`) by the ranks k, 2k, ... symbols on; returns what
    still ties."""
    n = len(rank)
    s = order[at]
    key = rank[s].astype(np.int64)
    for j in range(1, times):
        nxt = s + j * k
        key = key * (n + 1) + np.where(nxt < n, rank[np.minimum(nxt, n - 1)] + 1, 0)
    perm = np.argsort(key)
    s, key = s[perm], key[perm]
    order[at] = s
    new = np.r_[True, key[1:] != key[:-1]]
    first = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
    rank[s] = at[first]
    alone = new & np.r_[new[1:], True]
    return at[~alone]


def _head(text: np.ndarray) -> np.ndarray:
    """The first _FIRST symbols of every suffix as one number."""
    one = text.astype(np.int64)

    def then(x: np.ndarray, k: int, y: np.ndarray, more: int) -> np.ndarray:
        x = x * 258**more
        x[: max(len(x) - k, 0)] += y[k:]
        return x

    three = then(then(one, 1, one, 1), 2, one, 1)
    return then(then(three, 3, three, 3), 6, one, 1)


class RunLengthIndex:
    """Index of strings, each with a value; `least` finds for every LENGTH-byte
    window of a member string the least value of a string that holds it."""

    def __init__(self, strings: list[bytes], values: np.ndarray, depth: int | None = None) -> None:
        """With `depth` suffixes are put in order by that many symbols at least,
        or up to the end of their string, and no further; LENGTH + 1 is enough for
        `least`, as every step begins at the first suffix that agrees on LENGTH,
        and those are told from a suffix that ends sooner before its end;
        `locate` needs the whole order."""
        size = np.fromiter(map(len, strings), np.int64, len(strings))
        self.start = np.cumsum(size + 1) - size - 1
        # bytes count from 2, a string ends with 1 and the text with 0
        text = np.frombuffer(b"\0".join(strings) + b"\0\0", np.uint8).astype(np.int16) + np.int16(2)
        text[self.start + size] = 1
        text[-1] = 0
        self.n = n = len(text)
        key = _head(text)
        order = np.argsort(key)
        new = np.r_[True, np.diff(key[order]) != 0]
        rank = np.empty(n, np.int32)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n, dtype=np.int32), 0))
        ties, k, half = np.flatnonzero(~(new & np.r_[new[1:], True])), _FIRST, None
        times = 3 if (n + 1) ** 3 < _TOP else 2
        if depth is not None:
            left = np.append(np.repeat(self.start + size, size + 1), n - 1) - np.arange(n)
        while True:
            if depth is not None:
                ties = ties[left[order[ties]] >= k]
            done = not len(ties) or (depth is not None and k >= depth)
            if half is None and (done or k * times > LENGTH):
                half, width = rank if done else rank.copy(), k
            if done:
                break
            ties = _refine(order, rank, ties, k, times)
            k *= times
        bwt = text[order - 1]
        first = np.flatnonzero(np.r_[True, bwt[1:] != bwt[:-1]])
        head, length = bwt[first], np.diff(np.r_[first, n])
        #: positions of the last suffix of each run, and where the runs end
        self.run_ends, self.samples = first + length - 1, order[first + length - 1]
        count = np.bincount(text, minlength=258)
        self.below = np.cumsum(count) - count
        by = np.argsort(head, kind="stable")
        self.run_start, self.run_len, self.head = first[by], length[by], head[by].astype(np.int64)
        self.keys = self.head * (n + 1) + self.run_start
        self.before = np.cumsum(self.run_len) - self.run_len - self.below[self.head]
        # places whose suffixes agree on LENGTH symbols, and their least value
        other = np.zeros(n, bool)
        other[0] = True
        for shift in {*range(0, LENGTH - width, width), LENGTH - width}:
            part = half[np.minimum(order + shift, n - 1)]
            other[1:] |= part[1:] != part[:-1]
        self.groups = np.flatnonzero(other)
        #: the group of every place
        self.group = np.cumsum(other, dtype=np.int32) - np.int32(1)
        own = np.repeat(values, size + 1)
        self.group_least = np.minimum.reduceat(np.r_[own, own[-1]][order], self.groups)
        #: each string, its length, and the place of its last window
        self.text, self.size, self.last = text, size, rank[self.start + size - LENGTH]

    def step(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Backward step: where suffixes symbol + (those from `place` on) begin."""
        i = np.searchsorted(self.keys, symbol * (self.n + 1) + place) - 1
        own = (i >= 0) & (self.head[np.maximum(i, 0)] == symbol)
        i = np.maximum(i, 0)
        seen = self.before[i] + np.minimum(place - self.run_start[i], self.run_len[i])
        return self.below[symbol] + np.where(own, seen, 0)

    def locate(self, place: int) -> int:
        """Text position of the suffix at a place, from the next sampled run end."""
        steps, at = 0, place
        while True:
            r = int(np.searchsorted(self.run_ends, at))
            if self.run_ends[r] == at:
                return int(self.samples[r] + steps) % self.n
            by = int(np.flatnonzero(self.run_start + self.run_len - 1 == self.run_ends[r])[0])
            at = int(self.step(self.head[by : by + 1], np.array([at]))[0])
            steps += 1

    def least(self) -> list[np.ndarray]:
        """For each string the least value at each of its windows."""
        return np.split(self.windows(), np.cumsum(self.size - LENGTH + 1)[:-1])

    def windows(self) -> np.ndarray:
        """The least value at each window of each string, one after another.

        Strings are streamed backwards, all together, from their last windows,
        whose places are sampled. The place held is the first of the suffixes
        that match the LENGTH bytes read last; the byte that a step adds pushes
        out the oldest one by moving to the first suffix that agrees on LENGTH."""
        windows = self.size - LENGTH + 1
        end = np.cumsum(windows)
        out = np.empty(int(windows.sum()), np.int64)
        by = np.argsort(-windows, kind="stable")
        count, put, read = windows[by], end[by] - 1, (self.start + self.size - LENGTH)[by]
        place = self.last[by]
        for t in range(int(count[0]) if len(count) else 0):
            m = int(np.searchsorted(-count, -(t + 1), side="right"))
            place, put, read = place[:m], put[:m], read[:m]
            if t:
                place = self.step(self.text[read - t].astype(np.int64), place)
            g = self.group[place]
            out[put - t] = self.group_least[g]
            place = self.groups[g]
        return out
