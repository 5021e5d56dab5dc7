"""Suffix sorting by induction, in memory but for its text and queues.

In an alphabet of bytes the priority queue of external induced sorting, keyed by (first character, order of arrival), is
one first-in-first-out queue per character: induction reaches characters in order and appends in order. Each entry is a
suffix and its common-prefix value with the entry before it; entries move in whole arrays, and beyond a memory budget a
queue's arrays go to an unnamed file of the task (private scratch: it has no name, no other task reads it, and it ends
with the task). A text beyond a quarter of the budget is memory-mapped from such a file. Types, run lengths, rolling
hashes and results are plain arrays in memory, in proportion to the text: the caller bounds them by the size of its shards.

Common-prefix values are induced too: two entries of one queue that come from sources u < v share one character more
than the minimum over the sources in (u, v]. They stop at `cap`, the length that the caller asks about.

The suffixes that start inductions (a smaller-type suffix after a larger one) are sorted by inducing their substrings,
naming them and sorting the names' string; that string's alphabet is large, so it is sorted by doubling, to the depth
that `cap` needs. Suffixes equal in their first `cap` characters are in no particular order.
"""

from __future__ import annotations

import tempfile

import numpy as np

from .common import BYTE, Rolling, mix

#: Bytes that the queues of one sort hold in memory before they go to disk.
BUDGET = 96 << 20


def scratch(n: int, kind: type, budget: int = BUDGET) -> np.ndarray:
    """An array in memory, or in an unnamed file if it is large."""
    if n * np.dtype(kind).itemsize <= budget // 4:
        return np.empty(n, kind)
    return np.memmap(tempfile.TemporaryFile(), kind, "w+", shape=(n,))


class Queues:
    """A queue of (suffix, common prefix with the entry before) per character."""

    def __init__(self, budget: int = BUDGET):
        self.parts: dict[int, list] = {}
        self.budget, self.held, self.file = budget, 0, None

    def push(self, char: int, at: np.ndarray, lcp: np.ndarray) -> None:
        self.parts.setdefault(char, []).append((at, lcp))
        self.held += at.nbytes + lcp.nbytes
        if self.held > self.budget:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        for parts in self.parts.values():
            for i, part in enumerate(parts):
                if len(part) == 2:
                    self.file.seek(0, 2)
                    start = self.file.tell()
                    for x in part:
                        self.file.write(np.ascontiguousarray(x).data)
                    parts[i] = (start, len(part[0]), part[0].dtype, None)
        self.held = 0

    def pop(self, char: int) -> tuple[np.ndarray, np.ndarray]:
        """All entries of a character, in order; a part's first value refers to the part before."""
        ats, lcps = [], []
        for part in self.parts.pop(char, []):
            if len(part) == 4:
                start, n, kind, _ = part
                self.file.seek(start)
                raw = self.file.read(n * (kind.itemsize + 1))
                part = np.frombuffer(raw, kind, n), np.frombuffer(raw, np.uint8, n, n * kind.itemsize)
            else:
                self.held -= part[0].nbytes + part[1].nbytes
            ats.append(part[0]), lcps.append(part[1])
        if not ats:
            return np.zeros(0, np.int64), np.zeros(0, np.uint8)
        return np.concatenate(ats), np.concatenate(lcps)

    def last(self, char: int) -> bool:
        return char in self.parts


def _range_min(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """min(values[low:high + 1]) for each pair, low <= high."""
    out = np.empty(len(low), values.dtype)
    width = high - low + 1
    level = np.frexp(width.astype(np.float64))[1] - 1
    table, step = values, 1
    for k in range(int(level.max(initial=-1)) + 1):
        who = np.flatnonzero(level == k)
        out[who] = np.minimum(table[low[who]], table[high[who] - step + 1])
        if len(table) > step:
            table = np.minimum(table[:-step], table[step:])
        step *= 2
    return out


class SuffixSort:
    """Order and common-prefix values (up to cap) of the suffixes of `text`, an array of characters 1..., each under 1000.

    A character 0 ends the text. Equal characters of any kind match; a caller that joins strings cuts the values at
    their ends.
    """

    def __init__(self, text: np.ndarray, cap: int, budget: int = BUDGET):
        if cap > 255:
            raise ValueError("common prefixes are counted up to 255")
        self.cap, self.budget, n = cap, budget, len(text) + 1
        self.text = scratch(n, np.int16, budget)
        self.text[:-1], self.text[-1] = text, 0
        turn = np.flatnonzero(np.diff(self.text)) + 1  # starts of runs
        ends = np.concatenate([turn, [n]])
        starts = np.concatenate([[0], turn])
        small = np.zeros(len(starts), bool)  # type of each run by the character after it; the end mark is small
        small[:-1] = self.text[starts[:-1]] < self.text[starts[1:]]
        small[-1] = True
        self.small = np.repeat(small, ends - starts)
        self.run = np.minimum(np.repeat(ends, ends - starts) - np.arange(n), 255).astype(np.uint8)
        seeds = np.flatnonzero(self.small[1:] & ~self.small[:-1]) + 1
        self.kind = np.int64 if n >= 1 << 31 else np.int32
        self.seeds = seeds.astype(self.kind)
        self.chars = np.unique(self.text)

    def sort(self) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(self.text[self.seeds], kind="stable")
        start = self.seeds[order]
        first, _ = self._induce(start, np.zeros(len(start), np.uint8), True)
        ranked = self._rank(first)
        return self._induce(ranked, self._prefixes(ranked), False)

    # -- induction --

    def _spread(self, queues: Queues, at: np.ndarray, lcp: np.ndarray, small: bool, char: int, seen: dict[int, int]) -> np.ndarray:
        """Push the predecessors of sorted suffixes of one character; those of that same character are returned by index.

        seen: per target, the least common prefix since its last source among this character's earlier parts.
        """
        before = at - 1
        ok = np.flatnonzero((at > 0) & (self.small[before] == small))
        if not len(ok):
            for t in seen:
                seen[t] = min(seen[t], int(lcp.min(initial=255)))
            return ok
        to = self.text[before[ok]]
        by = np.argsort(to, kind="stable")
        ok, to = ok[by], to[by]
        cuts = np.flatnonzero(np.diff(to)) + 1
        starts = np.concatenate([[0], cuts])
        value = np.empty(len(ok), np.uint8)
        inner = np.ones(len(ok), bool)
        inner[starts] = False
        inside = np.flatnonzero(inner)
        value[inside] = _range_min(lcp, ok[inside - 1] + 1, ok[inside])
        for s in starts:  # against the last source of an earlier part of this bucket, if there is one
            last = seen.get(int(to[s]))
            value[s] = lcp[: ok[s] + 1].min() if last is not None else 0
            if last is not None:
                value[s] = min(value[s], last)
        value = np.minimum(value, self.cap - 1) + np.uint8(1)
        value[starts[[not queues.last(int(to[s])) and int(to[s]) != char for s in starts]]] = 0
        ends = np.concatenate([cuts, [len(ok)]])
        same = ok[:0]
        for t in list(seen):
            seen[t] = min(seen[t], int(lcp.min(initial=255)))
        for s, e in zip(starts, ends):
            t = int(to[s])
            tail = lcp[ok[e - 1] + 1 :]
            seen[t] = int(tail.min(initial=255))
            if t == char:
                same, self._same = ok[s:e], value[s:e]
            else:
                queues.push(t, before[ok[s:e]], value[s:e])
        return before[same] if len(same) else same

    def _pass(self, given: dict[int, tuple[np.ndarray, np.ndarray]], small: bool) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """One direction: `given` are the sorted suffixes of the other type (per character, in the order of this pass)."""
        queues, made = Queues(self.budget), {}
        for char in self.chars[::-1] if small else self.chars:
            char = int(char)
            at, lcp = queues.pop(char)
            ats, lcps, seen = [], [], {}
            while len(at):
                ats.append(at), lcps.append(lcp)
                at = self._spread(queues, at, lcp, small, char, seen)
                if len(at):
                    lcp = self._same.copy()
                    lcp[0] = min(self.cap, len(ats))  # the last of a run of w characters, then one of w + 1
            if ats:
                made[char] = np.concatenate(ats), np.concatenate(lcps)
            if char in given:
                at, lcp = given[char]
                lcp = lcp.copy()
                if ats and len(at):
                    lcp[0] = min(self.cap, self.run[ats[-1][-1]], self.run[at[0]])
                self._spread(queues, at, lcp, small, char, seen)
        return made

    def _induce(self, seeds: np.ndarray, lcp: np.ndarray, only_seeds: bool) -> tuple[np.ndarray, np.ndarray]:
        heads = self.text[seeds]
        cuts = np.flatnonzero(np.diff(heads)) + 1
        given = {}
        for s, e in zip([0, *cuts], [*cuts, len(seeds)]):
            if e > s:
                given[int(heads[s])] = seeds[s:e], np.concatenate([[np.uint8(0)], lcp[s + 1 : e]])
        large = self._pass(given, False)
        back = {c: (at[::-1], np.concatenate([[np.uint8(0)], v[1:][::-1]])) for c, (at, v) in large.items()}
        end = np.array([len(self.text) - 1], self.kind)
        small = self._pass(back, True)
        order, values = [end], [np.zeros(1, np.uint8)]
        for char in self.chars:
            char = int(char)
            parts = []
            if char in large and not only_seeds:
                parts.append(large[char])
            if char in small:
                at, v = small[char]
                parts.append((at[::-1], np.concatenate([[np.uint8(0)], v[1:][::-1]])))
            for i, (at, v) in enumerate(parts):
                v = v.copy()
                v[0] = min(self.cap, self.run[parts[0][0][-1]], self.run[at[0]]) if i else 0
                order.append(at), values.append(v)
        order, values = np.concatenate(order), np.concatenate(values)
        if only_seeds:
            mark = np.zeros(len(self.text), bool)
            mark[self.seeds] = True
            mark[-1] = True
            keep = mark[order]
            return order[keep], values[keep]
        return order, values

    # -- the string of names --

    def _rank(self, first: np.ndarray) -> np.ndarray:
        """Seeds in suffix order, from the order of their substrings."""
        inside = first[first < len(self.text) - 1]
        if len(inside) < 2:
            return np.concatenate([self.seeds[-1:], inside])
        ends = np.concatenate([self.seeds[1:], [len(self.text) - 1]])
        place = np.searchsorted(self.seeds, inside)
        until = np.minimum(ends[place] + 1, len(self.text))
        rolling = Rolling16(self.text)
        name = rolling.spans(inside, until)
        fresh = np.ones(len(inside), bool)
        fresh[1:] = name[1:] != name[:-1]
        rank = np.zeros(len(self.seeds), np.int64)  # the end mark comes first
        rank[place] = np.cumsum(fresh)
        step, count = 1, int(fresh.sum()) + 1
        while count < len(rank) and step < 2 * self.cap:
            later = np.zeros(len(rank), np.int64)
            later[:-step] = rank[step:] if step < len(rank) else 0
            both = rank * (len(rank) + 2) + later
            order = np.argsort(both, kind="stable")
            fresh = np.ones(len(rank), bool)
            fresh[1:] = np.diff(both[order]) != 0
            rank = np.empty(len(rank), np.int64)
            rank[order] = np.cumsum(fresh)
            step, count = step * 2, int(fresh.sum())
        return self.seeds[np.argsort(rank, kind="stable")]

    def _prefixes(self, order: np.ndarray) -> np.ndarray:
        """Common prefixes of neighbours among sorted seeds, by binary search over rolling hashes."""
        out = np.zeros(len(order), np.uint8)
        if len(order) < 2:
            return out
        rolling = Rolling16(self.text)
        a, b = order[:-1].astype(np.int64), order[1:].astype(np.int64)
        most = np.minimum(self.cap, len(self.text) - np.maximum(a, b))
        low, high = np.zeros(len(a), np.int64), most
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = rolling.spans(a, a + mid) == rolling.spans(b, b + mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        out[1:] = low
        return out


class Rolling16(Rolling):
    """Rolling hashes over characters beyond a byte."""

    def __init__(self, text: np.ndarray):
        from .common import powers

        self.sums = np.zeros(len(text) + 1, np.uint64)
        np.cumsum(mix(np.arange(1, 1001, dtype=np.uint64) * BYTE[7])[text] * powers(len(text) + 1)[:-1], out=self.sums[1:])
