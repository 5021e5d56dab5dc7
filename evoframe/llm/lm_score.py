"""Language-model scoring with an Elias-Fano trie of words, pairs and triples.

Level 1 holds every training token: its 64-bit hash in an Elias-Fano sequence, its exact count and its backoff weight.
Level 2 holds the successors of each token, level 3 those of each pair. A level is one monotone sequence: the successors'
hashes (32 bits, then 24) are sorted inside their context, and each context counts on from the last value of the one
before. Pointers, an Elias-Fano sequence without low bits, give a context's range; a successor is searched in that range,
relative to the value before it. Probabilities and backoff weights have 8 bits, rounded down.

    p(w | u v) = max(n(u, v, w) - d, 0) / n(u, v) + b(u, v) * p(w | v)          interpolated absolute discounting
    p(w | v)   = max(n(v, w) - d, 0) / n(v)       + b(v) * p(w)
    p(w)       = (n(w) + a) / (N + a (V + 1)), the base model

b is what the held probabilities of a context leave of 1, so the probabilities after any context add up to 1 at most.
Nothing is cut: n-grams seen once are held. Two successors of one context whose hashes agree count as one.

Counting: each task counts the triples of its texts (a text's end is padded, so that pairs and tokens are sums of triples)
in sorted runs, and sends one compressed block for each shard of the first word's hash; a shard merges its blocks. So a
frequent triple is one entry for each task. Each shard's levels are one file in the shared folder, memory-mapped by the
tasks that score, a bounded number at a time: memory use does not grow with the model, and a lost executor's work is
written again under the same name. The shared folder (spark.checkpoint.dir) has to be mounted on every machine; a folder
that only Spark reaches raises an error.

Cases: null text is empty and has only the end token; very long texts are scored in one piece; ties and repeated rows
count as often as they stand; an empty table or training set gives N = V = 0; rows with a null id are held in training
(the crc32 of null is null and counts as not held out); other columns are ignored, and kept ones that are named like
results are replaced.
"""

from __future__ import annotations

import mmap
import os
import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, returning, text_slices, utf8
from .ngram_join import word_hashes

U64 = np.uint64
END = U64(0x5EED0E0DF00DCAFE)
LOG_STEP = 1 / 24  # log10 units of a quantised probability or weight

#: 1 and 128 in each byte; the places of the set bits of each byte, 8 for each.
EACH, TOPS = U64(0x0101010101010101), U64(0x8080808080808080)
PLACES = np.array([([j for j in range(8) if i >> j & 1] + [0] * 8)[:8] for i in range(256)], np.int64).ravel()


class EliasFano:
    """A monotone sequence of integers under `universe`: low bits packed in bytes, high bits unary with a rank directory."""

    def __init__(self, low: np.ndarray, high: np.ndarray, ranks: np.ndarray, ones: np.ndarray, bits: int, n: int):
        self.low, self.high, self.ranks, self.ones, self.bits, self.n = low, high, ranks, ones, bits, n

    @classmethod
    def build(cls, values: np.ndarray, bits: int | None = None) -> EliasFano:
        n = len(values)
        values = values.astype(U64)
        if bits is None:  # whole bytes, for vectorised reads
            bits = -(-max(0, int(values[-1]).bit_length() - n.bit_length()) // 8) * 8 if n else 0
        low = np.zeros((n, bits // 8), np.uint8)
        for i in range(bits // 8):
            low[:, i] = (values >> U64(8 * i)) & U64(255)
        top = (values >> U64(bits)).astype(np.int64) if bits < 64 else np.zeros(n, np.int64)
        size = (int(top[-1]) if n else 0) + n + 1
        words = np.zeros(size // 64 + 2, U64)
        at = top + np.arange(n)
        np.bitwise_or.at(words, at >> 6, U64(1) << (at & 63).astype(U64))
        zeros = 64 - np.bitwise_count(words).astype(np.int64)
        ranks = np.concatenate([[0], np.cumsum(zeros)])  # zeros before each word
        ones = 64 * np.arange(len(ranks)) - ranks
        kind = np.int64 if 64 * len(ranks) >= 1 << 31 else np.int32
        return cls(low, words, ranks.astype(kind), ones.astype(kind), bits, n)

    def parts(self) -> list[np.ndarray]:
        return [np.array([self.bits, self.n], np.int64), self.low, self.high, self.ranks, self.ones]

    @classmethod
    def read(cls, parts: list[np.ndarray]) -> EliasFano:
        bits, n = (int(x) for x in parts[0])
        return cls(parts[1].reshape(n, bits // 8), parts[2], parts[3], parts[4], bits, n)

    @staticmethod
    def _inside(x: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Place of the set bit number `left` (from 0) of each word: its byte by the sums of all bytes' bits side by side in
        one word, then its place by a table."""
        left = left.astype(U64)
        sums = x - ((x >> U64(1)) & U64(0x5555555555555555))
        sums = (sums & U64(0x3333333333333333)) + ((sums >> U64(2)) & U64(0x3333333333333333))
        sums = ((sums + (sums >> U64(4))) & U64(0x0F0F0F0F0F0F0F0F)) * EACH
        at = np.bitwise_count(((left * EACH) | TOPS) - sums & TOPS) << np.uint8(3)
        before = (sums << U64(8)) >> at & U64(255)
        return at.astype(np.int64) + PLACES[(x >> at & U64(255)) << U64(3) | (left - before)]

    def values(self, at: np.ndarray) -> np.ndarray:
        """The values at the given places."""
        word = np.searchsorted(self.ones, at, "right") - 1
        top = (word << 6) + self._inside(self.high[word], at - self.ones[word]) - at
        return (top.astype(U64) << U64(self.bits)) | self._low(at) if self.bits < 64 else self._low(at)

    def ends(self, values: np.ndarray) -> np.ndarray:
        """How many values are at most the given ones, in a sequence without low bits."""
        return self._select_zero(values) - values

    def _select_zero(self, k: np.ndarray) -> np.ndarray:
        """Position of the k-th zero (from 0)."""
        word = np.searchsorted(self.ranks, k, "right") - 1
        return (word << 6) + self._inside(~self.high[word], k - self.ranks[word])

    def find(self, values: np.ndarray, first: np.ndarray | int = 0, last: np.ndarray | None = None) -> np.ndarray:
        """The index of each value, or -1: a search among those of the same high bits, between the places first and last."""
        if not self.n or not len(values):
            return np.full(len(values), -1, np.int64)
        top = (values >> U64(self.bits)).astype(np.int64) if self.bits < 64 else np.zeros(len(values), np.int64)
        most = int(self.ranks[-1]) - 1
        inside = top < most
        top = np.minimum(top, most - 1)
        end = self._select_zero(top) - top
        start = np.where(top > 0, self._select_zero(np.maximum(top - 1, 0)) - top + 1, 0)
        mask = (U64(1) << U64(self.bits)) - U64(1) if self.bits < 64 else ~U64(0)
        want = values & mask
        low = np.maximum(start, first)
        high = np.minimum(end, self.n if last is None else last)
        high = np.where(inside, np.maximum(high, low), low)
        stop = high.copy()
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            mid = (low[open_] + high[open_]) // 2
            less = self._low(mid) < want[open_]
            low[open_] = np.where(less, mid + 1, low[open_])
            high[open_] = np.where(less, high[open_], mid)
        found = np.full(len(values), -1, np.int64)
        hit = np.flatnonzero(low < stop)
        hit = hit[self._low(low[hit]) == want[hit]]
        found[hit] = low[hit]
        return found

    def _low(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), U64)
        raw = self.low[at]
        for i in range(self.bits // 8):
            out |= raw[:, i].astype(U64) << U64(8 * i)
        return out


def _pack(parts: list[np.ndarray]) -> bytes:
    """Arrays behind a table of their types and sizes, each at a multiple of 8 bytes."""
    head = [len(parts)]
    for p in parts:
        head += [ord(p.dtype.char), p.size]
    out = [np.array(head, np.int64).tobytes()]
    for p in parts:
        raw = np.ascontiguousarray(p).tobytes()
        out.append(raw + bytes(-len(raw) % 8))
    return b"".join(out)


def _unpack(raw) -> list[np.ndarray]:
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head = np.frombuffer(raw, np.int64, 2 * n, 8).reshape(n, 2)
    parts, at = [], 8 * (2 * n + 1)
    for char, size in head.tolist():
        kind = np.dtype(chr(char))
        parts.append(np.frombuffer(raw, kind, size, at))
        at += -(-size * kind.itemsize // 8) * 8
    return parts


def _quantise(p: np.ndarray) -> np.ndarray:
    """log10 in steps, rounded down, so that shares never add up to more than they are."""
    with np.errstate(divide="ignore"):
        return np.minimum(np.ceil(-np.log10(p) / LOG_STEP), 255).astype(np.uint8)


QUANTA = np.append(10.0 ** (-np.arange(255) * LOG_STEP), 0.0)


#: Bits of a successor's hash in the levels of pairs and triples.
PAIR_BITS, TRIPLE_BITS = 32, 24


def pair_hash(words: np.ndarray) -> np.ndarray:
    """Hashes of second words; 0 stands for no word."""
    return np.maximum(words >> U64(64 - PAIR_BITS), U64(1))


def triple_hash(words: np.ndarray) -> np.ndarray:
    return np.maximum(words >> U64(64 - TRIPLE_BITS), U64(1))


class Level:
    """The successors of all contexts: their hashes and quantised probabilities."""

    def __init__(self, values: EliasFano, pointers: EliasFano, share: np.ndarray):
        self.of, self.pointers, self.share = values, pointers, share

    @classmethod
    def build(cls, context: np.ndarray, hashes: np.ndarray, share: np.ndarray) -> Level:
        """context: the number of each successor's context, ascending; hashes: ascending inside a context, 1 at least."""
        if not len(context):
            return cls(EliasFano.build(hashes), EliasFano.build(hashes, 0), share)
        last = np.append(np.flatnonzero(np.diff(context)), len(context) - 1)  # of each context with successors
        base = np.zeros(len(last), U64)  # each context counts on from the last value of the one before
        np.cumsum(hashes[last][:-1], out=base[1:])
        return cls(EliasFano.build(hashes + np.repeat(base, np.diff(last, prepend=-1))), EliasFano.build(context, 0), share)

    def parts(self) -> list[np.ndarray]:
        return [*self.of.parts(), *self.pointers.parts(), self.share]

    @classmethod
    def read(cls, parts: list[np.ndarray]) -> Level:
        return cls(EliasFano.read(parts[:5]), EliasFano.read(parts[5:10]), parts[10])

    def find(self, context: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The place of the successor of that hash in each context, or -1; a context of -1 has none."""
        out = np.full(len(context), -1, np.int64)
        if not self.of.n:
            return out
        known = np.flatnonzero((context >= 0) & (context <= self.last()))
        if not len(known):
            return out
        each, at = np.unique(context[known], return_inverse=True)
        end = np.minimum(self.pointers.ends(each), self.of.n)
        start = np.where(each > 0, np.minimum(self.pointers.ends(np.maximum(each - 1, 0)), self.of.n), 0)
        base = np.where(start > 0, self.of.values(np.maximum(start - 1, 0)), U64(0))
        out[known] = self.of.find(base[at] + hashes[known], start[at], end[at])
        return out

    def last(self) -> int:
        """The last context that has successors."""
        return int(self.pointers.values(np.array([self.pointers.n - 1]))[0])


def _shares(counts: np.ndarray, context: np.ndarray, contexts: int, discount: float) -> tuple[np.ndarray, np.ndarray]:
    """Quantised probabilities of successors with their counts, and the backoff weights of all contexts."""
    total = np.bincount(context, counts, contexts)
    share = _quantise((counts - discount) / total[context]) if len(counts) else np.zeros(0, np.uint8)
    return share, _quantise(np.clip(1 - np.bincount(context, QUANTA[share], contexts), 1e-9, 1))


def _groups(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places of the runs of equal keys, and the sums of the counts."""
    first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)])) if len(keys) else np.zeros(0, np.int64)
    return first, np.add.reduceat(counts, first) if len(first) else counts


def build_shard(keys: np.ndarray, counts: np.ndarray, discount: float) -> tuple[bytes, int, int]:
    """The trie of one shard from sorted triples (hash of the first word; hashes of the second and third) with their
    counts; its number of tokens and of words."""
    mask = U64((1 << TRIPLE_BITS) - 1)
    pairs = np.stack([keys[:, 0], keys[:, 1] >> U64(TRIPLE_BITS)], 1)
    word_at, word_n = _groups(keys[:, :1], counts)
    pair_at, pair_n = _groups(pairs, counts)
    word = np.searchsorted(word_at, pair_at, "right") - 1
    real = pairs[pair_at, 1] > 0
    pair_at, pair_n, word = pair_at[real], pair_n[real], word[real]
    inner = np.flatnonzero((pairs[:, 1] > 0) & ((keys[:, 1] & mask) > 0))
    pair = np.searchsorted(pair_at, inner, "right") - 1
    share2, back1 = _shares(pair_n, word, len(word_at), discount)
    share3, back2 = _shares(counts[inner], pair, len(pair_at), discount)
    two = Level.build(word, pairs[pair_at, 1], share2)
    three = Level.build(pair, keys[inner, 1] & mask, share3)
    narrow = word_n.astype(np.uint32 if word_n.max(initial=0) < 1 << 32 else np.int64)
    return _pack([*EliasFano.build(keys[word_at, 0]).parts(), narrow, back1, *two.parts(), back2, *three.parts()]), int(word_n.sum()), len(word_at)


class Shard:
    def __init__(self, raw):
        parts = _unpack(raw)
        self.words, self.counts, self.back = EliasFano.read(parts[:5]), parts[5], parts[6]
        self.pairs, self.pair_back, self.triples = Level.read(parts[7:18]), parts[18], Level.read(parts[19:30])


class Model:
    """The shards of a trained model, mapped when asked; a bounded number stays open."""

    OPEN = 256

    def __init__(self, folder: str, shards: int, tokens: int, kinds: int, alpha: float):
        self.folder, self.shards, self.tokens, self.kinds, self.alpha = folder, shards, tokens, kinds, alpha
        self._open: dict[int, Shard | None] = {}

    def shard(self, i: int) -> Shard | None:
        if i not in self._open:
            if len(self._open) >= self.OPEN:
                self._open.pop(next(iter(self._open)))
            path = os.path.join(self.folder, f"{i}.trie")
            if os.path.exists(path):
                with open(path, "rb") as f:
                    self._open[i] = Shard(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
            else:
                self._open[i] = None
        return self._open[i]

    def base(self, count: np.ndarray) -> np.ndarray:
        return (count + self.alpha) / (self.tokens + self.alpha * (self.kinds + 1))

    def probabilities(self, tokens: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each token of the texts that begin at `starts`: its count, its base probability and that after the two before."""
        kind, place = np.unique(tokens, return_inverse=True)
        n, m = len(kind), len(tokens)
        turn = np.zeros(m, np.int64)  # 0 for a text's first token, 1 for its second, 2 for the others
        turn[1:] = 2
        second = starts[:-1] + 1
        turn[second[second < m]] = 1
        turn[starts[:-1]] = 0
        # pairs and triples once each; sorted by their first word's hash, so each shard's are neighbours
        at = np.flatnonzero(turn > 0)
        pair_of = np.full(m, -1, np.int64)
        codes, pair_of[at] = np.unique(place[at - 1] * n + place[at], return_inverse=True)
        first, then = codes // max(n, 1), codes % max(n, 1)
        at = np.flatnonzero(turn > 1)
        codes, some, triple_of = np.unique(pair_of[at - 1] * n + place[at], return_index=True, return_inverse=True)
        before, last, shorter = codes // max(n, 1), codes % max(n, 1), pair_of[at[some]]
        count, back = np.zeros(n, np.int64), np.ones(n)
        pair_share, pair_back, triple_share = np.zeros(len(first)), np.ones(len(first)), np.zeros(len(before))
        shard = shard_of(kind, self.shards)
        for i in np.unique(shard).tolist():
            s = self.shard(i)
            if s is None:
                continue
            low, high = np.searchsorted(shard, [i, i + 1])
            rank = s.words.find(kind[low:high])
            known = np.flatnonzero(rank >= 0)
            count[low + known], back[low + known] = s.counts[rank[known]], QUANTA[s.back[rank[known]]]
            p, q = np.searchsorted(first, [low, high])
            pair = s.pairs.find(rank[first[p:q] - low], pair_hash(kind[then[p:q]]))
            known = np.flatnonzero(pair >= 0)
            pair_share[p + known], pair_back[p + known] = QUANTA[s.pairs.share[pair[known]]], QUANTA[s.pair_back[pair[known]]]
            t, u = np.searchsorted(before, [p, q])
            triple = s.triples.find(pair[before[t:u] - p], triple_hash(kind[last[t:u]]))
            known = np.flatnonzero(triple >= 0)
            triple_share[t + known] = QUANTA[s.triples.share[triple[known]]]
        base = self.base(count)
        two = pair_share + back[first] * base[then]
        three = triple_share + pair_back[before] * two[shorter]
        told = base[place]
        told[turn == 1] = two[pair_of[turn == 1]]
        told[at] = three[triple_of]
        return count[place], base[place], told


def shard_of(words: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of the word hash."""
    return ((words >> U64(32)) * U64(shards) >> U64(32)).astype(np.int32)


def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each with the end token, and the first token of each text (n + 1)."""
    words, at = word_hashes(*utf8(column))
    starts = at + np.arange(len(at))
    out = np.full(starts[-1], END, U64)
    out[np.arange(len(words)) + np.repeat(np.arange(len(column)), np.diff(at))] = words
    return out, starts


def _block(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys and counts as a compressed block: differences to the key before, bytes by significance."""
    first = np.diff(keys[:, 0], prepend=U64(0))
    second = keys[:, 1].copy()
    second[1:] -= np.where(first[1:] == 0, keys[:-1, 1], U64(0))
    planes = [np.ascontiguousarray(x).view(np.uint8).reshape(len(keys), -1).T for x in (first, second, counts.astype(np.uint32))]
    return zstandard.compress(np.array([len(keys)], np.int64).tobytes() + b"".join(p.tobytes() for p in planes), 1)


def _unblock(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.decompress(raw)
    n, at, out = int(np.frombuffer(raw, np.int64, 1)[0]), 8, []
    for kind in (U64, U64, np.uint32):
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).view(kind).reshape(n))
        at += n * size
    keys = np.stack([np.cumsum(out[0], dtype=U64), out[1]], 1)
    fresh = np.flatnonzero(out[0] != 0)
    fresh = fresh if len(fresh) and fresh[0] == 0 else np.concatenate([[0], fresh]).astype(np.int64)
    total = np.cumsum(out[1], dtype=U64)  # sums of differences, less what stood before each first word's run
    before = np.where(fresh > 0, total[np.maximum(fresh - 1, 0)], U64(0))
    keys[:, 1] = total - np.repeat(before, np.diff(np.append(fresh, n)))
    return keys, out[2].astype(np.int64)


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    keys, counts = np.concatenate(keys), np.concatenate(counts)
    order = np.lexsort(keys.T[::-1]) if keys.shape[1] > 1 else np.argsort(keys[:, 0])
    keys, counts = keys[order], counts[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]).any(1)
    first = np.flatnonzero(fresh)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _triples(tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The triple that begins at each token; what lies beyond a text's end is 0."""
    then, last = np.zeros(len(tokens), U64), np.zeros(len(tokens), U64)
    then[:-1], last[:-2] = pair_hash(tokens[1:]), triple_hash(tokens[2:])
    end = starts[1:] - 1
    then[end], last[end], last[np.maximum(end - 1, 0)] = 0, 0, 0
    return np.stack([tokens, then << U64(TRIPLE_BITS) | last], 1)


def train(df: DataFrame, text_col: str = "text", shards: int | None = None, flush: int = 1 << 20, hold: int = 64 << 20, alpha: float = 0.1, discount: float = 0.75) -> tuple[Model, Scratch]:
    """A model of all rows of df. A shard's triples are merged in memory, so unless `shards` is given there is one for each
    16 MB of text, and 64 at least. A task sorts `flush` tokens at a time and holds `hold` bytes of sorted runs."""
    scratch = Scratch(df.sparkSession, "lm")
    if shards is None:
        shards = max(64, -(-(df.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0) // (16 << 20)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, runs, bytes_ = [], 0, [], 0

        def run() -> list[bytes | None]:
            keys, n = _merged(held, [np.ones(size, np.int64)])
            cuts = np.searchsorted(shard_of(keys[:, 0], shards), np.arange(shards + 1))
            return [_block(keys[s:e], n[s:e]) if e > s else None for s, e in zip(cuts[:-1], cuts[1:])]

        def out() -> Iterator[pa.RecordBatch]:
            for i in range(shards):
                parts = [r[i] for r in runs if r[i] is not None]
                if parts:
                    block = parts[0] if len(parts) == 1 else _block(*_merged(*(list(x) for x in zip(*map(_unblock, parts)))))
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([block], pa.binary())], ["shard", "block"])

        for b in text_slices(batches, 0):
            held.append(_triples(*tokens_of(b.column(0))))
            size += len(held[-1])
            if size > flush:
                runs.append(run())
                bytes_ += sum(len(x) for x in runs[-1] if x is not None)
                held, size = [], 0
                if bytes_ > hold:
                    yield from out()
                    runs, bytes_ = [], 0
        if size:
            runs.append(run())
        yield from out()

    folder = scratch.path("shards")
    if re.match(r"[a-z0-9+.-]{2,}:", folder) and not folder.startswith("file:"):
        raise ValueError(f"the trie's files need a mounted shared folder, not {folder}")
    local = "/" + folder.removeprefix("file:").lstrip("/")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(shard: int, held: list) -> pa.RecordBatch:
            raw, tokens, kinds = build_shard(*_merged(*(list(x) for x in zip(*map(_unblock, held)))), discount)
            os.makedirs(local, exist_ok=True)
            handle, path = tempfile.mkstemp(dir=local)
            with os.fdopen(handle, "wb") as f:
                f.write(raw)
            os.replace(path, os.path.join(local, f"{shard}.trie"))
            return pa.RecordBatch.from_arrays([pa.array([tokens]), pa.array([kinds]), pa.array([len(raw)])], ["tokens", "kinds", "bytes"])

        now, held = None, []
        for b in batches:
            for shard, block in zip(b.column(0).to_pylist(), b.column(1)):
                if shard != now:
                    if now is not None:
                        yield out(now, held)
                    now, held = shard, []
                held.append(block.as_py())
        if now is not None:
            yield out(now, held)

    blocks = df.select(F.col(text_col).alias("text")).mapInArrow(returning(count), "shard int, block binary")
    sums = blocks.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(returning(merge), "tokens long, kinds long, bytes long")
    tokens, kinds = sums.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    return Model(local, shards, tokens, kinds, alpha), scratch


ADDED = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]


def score(df: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns `keep` with n_tokens, n_known, train_tokens, base_score and score (both log10) added; any of those names are replaced."""
    keep = [c for c in keep if c not in ADDED]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "n_tokens long, n_known long, train_tokens long, base_score double, score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, len(keep), 4 << 20):
            tokens, starts = tokens_of(b.column(len(keep)))
            count, base, told = model.probabilities(tokens, starts)
            cuts = starts[:-1]
            sums = [np.add.reduceat(x, cuts) for x in ((count > 0).astype(np.int64), np.log10(base), np.log10(told))]
            n = np.diff(starts)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(n), pa.array(sums[0]), pa.array(np.full(len(n), model.tokens, np.int64)), pa.array(sums[1]), pa.array(sums[2])], [*keep, *ADDED])

    return df.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col).alias("__text")).mapInArrow(returning(run), schema)


def held_out(id_col: str = "doc_id", folds: int = 10, fold: int = 0):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))
