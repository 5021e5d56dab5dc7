"""Removal of repeated byte strings by suffix arrays.

Every byte of a text that a string of `length` bytes covers which also starts earlier (in a smaller id, or in the same
text) is removed. Strings never cross texts and are judged on the input.

1. Dealing. In each string of `length` bytes the `gram`-byte piece of least hash (leftmost on ties) is its anchor. Equal
   strings have equal anchors at equal offsets, so occurrences of an anchor, each with the region that strings with that
   anchor can reach, hold every repeat; an anchor that occurs once has none.
2. Of equal regions (one more hash) all but the first are removed whole; each task does so with its own texts first, so a
   region of a third of all texts is one row per slice of text. Where an anchor has different regions, one of each kind
   goes on with its bytes.
3. Shards of such regions, cut between anchors, are suffix-sorted by induced sorting (see induced_sort), and runs of
   suffixes whose common prefixes reach `length` give the strings that occur twice; all but the earliest occurrence are
   removed. The regions of an anchor that has more than `shard_bytes` of them are not held: slice by slice, their strings
   are hashed (two hashes of 64 bits), the first of each kind goes to unnamed task-private files by hash, and each file
   is settled alone. So a task holds two shards at most, however common an anchor is.

Cases: a null text is empty; a text shorter than `length` loses nothing; a row with a null id loses nothing and removes
nothing; ids are taken to be unique (rows that share one lose the same ranges); an empty table gives an empty result; a
character of which a byte is removed leaves the string output; other columns, of whatever names, pass through.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, Scratch, mix, returned_memory, returning, text_slices, utf8
from .induced_sort import SuffixSort

U64 = np.uint64


def anchors(data: np.ndarray, at: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of each anchor: its hash, its region's hash, its row, and the region's start and end in the row."""
    width = length - gram + 1
    none = (np.zeros(0, U64), np.zeros(0, U64), *(np.zeros(0, np.int64) for _ in range(3)))
    if len(data) < length:
        return none
    rolling = Rolling(data)
    hashes = rolling.grams(gram)
    bits = U64(int(len(hashes)).bit_length())
    low = (hashes >> bits << bits) | np.arange(len(hashes), dtype=U64)
    step = 1
    while 2 * step <= width:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    if width > step:
        low = np.minimum(low[: len(low) - (width - step)], low[width - step :])
    # windows inside one row: of row i those from at[i] to at[i + 1] - length
    inside = np.zeros(len(low) + 1, np.int32)
    long = np.flatnonzero(np.diff(at) >= length)
    if not len(long):
        return none
    np.add.at(inside, at[long], 1)
    np.add.at(inside, np.minimum(at[long + 1] - length + 1, len(low)), -1)
    chosen = np.zeros(len(hashes), bool)
    chosen[(low[np.cumsum(inside[:-1]) > 0] & ((U64(1) << bits) - U64(1))).astype(np.int64)] = True
    place = np.flatnonzero(chosen)
    row = np.searchsorted(at, place, "right") - 1
    start, end = np.maximum(at[row], place - width + 1), np.minimum(at[row + 1], place + length)
    region = mix(rolling.spans(start, end) + (place - start).astype(U64))
    return hashes[place], region, row, start - at[row], end - at[row]


def _merge(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of ranges, row by row."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    if not len(doc):
        return doc, start, end
    new_doc = np.concatenate([[True], doc[1:] != doc[:-1]])
    shift = np.cumsum(new_doc).astype(np.int64) * (int(end.max()) + 2)
    reach = np.maximum.accumulate(end + shift)
    fresh = new_doc.copy()
    fresh[1:] |= (start + shift)[1:] > reach[:-1]
    first = np.flatnonzero(fresh)
    last = np.concatenate([first[1:], [len(doc)]]) - 1
    return doc[first], start[first], (reach - shift)[last]


def repeats(docs: np.ndarray, starts: np.ndarray, regions: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges (doc, start, end) of all strings that also start earlier, by a suffix array of the joined regions."""
    size = np.array([len(r) for r in regions], np.int64)
    at = np.concatenate([[0], np.cumsum(size + 1)])
    text = np.frombuffer(b"\0".join(regions) + b"\0", np.uint8).astype(np.int16) + 2
    text[at[1:] - 1] = 1
    order, common = SuffixSort(text, length).sort()
    near = common >= length
    member = near.copy()
    member[:-1] |= near[1:]
    where = np.flatnonzero(member)
    if not len(where):
        return docs[:0], starts[:0], starts[:0]
    pos = order[where].astype(np.int64)
    row = np.searchsorted(at, pos, "right") - 1
    offset = pos - at[row]
    group = np.cumsum(~near[where])
    whole = offset + length <= size[row]
    row, offset, group = row[whole], offset[whole], group[whole]
    doc, start = docs[row], starts[row] + offset
    by = np.lexsort((start, doc, group))
    doc, start, group = doc[by], start[by], group[by]
    new = np.concatenate([[True], group[1:] != group[:-1]])
    first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    later = (doc != doc[first]) | (start != start[first])
    return _merge(doc[later], start[later], start[later] + length)


class Strings:
    """The later occurrences of all strings of `length` bytes in regions that come slice by slice; memory is bounded by `most`."""

    KIND = np.dtype([("a", U64), ("b", U64), ("doc", np.int64), ("start", np.int64)])

    def __init__(self, length: int, most: int, shift: int = 56):
        self.length, self.most, self.shift = length, most, shift
        self.files: dict[int, object] = {}

    def add(self, docs: np.ndarray, starts: np.ndarray, regions: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ranges of strings that start earlier in this same slice; the others are kept for settle()."""
        size = np.array([len(r) for r in regions], np.int64)
        data, n = np.frombuffer(b"".join(regions), np.uint8), np.maximum(size - self.length + 1, 0)
        row = np.repeat(np.arange(len(size)), n)
        inner = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        pos = (np.cumsum(size) - size)[row] + inner
        found = np.empty(len(row), self.KIND)
        for name, bytes_ in (("a", data), ("b", data ^ np.uint8(0x5A))):
            found[name] = Rolling(bytes_).spans(pos, pos + self.length)
        found["doc"], found["start"] = docs[row], starts[row] + inner
        first, later = self._split(found)
        self._put(first)
        return later

    def _split(self, found: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        found = found[np.lexsort((found["start"], found["doc"], found["b"], found["a"]))]
        new = np.ones(len(found), bool)
        new[1:] = (found["a"][1:] != found["a"][:-1]) | (found["b"][1:] != found["b"][:-1])
        head = found[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        later = found[(found["doc"] != head["doc"]) | (found["start"] != head["start"])]
        return found[new], _merge(later["doc"], later["start"], later["start"] + self.length)

    def _put(self, first: np.ndarray) -> None:
        part = ((first["a"] >> U64(self.shift)) & U64(255)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(257))
        for k in range(256):
            if cuts[k + 1] > cuts[k]:
                if k not in self.files:
                    self.files[k] = tempfile.TemporaryFile()
                self.files[k].write(first[order[cuts[k] : cuts[k + 1]]].tobytes())

    def settle(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Ranges of the rest, file by file; a file that is too large is dealt again by more bits of the hash."""
        for k in list(self.files):
            with self.files.pop(k) as file:
                large = file.tell() > self.most and self.shift >= 8
                file.seek(0)
                if not large:
                    yield self._split(np.frombuffer(file.read(), self.KIND))[1]
                    continue
                deeper = Strings(self.length, self.most, self.shift - 8)
                while raw := file.read(max(self.most // self.KIND.itemsize, 1) * self.KIND.itemsize):
                    first, later = self._split(np.frombuffer(raw, self.KIND))
                    deeper._put(first)
                    yield later
            yield from deeper.settle()


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor, region, doc, start: later rows of a region (kind 0) and the regions of an anchor with several (kind 1).

    Rows that come as kind 0 are told as they are.

    The first row of the last region seen is carried over from batch to batch.
    """
    carry = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [np.asarray(b.column(i)) for i in range(5)]
        given = np.asarray(b.column(5)) == 0
        if given.any():
            yield pa.RecordBatch.from_arrays([pa.array(cols[0][given]), *(pa.array(c[given]) for c in cols[2:]), pa.array(np.zeros(int(given.sum()), np.int32))], ["anchor", "doc", "start", "end", "kind"])
            cols = [c[~given] for c in cols]
            if not len(cols[0]):
                continue
        old, told = carry is not None, False
        if old:
            told = carry[1]
            cols = [np.concatenate([[c], x]) for c, x in zip(carry[0], cols)]
        anchor, region = cols[0], cols[1]
        new_anchor = np.concatenate([[True], anchor[1:] != anchor[:-1]])
        new = new_anchor.copy()
        new[1:] |= region[1:] != region[:-1]
        run = np.cumsum(new_anchor) - 1
        several = np.bincount(run[new]) > 1
        removed, needed = np.flatnonzero(~new), np.flatnonzero(new & several[run])
        if old and told:
            needed = needed[needed != 0]
        last = int(np.flatnonzero(new)[-1])
        carry = [c[last] for c in cols], bool(several[run[last]]) or (told and last == 0)
        if told and run[last] == 0:
            carry = carry[0], True
        for kind, rows in ((0, removed), (1, needed)):
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.array(anchor[rows]), *(pa.array(c[rows]) for c in cols[2:]), pa.array(np.full(len(rows), kind, np.int32))], ["anchor", "doc", "start", "end", "kind"])


def sort_shards(rows: Iterator[tuple], length: int, shard_bytes: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The ranges of repeats in rows (anchor, doc, start, region) that are sorted by anchor."""

    def columns(part: list[tuple]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        return np.array([h[1] for h in part], np.int64), np.array([h[2] for h in part], np.int64), [h[3] for h in part]

    held, size, first, own, hot = [], 0, 0, 0, None  # own: bytes of the last anchor's regions, which begin at held[first]
    for row in rows:
        if held and row[0] != held[-1][0]:
            if hot is not None:
                yield hot.add(*columns(held))
                yield from hot.settle()
                held, size, hot = [], 0, None
            elif size > shard_bytes:  # a shard ends between anchors
                yield repeats(*columns(held), length)
                held, size = [], 0
            first, own = len(held), 0
        elif own > shard_bytes:
            if hot is None:
                if first:
                    yield repeats(*columns(held[:first]), length)
                hot = Strings(length, 4 * shard_bytes)
            # one row stays, so that the next can be compared with it
            yield hot.add(*columns(held[first:-1]))
            held, first = held[-1:], 0
            size = own = len(held[0][3])
        held.append(row)
        size += len(row[3])
        own += len(row[3])
    if hot is not None:
        yield hot.add(*columns(held))
        yield from hot.settle()
    elif held:
        yield repeats(*columns(held), length)


def repeated_ranges(df: DataFrame, scratch: Scratch, id_col: str, text_col: str, length: int, gram: int, shard_bytes: int) -> DataFrame:
    """(doc, ranges array<struct<start, end>>): the ranges to remove; they may overlap."""
    docs = df.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).where("doc is not null and text is not null")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with returned_memory():
            yield from anchored(batches)

    def anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, 1):
            anchor, region, row, start, end = anchors(*utf8(b.column(1)), length, gram)
            doc = np.asarray(b.column(0))[row]
            order = np.lexsort((start, doc, region, anchor))
            anchor, region, doc, start, end = (x[order] for x in (anchor, region, doc, start, end))
            first = np.ones(len(anchor), bool)
            first[1:] = (anchor[1:] != anchor[:-1]) | (region[1:] != region[:-1])
            later = _merge(doc[~first], start[~first], end[~first])
            spread = mix(later[0].astype(U64) * U64(31) + later[1].astype(U64))  # any key: these rows meet no others
            columns = [np.concatenate(p) for p in zip((anchor[first].view(np.int64), region[first].view(np.int64), doc[first], start[first], end[first]), (spread.view(np.int64), spread.view(np.int64), *later))]
            kind = np.concatenate([np.ones(int(first.sum()), np.int32), np.zeros(len(later[0]), np.int32)])
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns[:3]), *(pa.array(c.astype(np.int32)) for c in columns[3:]), pa.array(kind)], ["anchor", "region", "doc", "start", "end", "kind"])

    dealt = docs.mapInArrow(deal, "anchor long, region long, doc long, start int, end int, kind int").repartition("anchor").sortWithinPartitions("anchor", "region", "doc", "start")
    classes = scratch.save(dealt.mapInArrow(_classes, "anchor long, doc long, start int, end int, kind int"), "classes")
    wanted = classes.where("kind = 1").groupBy("doc").agg(F.collect_list(F.struct("anchor", "start", "end")).alias("wanted"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 64):
                part = b.slice(s, 64)
                rows = []
                for doc, text, wanted in zip(part.column(0).to_pylist(), part.column(1), part.column(2)):
                    raw = text.as_py().encode()
                    got = wanted.values
                    for a, i, j in zip(*(np.asarray(got.field(f)).tolist() for f in range(3))):
                        rows.append((a, doc, i, raw[i:j]))
                if rows:
                    a, d, i, raw = zip(*rows)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(d, pa.int64()), pa.array(i, pa.int64()), pa.array(raw, pa.binary())], ["anchor", "doc", "start", "raw"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with returned_memory():
            for found in sort_shards(zipped(batches), length, shard_bytes):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["doc", "start", "end"])

    def zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            yield from zip(*(b.column(i).to_pylist() for i in range(4)))

    fetched = docs.join(wanted, "doc").select("doc", "text", "wanted").mapInArrow(fetch, "anchor long, doc long, start long, raw binary")
    sorted_ = fetched.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(sort, "doc long, start long, end long")
    same = classes.where("kind = 0").select("doc", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    return sorted_.unionByName(same).groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, gram: int = 24, shard_bytes: int = 2 << 20, digest: bool = False) -> DataFrame:
    """df with text_col shortened and n_bytes, n_removed, n_spans added; with digest=True the id, those and kept_sha256.

    `length` is 255 at most, as common prefixes are counted in bytes, and over `gram`.
    """
    if not gram < length <= 255:
        raise ValueError("length has to be over gram and at most 255")
    scratch = Scratch(df.sparkSession, "suffixes")
    ranges = repeated_ranges(df, scratch, id_col, text_col, length, gram, shard_bytes)
    added = ["n_bytes", "n_removed", "n_spans"]
    keep = [id_col] if digest else [c for c in df.columns if c not in added]
    last = "kept_sha256" if digest else None
    # the columns that pass through travel in one struct, so their names meet no others
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"), F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    rows = rows.join(ranges, "doc", "left").select("kept", "text", "ranges")
    base = [f for f in df.schema.fields if f.name in keep]
    from pyspark.sql import types as T

    schema = T.StructType([*base, *(T.StructField(c, T.LongType()) for c in added), *([T.StructField(last, T.StringType())] if last else [])])
    where = keep.index(text_col) if not digest else -1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, ranges = b.column(1), b.column(2)
            found, kept = [], []
            for i in range(b.num_rows):
                text = texts[i].as_py()
                raw = (text or "").encode()
                n_removed = n_spans = 0
                left = raw
                if ranges[i].is_valid:
                    got = ranges[i].values
                    s, e = np.asarray(got.field(0)), np.asarray(got.field(1))
                    _, s, e = _merge(np.zeros(len(s), np.int64), s, e)
                    n_removed, n_spans = int((e - s).sum()), len(s)
                    left = b"".join(raw[x:y] for x, y in zip([0, *e.tolist()], [*s.tolist(), len(raw)]))
                found.append((len(raw), n_removed, n_spans))
                kept.append(hashlib.sha256(left).hexdigest() if digest else None if text is None else text if not n_removed else left.decode("utf-8", "ignore"))
            numbers = [pa.array(x, pa.int64()) for x in (zip(*found) if found else ([], [], []))]
            columns = b.column(0).flatten()
            if not digest:
                columns[where] = pa.array(kept, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, *numbers, *([pa.array(kept, pa.string())] if digest else [])], [f.name for f in schema.fields])

    return rows.mapInArrow(returning(cut), schema)
