"""JSON arrays of any size, read in parallel.

Spark's text reader cuts a file into blocks; what a byte means depends on all before it: whether it stands in a string, and how
deep in brackets. So each block is first summed up for both cases (in a string or not) as what it does to the depth and how
many commas it has at each depth. One row a block goes to the driver, which chains them; then every block knows where it
begins, and gives the elements between its commas of depth 1. Those that reach over a block's end are put together by number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE = 4 << 20
_CHANGE = np.zeros(256, np.int8)
_CHANGE[list(b"[{")] = 1
_CHANGE[list(b"]}")] = -1


class Scan:
    """Reads bytes in order, from a state: in a string or not, after an odd number of backslashes, and how deep."""

    def __init__(self, quoted: bool = False, depth: int = 0):
        self.quoted, self.escaped, self.depth = quoted, False, depth

    def read(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(depth after each byte, whether it is in a string) of the next bytes."""
        slash = data == ord("\\")
        escaped = np.zeros(len(data) + 1, bool)
        escaped[0] = self.escaped
        if slash.any() or self.escaped:
            at = np.arange(len(data))
            last = np.maximum.accumulate(np.where(slash, -1, at))  # the last byte that is no backslash
            run = at - last  # backslashes that end here; one that is escaped by the bytes before counts as none
            odd = (run % 2 == 1) & slash
            lead = (last < 0) & slash
            odd[lead] ^= self.escaped
            escaped[1:] = odd
        quote = (data == ord('"')) & ~escaped[:-1]
        inside = (np.cumsum(quote) + self.quoted) % 2 == 1
        depth = self.depth + np.cumsum(np.where(inside | quote, 0, _CHANGE[data]), dtype=np.int64)
        if len(data):
            self.quoted, self.escaped, self.depth = bool(inside[-1]), bool(escaped[-1]), int(depth[-1])
        return depth, inside


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], np.ndarray]]:
    """((file, block), bytes) in order, the bytes of a block in slices."""
    key, held, size = None, [], 0
    for b in batches:
        for path, start, value in zip(*(b.column(i) for i in range(3))):
            own = (path.as_py(), start.as_py())
            if held and (own != key or size >= SLICE):
                yield key, np.frombuffer(b"".join(held), np.uint8)
                held, size = [], 0
            key = own
            piece = value.as_py().encode() + b"}"  # the file's last one may have none; it is outside the array then
            held.append(piece)
            size += len(piece)
    if held:
        yield key, np.frombuffer(b"".join(held), np.uint8)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block and case: whether it ends in a string, the change of depth, and its commas by depth."""
    found: dict[tuple, list] = {}
    for key, data in _blocks(batches):
        for quoted in (False, True):
            scan, commas = found.setdefault((*key, quoted), [Scan(quoted), {}])
            depth, inside = scan.read(data)
            levels, counts = np.unique(depth[(data == ord(",")) & ~inside], return_counts=True)
            for level, n in zip(levels.tolist(), counts.tolist()):
                commas[level] = commas.get(level, 0) + n
    rows = [(path, start, quoted, scan.quoted, scan.escaped, scan.depth, list(commas), list(commas.values())) for (path, start, quoted), (scan, commas) in found.items()]
    if rows:
        longs = pa.list_(pa.int64())
        kinds = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.int64(), longs, longs]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["path", "start", "quoted", "ends_quoted", "escaped", "depth", "levels", "commas"])


def _starts(sums: list) -> dict[tuple[str, int], tuple[bool, int, int]]:
    """(in a string, depth, commas of depth 1 before) at the beginning of every block."""
    by = {(r.path, r.start, r.quoted): r for r in sums}
    found: dict[tuple[str, int], tuple[bool, int, int]] = {}
    path, state = None, (False, 0, 0)
    for own, start in sorted({(r.path, r.start) for r in sums}):
        if own != path:
            path, state = own, (False, 0, 0)
        found[own, start] = state
        quoted, depth, index = state
        r = by[own, start, quoted]
        state = (r.ends_quoted, depth + r.depth, index + dict(zip(r.levels, r.commas)).get(1 - depth, 0))
    return found


def elements(spark: SparkSession, path: str) -> DataFrame:
    """(path, idx, value): the texts of the elements of the arrays in the files at `path`, by their place from 0."""
    pieces = spark.read.option("lineSep", "}").text(path).select("_metadata.file_path", F.col("_metadata.file_block_start").alias("start"), "value")
    sums = pieces.mapInArrow(_sums, "path string, start long, quoted boolean, ends_quoted boolean, escaped boolean, depth long, levels array<long>, commas array<long>")
    starts = spark.sparkContext.broadcast(_starts(sums.collect()))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(path, idx, start, n, whole, value): the parts between commas; the first and the last of a slice may go on elsewhere."""
        key, scan, index, n = None, Scan(), 0, 0
        for own, data in _blocks(batches):
            if own != key:
                key, n = own, 0
                quoted, depth, index = starts.value[own]
                scan = Scan(quoted, depth)
            depth, inside = scan.read(data)
            commas = np.flatnonzero((data == ord(",")) & ~inside & (depth == 1))
            # what is outside the array, and its own brackets, is no part of an element
            own_bracket = (data == ord("[")) & ~inside & (depth == 1)
            kept = (depth >= 1) & ~own_bracket
            begins, ends = [0, *(commas + 1).tolist()], [*commas.tolist(), len(data)]
            parts = [data[x:y][kept[x:y]].tobytes() for x, y in zip(begins, ends)]
            columns = [[own[0]] * len(parts), range(index, index + len(parts)), [own[1]] * len(parts), [n] * len(parts), [0 < i < len(parts) - 1 for i in range(len(parts))], parts]
            index, n = index + len(commas), n + 1
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["path", "idx", "start", "n", "whole", "value"])

    parts = pieces.mapInArrow(cut, "path string, idx long, start long, n long, whole boolean, value binary")
    ordered = F.array_sort(F.collect_list(F.struct("start", "n", "value")))
    joined = F.aggregate(ordered, F.lit(b""), lambda s, x: F.concat(s, x["value"]))
    ends = parts.where("not whole").groupBy("path", "idx").agg(joined.alias("value"))
    whole = parts.where("whole").select("path", "idx", "value").unionByName(ends)
    text = F.regexp_replace(F.col("value").cast("string"), r"^\s+|\s+$", "")
    return whole.select("path", "idx", text.alias("value")).where("value <> ''")
