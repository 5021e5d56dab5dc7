"""Shared pieces of the training-data operators: shared scratch space, Arrow text buffers,
stable numpy hashing and distributed connected components."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
Task = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
#: Bytes of text that a kernel handles at once; arrays of eight bytes for each stay small.
SLICE_BYTES = 2 << 20
#: Rows of ids and numbers that a task writes to one file.
FILE_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Unset, a session of one process (tests) gets a temporary one;
    a cluster has to name one, as its machines do not see one another's temporary folders."""
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="evoframe-")
        context.setCheckpointDir(path)
    return path


@contextlib.contextmanager
def returned_memory() -> Iterator[None]:
    """Give a task's memory back to the system: Python workers go on to other tasks and would keep it."""
    try:
        yield
    finally:
        _powers.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL("libc.so.6").malloc_trim(0)


def returning(task: Task) -> Task:
    """A task function for mapInArrow that gives its memory back at its end."""

    @functools.wraps(task)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with returned_memory():
            yield from task(batches)

    return run


class Scratch:
    """Parquet tables in the shared folder; they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        """df, written and read back. A narrow table of about `rows` rows gets no more files than one for each FILE_ROWS."""
        made = df if rows is None else df.coalesce(1 + rows // FILE_ROWS)
        made.write.option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            at = jvm.org.apache.hadoop.fs.Path(self.path(name))
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def sized(ids: DataFrame, most: int = 200_000) -> DataFrame:
    """A stored table of ids for the right side of a join: broadcast while it has at most `most` rows, else as it is."""
    return F.broadcast(ids) if ids.limit(most + 1).count() <= most else ids


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def text_slices(batches: Iterator[pa.RecordBatch], text: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the text column of each holds about `most` bytes, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), np.int64)
        total = np.concatenate([[0], np.cumsum(size)])
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(total, total[start] + most, "right")) - 1)
            yield batch.slice(start, end - start)
            start = end


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


BASE = U64(0x9E3779B97F4A7C15)
_INVERSE = U64(pow(int(BASE), -1, 1 << 64))
BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x2545F4914F6CDD1D))
_powers: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    key = "inverse" if inverse else "power"
    if key not in _powers or len(_powers[key]) < n:
        steps = np.full(max(n, SLICE_BYTES + 1), _INVERSE if inverse else BASE, U64)
        steps[0] = 1
        _powers[key] = np.multiply.accumulate(steps)
    return _powers[key][:n]


class Rolling:
    """Hashes of any byte ranges of a buffer in constant time each."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(BYTE[data] * powers(n), out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        value = (self.sums[end] - self.sums[start]) * powers(len(self.sums), True)[start]
        return mix(value ^ (end - start).astype(U64) * U64(0xC2B2AE3D27D4EB4F))

    def grams(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        if n <= 0:
            return np.zeros(0, U64)
        return mix((self.sums[k:] - self.sums[:n]) * powers(n, True))


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "cc", rows: int | None = None) -> DataFrame:
    """(id, component): component is the smallest id reachable over the undirected edges (a, b), for all other ids than it.

    Alternating large-star and small-star rounds; every round is a min per node and a join back, so a hub is
    pre-aggregated and its side of the join can be split. Nothing but one checksum row comes to the driver. `rows`: about
    how many edges there are.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, last, turn = scratch.save(now, f"{name}-0", rows), None, 0
    if not (size := now.count()):
        return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        small = small.where("u <> v").distinct()
        turn += 1
        now = scratch.save(small, f"{name}-{turn}", size)  # no round has more rows than twice those before
        scratch.drop(f"{name}-{turn - 1}")
        sign = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        size = sign[0]
        if sign == last:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
        last = sign
