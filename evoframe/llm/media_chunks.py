"""Media columns in a store of content-defined chunks.

A payload is kept as 8-bit samples of a WAV file: a header that follows from its length, and the payload itself in chunks. A
rolling gear hash of the last 64 bytes cuts where its highest bits are 0, between `least` and `most` bytes, so an insertion
moves the cuts near it only. Chunks are known by their SHA-256. Spark joins the digests and finds which chunks occur more
than once; such a chunk is stored once. A medium is its ordered list of digests, and is read back by joining the list with the
chunks; each chunk and the whole are checked by their digests, and a store that does not give them back raises.

Only media that share something have to be moved. What a medium shares is known from digests alone, some percent of the
data; media that share no chunk with any other and occur once are written where they are read, as a pack of their chunks.
The others are told apart by FILTER_BITS bits of a hash of their digest, which is at most 2 ** FILTER_BITS numbers to
broadcast whatever the input; media that have the same bits by chance go the way of the shared ones, with the same result.

Tables in the store: `lists` (media, size, digests in order, copies), `packs` (media, its chunks), `chunks` (digest, data).

Cases: a null payload is an empty one, and an empty one has no chunks; equal payloads are one medium; an empty table gives an
empty store; columns other than the payload are not stored. A payload has to fit into a row.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BYTE, SLICE_BYTES, U64, returning, text_slices, utf8

WINDOW = 64
#: Bytes of a chunk: at least, at most, and the highest bits of the hash that are 0 at a cut (2 ** bits bytes beyond `least`).
LEAST, MOST, BITS = 1024, 65536, 12
FILTER_BITS = 20
RATE = 8000


def gear(data: np.ndarray) -> np.ndarray:
    """The hash at each byte: the sum of BYTE[b] << distance over the last 64 bytes, in six doublings."""
    h = BYTE[data]
    width = 1
    while width < WINDOW:
        more = h[:-width] << U64(width)
        h[width:] += more
        width *= 2
    return h


def marks(data: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places behind which a cut may be."""
    found = [np.zeros(0, np.int64)]
    for start in range(0, len(data), SLICE_BYTES):
        first = max(0, start - WINDOW + 1)
        h = gear(data[first : start + SLICE_BYTES])[start - first :]
        found.append(start + np.flatnonzero(h >> U64(64 - bits) == 0))
    return np.concatenate(found)


def cuts(marks: np.ndarray, start: int, end: int, least: int = LEAST, most: int = MOST) -> list[int]:
    """Bounds of the chunks of the payload at start:end. The first `least` bytes have no cut, so no hash that a cut is by
    reaches beyond the payload's beginning."""
    found = [start]
    while found[-1] < end:
        at = found[-1]
        i = int(np.searchsorted(marks, at + least - 1))
        cut = int(marks[i]) + 1 if i < len(marks) else end
        found.append(min(cut, at + most, end))
    return found


def chunked(batches: Iterator[pa.RecordBatch], least: int, most: int, bits: int) -> Iterator[tuple[str, list[memoryview]]]:
    """(media, its chunks) of rows (media, payload)."""
    for b in text_slices(batches, 1):
        data, at = utf8(b.column(1))
        found, raw = marks(data, bits), memoryview(np.ascontiguousarray(data))
        for i, media in enumerate(b.column(0).to_pylist()):
            bounds = cuts(found, int(at[i]), int(at[i + 1]), least, most)
            yield media, [raw[x:y] for x, y in zip(bounds, bounds[1:])]


def _batches(rows: Iterator[tuple], schema: pa.Schema, size) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about SLICE_BYTES."""
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += size(row)
        if total >= SLICE_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


_BINARY = pa.list_(pa.binary())
_LISTS = pa.schema([("media", pa.string()), ("size", pa.int64()), ("digests", _BINARY)])
_PACKS = pa.schema([("media", pa.string()), ("data", _BINARY)])
_CHUNKS = pa.schema([("digest", pa.binary()), ("data", pa.binary())])
_WAVS = pa.schema([("media", pa.string()), ("wav", pa.binary())])


def _bucket(media: Column) -> Column:
    return F.pmod(F.xxhash64(media), F.lit(1 << FILTER_BITS)).cast("int")


def write_media(rows: DataFrame, root: str, payload: str = "payload", least: int = LEAST, most: int = MOST, bits: int = BITS) -> None:
    """Store the payloads of all rows in the folder `root`."""
    if least < WINDOW:
        raise ValueError(f"a chunk has at least {WINDOW} bytes, those of the hash")
    spark = rows.sparkSession
    cut = (least, most, bits)

    @returning
    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = ((media, sum(map(len, parts)), [hashlib.sha256(p).digest() for p in parts]) for media, parts in chunked(batches, *cut))
        yield from _batches(made, _LISTS, lambda r: 64 + 40 * len(r[2]))

    @returning
    def packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(((media, [bytes(p) for p in parts]) for media, parts in chunked(batches, *cut)), _PACKS, lambda r: 64 + sum(map(len, r[1])))

    @returning
    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # of one task's share of the input

        def fresh() -> Iterator[tuple[bytes, bytes]]:
            for _, parts in chunked(batches, *cut):
                for p in parts:
                    if (digest := hashlib.sha256(p).digest()) not in seen:
                        seen.add(digest)
                        yield digest, bytes(p)

        yield from _batches(fresh(), _CHUNKS, lambda r: 64 + len(r[1]))

    def save(df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{root}/{name}")
        return spark.read.schema(df.schema).parquet(f"{root}/{name}")

    data = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = rows.select(F.sha2(data, 256).alias("media"), data.alias("payload"))
    found = rows.mapInArrow(lists, "media string, size long, digests array<binary>")
    found = save(found.groupBy("media").agg(F.first("size").alias("size"), F.first("digests").alias("digests"), F.count(F.lit(1)).alias("copies")), "lists")
    digests = found.select("media", F.explode("digests").alias("digest"))
    shared = digests.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest")
    touched = found.where("copies > 1").select("media").unionByName(digests.join(shared, "digest", "left_semi").select("media"))
    buckets = F.broadcast(save(touched.select(_bucket(F.col("media")).alias("bucket")).distinct(), "touched"))
    placed = rows.withColumn("bucket", _bucket(F.col("media")))
    save(placed.join(buckets, "bucket", "left_anti").select("media", "payload").mapInArrow(packs, "media string, data array<binary>"), "packs")
    moved = placed.join(buckets, "bucket", "left_semi").select("media", "payload").mapInArrow(chunks, "digest binary, data binary")
    save(moved.dropDuplicates(["digest"]), "chunks")


def wav(payload: bytes) -> bytes:
    """One channel of 8-bit samples."""
    number = lambda x, n: x.to_bytes(n, "little")
    form = number(1, 2) + number(1, 2) + number(RATE, 4) + number(RATE, 4) + number(1, 2) + number(8, 2)
    body = b"fmt " + number(len(form), 4) + form + b"data" + number(len(payload), 4) + payload + b"\0" * (len(payload) % 2)
    return b"RIFF" + number(4 + len(body), 4) + b"WAVE" + body


def samples(media: bytes) -> memoryview:
    """The samples of a WAV file of 8 bits."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, width = 12, 0
    while at + 8 <= len(media):
        size = int.from_bytes(media[at + 4 : at + 8], "little")
        if media[at : at + 4] == b"fmt ":
            width = int.from_bytes(media[at + 22 : at + 24], "little")
        if media[at : at + 4] == b"data":
            if width != 8:
                raise ValueError(f"samples of {width} bits")
            return memoryview(media)[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


def _checked(media: str, payload: bytes) -> bytes:
    if hashlib.sha256(payload).hexdigest() != media:
        raise ValueError(f"medium {media} is not what was stored")
    return wav(payload)


@returning
def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = ((media.as_py(), b"".join(data.as_py())) for b in batches for media, data in zip(b.column(0), b.column(1)))
    yield from _batches(((media, _checked(media, data)) for media, data in rows), _WAVS, lambda r: len(r[1]))


@returning
def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (media, place, digest, data) in order."""

    def rows() -> Iterator[tuple[str, bytes]]:
        media, parts = None, []
        for b in batches:
            for m, _, digest, data in zip(*(b.column(i) for i in range(4))):
                if (m := m.as_py()) != media:
                    if media is not None:
                        yield media, _checked(media, b"".join(parts))
                    media, parts = m, []
                digest, data = digest.as_py(), data.as_py()
                if digest is not None and (data is None or hashlib.sha256(data).digest() != digest):
                    raise ValueError(f"chunk {digest.hex()} of medium {media} is {'not there' if data is None else 'not what was stored'}")
                parts.append(data or b"")
        if media is not None:
            yield media, _checked(media, b"".join(parts))

    yield from _batches(rows(), _WAVS, lambda r: len(r[1]))


def read_media(spark: SparkSession, root: str) -> DataFrame:
    """(media, wav): each stored medium once, checked."""
    read = lambda name, schema: spark.read.schema(schema).parquet(f"{root}/{name}")
    lists, touched = read("lists", "media string, digests array<binary>"), read("touched", "bucket int")
    packs, chunks = read("packs", "media string, data array<binary>"), read("chunks", "digest binary, data binary")
    moved = lists.withColumn("bucket", _bucket(F.col("media"))).join(F.broadcast(touched), "bucket", "left_semi")
    moved = moved.select("media", F.posexplode_outer("digests").alias("place", "digest")).join(chunks, "digest", "left")
    moved = moved.select("media", "place", "digest", "data").repartition("media").sortWithinPartitions("media", "place")
    schema = "media string, wav binary"
    return packs.mapInArrow(_unpack, schema).unionByName(moved.mapInArrow(_assemble, schema))


FEATURES = pa.schema([("media", pa.string()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def features(media: bytes) -> tuple[int, str, int, int, str, str]:
    """What the samples of a WAV file are: their number, digest and the checksum of the last 64, the file's size and digest,
    and their sum, the sum of their squares and how often they cross the middle."""
    said = samples(media)
    x = np.frombuffer(said, np.uint8)
    total = squares = crossings = 0
    for start in range(0, len(x), SLICE_BYTES):  # a wide copy of one piece at a time
        part = x[start : start + SLICE_BYTES + 1].astype(np.int64)
        own = part[:SLICE_BYTES]
        total += int(own.sum())
        squares += int((own * own).sum())
        crossings += int((np.diff(part >> 7) != 0).sum())
    sha = hashlib.sha256
    return len(x), sha(said).hexdigest(), zlib.crc32(said[-64:]), len(media), sha(media).hexdigest(), f"sum={total};squares={squares};crossings={crossings}"


def describe(wavs: DataFrame) -> DataFrame:
    """The features of each medium read back."""

    @returning
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((m.as_py(), *features(w.as_py())) for b in batches for m, w in zip(b.column(0), b.column(1)))
        yield from _batches(rows, FEATURES, lambda r: 300)

    return wavs.select("media", "wav").mapInArrow(run, ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'string'}" for f in FEATURES))


def padded(text: Column, unit: int = 64) -> Column:
    """The UTF-8 bytes of a text, null as empty, and bytes 0 up to a positive multiple of `unit`."""
    raw = F.coalesce(text, F.lit("")).cast("binary")
    size = F.octet_length(raw)
    lacking = F.when(size == 0, unit).otherwise(F.pmod(-size, F.lit(unit)))
    return F.concat(raw, F.repeat(F.lit("\0"), lacking).cast("binary"))
