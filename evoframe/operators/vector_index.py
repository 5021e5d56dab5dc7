"""Exact nearest vectors by balls that the triangle inequality leaves out.

Centres come from a bounded sample of the keys, each as far from those before as can be; every key belongs to its nearest
centre, and a ball is a centre, its radius and the number of its keys. A point first meets its nearest balls that have k keys
together; the k-th distance there bounds the rest, so only balls whose rim is not farther are met, and of their keys only
those whose distance to the centre does not differ more. Points and blocks of keys are dealt to tasks in bounded groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evoframe.sources.stored import stored

#: Balls at most, keys of the sample per ball, keys and points that a task compares at once.
BALLS, SAMPLE, KEYS, POINTS = 1024, 16, 512, 2048
SLACK = 1e-9


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of all rows, from differences: what is near is not lost in large sums."""
    out = np.empty((len(x), len(y)))
    step = max(1, (1 << 20) // max(1, y.size))
    for i in range(0, len(x), step):
        out[i : i + step] = np.sqrt(((x[i : i + step, None, :] - y[None]) ** 2).sum(2))
    return out


def _usable(df: DataFrame, id_: str, vector: str, name: str) -> DataFrame:
    """(id, v) of the rows whose vector has no null component."""
    v = F.col(vector).cast("array<double>")
    return df.select(F.col(id_).alias(name), v.alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull()))


@dataclass
class Balls:
    """An index of keys: the centres with radius and count, and the stored keys (ball, part, kid, v, far)."""

    centres: np.ndarray
    radius: np.ndarray
    count: np.ndarray
    keys: DataFrame


def build(keys: DataFrame, key_id: str, vector: str) -> Balls:
    """The index of the keys, stored in the shared folder."""
    rows = stored(_usable(keys, key_id, vector, "kid"), "keys")
    n = rows.count()
    most = max(1, min(BALLS, int(np.ceil(np.sqrt(n)))))
    sample = rows.orderBy(F.xxhash64("kid"), "kid").limit(most * SAMPLE).select("v").toArrow().column(0).combine_chunks()
    x = _matrix(sample) if len(sample) else np.zeros((1, 1))
    chosen, far = [0], _distances(x[:1], x)[0]
    while len(chosen) < most and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, _distances(x[chosen[-1:]], x)[0])
    centres = x[chosen]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = _distances(_matrix(b.column(1)), centres)
                ball = d.argmin(1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ball), pa.array(d[np.arange(len(ball)), ball])], ["kid", "v", "ball", "far"])

    kind = rows.schema["kid"].dataType.simpleString()
    placed = stored(rows.mapInArrow(place, f"kid {kind}, v array<double>, ball long, far double"), "placed")
    sizes = placed.groupBy("ball").agg(F.max("far").alias("radius"), F.count(F.lit(1)).alias("n")).collect()  # a row per ball
    radius, count = np.full(len(centres), -np.inf), np.zeros(len(centres), np.int64)
    for r in sizes:
        radius[r.ball], count[r.ball] = r.radius, r.n
    parts = F.element_at(F.array(*[F.lit(max(1, -(-int(c) // KEYS))) for c in count]), (F.col("ball") + 1).cast("int"))
    return Balls(centres, radius, count, placed.withColumn("part", F.pmod(F.xxhash64("kid"), parts)))


def search(points: DataFrame, index: Balls, k: int, point_id: str, vector: str, compared=None) -> DataFrame:
    """(pid, kid, dist): the k nearest keys of every point, ties by key. `compared`: an accumulator that counts pairs."""
    rows = stored(_usable(points, point_id, vector, "pid").withColumn("row", F.monotonically_increasing_id()), "points")
    pid, kid = rows.schema["pid"].dataType.simpleString(), index.keys.schema["kid"].dataType.simpleString()
    centres, radius, count = index.centres, index.radius, index.count

    def nearest(d: np.ndarray) -> np.ndarray:
        """For each point, the nearest balls that have k keys together."""
        order = np.argsort(np.where(count > 0, d, np.inf), 1, kind="stable")
        before = np.cumsum(count[order], 1) - count[order]
        found = np.zeros(d.shape, bool)
        np.put_along_axis(found, order, before < k, 1)
        return found & (count > 0)

    def choose(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                d = _distances(_matrix(b.column(1)), centres)
                bound = np.full(b.num_rows, np.inf) if first else np.asarray(b.column(3).fill_null(np.inf))
                met = nearest(d) if first else ~nearest(d) & (count > 0) & (d - radius <= bound[:, None] * (1 + SLACK) + SLACK)
                p, ball = np.nonzero(met)
                for i in range(0, len(p), 4096):
                    own, at = p[i : i + 4096], pa.array(p[i : i + 4096])
                    yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), b.column(2).take(at), pa.array(bound[own]), pa.array(d[own, ball[i : i + 4096]]), pa.array(ball[i : i + 4096])], ["pid", "v", "row", "bound", "away", "ball"])

        return run

    def compare(points: pa.Table, keys: pa.Table) -> pa.Table:
        if not keys.num_rows:
            points = points.slice(0, 0)
        x, y = _matrix(points.column("v").combine_chunks()), _matrix(keys.column("v").combine_chunks())
        away, far = np.asarray(points.column("away")), np.asarray(keys.column("far"))
        bound = np.asarray(points.column("bound"))
        ids = keys.column("kid").combine_chunks()
        rank = np.empty(len(ids), np.int64)
        rank[np.asarray(pa.compute.sort_indices(ids))] = np.arange(len(ids))
        found_p, found_k, found_d, pairs = [], [], [], 0
        for i in range(len(x)):
            own = np.flatnonzero(np.abs(away[i] - far) <= bound[i] * (1 + SLACK) + SLACK)
            pairs += len(own)
            d = _distances(x[i : i + 1], y[own])[0]
            best = np.lexsort((rank[own], d))[:k]
            found_p += [i] * len(best)
            found_k += own[best].tolist()
            found_d += d[best].tolist()
        if compared is not None:
            compared.add(pairs)
        at = pa.array(found_p, pa.int64())
        return pa.table({"pid": points.column("pid").take(at), "row": points.column("row").take(at), "kid": ids.take(pa.array(found_k, pa.int64())), "dist": pa.array(found_d, pa.float64())})

    def meet(chosen: DataFrame) -> DataFrame:
        """Points and keys of a ball, in groups of some POINTS points and a part of the keys."""
        chosen = stored(chosen, "chosen")
        sizes = chosen.groupBy("ball").agg(F.ceil(F.count(F.lit(1)) / POINTS).alias("lots"))
        parts = index.keys.groupBy("ball").agg((F.max("part") + 1).alias("parts"))
        groups = sizes.join(parts, "ball")
        left = chosen.join(groups, "ball").withColumn("lot", F.pmod(F.xxhash64("row"), F.col("lots"))).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)))
        right = index.keys.join(groups, "ball").withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lots").cast("long") - 1)))
        key = ["ball", "part", "lot"]
        left, right = left.select(F.col("part").cast("long").alias("part"), "ball", "lot", "pid", "v", "row", "bound", "away"), right.select(F.col("part").cast("long").alias("part"), "ball", "lot", "kid", "v", "far")
        return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(compare, f"pid {pid}, row long, kid {kid}, dist double")

    place = F.row_number().over(Window.partitionBy("row").orderBy("dist", "kid"))
    schema = f"pid {pid}, v array<double>, row long, bound double, away double, ball long"
    first = stored(meet(rows.select("pid", "v", "row").mapInArrow(choose(True), schema)).withColumn("place", place).where(F.col("place") <= k), "first")
    bound = first.where(F.col("place") == k).select("row", F.col("dist").alias("bound"))
    rest = meet(rows.join(bound, "row", "left").select("pid", "v", "row", "bound").mapInArrow(choose(False), schema))
    return first.drop("place").unionByName(rest).withColumn("place", place.cast("long")).where(F.col("place") <= k).select("pid", "kid", "dist", "place")
