"""Near-duplicate vectors by an exact metric range join.

Unit vectors lie in a metric space (chord length); cosine >= t is chord <= r = sqrt(2 - 2t). Each vector's home is the
cell of its nearest pivot. By the triangle inequality a vector y linked to a member of pivot p's cell has
d(y, p) <= d(y, home(y)) + 2r and d(y, p) <= radius(p) + r, so y is replicated to the cells where both hold; each cell
then joins alone. Of two cells that reach into one another, a hash of both says which one takes the other's vectors, so
each pair meets exactly once and no cell takes them all. Cells of many vectors are split by a salt into chunks of
`cell_rows`, which is how a hot direction is spread.

Cosines are taken in single precision first; the error of such a sum over `dim` products of unit vectors is under
(dim + 4) * 2 ** -24, and pairs nearer than twice that to the threshold are decided in double precision.

Cases: a null, empty, zero or non-finite vector, or one with a null component, links with nothing and is its own
component. A shorter vector counts as padded with zeros. Rows that repeat an id are one vector, the least of theirs. A vector
without id links with nothing and has no component; each such row is kept. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, connected_components, mix, returning


def _vectors(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, dim) doubles and which rows are usable."""
    n = len(column)
    valid = np.asarray(column.is_valid())
    at = np.asarray(column.offsets, np.int64)
    flat = column.values
    holes = np.asarray(flat.is_null()) if flat.null_count else None
    flat = np.asarray(flat.fill_null(0.0) if flat.null_count else flat, np.float64)
    size = np.where(valid, np.diff(at), 0)
    if n and (size == dim).all():
        x = flat[at[0] : at[-1]].reshape(n, dim).copy()
        bad = holes[at[0] : at[-1]].reshape(n, dim).any(1) if holes is not None else np.zeros(n, bool)
    else:
        x, bad = np.zeros((n, dim)), np.zeros(n, bool)
        for i in range(n):
            s, e = at[i], at[i] + size[i]
            x[i, : e - s] = flat[s:e]
            bad[i] = holes is not None and holes[s:e].any()
    with np.errstate(all="ignore"):
        norm = np.sqrt((x * x).sum(1))
        finite = np.isfinite(x).all(1)
        wild = finite & ~((norm > 1e-150) & (norm < 1e150)) & (np.abs(x).max(1, initial=0) > 0)
        if wild.any():  # scale first where squares leave the range of doubles
            x[wild] /= np.abs(x[wild]).max(1, keepdims=True)
            norm[wild] = np.sqrt((x[wild] ** 2).sum(1))
    return x, valid & ~bad & finite & (norm > 0)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


def _chords(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * (x @ pivots.T)))


def choose_pivots(sample: np.ndarray, most: int) -> np.ndarray:
    """Farthest-first traversal over unit vectors."""
    chosen = [0]
    near = _chords(sample, sample[:1])[:, 0]
    while len(chosen) < min(most, len(sample)):
        far = int(near.argmax())
        if near[far] <= 1e-9:
            break
        chosen.append(far)
        near = np.minimum(near, _chords(sample, sample[far : far + 1])[:, 0])
    return sample[chosen]


class _Cell:
    """The home chunk of one cell, and what its visitors link to."""

    def __init__(self, threshold: float, dim: int):
        self.t, self.ids, self.rows, self.ready = threshold, [], [], False
        self.band = 2 * (dim + 4) * 2.0**-24

    def links(self, a: np.ndarray, b: np.ndarray, a32: np.ndarray, b32: np.ndarray) -> np.ndarray:
        near = a32 @ b32.T
        hit = near >= self.t
        i, j = np.nonzero(np.abs(near - self.t) < self.band)
        if len(i):
            for s in range(0, len(i), 1 << 16):
                p, q = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
                hit[p, q] = np.einsum("ij,ij->i", a[p], b[q]) >= self.t
        return hit

    def close_home(self) -> list[tuple]:
        self.id = np.concatenate(self.ids) if self.ids else np.zeros(0, np.int64)
        self.x = np.concatenate(self.rows) if self.rows else np.zeros((0, 1))
        order = np.argsort(self.id, kind="stable")
        self.id, self.x, self.ready = self.id[order], self.x[order], True
        self.x32 = self.x.astype(np.float32)
        n = len(self.id)
        self.label, self.count = np.arange(n), np.zeros(n, np.int64)
        if n:
            hit = self.links(self.x, self.x, self.x32, self.x32)
            np.fill_diagonal(hit, False)
            self.count += hit.sum(1)
            busy = np.flatnonzero(self.count)
            hit = hit[np.ix_(busy, busy)]
            label = np.arange(len(busy))
            while len(busy):  # the smallest number reachable spreads until nothing changes
                new = np.minimum(label, np.where(hit, label[None, :], len(busy)).min(1))
                new = new[new]
                if (new == label).all():
                    break
                label = new
            self.label[busy] = busy[label]

    def visit(self, ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        hit = self.links(x, self.x, x.astype(np.float32), self.x32)
        found = hit.sum(1)
        self.count += hit.sum(0)
        rows = np.flatnonzero(found)
        first = hit[rows].argmax(1)
        for r in rows[found[rows] > 1]:
            met = np.unique(self.label[hit[r]])
            if len(met) > 1:
                self.label[np.isin(self.label, met)] = met[0]
        return ids[rows], found[rows].astype(np.int64), self.id[first]


def _takes(cell: int, others: np.ndarray) -> np.ndarray:
    """Whether a cell takes the vectors of each of the others, and not the other way round."""
    low, high = np.minimum(others, cell).astype(np.uint64), np.maximum(others, cell).astype(np.uint64)
    return (others != cell) & (((mix(low << np.uint64(32) | high) & np.uint64(1)) == 0) == (others > cell))


def near_duplicate_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, cell_rows: int = 4096, max_pivots: int = 256, pivot_sample: int = 4096) -> DataFrame:
    """One row per vector: id_col, n_links, component_id, kept. See the module's text for the cases.

    Pivots come from the `pivot_sample` vectors of smallest id hash (a bounded sample: pivots steer cost, never results).
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "vectors")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    table = scratch.save(rows.where("id is not null").groupBy("id").agg(F.min("v").alias("v")), "table")
    result = lambda found: found.unionByName(rows.where("id is null").select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept")))
    total, dim = table.agg(F.count("*"), F.max(F.size("v"))).first()
    dim = max(1, dim or 1)
    radius = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9
    first = table.where("v is not null").orderBy(F.xxhash64("id"), "id").limit(pivot_sample).select("v").toArrow().column(0).combine_chunks()
    first = first.chunk(0) if isinstance(first, pa.ChunkedArray) else first
    x, ok = _vectors(first, dim)
    counts = table.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n"))
    if not ok.any():
        return result(counts.select(id_col, F.col("n").alias("n_links"), F.col(id_col).alias("component_id"), F.lit(True).alias("kept")))
    pivots = choose_pivots(_unit(x[ok]), min(max_pivots, max(1, math.ceil(total / cell_rows))))

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, ok = _vectors(b.column(1), dim)
            if ok.any():
                d = _chords(_unit(x[ok]), pivots)
                yield pa.RecordBatch.from_arrays([pa.array(d.argmin(1).astype(np.int32)), pa.array(d.min(1))], ["p", "d"])

    met = {r.p: r for r in table.mapInArrow(returning(homes), "p int, d double").groupBy("p").agg(F.count("*").alias("n"), F.max("d").alias("r")).collect()}
    used = sorted(met)
    chunks = np.array([math.ceil(met[p].n / cell_rows) for p in used])
    base = np.concatenate([[0], np.cumsum(chunks)])  # chunk s of used[i] is cell base[i] + s
    kept, reach = pivots[used], np.array([met[p].r for p in used]) + radius

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 1024):
                part = b.slice(s, 1024)
                x, ok = _vectors(part.column(1), dim)
                if not ok.any():
                    continue
                x, ids = _unit(x[ok]), np.asarray(part.column(0), np.int64)[ok]
                d = _chords(x, kept)
                home = d.argmin(1)
                cell = base[home] + (mix(ids.astype(np.uint64)) % chunks[home].astype(np.uint64)).astype(np.int64)
                open_ = (d <= d.min(1)[:, None] + 2 * radius) & (d <= reach[None, :] + 1e-9)
                at, to, role = [np.arange(len(ids))], [cell], [np.zeros(len(ids), np.int32)]
                for i in range(len(kept)):
                    who = np.flatnonzero(open_[:, i])
                    for c in range(base[i], base[i + 1]):
                        go = who[_takes(c, cell[who])]
                        if len(go):
                            at.append(go), to.append(np.full(len(go), c)), role.append(np.ones(len(go), np.int32))
                at = np.concatenate(at)
                raw = x[at].tobytes()
                step = dim * 8
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(to)), pa.array(np.concatenate(role)), pa.array(ids[at]), pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer((np.arange(len(at) + 1) * step).astype(np.int32)), pa.py_buffer(raw)])], ["cell", "role", "id", "v"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(ids, n, to):
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(to, pa.int64())], ["id", "n", "to"])

        def end(cell):
            if not cell.ready:
                cell.close_home()
            return out(cell.id, cell.count, cell.id[cell.label])

        cell, now = None, -1
        for b in batches:
            to, role, ids = (np.asarray(b.column(i)) for i in range(3))
            x = np.frombuffer(b"".join(b.column(3).to_pylist()), np.float64).reshape(-1, dim)
            cuts = np.flatnonzero((np.diff(to) != 0) | (np.diff(role) != 0)) + 1
            for s, e in zip([0, *cuts], [*cuts, len(to)]):
                if to[s] != now:
                    if cell is not None:
                        yield end(cell)
                    cell, now = _Cell(threshold, dim), to[s]
                if role[s] == 0:
                    cell.ids.append(ids[s:e]), cell.rows.append(x[s:e])
                    continue
                if not cell.ready:
                    cell.close_home()
                for k in range(s, e, 1024):
                    got = cell.visit(ids[k : min(e, k + 1024)], x[k : min(e, k + 1024)])
                    if len(got[0]):
                        yield out(*got)
        if cell is not None:
            yield end(cell)

    dealt = table.mapInArrow(returning(deal), "cell long, role int, id long, v binary").repartition("cell").sortWithinPartitions("cell", "role")
    found = scratch.save(dealt.mapInArrow(returning(join), "id long, n long, to long").where("n > 0 or id <> to"), "found")
    parts = connected_components(found.select(F.col("id").alias("a"), F.col("to").alias("b")), scratch, rows=total)
    counts = counts.unionByName(found.select(F.col("id").alias(id_col), "n")).groupBy(id_col).agg(F.sum("n").alias("n_links"))
    joined = counts.join(parts.select(F.col("id").alias(id_col), "component"), id_col, "left")
    component = F.coalesce("component", id_col)
    return result(joined.select(id_col, "n_links", component.alias("component_id"), (component == F.col(id_col)).alias("kept")))
