"""Nearest-key codebook: lookup under per-key radii, and ordered maintenance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .retrieval import nearest


def lookup(queries: DataFrame, book: DataFrame, query_id: str, vector: str) -> DataFrame:
    """(query_id, key_id, dist, hit): the nearest key, and whether it lies within that key's radius."""
    one = nearest(queries, book, 1, query_id, "key_id", vector, "key")
    return one.join(book.select("key_id", "eps"), "key_id").select(query_id, "key_id", "dist", (F.col("dist") <= F.col("eps")).alias("hit"))


def delete(book: DataFrame, edit_id: str) -> DataFrame:
    return book.where(~F.col("edit_id").eqNullSafe(edit_id))


class Book:
    """Keys, radii and labels of one codebook; entries are added in order."""

    def __init__(self, eps: float, expand: str = "coverage"):
        if expand not in ("coverage", "moving_average"):
            raise ValueError(expand)
        self.eps0, self.expand = eps, expand
        self._rows = np.zeros((0, 0))  # grows by doubling; the first len(eps) rows are keys
        self.eps: list[float] = []
        self.labels: list[float] = []
        self.ids: list = []

    def add(self, key: np.ndarray, label: float, edit_id) -> str:
        """Insert, split or expand; what was done."""
        if not self.eps:
            return self._insert(key, label, edit_id, self.eps0)
        dist = np.sqrt(((self.keys - key) ** 2).sum(1))
        i = int(dist.argmin())
        d = float(dist[i])
        if d > self.eps0 + self.eps[i]:
            return self._insert(key, label, edit_id, self.eps0)
        if self.labels[i] != label:
            self.eps[i] = d / 2 - 1e-5  # the two radii meet halfway
            self._insert(key, label, edit_id, d / 2)
            return "split"
        if d > self.eps[i]:
            if self.expand == "moving_average":
                self.keys[i] = 0.5 * self.keys[i] + 0.5 * key
            self.eps[i] = d
            return "expand"
        return "keep"

    @property
    def keys(self) -> np.ndarray:
        return self._rows[: len(self.eps)]

    def _insert(self, key: np.ndarray, label: float, edit_id, eps: float) -> str:
        n = len(self.eps)
        if n >= len(self._rows):
            rows = np.zeros((max(16, 2 * n), len(key)))
            rows[:n] = self._rows[:n] if n else 0
            self._rows = rows
        self._rows[n] = key
        self.eps.append(eps), self.labels.append(label), self.ids.append(edit_id)
        return "insert"


def build(edits: DataFrame, group: str, order: str, vector: str, label: str, edit_id: str, eps: float = 1.0, expand: str = "coverage") -> DataFrame:
    """(group, key_id, key, eps, label, edit_id): one codebook per group, from its edits in order.

    Each addition sees the ones before, so a group is one pass; groups run apart. Rows stream through the task.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, book = None, None

        def out() -> pd.DataFrame:
            return pd.DataFrame({"grp": name, "key_id": range(len(book.keys)), "key": [k.tolist() for k in book.keys], "eps": book.eps, "label": book.labels, "edit_id": book.ids})

        for frame in frames:
            for g, v, lab, e in zip(frame["grp"], frame["v"], frame["label"], frame["edit_id"]):
                if book is None or g != name:
                    if book is not None:
                        yield out()
                    name, book = g, Book(eps, expand)
                book.add(np.asarray(v, np.float64), float(lab), e)
        if book is not None:
            yield out()

    rows = edits.where(F.col(vector).isNotNull()).select(F.col(group).cast("string").alias("grp"), F.col(order).alias("o"), F.col(vector).cast("array<double>").alias("v"), F.col(label).cast("double").alias("label"), F.col(edit_id).cast("string").alias("edit_id"))
    rows = rows.repartition("grp").sortWithinPartitions("grp", "o").drop("o")
    return rows.mapInPandas(run, "grp string, key_id long, key array<double>, eps double, label double, edit_id string")
