"""Vectors, distributions and key-value states as columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def norm(v: Column) -> Column:
    """Euclidean length, in doubles."""
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def scaled(v: Column, by: Column) -> Column:
    return F.transform(v, lambda x: x * by)


def clamped(v: Column, most: Column) -> Column:
    """The vector, shortened to about the length `most` if it is longer."""
    length = norm(v)
    return F.when(length > most, scaled(v, most / (length + 1e-8))).otherwise(scaled(v, F.lit(1.0)))


def layer_share(target: Column, now: Column, layers: int, layer: int) -> Column:
    """What layer number `layer` of `layers` has to add: the difference over the layers that are left."""
    return F.zip_with(target, now, lambda a, b: (a - b) / (layers - layer))


def unselected(size: Column, selected: Column) -> Column:
    """The positions 0 to size - 1 that are not selected."""
    return F.when(size > 0, F.array_except(F.sequence(F.lit(0), size - 1), selected)).otherwise(F.array().cast("array<int>"))


def pooled(vectors: Column, mask: Column) -> Column:
    """The mean of an array of vectors where the mask is not 0, at unit length; the shared length of the vectors is that of the first."""
    kept = F.transform(F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda x: x["m"] != 0), lambda x: x["v"])
    zero = F.transform(F.element_at(vectors, 1), lambda x: F.lit(0.0))
    total = F.aggregate(kept, zero, lambda s, v: F.zip_with(s, v, lambda a, b: a + b))
    return F.transform(scaled(total, 1 / F.greatest(F.size(kept), F.lit(1))), lambda x: x / F.greatest(norm(scaled(total, 1 / F.greatest(F.size(kept), F.lit(1)))), F.lit(1e-8)))


def top_k(df: DataFrame, by: Sequence[str], probability: str, k: int, order: str, renormalise: bool = False) -> DataFrame:
    """The k most probable rows of each group, ties by `order`, with their place; renormalised to sum to 1 if asked."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(probability), order))
    best = df.withColumn("place", place.cast("long")).where(F.col("place") <= k)
    return best.withColumn(probability, F.col(probability) / F.sum(probability).over(Window.partitionBy(*by))) if renormalise else best


def sample_portion(df: DataFrame, p: float, seed: int = 0) -> DataFrame:
    """Each row with probability p."""
    return df.sample(fraction=p, seed=seed)


def auxiliary(df: DataFrame, key: str, k: int = 20, seed: int = 0) -> DataFrame:
    """k rows drawn by seeded hashes of the key: the same rows whatever the partitions."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(k)


def push_prefix(prefix: str, state: Column) -> Column:
    """A map with `prefix.` before every key."""
    return F.transform_keys(state, lambda k, _: F.concat(F.lit(prefix + "."), k))


def pull_prefix(prefix: str, state: Column) -> Column:
    """The entries whose key begins with `prefix.`, without it."""
    mark = prefix + "."
    return F.transform_keys(F.map_filter(state, lambda k, _: k.startswith(mark)), lambda k, _: F.substr(k, F.lit(len(mark) + 1)))


def flattened(nested: Column, depth: int = 1) -> Column:
    """An array of arrays as one array, `depth` levels down."""
    for _ in range(depth):
        nested = F.flatten(nested)
    return nested


def restored(flat: Column, width: int) -> Column:
    """An array as rows of `width` values."""
    n = F.floor(F.size(flat) / width).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(flat, i * width + 1, F.lit(width)))).otherwise(F.array().cast("array<array<double>>"))


def dereference(samples: DataFrame, chosen: DataFrame, index: str = "idx") -> DataFrame:
    """The rows of samples whose index is among the chosen places."""
    return samples.join(chosen.select(index).distinct(), index, "left_semi")


def span_mean(vectors: Column, start: Column, end: Column) -> Column:
    """The mean of the vectors at places start to end - 1; null where there is none."""
    part = F.slice(vectors, start + 1, F.greatest(end - start, F.lit(0)))
    total = F.aggregate(part, F.transform(F.element_at(part, 1), lambda x: F.lit(0.0)), lambda s, v: F.zip_with(s, v, lambda a, b: a + b))
    return F.when(F.size(part) > 0, scaled(total, 1 / F.size(part)))


def encoder(first: np.ndarray, first_bias: np.ndarray, second: np.ndarray, second_bias: np.ndarray, slope: float = 0.5) -> Callable[[Column], Column]:
    """A column function: linear, leaky rectifier, linear, with given weights (rows are outputs)."""

    @F.pandas_udf("array<double>")
    def encode(vectors: pd.Series) -> pd.Series:
        x = np.stack(vectors.to_numpy()) @ first.T + first_bias if len(vectors) else np.zeros((0, len(first_bias)))
        return pd.Series(list(np.where(x > 0, x, slope * x) @ second.T + second_bias))

    return encode


def improvements(losses: DataFrame, by: Sequence[str], step: str, loss: str, least: float = 0.0) -> DataFrame:
    """losses with `best`, the least loss so far, and `improved`: whether a step is lower than all before it by over `least`."""
    before = Window.partitionBy(*by).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    low = F.min(loss).over(before)
    return losses.withColumns({"best": F.least(F.coalesce(low, F.col(loss)), F.col(loss)), "improved": low.isNull() | (F.col(loss) < low - least)})
