"""Incremental statistics as mergeable aggregates.

Each read-out is one aggregation. Matrices are long: (i, j, value) rows from one pass over the wide columns. Partial
states (count, mean, M2, min, max, sketch) can be saved, merged and continued; see streaming/running.py.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations_with_replacement, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evoframe.sources.stored import stored


def summary(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """count, mean, unbiased variance and deviation, min and max of each column: many statistics, one pass."""
    aggs = []
    for c in columns:
        x = F.col(c).cast("double")
        aggs += [F.count(c).alias(f"{c}_n"), F.avg(x).alias(f"{c}_mean"), F.var_samp(x).alias(f"{c}_var"), F.stddev_samp(x).alias(f"{c}_std"), F.min(x).alias(f"{c}_min"), F.max(x).alias(f"{c}_max")]
    return df.groupBy(*by).agg(*aggs)


def _long(df: DataFrame, cells: list[tuple[str, str, list[Column]]], names: list[str]) -> DataFrame:
    """One aggregation, then one row (i, j, names...) per cell."""
    flat = [c.alias(f"v{i}_{k}") for i, (_, _, values) in enumerate(cells) for k, c in enumerate(values)]
    one = df.agg(*flat)
    rows = [F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), *(F.col(f"v{i}_{k}").alias(n) for k, n in enumerate(names))) for i, (a, b, _) in enumerate(cells)]
    return one.select(F.inline(F.array(*rows)))


def _d(c: str) -> Column:
    return F.col(c).cast("double")


def covariance(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(i, j, cov, cov_pop, corr) for i <= j in the order of `columns`."""
    cells = [(a, b, [F.covar_samp(_d(a), _d(b)), F.covar_pop(_d(a), _d(b)), F.corr(_d(a), _d(b))]) for a, b in combinations_with_replacement(columns, 2)]
    return _long(df, cells, ["cov", "cov_pop", "corr"])


def second_moment(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(i, j, moment): E[x_i x_j], not centred."""
    cells = [(a, b, [F.sum(_d(a) * _d(b)) / F.count(F.lit(1))]) for a, b in combinations_with_replacement(columns, 2)]
    return _long(df, cells, ["moment"])


def cross_covariance(df: DataFrame, left: Sequence[str], right: Sequence[str]) -> DataFrame:
    """(i, j, cov, corr) of the block left x right; an undefined correlation is 0."""
    cells = [(a, b, [F.covar_samp(_d(a), _d(b)), F.coalesce(F.nanvl(F.corr(_d(a), _d(b)), F.lit(0.0)), F.lit(0.0))]) for a, b in product(left, right)]
    return _long(df, cells, ["cov", "corr"])


def positive(c: Column) -> Column:
    """1 where a value is above 0 (or true), else 0; NaN and null are 0."""
    x = c.cast("double")
    return F.when((x > 0) & ~F.isnan(x), 1).otherwise(0)


def iou(df: DataFrame, left: dict[str, Column], right: dict[str, Column] | None = None) -> DataFrame:
    """(i, j, shared, iou) of where two features are positive: within one set (i <= j) or across two."""
    pairs = combinations_with_replacement(left, 2) if right is None else product(left, right)
    cells = []
    for a, b in pairs:
        x, y = positive(left[a]), positive((right or left)[b])
        both = F.sum(x * y)
        cells.append((a, b, [both, both / (F.sum(x) + F.sum(y) - both + F.lit(1e-20))]))
    return _long(df, cells, ["shared", "iou"])


def bincount(df: DataFrame, column: str) -> DataFrame:
    """(bin, n) for every bin 0..max, empty ones with 0."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    bins = counts.agg(F.max("bin").alias("m")).where("m is not null").select(F.explode(F.sequence(F.lit(0).cast("long"), "m")).alias("bin"))
    return bins.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def norm_mean(df: DataFrame, vector: str, by: Sequence[str] = ()) -> DataFrame:
    norm = F.sqrt(F.aggregate(F.col(vector), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return df.groupBy(*by).agg(F.avg(norm).alias("norm_mean"))


def _met(a: DataFrame, b: DataFrame, by: Sequence[str]) -> DataFrame:
    """An inner join on `by` in which null is a group like others."""
    same = {c: f"__{c}" for c in by}
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(same[c]))
    return a.join(b.withColumnsRenamed(same), on).drop(*same.values())


def ranked(df: DataFrame, column: str, by: Sequence[str] = (), buckets: int = 64) -> DataFrame:
    """(by..., x, n, last, total, bucket): distinct values with their count, last rank and the group's size.

    Ranks are global without sorting a group in one task: values are counted first, so a frequent one is one row;
    approximate cut points deal the values to buckets; ranks inside a bucket are offset by the buckets before. The cut
    points depend on the order in which sketches meet, so they are stored: sizes and ranks have to be of the same buckets.
    """
    by = list(by)
    values = stored(df.where(F.col(column).isNotNull()).groupBy(*by, _d(column).alias("x")).agg(F.count(F.lit(1)).alias("n")), "values")
    cuts = stored(values.groupBy(*by).agg(F.percentile_approx("x", [i / buckets for i in range(1, buckets)], 1000).alias("cuts"), F.sum("n").alias("total")), "cuts")
    placed = _met(values, cuts, by) if by else values.crossJoin(F.broadcast(cuts))  # without groups: one row
    placed = placed.withColumn("bucket", F.size(F.filter("cuts", lambda c: c < F.col("x")))).drop("cuts")
    sizes = placed.groupBy(*by, "bucket").agg(F.sum("n").alias("in_bucket"))
    before = sizes.withColumn("before", F.coalesce(F.sum("in_bucket").over(Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("in_bucket")
    inside = Window.partitionBy(*by, "bucket").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    return _met(placed.withColumn("run", F.sum("n").over(inside)), before, [*by, "bucket"]).select(*by, "x", "n", (F.col("before") + F.col("run")).alias("last"), "total", "bucket")


def _values_at(r: DataFrame, places: DataFrame, by: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """(by..., keys..., value): the values at fractional `place`s of stored ranks, linear between neighbours.

    A place's bucket is found among the few buckets of its group; then place and values meet by bucket.
    """
    by = list(by)
    whole = places.select(*by, *keys, F.floor("place").alias("low"), (F.col("place") - F.floor("place")).alias("part"))
    whole = whole.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))).where("k = 0 or part > 0").withColumn("rank", F.col("low") + F.col("k"))
    ends = r.groupBy(*by, "bucket").agg(F.max("last").alias("end"), F.sum("n").alias("size"))
    held = _met(whole, ends, by) if by else whole.crossJoin(F.broadcast(ends))  # without groups: one row for each bucket
    held = held.where("rank <= end and rank > end - size").drop("end", "size")
    met = _met(r.select(*by, "bucket", "x", "n", "last"), held, [*by, "bucket"]).where("rank <= last and rank > last - n")
    weight = F.when(F.col("k") == 0, 1 - F.col("part")).otherwise(F.col("part"))
    return met.groupBy(*by, *keys).agg(F.sum(weight * F.col("x")).alias("value"))


def hazen_quantile(df: DataFrame, column: str, at: Sequence[float] | Column, by: Sequence[str] = ()) -> DataFrame:
    """(by..., q, value): knots (r - 0.5) / n, linear between them, min and max outside."""
    by = list(by)
    points = at if isinstance(at, Column) else F.array(*[F.lit(float(q)) for q in at])
    r = stored(ranked(df, column, by), "ranks")
    groups = r.groupBy(*by).agg(F.max("total").alias("total")).select(*by, "total", F.explode(points).alias("q"))
    place = F.least(F.greatest(F.col("q") * F.col("total") + 0.5, F.lit(1.0)), F.col("total").cast("double"))
    return _values_at(r, groups.withColumn("place", place), by, ["q"])


def hazen_rank(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., x, rank01): the quantile of each distinct value; tied values take the middle of their knots."""
    r = ranked(df, column, by)
    return r.select(*by, "x", ((F.col("last") - F.col("n") / 2) / F.col("total")).alias("rank01"))


def kll_quantile(df: DataFrame, column: str, at: Sequence[float], by: Sequence[str] = (), k: int = 3072) -> DataFrame:
    """(by..., q, value) from a native KLL sketch of k."""
    sketch = df.groupBy(*by).agg(F.expr(f"kll_sketch_agg_double(cast({column} as double), {k})").alias("s"))
    found = F.array(*[F.struct(F.lit(float(q)).alias("q"), F.expr(f"kll_sketch_get_quantile_double(s, {float(q)}D)").alias("value")) for q in at])
    return sketch.select(*by, F.inline(found))


def top_k(df: DataFrame, column: str, k: int, tie: str, by: Sequence[str] = (), largest: bool = True) -> DataFrame:
    """The k rows of largest (or smallest) value per group, ties by `tie`, with their place from 1."""
    order = F.desc(column) if largest else F.asc(column)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(order, tie))
    return df.where(F.col(column).isNotNull()).withColumn("place", place.cast("long")).where(F.col("place") <= k)


def history(df: DataFrame, value: str, order: Sequence[str], by: Sequence[str]) -> DataFrame:
    """(by..., values): the values of each group in arrival order, in one row; a group has to fit into a row."""
    held = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("__v"))))
    return df.groupBy(*by).agg(F.transform(held, lambda s: s["__v"]).alias("values"))


def iqr_scaled(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., iqr, spread): type-7 interquartile range, and the mean over iqr + 1e-8."""
    by = list(by)
    r = stored(ranked(df, column, by), "ranks")
    groups = r.groupBy(*by).agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("mean"), F.max("total").alias("total"))
    places = groups.select(*by, "mean", F.explode(F.array(F.lit(0.25), F.lit(0.75))).alias("q"), "total").withColumn("place", (F.col("total") - 1) * F.col("q") + 1)
    found = _values_at(r, places, by, ["q", "mean"])
    iqr = F.sum(F.when(F.col("q") == 0.75, F.col("value")).otherwise(-F.col("value")))
    return found.groupBy(*by).agg(iqr.alias("iqr"), (F.first("mean") / (iqr + 1e-8)).alias("spread"))


def integrate(df: DataFrame, expression: Column, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.sum(expression).alias("integral"))


def weighted_mean(df: DataFrame, value: Column, weight: Column, by: Sequence[str] = ()) -> DataFrame:
    """-sum(value * weight) / max(sum(weight), 1)"""
    return df.groupBy(*by).agg((-F.sum(value * weight) / F.greatest(F.sum(weight), F.lit(1.0))).alias("weighted"))


def gram(df: DataFrame, vector: str, dim: int) -> DataFrame:
    """(n, gram array<double> of dim * dim): sum of x x^T, from one partial matrix per task."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((dim, dim)), 0
        for b in batches:
            c = b.column(0).drop_null()
            if len(c):
                x = np.asarray(c.flatten(), np.float64).reshape(len(c), dim)
                total += x.T @ x
                n += len(c)
        if n:
            i, j = np.divmod(np.arange(dim * dim), dim)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel()), pa.array(np.full(dim * dim, n))], ["i", "j", "value", "n"])

    parts = df.where(F.size(vector) == dim).select(F.col(vector).cast("array<double>")).mapInArrow(partial, "i long, j long, value double, n long")
    return parts.groupBy("i", "j").agg((F.sum("value") / F.sum("n")).alias("moment"))


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 1) -> DataFrame:
    """The n rows of smallest seeded hash: a fixed sample whatever the partitions."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def ridge(moment: np.ndarray, keys: np.ndarray, weight: float) -> np.ndarray:
    """weight * C + K K^T on the driver, for a d x d matrix."""
    return weight * moment + keys @ keys.T


def null_projector(moment: np.ndarray, weight: float) -> np.ndarray:
    """I - C (weight I + C)^-1 C on the driver."""
    eye = np.eye(len(moment))
    return eye - moment @ np.linalg.solve(weight * eye + moment, moment)
