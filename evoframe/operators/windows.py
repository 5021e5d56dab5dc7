"""Token windows, ordered clean-up and batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spans(n: Column, size: int, overlap: int = 0, tail: bool = False) -> Column:
    """array<struct<start, end>> over n tokens: windows of `size` every size - overlap.

    Without `tail` the first window that reaches n is the last; with it, windows start as long as there are tokens.
    """
    step = size - overlap
    last = n - 1 if tail else F.greatest(F.ceil((n - size) / step).cast("int"), F.lit(0)) * step
    starts = F.when(n > 0, F.sequence(F.lit(0), last, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(s + size, n).alias("end")))


def window_hits(df: DataFrame, key: Sequence[str], n: Column, marked: Column, size: int, overlap: int = 0, tail: bool = False) -> DataFrame:
    """(key..., start, end, hits): the windows over n tokens, and how many of the marked positions each holds. A position goes
    to the few windows that hold it by its number; no window looks at the others' positions."""
    step = size - overlap
    made = df.select(*key, F.posexplode(spans(n, size, overlap, tail)).alias("w", "s")).select(*key, F.col("w").cast("long").alias("w"), "s.start", "s.end")
    first, last = F.greatest(F.floor((F.col("p") - size) / step) + 1, F.lit(0).cast("long")), F.floor(F.col("p") / step)
    hit = df.select(*key, F.explode(marked).alias("p")).where("p >= 0").select(*key, F.explode(F.sequence(first, last)).alias("w")).groupBy(*key, "w").agg(F.count(F.lit(1)).alias("hits"))
    return made.join(hit, [*key, "w"], "left").select(*key, "start", "end", F.coalesce("hits", F.lit(0)).cast("long").alias("hits"))


def focus(hits: Column) -> Column:
    return F.when(hits == 0, "skip").otherwise("focus")


def normalised(weights: Column) -> Column:
    """Weights over their mean."""
    mean = F.aggregate(weights, F.lit(0.0), lambda s, x: s + x) / F.size(weights)
    return F.transform(weights, lambda w: w / mean)


def first_wins(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__r = 1").drop("__r")


def padded(tokens: Column, width: Column, fill: int = 0) -> Column:
    return F.concat(tokens, F.array_repeat(F.lit(fill).cast("bigint"), F.greatest(width - F.size(tokens), F.lit(0))))


def unmasked(tokens: Column, mask: Column) -> Column:
    """The tokens whose mask is not 0."""
    return F.transform(F.filter(F.arrays_zip(tokens.alias("t"), mask.alias("m")), lambda x: x["m"] != 0), lambda x: x["t"])


def length_batches(df: DataFrame, id_col: str, length: str, budget: int, groups: int = 1) -> DataFrame:
    """(id, batch, width): greedy batches of descending length whose padded size (rows * longest) is within the budget.

    Lengths are counted first. A run of equal lengths fills batches by arithmetic, so the greedy pass reads one row per
    distinct length; rows then find their batch by their place in the order. Empty rows are in no batch.
    """
    live = df.where(F.col(length) > 0)
    counts = live.groupBy(F.col(length).cast("long").alias("len")).agg(F.count(F.lit(1)).alias("n"))

    def greedy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch, width, used = -1, 0, 0
        for b in batches:
            rows = []
            for size, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                at = 0
                while at < n:
                    if batch < 0 or (used + 1) * width > budget:
                        batch, width, used = batch + 1, size, 0
                        if n - at > (most := max(1, budget // size)):  # several whole batches of one length
                            whole = (n - at) // most
                            rows.append((size, at, whole * most, batch, most, size))
                            batch, at = batch + whole - 1, at + whole * most
                            used = most
                            continue
                    take = min(n - at, max(1, budget // width) - used)
                    rows.append((size, at, take, batch, take, width))
                    used, at = used + take, at + take
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["len", "at", "n", "batch", "each", "width"])

    plan = counts.repartition(1).sortWithinPartitions(F.desc("len")).mapInArrow(greedy, "len long, at long, n long, batch long, each long, width long")
    place = F.row_number().over(Window.partitionBy("len").orderBy(id_col)) - 1
    rows = live.select(id_col, F.col(length).cast("long").alias("len")).withColumn("r", place)
    met = rows.join(plan, "len").where("r >= at and r < at + n")
    return met.select(id_col, (F.col("batch") + F.floor((F.col("r") - F.col("at")) / F.col("each"))).alias("batch"), "width")
