"""Running statistics over streams: per micro-batch partial states, merged into a small state table.

A batch's partial state is written under its batch id, replacing any earlier try, so a replayed batch counts once.
Reading merges the partials; compact() folds those of finished batches into one folder, `upto=<batch>`. A reader takes the
last whole such folder and the batches after it, so a compaction that is broken off changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from evoframe.sources.folders import Numbered


def partial(df: DataFrame, by: Sequence[str], value: str, sketch_k: int = 3072) -> DataFrame:
    """(by..., n, mean, m2, lo, hi, sketch): a state that merges with others."""
    x = F.col(value).cast("double")
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(x).alias("mean"), (F.var_pop(x) * F.count(value)).alias("m2"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.expr(f"kll_sketch_agg_double(cast({value} as double), {sketch_k})").alias("sketch"))


def merge(states: DataFrame, by: Sequence[str]) -> DataFrame:
    """The state of all rows behind the given states. Spreads between states are taken around the common mean, not as a
    difference of large sums."""
    own = Window.partitionBy(*by)
    live = states.where("n > 0").withColumn("whole", F.sum(F.col("n") * F.col("mean")).over(own) / F.sum("n").over(own))
    off = F.col("mean") - F.col("whole")
    return live.groupBy(*by).agg(F.sum("n").alias("n"), F.first("whole").alias("mean"), F.sum(F.col("m2") + F.col("n") * off * off).alias("m2"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.expr("kll_merge_agg_double(sketch)").alias("sketch"))


def read_out(states: DataFrame, by: Sequence[str], quantiles: Sequence[float] = (0.5,)) -> DataFrame:
    """count, mean, unbiased variance and deviation, min, max, and quantiles of states."""
    var: Column = F.when(F.col("n") > 1, F.col("m2") / (F.col("n") - 1))
    found = [F.expr(f"kll_sketch_get_quantile_double(sketch, {q}D)").alias(f"q{q:g}".replace(".", "_")) for q in quantiles]
    return states.select(*by, "n", "mean", var.alias("variance"), F.sqrt(var).alias("stdev"), "lo", "hi", *found)


class RunningStats:
    """Statistics of a stream, kept in the folder `path`."""

    def __init__(self, spark: SparkSession, path: str, by: Sequence[str], value: str):
        self.spark, self.path, self.by, self.value = spark, path.rstrip("/"), list(by), value

    def add(self, batch: DataFrame, batch_id: int) -> None:
        if batch_id > self._compacted():  # an older one is in the compacted state
            partial(batch, self.by, self.value).write.mode("overwrite").parquet(f"{self.path}/batch_id={batch_id}")

    def _folders(self, name: str) -> dict[int, str]:
        """The whole folders `name=<number>`."""
        return Numbered(self.spark, self.path, name).folders()

    def _compacted(self) -> int:
        return max(self._folders("upto"), default=-1)

    def compact(self, upto: int | None = None) -> None:
        """Fold the batches up to `upto` (default: all) into one state. Only batches that will not be replayed may be folded."""
        last, batches = self._compacted(), self._folders("batch_id")
        upto = max(batches, default=last) if upto is None else upto
        fold = [path for i, path in batches.items() if last < i <= upto]
        if not fold:
            return
        old = self._folders("upto")
        merge(self.spark.read.parquet(*fold, *([old[last]] if old else [])), self.by).write.mode("overwrite").parquet(f"{self.path}/upto={upto}")
        for path in [*(p for i, p in batches.items() if i <= upto), *(p for i, p in old.items() if i < upto)]:
            gone = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            gone.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(gone, True)

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def states(self) -> DataFrame | None:
        last, old = self._compacted(), self._folders("upto")
        paths = [p for i, p in self._folders("batch_id").items() if i > last] + ([old[last]] if old else [])
        return self.spark.read.parquet(*paths) if paths else None

    def result(self, quantiles: Sequence[float] = (0.5,)) -> DataFrame:
        states = self.states()
        if states is None:
            raise ValueError("no batch has been added")
        return read_out(merge(states, self.by), self.by, quantiles)
