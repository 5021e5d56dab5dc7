"""Prebuilt graph files and graph tables, vector stores, saved states and sources of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .folders import Numbered, whole
from .json_arrays import elements

#: A graph of a file (fixed values of its format); whatever a node or an edge has is text.
GRAPH = "struct<nodes: array<map<string,string>>, edges: array<map<string,string>>, api: map<string,string>>"


def read_graphs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """(graphs, nodes, edges) of a JSON array of graphs, or None without such a file.

    graphs are (graph_id, valid, api): graph_id is the place in the file, and a graph that could not be built is not valid.
    Nodes have their id, type and name beside the map of the rest; edges have src, dst and type.
    """
    try:
        found = elements(spark, path)
    except AnalysisException:
        return None
    rows = found.select(F.col("idx").alias("graph_id"), F.when(F.col("value") != "null", F.from_json("value", GRAPH)).alias("g"))
    graphs = rows.select("graph_id", F.col("g").isNotNull().alias("valid"), "g.api")
    nodes = rows.select("graph_id", F.posexplode("g.nodes").alias("pos", "x")).select("graph_id", F.col("x")["id"].alias("node_id"), F.coalesce(F.col("x")["type"], F.lit("")).alias("type"), F.col("x")["name"].alias("name"), F.col("pos").cast("long").alias("pos"), F.map_filter("x", lambda k, v: ~k.isin("id", "type", "name")).alias("attrs"))
    edges = rows.select("graph_id", F.explode("g.edges").alias("x")).select("graph_id", F.col("x")["from"].alias("src"), F.col("x")["to"].alias("dst"), F.coalesce(F.nullif(F.col("x")["type"], F.lit("")), F.nullif(F.col("x")["relation"], F.lit("")), F.lit("relates")).alias("type"))
    return graphs, nodes.where("node_id <> ''"), edges


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: graphs, nodes, edges and their means per graph."""
    n = nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("nodes"))
    e = edges.groupBy("graph_id").agg(F.count(F.lit(1)).alias("edges"))
    each = n.join(e, "graph_id", "left").select("nodes", F.coalesce("edges", F.lit(0)).alias("edges"))
    count = F.count(F.lit(1))
    return each.agg(count.alias("graphs"), F.coalesce(F.sum("nodes"), F.lit(0)).alias("nodes"), F.coalesce(F.sum("edges"), F.lit(0)).alias("edges"), (F.coalesce(F.sum("nodes"), F.lit(0)) / F.greatest(count, F.lit(1))).alias("mean_nodes"), (F.coalesce(F.sum("edges"), F.lit(0)) / F.greatest(count, F.lit(1))).alias("mean_edges"))


def write_graphs(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """nodes, edges and stats as Parquet under a path."""
    for name, table in (("nodes", nodes), ("edges", edges), ("stats", graph_stats(nodes, edges))):
        table.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")


def with_graph(samples: DataFrame, graphs: DataFrame, key: str = "idx") -> DataFrame:
    """Each sample with has_graph: whether the graph of its place is valid."""
    known = graphs.where("valid").select(F.col("graph_id").alias(key), F.lit(True).alias("has_graph")).distinct()
    return samples.join(known, key, "left").withColumn("has_graph", F.coalesce("has_graph", F.lit(False)))


class VectorStore:
    """Embedded texts in a folder, in versions: documents that are not there yet are embedded and added."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.versions = spark, Numbered(spark, path, "version")

    def open_or_build(self, docs: DataFrame, text: str, embed: Callable[[Sequence[str]], Sequence[Sequence[float]]], batch: int = 100) -> DataFrame:
        """docs with `vector`: read for the rows that are stored, embedded by `embed`, `batch` texts at a time, and stored for
        the others. Rows are told apart by a digest of all their columns."""

        @F.pandas_udf("array<double>")
        def vectors(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for part in parts:
                yield pd.Series([[float(x) for x in v] for s in range(0, len(part), batch) for v in embed(part.iloc[s : s + batch].fillna("").tolist())], index=part.index)

        known = self.versions.folders()
        keyed = docs.withColumn("row_key", F.sha2(F.to_json(F.struct(*docs.columns), {"ignoreNullFields": "false"}), 256))
        new = keyed.join(self.versions.read().select("row_key").distinct(), "row_key", "left_anti") if known else keyed
        if not (known and new.isEmpty()):
            fresh = new.dropDuplicates(["row_key"]).select("row_key", vectors(F.col(text)).alias("vector"))
            self.versions.write(fresh, max(known, default=-1) + 1)
        return keyed.join(self.versions.read(), "row_key").select(*docs.columns, "vector")


def resolve(spark: SparkSession, state: str | DataFrame | None) -> DataFrame | None:
    """A saved state by its path, or the state itself; None without one, or if it was not written to its end."""
    if state is None or isinstance(state, DataFrame):
        return state
    return spark.read.parquet(state) if whole(spark, state) else None


def source(spark: SparkSession, rows: DataFrame | Callable[[], DataFrame] | pd.DataFrame, size: int | None = None, seed: int | None = None, order: str = "idx") -> DataFrame:
    """Rows of a table, a function that makes one or a frame; the first `size` by `order`, or by seeded hashes of it."""
    made = rows() if callable(rows) else rows
    made = spark.createDataFrame(made) if isinstance(made, pd.DataFrame) else made
    if size is None:
        return made
    by = [order] if seed is None else [F.xxhash64(F.lit(seed), F.col(order)), order]
    return made.orderBy(*by).limit(size)


def subset(df: DataFrame, rule: Column | Callable[[DataFrame], Column]) -> DataFrame:
    """The rows of a class, by a predicate."""
    return df.where(rule(df) if callable(rule) else rule)


def map_rows(df: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """f over batches of rows, side by side on all executors, in no order."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from map(f, frames)

    return df.mapInPandas(run, schema)


def corpus_stat(store, corpus: DataFrame, stat: Callable[[DataFrame], DataFrame], size: int | None = None, seed: int = 1, order: str = "idx", **parameters) -> DataFrame:
    """A statistic of a sampled corpus, by its parameters from a StateStore or computed and stored."""
    return store.get(lambda: stat(source(corpus.sparkSession, corpus, size, seed, order)), size=size, seed=seed, **parameters)
