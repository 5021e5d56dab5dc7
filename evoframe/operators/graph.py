"""Property graphs as long tables: nodes(graph_id, node_id, type, ...), edges(graph_id, src, dst, type, ...).

Every operator keeps graph_id in its keys, so one partitioning by graph serves a chain of them.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evoframe.sources.stored import stored

G = "graph_id"


def undirected(edges: DataFrame) -> DataFrame:
    """(graph_id, a, b) both ways, once each."""
    return edges.select(G, F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(edges.select(G, F.col("dst").alias("a"), F.col("src").alias("b"))).distinct()


def k_hop(edges: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """(graph_id, node_id, hops): nodes within k undirected steps of any seed, with the fewest steps.

    Edges are stored once, by node. Each step joins them with the last front, drops what is known and stores the new one.
    """
    around = stored(undirected(edges).repartition(G, "a"), "around")
    front = stored(seeds.select(G, "node_id").distinct().withColumn("hops", F.lit(0)), "front")
    fronts = [front]
    for step in range(1, k + 1):
        known = functools.reduce(DataFrame.unionByName, fronts).select(G, "node_id")
        reached = front.select(G, F.col("node_id").alias("a")).join(around, [G, "a"]).select(G, F.col("b").alias("node_id")).distinct()
        front = stored(reached.join(known, [G, "node_id"], "left_anti").withColumn("hops", F.lit(step)), "front")
        fronts.append(front)
    return functools.reduce(DataFrame.unionByName, fronts)


def prune(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, k: int, always: Column, keep_unseeded: bool) -> tuple[DataFrame, DataFrame]:
    """Nodes within k hops of the graph's seeds or always kept; edges between them.

    A graph without seeds keeps all its nodes if keep_unseeded, else only those always kept.
    """
    near = k_hop(edges, seeds, k).select(G, "node_id").withColumn("near", F.lit(True))
    marked = nodes.join(near, [G, "node_id"], "left").join(seeds.select(G).distinct().withColumn("seeded", F.lit(True)), G, "left")
    keep = F.coalesce("near", F.lit(False)) | always | (F.col("seeded").isNull() if keep_unseeded else F.lit(False))
    kept = marked.where(keep).drop("near", "seeded")
    return kept, endpoints_kept(edges, kept)


def endpoints_kept(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends are both among the nodes."""
    ids = nodes.select(G, "node_id").distinct()
    return edges.join(ids.withColumnRenamed("node_id", "src"), [G, "src"], "left_semi").join(ids.withColumnRenamed("node_id", "dst"), [G, "dst"], "left_semi")


def edge_kinds(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between known nodes, once per (src, dst, type), with the type's number in its graph."""
    kind = F.coalesce("type", "relation", F.lit("relates")) if "relation" in edges.columns else F.coalesce("type", F.lit("relates"))
    one = endpoints_kept(edges.withColumn("type", kind), nodes).dropDuplicates([G, "src", "dst", "type"])
    return one.withColumn("type_id", (F.dense_rank().over(Window.partitionBy(G).orderBy("type")) - 1).cast("long"))


def reversed_edges(edges: DataFrame, types: Sequence[str]) -> DataFrame:
    """The edges, and rev_<type> the other way for the given types."""
    back = edges.where(F.col("type").isin(*types)).select(G, F.col("dst").alias("src"), F.col("src").alias("dst"), F.concat(F.lit("rev_"), "type").alias("type"))
    return edges.select(G, "src", "dst", "type").unionByName(back)


def in_degree_norm(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(graph_id, node_id, degree, norm): in-degree with a self loop for every node, and its power -1/2."""
    loops = nodes.select(G, F.col("node_id").alias("dst"))
    degree = edges.select(G, "dst").unionByName(loops).groupBy(G, "dst").agg(F.count(F.lit(1)).alias("degree"))
    return degree.select(G, F.col("dst").alias("node_id"), "degree", F.pow(F.greatest("degree", F.lit(1)).cast("double"), F.lit(-0.5)).alias("norm"))


def attention(edges: DataFrame, score: Column, value: Column) -> DataFrame:
    """(graph_id, dst, message): softmax of the scores of incoming edges, weighting their values."""
    scored = edges.select(G, "dst", score.alias("s"), value.alias("v"))
    top = scored.groupBy(G, "dst").agg(F.max("s").alias("top"))
    weight = F.exp(F.col("s") - F.col("top"))
    return scored.join(top, [G, "dst"]).groupBy(G, "dst").agg((F.sum(weight * F.col("v")) / F.sum(weight)).alias("message"))


def type_histogram(df: DataFrame, order: str) -> DataFrame:
    """(type, n) by count, then by where the type is first seen in the column `order`."""
    return df.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first")).orderBy(F.desc("n"), "first", "type").drop("first")


def sort_nodes(nodes: DataFrame, ranks: dict[str, int]) -> DataFrame:
    """Nodes by the rank of their type (unknown last), then id."""
    rank = F.lit(len(ranks))
    for name, r in ranks.items():
        rank = F.when(F.col("type") == name, r).otherwise(rank)
    return nodes.withColumn("type_rank", rank).orderBy(G, "type_rank", "node_id")


def sort_edges(edges: DataFrame) -> DataFrame:
    return edges.orderBy(G, "src", "dst", "type")


# A node's shortest telling text, words that tell nothing, and what each category asks for one of.
LEAST_TEXT = 3
EMPTY_WORDS = ("unknown", "placeholder", "none", "empty", "null")
REQUIRED = {"type_dependencies": ("kind", "name"), "api_evolution": ("kind", "type", "name")}


def valid_node(category: str = "generic") -> Column:
    """Whether a node of the columns node_id, type, name and the map attrs says something: one of its texts is long enough
    and no empty word; a placeholder has a purpose or what it connects; a change of an API says what kind it is."""
    of = lambda c: F.coalesce(F.col({"id": "node_id"}.get(c, c)) if c in ("id", "type", "name") else F.try_element_at("attrs", F.lit(c)), F.lit(""))
    low = lambda c: F.trim(F.lower(of(c)))
    told, kind = F.lit(False), F.lower(of("type"))
    for c in ("value", "name", "kind", "type"):
        told = told | (F.length(low(c)) >= LEAST_TEXT) & ~low(c).isin(*EMPTY_WORDS)
    purpose = (F.length(F.trim(of("purpose"))) >= LEAST_TEXT) | (F.length(F.trim(of("connects_to"))) >= LEAST_TEXT)
    known = F.lit(category not in REQUIRED)
    for c in REQUIRED.get(category, ()):
        known = known | (of(c) != "")
    changed = ~kind.isin("change", "transition", "signature") | (of("kind") != "") | (of("changes") != "") if category == "api_evolution" else F.lit(True)
    return (of("id") != "") & known & F.when(kind.contains("placeholder"), purpose).otherwise(told & changed)


def valid_graph(nodes: DataFrame, edges: DataFrame, category: str = "generic") -> tuple[DataFrame, DataFrame]:
    """The nodes that say something, and the edges between them."""
    kept = nodes.where(valid_node(category))
    return kept, endpoints_kept(edges, kept)


def code_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("type").startswith("code_"))


def drop_empty(attrs: Column) -> Column:
    """Map entries without null, '', '[]' or '{}' values."""
    return F.map_filter(attrs, lambda k, v: v.isNotNull() & ~v.isin("", "[]", "{}"))


def drop_debug(attrs: Column) -> Column:
    """Map entries without null and empty values, and without where a node comes from."""
    return F.map_filter(drop_empty(attrs), lambda k, v: ~k.isin("source", "source_role"))


def param_diff(old: DataFrame, new: DataFrame, key: Sequence[str], name: str = "name", kind: str = "type") -> DataFrame:
    """(key..., name, change, old_type, new_type): removed, added or retyped members, by kind and name; self and cls left out."""
    a = old.where(~F.col(name).isin("self", "cls")).select(*key, name, F.col(kind).alias("old_type"), F.lit(1).alias("in_old"))
    b = new.where(~F.col(name).isin("self", "cls")).select(*key, name, F.col(kind).alias("new_type"), F.lit(1).alias("in_new"))
    both = a.join(b, [*key, name], "full_outer")
    change = F.when(F.col("in_new").isNull(), "removed").when(F.col("in_old").isNull(), "added").when(~F.col("old_type").eqNullSafe(F.col("new_type")), "type_changed")
    return both.withColumn("change", change).where("change is not null").select(*key, name, "change", "old_type", "new_type")


def ordinal_zip(left: DataFrame, right: DataFrame, key: Sequence[str], left_order: Sequence[str], right_order: Sequence[str]) -> DataFrame:
    """Rows of both sides of equal place in their key's order."""
    a = left.withColumn("ordinal", F.row_number().over(Window.partitionBy(*key).orderBy(*left_order)).cast("long"))
    b = right.withColumn("ordinal", F.row_number().over(Window.partitionBy(*key).orderBy(*right_order)).cast("long"))
    return a.join(b, [*key, "ordinal"])


def first_match(left: DataFrame, right: DataFrame, on: Sequence[str], order: Sequence[str], left_key: Sequence[str]) -> DataFrame:
    """Each left row with the first right row of equal `on` columns, if any."""
    one = right.withColumn("__r", F.row_number().over(Window.partitionBy(*on).orderBy(*order))).where("__r = 1").drop("__r")
    return left.join(one, list(on))


def running_names(nodes: DataFrame, prefix: str = "prefix", order: str = "pos") -> DataFrame:
    """Unique ids: prefix, prefix_1, prefix_2, ... in order within the graph."""
    n = F.row_number().over(Window.partitionBy(G, prefix).orderBy(order)) - 1
    return nodes.withColumn("unique_id", F.when(n == 0, F.col(prefix)).otherwise(F.concat_ws("_", prefix, n.cast("string"))))


def index_nodes(nodes: DataFrame, edges: DataFrame, order: Sequence[str] = ("node_id",)) -> DataFrame:
    """(graph_id, src_index, dst_index, type): edge ends as places of nodes in their graph, from 0."""
    at = nodes.select(G, "node_id", (F.row_number().over(Window.partitionBy(G).orderBy(*order)) - 1).cast("long").alias("at"))
    src = at.select(G, F.col("node_id").alias("src"), F.col("at").alias("src_index"))
    dst = at.select(G, F.col("node_id").alias("dst"), F.col("at").alias("dst_index"))
    return edges.join(src, [G, "src"]).join(dst, [G, "dst"]).select(G, "src_index", "dst_index", "type")
