"""Half edges, positioned adjacency, degrees and adjacency matrices.

A self loop gives one half edge on an undirected graph; parallel edges give one
each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftgraph.graph import Graph


def half_edges(graph: Graph, direction: str = "both") -> DataFrame:
    """(node, nbr, eid, type, weight): 'out' from src, 'in' from dst, 'both' either way."""
    e = graph.edges
    out = e.select(F.col("src").alias("node"), F.col("dst").alias("nbr"), "eid", "type", "weight")
    back = e.select(F.col("dst").alias("node"), F.col("src").alias("nbr"), "eid", "type", "weight")
    if direction == "out":
        return out
    if direction == "in":
        return back
    return out.unionByName(back.where("node <> nbr"))


def neighbors(graph: Graph, nodes: DataFrame | None = None, *, direction: str = "both", edge_types: Sequence[str] | None = None) -> DataFrame:
    """(node, nbr, type, weight), a row for each edge; directions mean nothing on an undirected graph."""
    half = half_edges(graph, direction if graph.directed else "both")
    if edge_types is not None:
        half = half.where(F.col("type").isin(list(edge_types)))
    if nodes is not None:
        half = half.join(nodes.select(F.col("id").cast("string").alias("node")).distinct(), "node", "left_semi")
    return half.select("node", "nbr", "type", "weight")


def degrees(graph: Graph, direction: str = "both") -> DataFrame:
    """(id, degree): isolated nodes have 0, a self loop counts once."""
    count = half_edges(graph, direction).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    return graph.nodes.select("id").join(count.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def positioned(graph: Graph, direction: str = "both", by: Sequence[str] = ()) -> DataFrame:
    """(node, pos, nbr, eid, type, weight, degree, cum, total): neighbours numbered from 0 by
    (eid, nbr), with running weights; ``by`` numbers them within further columns
    (``type``, ``nbr_type``)."""
    half = half_edges(graph, direction)
    if "nbr_type" in by:
        half = half.join(graph.nodes.select(F.col("id").alias("nbr"), F.col("type").alias("nbr_type")), "nbr")
    group = W.partitionBy("node", *by)
    order = group.orderBy("eid", "nbr")
    return half.select(
        "node", *[c for c in by if c != "type"], (F.row_number().over(order) - 1).alias("pos"), "nbr", "eid", "type", "weight",
        F.count(F.lit(1)).over(group).cast("int").alias("degree"),
        F.sum("weight").over(order.rowsBetween(W.unboundedPreceding, 0)).alias("cum"), F.sum("weight").over(group).alias("total"),
    )


def adjacency_matrix(graph: Graph, *, weighted: bool = False, edge_type: str | None = None) -> DataFrame:
    """(i, j, v): parallel edges add up; symmetric on an undirected graph, loops counted once."""
    half = half_edges(graph, "out" if graph.directed else "both")
    if edge_type is not None:
        half = half.where(F.col("type") == edge_type)
    return half.groupBy(F.col("node").alias("i"), F.col("nbr").alias("j")).agg(F.sum("weight" if weighted else F.lit(1.0)).alias("v"))


def typed_adjacency(graph: Graph) -> DataFrame:
    """(src_type, type, dst_type, node, nbrs): sorted neighbours by type triple; both triples on an undirected graph."""
    ends = edges_with_types(graph)
    rows = ends.select("src_type", "type", "dst_type", F.col("src").alias("node"), F.col("dst").alias("nbr"))
    if not graph.directed:
        rows = rows.unionByName(ends.where("src <> dst").select(F.col("dst_type").alias("src_type"), "type", F.col("src_type").alias("dst_type"), F.col("dst").alias("node"), F.col("src").alias("nbr")))
    return rows.groupBy("src_type", "type", "dst_type", "node").agg(F.sort_array(F.collect_list("nbr")).alias("nbrs"))


def edges_with_types(graph: Graph) -> DataFrame:
    """Edges with src_type and dst_type."""
    kinds = graph.nodes.select("id", "type")
    return (
        graph.edges.join(kinds.select(F.col("id").alias("src"), F.col("type").alias("src_type")), "src")
        .join(kinds.select(F.col("id").alias("dst"), F.col("type").alias("dst_type")), "dst")
    )


def parallel_edges(graph: Graph) -> DataFrame:
    """(a, b, n, weights): edges between the same two nodes, either way on an undirected graph."""
    a, b = (F.col("src"), F.col("dst")) if graph.directed else (F.least("src", "dst"), F.greatest("src", "dst"))
    return graph.edges.groupBy(a.alias("a"), b.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("weight")).alias("weights"))
