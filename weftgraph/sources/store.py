"""Graphs in columnar storage, clustered by type so that type predicates prune files."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from weftgraph.graph import Graph


def write(graph: Graph, folder: str, *, mode: str = "errorifexists") -> None:
    graph.nodes.write.mode(mode).partitionBy("type").parquet(f"{folder}/nodes")
    graph.edges.withColumn("directed", F.lit(graph.directed)).write.mode(mode).partitionBy("type").parquet(f"{folder}/edges")


def read(spark: SparkSession, folder: str, *, directed: bool = False) -> Graph:
    nodes = spark.read.parquet(f"{folder}/nodes").select("id", F.col("type").cast("string").alias("type"), "features")
    edges = spark.read.parquet(f"{folder}/edges").select("eid", "src", "dst", F.col("type").cast("string").alias("type"), "weight", "features")
    return Graph(nodes, edges, directed)


def write_bucketed(graph: Graph, table: str, buckets: int) -> None:
    """Half edges as a table bucketed by node: later joins on node need no exchange of it."""
    from weftgraph.operators.adjacency import half_edges

    half_edges(graph).write.mode("overwrite").bucketBy(buckets, "node").sortBy("node").saveAsTable(table)


def write_batches(batches, folder: str) -> None:
    """Batches as files for a trainer, one folder a batch."""
    batches.write.mode("overwrite").partitionBy("batch").parquet(folder)
