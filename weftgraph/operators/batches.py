"""Tensor-shaped batches: features by hop and slot, padding, corruption, pooling."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftgraph.functions.vectors import zeros
from weftgraph.graph import Graph, GraphError
from weftgraph.operators import linalg
from weftgraph.operators.linalg import gcn_matrix
from weftgraph.operators.adjacency import adjacency_matrix
from weftgraph.operators.sampling import batches, directed_bfs, hin_bfs, numbered, sampled_bfs
from weftgraph.plans.staging import if_small, stored


def hop_features(samples: DataFrame, graph: Graph, size: int, by: Sequence[str]) -> DataFrame:
    """(by…, features): the sampled slots' feature rows in slot order; null nodes have zeros."""
    some = graph.nodes.where(F.col("features") != zeros(size)).select(F.col("id").alias("node"), "features")
    rows = samples.join(if_small(some), "node", "left")
    rows = rows.select(*by, "slot", F.coalesce("features", zeros(size)).alias("f"))
    return rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("slot", "f"))).alias("s")).select(*by, F.col("s.f").alias("features"))


def graphsage_nodes(graph: Graph, heads: DataFrame, sizes: Sequence[int], size: int, *, seed: int = 42, weighted: bool = False) -> DataFrame:
    """(root, hop, features)."""
    return hop_features(sampled_bfs(graph, heads, sizes, seed=seed, weighted=weighted), graph, size, ("root", "hop"))


def directed_graphsage_nodes(graph: Graph, heads: DataFrame, in_sizes: Sequence[int], out_sizes: Sequence[int], size: int, *, seed: int = 42) -> DataFrame:
    """(root, part, features)."""
    return hop_features(directed_bfs(graph, heads, in_sizes, out_sizes, seed=seed), graph, size, ("root", "part"))


def hinsage_nodes(graph: Graph, heads: DataFrame, sizes: Sequence[int], size: int, *, seed: int = 42) -> DataFrame:
    """(root, path, node_type, features)."""
    return hop_features(hin_bfs(graph, heads, sizes, seed=seed), graph, size, ("root", "path", "node_type"))


def graphsage_links(graph: Graph, pairs: DataFrame, sizes: Sequence[int], size: int, *, seed: int = 42) -> DataFrame:
    """(src, dst, label, side, hop, features): the ends sampled apart."""
    out = None
    for side, offset in (("src", 0), ("dst", 1)):
        heads = pairs.select(F.col(side).alias("id")).distinct()
        part = graphsage_nodes(graph, heads, sizes, size, seed=2 * seed + offset)
        rows = pairs.join(part, pairs[side] == part["root"]).select("src", "dst", "label", F.lit(side).alias("side"), "hop", "features")
        out = rows if out is None else out.unionByName(rows)
    return out


def hinsage_links(graph: Graph, pairs: DataFrame, sizes: Sequence[int], size: int, *, seed: int = 42) -> DataFrame:
    """(src, dst, label, side, path, node_type, features): the ends sampled apart, by type triple."""
    out = None
    for side, offset in (("src", 0), ("dst", 1)):
        part = hinsage_nodes(graph, pairs.select(F.col(side).alias("id")).distinct(), sizes, size, seed=2 * seed + offset)
        rows = pairs.join(part, pairs[side] == part["root"]).select("src", "dst", "label", F.lit(side).alias("side"), "path", "node_type", "features")
        out = rows if out is None else out.unionByName(rows)
    return out


def node_batches(graph: Graph, heads: DataFrame, size: int, *, head_type: str | None = None, epoch: int | None = None) -> DataFrame:
    """(id, n, batch); heads of another type than ``head_type`` raise."""
    if head_type is not None:
        wrong = graph.types_of(heads).where(F.col("type") != head_type).limit(1).collect()
        if wrong:
            raise GraphError(f"expected heads of type {head_type!r}, found {wrong[0].id!r} of {wrong[0].type!r}")
    return batches(heads.select("id"), size, shuffle_seed=epoch)


def directed_graphsage_links(graph: Graph, pairs: DataFrame, in_sizes: Sequence[int], out_sizes: Sequence[int], size: int, *, seed: int = 42) -> DataFrame:
    """(src, dst, label, side, part, features): the ends sampled apart, along and against direction."""
    out = None
    for side, offset in (("src", 0), ("dst", 1)):
        part = directed_graphsage_nodes(graph, pairs.select(F.col(side).alias("id")).distinct(), in_sizes, out_sizes, size, seed=2 * seed + offset)
        rows = pairs.join(part, pairs[side] == part["root"]).select("src", "dst", "label", F.lit(side).alias("side"), "part", "features")
        out = rows if out is None else out.unionByName(rows)
    return out


def attri2vec_nodes(graph: Graph, heads: DataFrame) -> DataFrame:
    """(id, features): the heads' own features."""
    return graph.nodes.join(heads.select(F.col("id").cast("string").alias("id")).distinct(), "id", "left_semi").select("id", "features")


def node2vec_nodes(graph: Graph, heads: DataFrame) -> DataFrame:
    """(id, n): the heads' dense numbers among all nodes."""
    ids = heads.select(F.col("id").cast("string").alias("id")).distinct()
    return numbered(graph.nodes.select("id"), "id").join(ids, "id", "left_semi").select("id", "n")


def attri2vec_links(graph: Graph, pairs: DataFrame) -> DataFrame:
    """(src, dst, label, features, n): the source's features and the target's dense number."""
    ends = pairs.join(graph.nodes.select(F.col("id").alias("src"), "features"), "src")
    return ends.join(numbered(graph.nodes.select("id"), "id").withColumnRenamed("id", "dst"), "dst").select("src", "dst", "label", "features", "n")


def node2vec_links(graph: Graph, pairs: DataFrame) -> DataFrame:
    """(src, dst, label, src_n, dst_n): the ends' dense numbers."""
    n = stored(numbered(graph.nodes.select("id"), "id").select("id", "n"), "numbers")
    rows = pairs.join(n.select(F.col("id").alias("src"), F.col("n").alias("src_n")), "src").join(n.select(F.col("id").alias("dst"), F.col("n").alias("dst_n")), "dst")
    return rows.select("src", "dst", "label", "src_n", "dst_n")


def cluster_targets(batches_of: DataFrame, targets: DataFrame) -> DataFrame:
    """(batch, id) of the batches' nodes that are targets; batches(id, batch)."""
    return batches_of.select("batch", "id").join(targets.select("id").distinct(), "id", "left_semi").select("batch", "id")


def hin_layout(triples: Sequence[tuple[str, str, str]], head_types: Sequence[str], hops: int) -> list[tuple[int, str, str]]:
    """(hop, path, node type) of every tensor that heterogeneous sampling gives, heads first."""
    rows = [(0, "", t) for t in head_types]
    frontier = rows
    for hop in range(1, hops + 1):
        frontier = [(hop, "/".join(filter(None, [path, f"{a}-{r}-{b}"])), b) for _, path, kind in frontier for a, r, b in sorted(triples) if a == kind]
        rows = rows + frontier
    return rows


def corrupted(features: DataFrame, *, seed: int = 42) -> DataFrame:
    """(id, features): feature rows dealt out anew, by a permutation in hash order."""
    at = numbered(features.select("id"), "id").select("id", "n")
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), "id"))
    moved = numbered(features.select(h.alias("h"), "features"), "h").select("n", "features")
    return at.join(moved, "n").select("id", "features")


def padded_graphs(nodes: DataFrame, *, per_batch: int, size: int) -> DataFrame:
    """(batch, graph_id, features, mask): nodes(graph_id, id, features) as one row a graph, padded
    to the batch's largest with zeros; graphs in the order of their id."""
    rows = nodes.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("id", "features"))).alias("s")).select("graph_id", F.col("s.features").alias("f"))
    numbered_rows = batches(rows.select("graph_id"), per_batch, key="graph_id").select("graph_id", "batch")
    rows = rows.join(numbered_rows, "graph_id")
    most = rows.groupBy("batch").agg(F.max(F.size("f")).alias("most"))
    rows = rows.join(most, "batch")
    pad = F.array_repeat(zeros(size), F.col("most") - F.size("f"))
    mask = F.concat(F.array_repeat(F.lit(True), F.size("f")), F.array_repeat(F.lit(False), F.col("most") - F.size("f")))
    return rows.select("batch", "graph_id", F.concat("f", pad).alias("features"), mask.alias("mask"))


def padded_adjacency(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, row, col, v): the normalised adjacency, with self loops, that goes with
    padded_graphs; rows and columns count from 0 in the order of ids, and padding has no entries.
    nodes(graph_id, id), edges(graph_id, src, dst)."""
    place = nodes.select("graph_id", "id", (F.row_number().over(W.partitionBy("graph_id").orderBy("id")) - 1).alias("at"))
    place = stored(place.withColumn("key", F.concat_ws("/", F.col("graph_id").cast("string"), F.col("id").cast("string"))), "places")
    ends = edges.select(*(F.concat_ws("/", F.col("graph_id").cast("string"), F.col(c).cast("string")).alias(c) for c in ("src", "dst")))
    both = ends.select(F.col("src").alias("i"), F.col("dst").alias("j")).unionByName(ends.where("src <> dst").select(F.col("dst").alias("i"), F.col("src").alias("j")))
    adj = both.groupBy("i", "j").agg(F.count(F.lit(1)).cast("double").alias("v"))
    matrix = linalg.normalized(linalg.with_self_loops(adj, place.select(F.col("key").alias("id"))))
    rows = matrix.join(place.select(F.col("key").alias("i"), "graph_id", F.col("at").alias("row")), "i").join(place.select(F.col("key").alias("j"), F.col("at").alias("col")), "j")
    return rows.select("graph_id", "row", "col", "v")


def graph_pairs(padded: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs(left, right, …) of graphs with the padded features and masks of either."""
    sides = [padded.select(F.col("graph_id").alias(s), F.col("features").alias(f"{s}_features"), F.col("mask").alias(f"{s}_mask")) for s in ("left", "right")]
    return pairs.join(sides[0], "left").join(sides[1], "right")


def sort_pooling(features: DataFrame, k: int, size: int) -> DataFrame:
    """(graph_id, features): the k rows greatest in their last channel (ties by id), zero padded and flattened."""
    last = F.element_at("features", -1)
    top = features.withColumn("r", F.row_number().over(W.partitionBy("graph_id").orderBy(last.desc(), "id"))).where(F.col("r") <= k)
    rows = top.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("r", "features"))).alias("s"))
    flat = F.flatten(F.col("s.features"))
    return rows.select("graph_id", F.concat(flat, F.array_repeat(F.lit(0.0), k * size - F.size(flat))).alias("features"))


def full_batch(graph: Graph, method: str | Callable[[DataFrame, DataFrame], DataFrame] = "gcn", *, k: int = 1, weighted: bool = False, teleport: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """(features(id, features), matrix(i, j, v)) for full-batch models: method 'gcn', 'sgc' (its
    power k), 'ppnp' (personalised page rank with ``teleport``; n² entries), 'gat' (self loops),
    'none', or a function of (matrix(i, j, v), nodes)."""
    adj = adjacency_matrix(graph, weighted=weighted)
    if callable(method):
        adj = method(adj, graph.nodes)
    elif method == "ppnp":
        adj = linalg.ppr_matrix(gcn_matrix(adj, graph.nodes), graph.nodes, alpha=teleport)
    elif method == "gcn":
        adj = gcn_matrix(adj, graph.nodes)
    elif method == "sgc":
        adj = linalg.power(gcn_matrix(adj, graph.nodes), k)
    elif method in ("gat", "self_loops"):
        adj = linalg.with_self_loops(adj, graph.nodes)
    elif method != "none":
        raise GraphError(f"expected a method 'gcn', 'sgc', 'ppnp', 'gat', 'none' or a function, found {method!r}")
    return graph.nodes.select("id", "features"), adj
