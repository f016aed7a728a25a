"""Schema, metrics, summaries, subgraphs and feature look-ups."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.graph import Graph, GraphError, shown
from weftgraph.operators.adjacency import edges_with_types, half_edges
from weftgraph.operators.sampling import numbered


def type_triples(graph: Graph) -> DataFrame:
    """Distinct (src_type, type, dst_type)."""
    return edges_with_types(graph).select("src_type", "type", "dst_type").distinct()


def schema(graph: Graph, nodes: DataFrame | None = None) -> DataFrame:
    """(node_type, src_type, type, dst_type): the triples that leave each node type; mirrored
    on an undirected graph; of the edges between ``nodes`` if given."""
    part = graph if nodes is None else induced_subgraph(graph, nodes, strict=False)
    rows = type_triples(part)
    if not graph.directed:
        rows = rows.unionByName(rows.select(F.col("dst_type").alias("src_type"), "type", F.col("src_type").alias("dst_type"))).distinct()
    return rows.select(F.col("src_type").alias("node_type"), "src_type", "type", "dst_type")


def edge_metrics(graph: Graph) -> DataFrame:
    """Count and weight statistics of each type triple; end types are sorted on an undirected graph."""
    ends = edges_with_types(graph)
    s, d = F.col("src_type"), F.col("dst_type")
    if not graph.directed:
        s, d = F.least(s, d), F.greatest(s, d)
    w = F.col("weight")
    return ends.groupBy(s.alias("src_type"), "type", d.alias("dst_type")).agg(
        F.count(F.lit(1)).alias("n"), F.min(w).alias("least"), F.max(w).alias("most"), F.avg(w).alias("mean"), F.stddev_samp(w).alias("std")
    )


def info(graph: Graph, truncate: int | None = 20) -> str:
    """A text summary: counts, node types with their triples, edge types with their weights."""
    sizes = {r.type: r["size"] for r in graph.feature_sizes().collect()}
    nodes = sorted(((r["count"], r.type) for r in graph.nodes.groupBy("type").count().collect()), reverse=True)
    metrics = sorted(edge_metrics(graph).collect(), key=lambda r: (r.n, r.src_type, r.type, r.dst_type), reverse=True)
    arrow = "->"
    lines = [
        f"{'Directed' if graph.directed else 'Undirected'} multigraph",
        f" Nodes: {sum(n for n, _ in nodes)}, Edges: {sum(r.n for r in metrics)}", "", " Node types:",
    ]
    for n, kind in nodes[:truncate]:
        size = sizes.get(kind, 0)
        lines.append(f"  {kind}: [{n}]")
        lines.append(f"    Features: {f'vector, length {size}' if size else 'none'}")
        own = sorted({(a, r.type, b) for r in metrics for a, b in ((r.src_type, r.dst_type), *([] if graph.directed else [(r.dst_type, r.src_type)])) if a == kind})
        text = ", ".join(f"{a}-{t}{arrow}{b}" for a, t, b in own[:5]) + (f", ... ({len(own) - 5} more)" if len(own) > 5 else "")
        lines.append(f"    Edge types: {text or 'none'}")
    if truncate is not None and len(nodes) > truncate:
        lines.append(f"  ... ({len(nodes) - truncate} more)")
    lines += ["", " Edge types:"]
    for r in metrics[:truncate]:
        lines.append(f"    {r.src_type}-{r.type}{arrow}{r.dst_type}: [{r.n}]")
        if r.least == r.most:
            text = "all 1 (default)" if r.least == 1 else f"all {r.least:.6g}"
        else:
            text = f"range=[{r.least:.6g}, {r.most:.6g}], mean={r.mean:.6g}, std={r['std']:.6g}"
        lines.append(f"        Weights: {text}")
    if truncate is not None and len(metrics) > truncate:
        lines.append(f"    ... ({len(metrics) - truncate} more)")
    return "\n".join(lines)


def induced_subgraph(graph: Graph, nodes: DataFrame, *, strict: bool = True) -> Graph:
    """The nodes wanted and the edges with both ends among them."""
    ids = nodes.select(F.col("id").cast("string").alias("id")).distinct()
    if strict:
        lost = [r[0] for r in ids.join(graph.nodes.select("id"), "id", "left_anti").orderBy("id").limit(21).collect()]
        if lost:
            raise GraphError(f"expected known node ids, found others: {shown(lost)}")
    edges = graph.edges
    for end in ("src", "dst"):
        edges = edges.join(ids.withColumnRenamed("id", end), end, "left_semi")
    return replace(graph, nodes=graph.nodes.join(ids, "id", "left_semi"), edges=edges.select(*graph.edges.columns))


def khop_nodes(graph: Graph, seeds: DataFrame, k: int, direction: str = "both") -> DataFrame:
    """(id, hop): nodes within k edges of the seeds, with their least distance."""
    half = half_edges(graph, direction).select("node", "nbr").distinct()
    reached = seeds.select(F.col("id").cast("string").alias("id")).distinct().withColumn("hop", F.lit(0))
    frontier = reached
    for hop in range(1, k + 1):
        step = frontier.join(half, frontier["id"] == half["node"]).select(F.col("nbr").alias("id")).distinct()
        frontier = step.join(reached.select("id"), "id", "left_anti").withColumn("hop", F.lit(hop))
        reached = reached.unionByName(frontier)
    return reached


def gather_features(graph: Graph, wanted: DataFrame, size: int, of: str = "node") -> DataFrame:
    """The rows wanted (pos, id) with features; a null or unknown id has zeros."""
    table = graph.nodes.select("id", "features") if of == "node" else graph.edges.select(F.col("eid").alias("id"), "features")
    return wanted.join(table, "id", "left").select("pos", "id", F.coalesce("features", F.array_repeat(F.lit(0.0), size)).alias("features"))


def edges_after(graph: Graph, dates: DataFrame, threshold: str, edge_type: str | None = None) -> DataFrame:
    """Edges whose date, given as dd/MM/yyyy in dates(eid, date), is after the threshold."""
    edges = graph.edges if edge_type is None else graph.edges.where(F.col("type") == edge_type)
    after = F.to_date("date", "dd/MM/yyyy") > F.to_date(F.lit(threshold), "dd/MM/yyyy")
    return edges.join(dates.where(after).select("eid"), "eid", "left_semi")


def cluster_edge_counts(graph: Graph, clusters: DataFrame) -> DataFrame:
    """(cluster, internal, external, ratio): edge ends inside and across clusters(id, cluster)."""
    both = half_edges(graph).join(clusters.select(F.col("id").alias("node"), "cluster"), "node").join(
        clusters.select(F.col("id").alias("nbr"), F.col("cluster").alias("other")), "nbr"
    )
    inside = F.sum(F.when((F.col("cluster") == F.col("other")) & (F.col("node") <= F.col("nbr")), 1).otherwise(0)).cast("long")
    across = F.sum(F.when(F.col("cluster") != F.col("other"), 1).otherwise(0)).cast("long")
    found = both.groupBy("cluster").agg(inside.alias("internal"), across.alias("external"))
    return found.withColumn("ratio", F.col("external") / F.greatest(F.col("internal"), F.lit(1)))


def dense_ids(graph: Graph) -> DataFrame:
    """(id, n, code): nodes numbered from 0, dense, in hash order, and their types' codes, in
    the order of the types' names."""
    codes = graph.nodes.select("type").distinct().withColumn("code", F.row_number().over(Window.orderBy("type")) - 1)  # a row a type
    return numbered(graph.nodes.select("id", "type"), "id").join(F.broadcast(codes), "type").select("id", "n", F.col("code").cast("long").alias("code"))


def id_differences(graph_ids: DataFrame, feature_ids: DataFrame) -> DataFrame:
    """(id, problem): 'missing' where the features lack a node, 'extra' where they have another."""
    missing = graph_ids.select("id").exceptAll(feature_ids.select("id")).withColumn("problem", F.lit("missing"))
    return missing.unionByName(feature_ids.select("id").exceptAll(graph_ids.select("id")).withColumn("problem", F.lit("extra")))
