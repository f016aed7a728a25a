"""In-memory graph objects with ``nodes`` and ``edges`` views, both ways.  For small graphs."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import SparkSession

from weftgraph.graph import Graph, GraphError, shown

NODE = "id string, type string, features array<double>"
EDGE = "eid string, src string, dst string, type string, weight double, features array<double>"


def _vectors(table: Any) -> dict[str, list[float]]:
    if hasattr(table, "itertuples"):
        return {str(r[0]): [float(x) for x in r[1:]] for r in table.itertuples()}
    return {str(k): [float(x) for x in v] for k, v in (table.items() if isinstance(table, Mapping) else table)}


def from_object(spark: SparkSession, g: Any, *, weight: str = "weight", node_type: str = "label", edge_type: str = "label", features: str | Any = None) -> Graph:
    """From an object with ``nodes(data=True)``, ``edges(data=True)`` and ``is_directed()``.

    ``features`` names a node attribute, or holds the features: a mapping of ids to vectors, an
    iterable of (id, vector), a pandas frame indexed by id, or a mapping of node types to any of
    these.  A node without features has none if its type has none at all, else that raises."""
    given: dict[str, list[float]] = {}
    if features is not None and not isinstance(features, str):
        kinds = {str(d.get(node_type, "default")) for _, d in g.nodes(data=True)}
        tables = list(features.values()) if isinstance(features, Mapping) and features and set(map(str, features)) <= kinds else [features]
        for t in tables:
            given.update(_vectors(t))

    def vector(n: Any, d: dict) -> list[float]:
        return [float(x) for x in d.get(features, ())] if isinstance(features, str) else given.get(str(n), [])

    nodes = [(str(n), str(d.get(node_type, "default")), vector(n, d)) for n, d in g.nodes(data=True)]
    if given:
        known, having = {n for n, _, _ in nodes}, {t for _, t, x in nodes if x}
        lost = [n for n, t, x in nodes if t in having and not x]
        extra = sorted(set(given) - known)
        if lost or extra:
            raise GraphError(f"expected features of the graph's nodes; missing: {shown(lost)}; extra: {shown(extra)}")
    edges = [(str(k), str(a), str(b), str(d.get(edge_type, "default")), float(d.get(weight, 1)), []) for k, (a, b, d) in enumerate(g.edges(data=True))]
    return Graph(spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE), bool(g.is_directed()))


def to_object(graph: Graph, make: Any, *, weight: str = "weight", node_type: str = "label", edge_type: str = "label", features: str | None = None) -> Any:
    """Fills ``make()``, which has ``add_node`` and ``add_edge``, row by row."""
    g = make()
    for r in graph.nodes.toLocalIterator():
        g.add_node(r.id, **{node_type: r.type}, **({features: list(r.features)} if features else {}))
    for r in graph.edges.toLocalIterator():
        g.add_edge(r.src, r.dst, **{edge_type: r.type, weight: r.weight})
    return g
