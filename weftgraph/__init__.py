"""Graph analytics and graph-learning data operators as PySpark DataFrame queries."""

from weftgraph.graph import Graph, GraphError

__all__ = ["Graph", "GraphError"]
