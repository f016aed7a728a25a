"""EPGM JSON lines: graphs, vertices and edges with labels and free attributes."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.graph import Graph, GraphError

META = "meta struct<label: string, graphs: array<string>>"
ELEMENT = f"id string, data map<string,string>, {META}"


@dataclass(frozen=True)
class Epgm:
    graphs: DataFrame
    vertices: DataFrame
    edges: DataFrame

    @classmethod
    def read(cls, spark: SparkSession, folder: str) -> Epgm:
        return cls(
            spark.read.schema("id string, data map<string,string>, meta struct<label: string>").json(f"{folder}/graphs.json"),
            spark.read.schema(ELEMENT).json(f"{folder}/vertices.json"),
            spark.read.schema(f"{ELEMENT}, source string, target string").json(f"{folder}/edges.json"),
        )

    def write(self, folder: str) -> None:
        for name in ("graphs", "vertices", "edges"):
            getattr(self, name).write.mode("overwrite").json(f"{folder}/{name}.json")

    def graph_id(self, label: str) -> str:
        """The id of the graph whose label contains the text; it has to be the only one."""
        found = [r.id for r in self.graphs.where(F.col("meta.label").contains(label)).orderBy("id").limit(2).collect()]
        if len(found) != 1:
            raise GraphError(f"expected one graph labelled {label!r}, found {len(found) or 'none'}")
        return found[0]

    def members(self, graph_id: str) -> tuple[DataFrame, DataFrame]:
        inside = F.array_contains("meta.graphs", graph_id)
        return self.vertices.where(inside), self.edges.where(inside)

    def node_types(self, graph_id: str) -> DataFrame:
        return self.members(graph_id)[0].select(F.col("meta.label").alias("type")).distinct()

    def node_attributes(self, graph_id: str, label: str) -> DataFrame:
        """(attribute): distinct keys of the vertices whose label contains the text."""
        v = self.members(graph_id)[0].where(F.col("meta.label").contains(label))
        return v.select(F.explode(F.map_keys("data")).alias("attribute")).distinct()

    def node_attribute_count(self, graph_id: str, label: str) -> int:
        """How many attributes the vertices whose label contains the text have."""
        return self.node_attributes(graph_id, label).count()

    def edge_list(self, graph_id: str) -> DataFrame:
        return self.members(graph_id)[1].select("id", "source", "target", F.col("meta.label").alias("type"))

    def adjacency(self, graph_id: str) -> DataFrame:
        """(node, nbrs) along the edges' direction."""
        return self.members(graph_id)[1].groupBy(F.col("source").alias("node")).agg(F.sort_array(F.collect_set("target")).alias("nbrs"))

    def append(self, other: Epgm) -> Epgm:
        """Both together: an element in both keeps its own data and gains the other's graph ids."""
        def merged(a: DataFrame, b: DataFrame) -> DataFrame:
            mine, theirs = a.select("id", F.struct(*a.columns).alias("a")), b.select("id", F.struct(*b.columns).alias("b"))
            both = mine.join(theirs, "id", "full")
            kept = F.coalesce("a", "b")
            graphs = F.array_union(F.coalesce(F.col("a.meta.graphs"), F.array().cast("array<string>")), F.coalesce(F.col("b.meta.graphs"), F.array().cast("array<string>")))
            rest = [kept[c].alias(c) for c in a.columns if c not in ("id", "meta")]
            return both.select("id", *rest, F.struct(kept["meta"]["label"].alias("label"), graphs.alias("graphs")).alias("meta")).select(*a.columns)

        extra = other.graphs.join(self.graphs.select("id"), "id", "left_anti").select(*self.graphs.columns)
        return replace(self, graphs=self.graphs.unionByName(extra), vertices=merged(self.vertices, other.vertices), edges=merged(self.edges, other.edges))

    def to_graph(self, graph_id: str, attributes: list[str], *, directed: bool = False) -> Graph:
        """Vertices and edges as a graph; attributes become numeric features, 0 where absent."""
        v, e = self.members(graph_id)
        values = F.array(*(F.coalesce(F.col("data")[a].cast("double"), F.lit(0.0)) for a in attributes)) if attributes else F.array().cast("array<double>")
        nodes = v.select("id", F.col("meta.label").alias("type"), values.alias("features"))
        edges = e.select(F.col("id").alias("eid"), F.col("source").alias("src"), F.col("target").alias("dst"), F.col("meta.label").alias("type"), F.coalesce(F.col("data")["weight"].cast("double"), F.lit(1.0)).alias("weight"), F.array().cast("array<double>").alias("features"))
        return Graph(nodes, edges, directed)


def write_graphml(graph: Graph, folder: str) -> None:
    """The graph as GraphML text in one part file: header, nodes with their type, edges with type and
    weight.  For graphs that one task can write."""
    safe = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col(c), "&", "&amp;"), "<", "&lt;"), '"', "&quot;")
    head = (
        '<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n<key id="type" for="all" attr.name="type" attr.type="string"/>\n'
        f'<key id="weight" for="edge" attr.name="weight" attr.type="double"/>\n<graph edgedefault="{"directed" if graph.directed else "undirected"}">'
    )
    node = F.format_string('<node id="%s"><data key="type">%s</data></node>', safe("id"), safe("type"))
    edge = F.format_string('<edge id="%s" source="%s" target="%s"><data key="type">%s</data><data key="weight">%s</data></edge>', safe("eid"), safe("src"), safe("dst"), safe("type"), F.col("weight").cast("string"))
    lines = graph.spark.range(1).select(F.lit(0).alias("k"), F.lit(head).alias("value"))
    lines = lines.unionByName(graph.nodes.select(F.lit(1).alias("k"), node.alias("value"))).unionByName(graph.edges.select(F.lit(2).alias("k"), edge.alias("value")))
    lines = lines.unionByName(graph.spark.range(1).select(F.lit(3).alias("k"), F.lit("</graph>\n</graphml>").alias("value")))
    lines.orderBy("k", "value").coalesce(1).select("value").write.text(folder)
