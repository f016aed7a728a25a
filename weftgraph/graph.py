"""The graph abstraction: two DataFrames, typed nodes and typed, weighted multi-edges."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

SHOWN = 20


class GraphError(ValueError):
    """The tables don't make a graph."""


def shown(values: Sequence, limit: int = SHOWN) -> str:
    """The first values as text, with a count of the rest."""
    rest = len(values) - limit
    return ", ".join(map(repr, values[:limit])) + (f", ... ({rest} more)" if rest > 0 else "")


def features_of(df: DataFrame, skip: Sequence[str]) -> Column:
    """All other columns as one array of doubles; they have to be numeric."""
    names = [c for c in df.columns if c not in skip]
    bad = [c for c in names if not isinstance(df.schema[c].dataType, NumericType)]
    if bad:
        raise GraphError(f"expected numeric feature columns, found others: {shown(bad)}")
    return F.array(*(F.col(c).cast("double") for c in names)) if names else F.array().cast("array<double>")


def row_digest(kind: str, columns: Sequence[str]) -> Column:
    """An edge id that any partitioning gives alike: the row's digest and, as equal rows are
    edges of their own, its number among those."""
    digest = F.md5(F.to_json(F.struct(*columns)))
    return F.concat(F.lit(f"{kind}:"), digest, F.lit("-"), F.row_number().over(Window.partitionBy(digest).orderBy(digest)).cast("string"))


@dataclass(frozen=True)
class Graph:
    """nodes(id, type, features), edges(eid, src, dst, type, weight, features).

    Ids are strings.  Parallel edges and self loops are allowed.  Nothing is computed
    until a result is read.
    """

    nodes: DataFrame
    edges: DataFrame
    directed: bool = False

    @property
    def spark(self) -> SparkSession:
        return self.edges.sparkSession

    # -- construction ---------------------------------------------------------

    @classmethod
    def from_tables(
        cls, nodes: DataFrame | Mapping[str, DataFrame] | None = None, edges: DataFrame | Mapping[str, DataFrame] | None = None, *,
        directed: bool = False, id_column: str = "id", source_column: str = "source", target_column: str = "target",
        weight_column: str = "weight", edge_id_column: str = "eid", edge_type_column: str | None = None,
        node_type: str = "default", edge_type: str = "default", validate: bool = True,
    ) -> Graph:
        """A graph of one table, or of a table for each type.

        Columns besides the named ones become features (an ``features`` array column is
        taken as it is).  Edges without a weight column weigh 1.  Without nodes, the ends
        of the edges are the nodes.  ``edge_type_column`` needs a single edge table.
        """
        if edges is None and nodes is None:
            raise GraphError("expected nodes or edges")
        if edge_type_column and isinstance(edges, Mapping):
            raise GraphError("edge_type_column needs a single edge table")
        edge_tables = {} if edges is None else dict(edges) if isinstance(edges, Mapping) else {edge_type: edges}
        made = []
        for kind, df in sorted(edge_tables.items()):
            missing = [c for c in (source_column, target_column, *([edge_type_column] if edge_type_column else [])) if c not in df.columns]
            if missing:
                raise GraphError(f"edge table {kind!r} lacks columns: {shown(missing)}")
            if weight_column in df.columns and not isinstance(df.schema[weight_column].dataType, NumericType):
                raise GraphError(f"expected numeric weights in {weight_column!r} of {kind!r}")
            special = [source_column, target_column, weight_column, edge_id_column, *([edge_type_column] if edge_type_column else [])]
            made.append(df.select(
                (F.col(edge_id_column).cast("string") if edge_id_column in df.columns else row_digest(kind, df.columns)).alias("eid"),
                F.col(source_column).cast("string").alias("src"), F.col(target_column).cast("string").alias("dst"),
                (F.col(edge_type_column).cast("string") if edge_type_column else F.lit(kind)).alias("type"),
                (F.coalesce(F.col(weight_column).cast("double"), F.lit(1.0)) if weight_column in df.columns else F.lit(1.0)).alias("weight"),
                (F.col("features").cast("array<double>") if "features" in df.columns else features_of(df, special)).alias("features"),
            ))
        all_edges = made[0] if made else None
        for df in made[1:]:
            all_edges = all_edges.unionByName(df)
        if nodes is None:
            all_nodes = infer_nodes(all_edges, node_type)
        else:
            tables = dict(nodes) if isinstance(nodes, Mapping) else {node_type: nodes}
            all_nodes = None
            for kind, df in sorted(tables.items()):
                if id_column not in df.columns:
                    raise GraphError(f"node table {kind!r} lacks columns: {id_column!r}")
                one = df.select(
                    F.col(id_column).cast("string").alias("id"), F.lit(kind).alias("type"),
                    (F.col("features").cast("array<double>") if "features" in df.columns else features_of(df, [id_column])).alias("features"),
                )
                all_nodes = one if all_nodes is None else all_nodes.unionByName(one)
        if all_edges is None:
            all_edges = all_nodes.sparkSession.createDataFrame([], "eid string, src string, dst string, type string, weight double, features array<double>")
        graph = cls(all_nodes, all_edges, directed)
        return graph.validated() if validate else graph

    def validated(self) -> Graph:
        """The graph itself, or a GraphError that names offending ids: repeated node or edge
        ids, ends that aren't nodes, negative or non-finite weights are left to the
        operators that care."""
        for what, df, key in (("node", self.nodes, "id"), ("edge", self.edges, "eid")):
            twice = [r[0] for r in df.groupBy(key).count().where("count > 1").select(key).orderBy(key).limit(SHOWN + 1).collect()]
            if twice:
                raise GraphError(f"expected {what} ids to be unique, found repeated: {shown(twice)}")
        ends = self.edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        lost = [r[0] for r in ends.join(self.nodes.select("id"), "id", "left_anti").orderBy("id").limit(SHOWN + 1).collect()]
        if lost:
            raise GraphError(f"expected all ends of edges to be nodes, found some missing: {shown(lost)}")
        return self

    # -- accessors ------------------------------------------------------------

    def node_ids(self, node_type: str | None = None) -> DataFrame:
        df = self.nodes if node_type is None else self.nodes.where(F.col("type") == node_type)
        return df.select("id")

    def edge_list(self, *, with_type: bool = False, with_weight: bool = False) -> DataFrame:
        return self.edges.select("src", "dst", *(["type"] if with_type else []), *(["weight"] if with_weight else []))

    def number_of_nodes(self) -> int:
        return self.nodes.count()

    def number_of_edges(self) -> int:
        return self.edges.count()

    def has_node(self, node: str) -> bool:
        return not self.nodes.where(F.col("id") == str(node)).limit(1).isEmpty()

    def node_types(self) -> list[str]:
        return sorted(r[0] for r in self.nodes.select("type").distinct().collect())

    def edge_types(self) -> list[str]:
        return sorted(r[0] for r in self.edges.select("type").distinct().collect())

    def unique_type(self, of: str = "node") -> str:
        kinds = self.node_types() if of == "node" else self.edge_types()
        if len(kinds) != 1:
            raise GraphError(f"expected one {of} type, found: {shown(kinds)}")
        return kinds[0]

    def types_of(self, wanted: DataFrame, *, strict: bool = True) -> DataFrame:
        """(id, type) of the ids wanted; strict raises where one isn't a node."""
        found = wanted.select(F.col("id").cast("string").alias("id")).join(self.nodes.select("id", "type"), "id", "left")
        if strict:
            lost = [r[0] for r in found.where("type is null").orderBy("id").limit(SHOWN + 1).collect()]
            if lost:
                raise GraphError(f"expected known node ids, found others: {shown(lost)}")
        return found

    def feature_sizes(self, of: str = "node") -> DataFrame:
        """(type, size); a type whose rows differ in size raises."""
        df = self.nodes if of == "node" else self.edges
        found = df.groupBy("type").agg(F.min(F.size("features")).alias("least"), F.max(F.size("features")).alias("size"))
        bad = [r.type for r in found.where("least <> size").collect()]
        if bad:
            raise GraphError(f"expected one feature size for each type, found several: {shown(bad)}")
        return found.select("type", "size")

    def check_features(self) -> None:
        if self.nodes.where(F.size("features") > 0).limit(1).isEmpty():
            raise GraphError("expected nodes with features")

    def with_features(self, table: DataFrame, size: int) -> Graph:
        """Features by id; nodes that the table lacks get zeros."""
        joined = self.nodes.drop("features").join(table.select(F.col("id").cast("string").alias("id"), F.col("features").cast("array<double>").alias("features")), "id", "left")
        return replace(self, nodes=joined.select("id", "type", F.coalesce("features", F.array_repeat(F.lit(0.0), size)).alias("features")))


def infer_nodes(edges: DataFrame, node_type: str = "default") -> DataFrame:
    """The distinct ends of edges as nodes without features."""
    ids = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return ids.select("id", F.lit(node_type).alias("type"), F.array().cast("array<double>").alias("features"))
