"""Public graph datasets' text layouts, read into graphs.  Paths in, graphs out."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.graph import Graph, infer_nodes
from weftgraph.operators import components, query
from weftgraph.plans.staging import stored


def citation_graph(spark: SparkSession, content: str, cites: str, *, weight: Column | None = None, largest_component: bool = False) -> tuple[Graph, DataFrame]:
    """Tab-separated content (id, 0/1 words…, subject) and citations (cited, citing): the graph
    without dangling edges, and (id, subject).  ``weight`` is an expression over the ends'
    features a and b; ``largest_component`` leaves the other components out."""
    wide = spark.read.csv(content, sep="\t")
    first, last = wide.columns[0], wide.columns[-1]
    words = F.array(*(F.col(c).cast("double") for c in wide.columns[1:-1]))
    nodes = wide.select(F.col(first).alias("id"), F.lit("paper").alias("type"), words.alias("features"))
    edges = spark.read.csv(cites, sep="\t").toDF("target", "source")
    edges = edges.join(nodes.select(F.col("id").alias("source")), "source", "left_semi").join(nodes.select(F.col("id").alias("target")), "target", "left_semi")
    w: Column = F.lit(1.0)
    if weight is not None:
        edges = edges.join(nodes.select(F.col("id").alias("source"), F.col("features").alias("a")), "source").join(nodes.select(F.col("id").alias("target"), F.col("features").alias("b")), "target")
        w = weight
    made = edges.select(
        F.concat_ws(">", "source", "target").alias("eid"), F.col("source").alias("src"), F.col("target").alias("dst"), F.lit("cites").alias("type"),
        w.cast("double").alias("weight"), F.array().cast("array<double>").alias("features"),
    )
    graph, subjects = Graph(nodes, made), wide.select(F.col(first).alias("id"), F.col(last).alias("subject"))
    if not largest_component:
        return graph, subjects
    kept = stored(components.largest_component(components.connected_components(graph)).select("id"), "largest")
    return query.induced_subgraph(graph, kept, strict=False), subjects.join(kept, "id", "left_semi")


def sparse_nodes(spark: SparkSession, path: str, keys: list[str], *, skip_lines: int = 2, label: str = "label") -> DataFrame:
    """(id, label, features) from lines ``id<TAB>label=x<TAB>key=value…``; absent keys are 0.  The
    header's lines hold no such fields."""
    lines = spark.read.text(path).where(F.col("value").contains(f"\t{label}="))
    pairs = F.str_to_map(F.regexp_replace("value", r"^[^\t]*\t", ""), F.lit("\t"), F.lit("="))
    rows = lines.select(F.split("value", "\t")[0].alias("id"), pairs.alias("m"))
    return rows.select("id", F.col("m")[label].alias(label), F.array(*(F.coalesce(F.col("m")[k].cast("double"), F.lit(0.0)) for k in keys)).alias("features"))


def stripped_id(column: Column, characters: str) -> Column:
    """Without any of the characters at its start."""
    return F.ltrim(column, F.lit(characters))


def prefixed_csv_graph(spark: SparkSession, nodes: Mapping[str, tuple[str, str]], edges: Mapping[str, tuple[str, str, str]]) -> Graph:
    """nodes: type → (path, prefix); edges: type → (path, source prefix, target prefix); files
    without a header, ids made unique by their prefix."""
    made = {k: spark.read.csv(p).select(F.concat(F.lit(x), F.col("_c0")).alias("id")) for k, (p, x) in nodes.items()}
    links = {}
    for k, (p, a, b) in edges.items():
        links[k] = spark.read.csv(p).select(F.concat(F.lit(a), F.col("_c0")).alias("source"), F.concat(F.lit(b), F.col("_c1")).alias("target"))
    return Graph.from_tables(made, links, validate=False)


def ratings_graph(users: DataFrame, items: DataFrame, ratings: DataFrame, *, user_numeric: list[str], user_categories: list[str], item_features: list[str]) -> Graph:
    """Users, items and (user, item, rating): categories one-hot, numbers scaled to mean 0 and
    population deviation 1; ids prefixed u_ and m_."""
    stats = users.agg(*(f(c).alias(f"{n}_{c}") for c in user_numeric for n, f in (("mean", F.avg), ("std", F.stddev_pop))))
    values = {c: sorted(r[0] for r in users.select(c).distinct().collect() if r[0] is not None) for c in user_categories}  # few categories
    scaled = [F.when(F.col(f"std_{c}") > 0, (F.col(c) - F.col(f"mean_{c}")) / F.col(f"std_{c}")).otherwise(0.0) for c in user_numeric]
    one_hot = [F.when(F.col(c) == v, 1.0).otherwise(0.0) for c in user_categories for v in values[c]]
    u = users.join(F.broadcast(stats)).select(F.concat(F.lit("u_"), F.col("user").cast("string")).alias("id"), F.array(*scaled, *one_hot).alias("features"))
    m = items.select(F.concat(F.lit("m_"), F.col("item").cast("string")).alias("id"), F.array(*(F.col(c).cast("double") for c in item_features)).alias("features"))
    e = ratings.select(F.concat(F.lit("u_"), F.col("user").cast("string")).alias("source"), F.concat(F.lit("m_"), F.col("item").cast("string")).alias("target"), F.col("rating").alias("weight"))
    return Graph.from_tables({"user": u, "item": m}, {"rating": e}, validate=False)


def ntriples_graph(spark: SparkSession, path: str, *, label_relations: tuple[str, ...] = ()) -> tuple[Graph, DataFrame]:
    """Lines ``<s> <p> <o> .`` as typed edges, and the held-out (id, relation, value) of the label
    relations."""
    lines = spark.read.text(path).where("trim(value) <> '' and not startswith(trim(value), '#')")
    part = F.regexp_extract_all("value", F.lit(r'(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:@\S+|\^\^<[^>]*>)?)'), F.lit(1))
    rows = lines.select(part.alias("p")).where("size(p) >= 3").select(F.col("p")[0].alias("s"), F.col("p")[1].alias("r"), F.col("p")[2].alias("o"))
    held = F.col("r").isin([f"<{x}>" for x in label_relations])
    kept = rows.where(~held).distinct()
    edges = kept.select(F.md5(F.concat_ws(" ", "s", "r", "o")).alias("eid"), F.col("s").alias("src"), F.col("o").alias("dst"), F.col("r").alias("type"), F.lit(1.0).alias("weight"), F.array().cast("array<double>").alias("features"))
    return Graph(infer_nodes(edges), edges, True), rows.where(held).select(F.col("s").alias("id"), F.col("r").alias("relation"), F.col("o").alias("value"))


def triples_graph(spark: SparkSession, paths: Mapping[str, str], *, sep: str = "\t") -> Graph:
    """Splits (name → path) of ``head<TAB>relation<TAB>tail`` as one knowledge graph; edge ids begin
    with the split's name."""
    rows = None
    for split, path in paths.items():
        part = spark.read.csv(path, sep=sep, schema="src string, type string, dst string").withColumn("split", F.lit(split))
        rows = part if rows is None else rows.unionByName(part)
    edges = rows.select(F.concat_ws(":", "split", F.md5(F.concat_ws(" ", "src", "type", "dst"))).alias("eid"), "src", "dst", "type", F.lit(1.0).alias("weight"), F.array().cast("array<double>").alias("features"))
    return Graph(infer_nodes(edges), edges, True)


def timed_edges_graph(spark: SparkSession, path: str, *, sep: str = " ", comment: str = "%") -> Graph:
    """``source target weight time`` lines; the time is the weight."""
    rows = spark.read.csv(path, sep=sep, comment=comment, schema="src string, dst string, x double, time double")
    edges = rows.select(F.md5(F.concat_ws(" ", "src", "dst", "time", "x")).alias("eid"), "src", "dst", F.lit("default").alias("type"), F.col("time").alias("weight"), F.array().cast("array<double>").alias("features"))
    return Graph(infer_nodes(edges), edges)


def line_numbered(spark: SparkSession, path: str) -> DataFrame:
    """(n, value): the file's lines numbered from 1, by counts of the lines in each part of it."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("m"))
    lines = lines.select("value", F.shiftright("m", 33).alias("part"), F.col("m").bitwiseAND(F.lit((1 << 33) - 1)).alias("k"))
    count = lines.groupBy("part").agg(F.count(F.lit(1)).alias("c"))
    before = F.sum("c").over(Window.orderBy("part")) - F.col("c")  # a row a part of the file
    return lines.join(F.broadcast(count.select("part", before.alias("before"))), "part").select((F.col("before") + F.col("k") + 1).alias("n"), "value")


def kernel_graphs(spark: SparkSession, stem: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes(graph_id, id, label), edges(graph_id, src, dst), labels(graph_id, label)) of a bundle
    stem_A.txt, stem_graph_indicator.txt, stem_graph_labels.txt and, if present, node labels."""
    owner = line_numbered(spark, f"{stem}_graph_indicator.txt").select(F.col("n").cast("string").alias("id"), F.trim("value").cast("long").alias("graph_id"))
    label = line_numbered(spark, f"{stem}_node_labels.txt").select(F.col("n").cast("string").alias("id"), F.trim("value").alias("label"))
    nodes = owner.join(label, "id").select("graph_id", "id", "label")
    pair = F.split("value", r"\s*,\s*")
    edges = spark.read.text(f"{stem}_A.txt").select(F.trim(pair[0]).alias("src"), F.trim(pair[1]).alias("dst")).join(owner.withColumnRenamed("id", "src"), "src").select("graph_id", "src", "dst")
    labels = line_numbered(spark, f"{stem}_graph_labels.txt").select(F.col("n").alias("graph_id"), F.trim("value").alias("label"))
    return nodes, edges, labels


def matrix_series(spark: SparkSession, path: str) -> DataFrame:
    """(node, t, value) from a CSV with a header of node names and a row a time step."""
    wide = spark.read.csv(path, header=True)
    rows = line_numbered(spark, path).where("n > 1").select((F.col("n") - 2).alias("t"), F.posexplode(F.split("value", ",")).alias("k", "v"))
    names = F.array(*(F.lit(c) for c in wide.columns))
    return rows.select(F.element_at(names, F.col("k") + 1).alias("node"), "t", F.col("v").cast("double").alias("value"))


def matrix_edges(spark: SparkSession, path: str, nodes: list[str]) -> DataFrame:
    """(i, j, v): the non-zero entries of a CSV matrix whose rows and columns are the nodes."""
    names = F.array(*(F.lit(c) for c in nodes))
    rows = line_numbered(spark, path).select((F.col("n")).cast("int").alias("r"), F.posexplode(F.split("value", ",")).alias("k", "v"))
    return rows.select(F.element_at(names, F.col("r")).alias("i"), F.element_at(names, F.col("k") + 1).alias("j"), F.col("v").cast("double").alias("v")).where("v <> 0")
