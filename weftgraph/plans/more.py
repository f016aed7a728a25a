"""Further graph queries and their SQL: sources, accessors, batches, layers, scores.

Text layouts are written from the driver's tables into the shared folder and read
back, so that the readers see what a file would hold.  Like ``catalog``, which
registers these, arrays come out in order, a row a component or as a digest.
"""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftgraph.functions import vectors as V
from weftgraph.functions.rng import draw_sql
from weftgraph.graph import Graph
from weftgraph.operators import adjacency as A
from weftgraph.operators import batches as B
from weftgraph.operators import calibration, components, layers, linalg, links, query, sampling, splitter, walks
from weftgraph.plans.catalog import (
    ADJ0, B2, GCN, HALF_SQL, HET, KG, OP, OP_ADJ, PAIRS, SQL, W42, W642, X4, bfs_sql, directed_bfs_sql, featured, hin_sql, kg_tables, long_form, metapath_sql, register, walk_sql,
)
from weftgraph.plans.staging import shared_dir
from weftgraph.plans.tables import adj_sql, features, het_graph, key, op_graph, op_sql, table
from weftgraph.sources import epgm, store, text


def folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def as_text(lines: DataFrame, label: str, *, order: str | None = None) -> str:
    """The path of the lines (column value) as text; in one file, in order, if asked."""
    path = folder(lines.sparkSession, label)
    (lines if order is None else lines.orderBy(order).coalesce(1)).select("value").write.text(path)
    return path


def tab(*columns) -> Column:
    return F.concat_ws("\t", *columns).alias("value")


# -- sources and sinks -----------------------------------------------------------


@register("store_round_trip", f"{HET} SELECT eid, src, dst, type, weight FROM edges")
def _(spark, d):
    path = folder(spark, "store")
    store.write(het_graph(spark, d), path)
    return store.read(spark, path).edges.select("eid", "src", "dst", "type", "weight")


def _epgm(spark, vertices: DataFrame, edges: DataFrame, graph: str) -> epgm.Epgm:
    """vertices(id, label, data), edges(id, source, target, label) of one graph."""
    meta = F.struct(F.col("label").alias("label"), F.array(F.lit(graph)).alias("graphs")).alias("meta")
    none = F.create_map().cast("map<string,string>")
    graphs = spark.range(1).select(F.lit(graph).alias("id"), none.alias("data"), F.struct(F.lit(f"all of {graph}").alias("label")).alias("meta"))
    return epgm.Epgm(graphs, vertices.select("id", F.col("data"), meta), edges.select("id", none.alias("data"), meta, "source", "target"))


def _places(spark, d) -> tuple[epgm.Epgm, epgm.Epgm]:
    data = lambda c: F.create_map(F.lit("name"), F.col(c).cast("string"))
    n, c = table(spark, d, "nation"), table(spark, d, "customer")
    nations = n.select(key("n", "n_nationkey").alias("id"), F.lit("nation").alias("label"), data("n_name").alias("data"))
    regions = table(spark, d, "region").select(key("r", "r_regionkey").alias("id"), F.lit("region").alias("label"), data("r_name").alias("data"))
    people = c.select(key("c", "c_custkey").alias("id"), F.lit("customer").alias("label"), F.create_map(F.lit("balance"), F.round(F.col("c_acctbal") * 100).cast("bigint").cast("string")).alias("data"))
    where = n.select(key("nr", "n_nationkey").alias("id"), key("n", "n_nationkey").alias("source"), key("r", "n_regionkey").alias("target"), F.lit("in_region").alias("label"))
    lives = c.select(key("cn", "c_custkey").alias("id"), key("c", "c_custkey").alias("source"), key("n", "c_nationkey").alias("target"), F.lit("lives_in").alias("label"))
    return _epgm(spark, nations.unionByName(regions), where, "g1"), _epgm(spark, nations.unionByName(people), lives, "g2")


@register("epgm_append", """SELECT 'n' || n_nationkey AS id, 'nation' AS label, 'g1,g2' AS graphs FROM nation UNION ALL SELECT 'r' || r_regionkey, 'region', 'g1' FROM region UNION ALL SELECT 'c' || c_custkey, 'customer', 'g2' FROM customer
UNION ALL SELECT 'nr' || n_nationkey, 'in_region', 'g1' FROM nation UNION ALL SELECT 'cn' || c_custkey, 'lives_in', 'g2' FROM customer""")
def _(spark, d):
    first, second = _places(spark, d)
    path = folder(spark, "epgm")
    first.append(second).write(path)
    e = epgm.Epgm.read(spark, path)
    rows = e.vertices.select("id", "meta").unionByName(e.edges.select("id", "meta"))
    return rows.select("id", F.col("meta.label").alias("label"), F.array_join(F.sort_array("meta.graphs"), ",").alias("graphs"))


@register("epgm_edge_list", "SELECT 'cn' || c_custkey AS id, 'c' || c_custkey AS source, 'n' || c_nationkey AS target, 'lives_in' AS type FROM customer")
def _(spark, d):
    e = _places(spark, d)[1]
    return e.edge_list(e.graph_id("g2"))


@register("epgm_node_attributes", "SELECT 'balance' AS attribute UNION ALL SELECT 'name'")
def _(spark, d):
    e = _places(spark, d)[1]
    return e.node_attributes("g2", "customer").unionByName(e.node_attributes("g2", "nation"))


@register("epgm_adjacency", "SELECT 'n' || n_nationkey AS node, 'r' || n_regionkey AS nbrs FROM nation")
def _(spark, d):
    return _places(spark, d)[0].adjacency("g1").withColumn("nbrs", F.array_join("nbrs", ","))


@register("epgm_to_graph", "SELECT 'c' || c_custkey AS id, 'customer' AS type, round(c_acctbal * 100) AS balance FROM customer UNION ALL SELECT 'n' || n_nationkey, 'nation', 0 FROM nation")
def _(spark, d):
    g = _places(spark, d)[1].to_graph("g2", ["balance"])
    return g.nodes.select("id", "type", F.col("features")[0].alias("balance"))


@register("citation_graph", """SELECT l_suppkey || '>' || l_partkey AS eid, CAST(l_suppkey AS VARCHAR) AS src, CAST(l_partkey AS VARCHAR) AS dst, a.p_size & 1 AS a, b.p_size >> 1 & 1 AS b, b.p_brand AS subject
FROM lineitem JOIN part a ON a.p_partkey = l_suppkey JOIN part b ON b.p_partkey = l_partkey""")
def _(spark, d):
    p = table(spark, d, "part")
    content = as_text(p.select(tab(F.col("p_partkey").cast("string"), (F.col("p_size") % 2).cast("string"), (F.floor(F.col("p_size") / 2) % 2).cast("string"), "p_brand")), "content")
    cites = as_text(table(spark, d, "lineitem").select(tab(F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"))), "cites")
    g, subjects = text.citation_graph(spark, content, cites)
    at = g.nodes.select(F.col("id").alias("src"), F.col("features")[0].cast("int").alias("a"))
    to = g.nodes.select(F.col("id").alias("dst"), F.col("features")[1].cast("int").alias("b")).join(subjects.withColumnRenamed("id", "dst"), "dst")
    return g.edges.join(at, "src").join(to, "dst").select("eid", "src", "dst", "a", "b", "subject")


@register("sparse_line_nodes", "SELECT 's' || s_suppkey AS id, CAST(s_nationkey AS VARCHAR) AS label, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey / 4.0 ELSE 0 END::DOUBLE AS one, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey / 8.0 ELSE 0 END::DOUBLE AS two FROM supplier")
def _(spark, d):
    k = F.col("s_suppkey")
    lines = table(spark, d, "supplier").select(tab(
        key("s", "s_suppkey"), F.concat(F.lit("label="), F.col("s_nationkey").cast("string")),
        F.when(k % 2 == 0, F.concat(F.lit("w-one="), (k / 4.0).cast("string"))), F.when(k % 3 == 0, F.concat(F.lit("w-two="), (k / 8.0).cast("string"))),
    ))
    header = spark.createDataFrame([("NODE\tpaper",), ("cat=1,2,3:label\tnumeric:w-one:0.0",)], "value string")
    found = text.sparse_nodes(spark, as_text(lines.unionByName(header), "lines"), ["w-one", "w-two"])
    return found.select("id", "label", F.col("features")[0].alias("one"), F.col("features")[1].alias("two"))


@register("prefixed_csv_graph", f"{HET} SELECT src, dst, type FROM edges WHERE type IN ('placed', 'lives_in')")
def _(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")

    def csv(df: DataFrame, *columns: str) -> str:
        return as_text(df.select(F.concat_ws(",", *(F.col(x).cast("string") for x in columns)).alias("value")), "csv")

    g = text.prefixed_csv_graph(
        spark, {"customer": (csv(c, "c_custkey"), "c"), "order": (csv(o, "o_orderkey"), "o"), "nation": (csv(table(spark, d, "nation"), "n_nationkey"), "n")},
        {"placed": (csv(o, "o_custkey", "o_orderkey"), "c", "o"), "lives_in": (csv(c, "c_custkey", "c_nationkey"), "c", "n")},
    )
    return g.edges.select("src", "dst", "type")


@register("ratings_graph", """WITH s AS (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS s FROM customer), g AS (SELECT c_mktsegment AS seg, row_number() OVER (ORDER BY c_mktsegment) + 1 AS k FROM (SELECT DISTINCT c_mktsegment FROM customer))
SELECT 'u_' || c_custkey AS id, 1::BIGINT AS k, round((c_acctbal - m) / s, 5) AS f FROM customer, s UNION ALL SELECT 'u_' || c_custkey, k, CASE WHEN c_mktsegment = seg THEN 1.0 ELSE 0.0 END FROM customer, g
UNION ALL SELECT 'm_' || p_partkey, 1, p_size::DOUBLE FROM part""")
def _(spark, d):
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("user"), "c_acctbal", "c_mktsegment")
    items = table(spark, d, "part").select(F.col("p_partkey").alias("item"), "p_size")
    ratings = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("user"), F.col("l_partkey").alias("item"), F.col("l_quantity").alias("rating"))
    return long_form(text.ratings_graph(users, items, ratings, user_numeric=["c_acctbal"], user_categories=["c_mktsegment"], item_features=["p_size"]).nodes, 5)


def _triples(spark, d) -> DataFrame:
    return het_graph(spark, d).edges.where(F.col("type") != "contains").select("src", "type", "dst").distinct()


@register("ntriples_graph", f"{HET} SELECT DISTINCT '<' || src || '>' AS s, '<' || type || '>' AS r, '<' || dst || '>' AS o, type = 'in_region' AS held FROM edges WHERE type <> 'contains'")
def _(spark, d):
    lines = _triples(spark, d).select(F.format_string("<%s> <%s> <%s> .", "src", "type", "dst").alias("value"))
    g, held = text.ntriples_graph(spark, as_text(lines, "ntriples"), label_relations=("in_region",))
    return g.edges.select(F.col("src").alias("s"), F.col("type").alias("r"), F.col("dst").alias("o"), F.lit(False).alias("held")).unionByName(
        held.select(F.col("id").alias("s"), F.col("relation").alias("r"), F.col("value").alias("o"), F.lit(True).alias("held"))
    )


@register("triples_graph", f"{HET} SELECT CASE WHEN type = 'placed' THEN 'train' ELSE 'test' END AS split, src, type, dst FROM edges WHERE type IN ('placed', 'lives_in')")
def _(spark, d):
    t = _triples(spark, d)
    paths = {s: as_text(t.where(F.col("type") == k).select(tab("src", "type", "dst")), s) for s, k in (("train", "placed"), ("test", "lives_in"))}
    return text.triples_graph(spark, paths).edges.select(F.split("eid", ":")[0].alias("split"), "src", "type", "dst")


@register("timed_edges_graph", "SELECT 'u' || user_id AS src, event_type AS dst, event_id::DOUBLE AS weight FROM events")
def _(spark, d):
    e = table(spark, d, "events")
    lines = e.select(F.concat_ws(" ", key("u", "user_id"), "event_type", F.lit("1"), F.col("event_id").cast("string")).alias("value"))
    return text.timed_edges_graph(spark, as_text(lines, "timed")).edges.select("src", "dst", "weight")


@register("kernel_graphs", """SELECT l_orderkey + 1 AS graph_id, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey) AS id, CAST(l_linenumber AS VARCHAR) AS label, CASE WHEN l_orderkey % 2 = 0 THEN '1' ELSE '-1' END AS graph_label FROM lineitem""")
def _(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("at"))
    stem = folder(spark, "bundle")
    rows.orderBy("at").coalesce(1).select((F.col("l_orderkey") + 1).cast("string")).write.text(f"{stem}_graph_indicator.txt")
    rows.orderBy("at").coalesce(1).select(F.col("l_linenumber").cast("string")).write.text(f"{stem}_node_labels.txt")
    rows.limit(1).select(F.lit("1, 1")).write.text(f"{stem}_A.txt")
    most = rows.agg(F.max("l_orderkey")).first()[0]
    spark.range(0, most + 1).orderBy("id").coalesce(1).select(F.when(F.col("id") % 2 == 0, "1").otherwise("-1")).write.text(f"{stem}_graph_labels.txt")
    nodes, _edges, labels = text.kernel_graphs(spark, stem)
    return nodes.select("graph_id", F.col("id").cast("long").alias("id"), "label").join(labels.select("graph_id", F.col("label").alias("graph_label")), "graph_id")


def _matrix(spark, d, header: bool) -> str:
    """Nations by vector component: a CSV with a row a component."""
    n = table(spark, d, "nation").select("n_nationkey").join(table(spark, d, "embeddings"), F.col("vec_id") == F.col("n_nationkey"))
    cells = n.select("n_nationkey", F.posexplode("embedding").alias("t", "v")).select("n_nationkey", "t", F.round(F.col("v").cast("double") * 1000).cast("long").cast("string").alias("v"))
    if not header:  # a square one
        cells = cells.where(F.col("t") < n.count())
    rows = cells.groupBy("t").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "v"))), lambda x: x["v"]), ",").alias("value"))
    if header:
        names = n.agg(F.array_join(F.transform(F.array_sort(F.collect_list("n_nationkey")), lambda k: F.concat(F.lit("n"), k.cast("string"))), ",").alias("value"))  # 25 nations
        rows = names.select(F.lit(-1).alias("t"), "value").unionByName(rows)
    return as_text(rows, "matrix", order="t")


@register("matrix_series", "SELECT 'n' || n_nationkey AS node, t, round(embedding[t + 1]::DOUBLE * 1000) AS value FROM nation JOIN embeddings ON vec_id = n_nationkey, range(64) r(t)")
def _(spark, d):
    return text.matrix_series(spark, _matrix(spark, d, True))


@register("matrix_edges", "SELECT 't' || t AS i, 'n' || n_nationkey AS j, round(embedding[t + 1]::DOUBLE * 1000) AS v FROM nation JOIN embeddings ON vec_id = n_nationkey, range(25) r(t) WHERE round(embedding[t + 1]::DOUBLE * 1000) <> 0")
def _(spark, d):
    names = [r[0] for r in table(spark, d, "nation").select("n_nationkey").orderBy("n_nationkey").collect()]
    found = text.matrix_edges(spark, _matrix(spark, d, False), [f"n{k}" for k in names])
    return found.select(F.concat(F.lit("t"), F.substring("i", 2, 9)).alias("i"), "j", "v")


# -- accessors --------------------------------------------------------------------


@register("edge_listing", f"{HET} SELECT src, dst, type, weight FROM edges")
def _(spark, d):
    return het_graph(spark, d).edge_list(with_type=True, with_weight=True)


@register("node_type_lookup", f"{HET} SELECT DISTINCT src AS id, n.type FROM edges JOIN nodes n ON n.id = src")
def _(spark, d):
    g = het_graph(spark, d)
    return g.types_of(g.edges.select(F.col("src").alias("id")).distinct())


@register("graph_totals", f"{HET} SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT string_agg(DISTINCT type, ',' ORDER BY type) FROM nodes) AS node_types, (SELECT string_agg(DISTINCT type, ',' ORDER BY type) FROM edges) AS edge_types")
def _(spark, d):
    g = het_graph(spark, d)
    return spark.range(1).select(F.lit(g.number_of_nodes()).cast("long").alias("nodes"), F.lit(g.number_of_edges()).cast("long").alias("edges"), F.lit(",".join(g.node_types())).alias("node_types"), F.lit(",".join(g.edge_types())).alias("edge_types"))


def _sized(spark, d) -> Graph:
    """Orders without features, parts with vectors, edges with two numbers."""
    g = op_graph(spark, d)
    parts = table(spark, d, "part").select(key("p", "p_partkey").alias("id")).join(features(spark, d, "p"), "id", "left").select("id", F.lit("part").alias("type"), F.coalesce("features", V.zeros(64)).alias("features"))
    edges = g.edges.withColumn("features", F.array(F.col("weight"), F.col("weight") * 2))
    return Graph(g.nodes.where("type = 'order'").unionByName(parts), edges)


@register("feature_sizes", "SELECT 'node' AS of, 'order' AS type, 0 AS size UNION ALL SELECT 'node', 'part', 64 UNION ALL SELECT 'edge', 'contains', 2")
def _(spark, d):
    g = _sized(spark, d)
    return g.feature_sizes().select(F.lit("node").alias("of"), "type", "size").unionByName(g.feature_sizes("edge").select(F.lit("edge").alias("of"), "type", "size"))


@register("edge_features_gather", f"{OP} SELECT eid AS id, weight AS a, weight * 2 AS b FROM edges UNION ALL SELECT 'x' || o_orderkey, 0, 0 FROM orders")
def _(spark, d):
    g = _sized(spark, d)
    wanted = g.edges.select(F.lit(0).alias("pos"), F.col("eid").alias("id")).unionByName(table(spark, d, "orders").select(F.lit(0).alias("pos"), key("x", "o_orderkey").alias("id")))
    return query.gather_features(g, wanted, 2, of="edge").select("id", F.col("features")[0].alias("a"), F.col("features")[1].alias("b"))


@register("dense_ids", f"""{HET}, t AS (SELECT type, row_number() OVER (ORDER BY type) - 1 AS code FROM (SELECT DISTINCT type FROM nodes))
SELECT id, row_number() OVER (ORDER BY ('0x' || substr(md5(id), 1, 3))::INT % 1024, id) - 1 AS n, code FROM nodes JOIN t USING (type)""")
def _(spark, d):
    return query.dense_ids(het_graph(spark, d))


@register("schema_of_subset", f"""{HET}, t AS (SELECT DISTINCT a.type AS s, e.type AS r, b.type AS o FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst WHERE a.type IN ('customer', 'nation', 'order') AND b.type IN ('customer', 'nation', 'order'))
SELECT s AS node_type, s AS src_type, r AS type, o AS dst_type FROM t UNION SELECT o, o, r, s FROM t""")
def _(spark, d):
    g = het_graph(spark, d)
    return query.schema(g, g.nodes.where(F.col("type").isin("customer", "nation", "order")))


@register("connected_components_places", """WITH p AS (SELECT 'r' || r_regionkey AS id, r_regionkey AS r FROM region UNION ALL SELECT 'n' || n_nationkey, n_regionkey FROM nation UNION ALL SELECT 'c' || c_custkey, n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey
  UNION ALL SELECT 's' || s_suppkey, n_regionkey FROM supplier JOIN nation ON n_nationkey = s_nationkey), m AS (SELECT r, min(id) AS component, count(*) AS size FROM p GROUP BY r)
SELECT id, component, size, rank() OVER (ORDER BY size DESC, component) = 1 AS largest FROM p JOIN m USING (r)""")
def _(spark, d):
    """Regions, nations and the whole of customers and suppliers: a component a region."""
    g = het_graph(spark, d)
    g = replace(g, nodes=g.nodes.where(F.col("type").isin("region", "nation", "customer", "supplier")), edges=g.edges.where(F.col("type").isin("in_region", "lives_in", "located_in")))
    found = components.connected_components(g)
    return found.join(components.largest_component(found).select("id", F.lit(True).alias("largest")), "id", "left").withColumn("largest", F.coalesce("largest", F.lit(False)))


@register("spanning_forest_places", """SELECT 'nr' || n_nationkey AS eid FROM nation UNION ALL SELECT 'cn' || c_custkey FROM customer UNION ALL SELECT 'sn' || s_suppkey FROM supplier""")
def _(spark, d):
    """The places' edges once, and again with a greater weight: the lighter ones stay."""
    g = het_graph(spark, d)
    e = g.edges.where(F.col("type").isin("in_region", "lives_in", "located_in"))
    twice = e.unionByName(e.select(F.concat(F.lit("z"), "eid").alias("eid"), "src", "dst", "type", (F.col("weight") + 1).alias("weight"), "features"))
    return components.spanning_forest(replace(g, edges=twice)).select("eid")


# -- walks, splits, propagation ---------------------------------------------------


@register("metapath_walks_several", f"""SELECT * FROM ({metapath_sql(["customer", "nation", "customer"], 3)}) UNION ALL SELECT * FROM ({metapath_sql(["supplier", "part", "supplier"], 3).replace("0 AS walk", "1 AS walk")})""")
def _(spark, d):
    g = het_graph(spark, d)
    return walks.metapath_walks(g, g.nodes, [["customer", "nation", "customer"], ["supplier", "part", "supplier"]], length=3)


def _biased_weighted() -> str:
    return SQL["node2vec_walks"].replace("ELSE 2.0 END AS w", "ELSE 2.0 END * a.weight AS w").replace("ELSE 0.5 END AS w", "ELSE 0.5 END * a.weight AS w")


@register("node2vec_walks_weighted", _biased_weighted())
def _(spark, d):
    g = op_graph(spark, d)
    return walks.biased_walks(g, g.nodes, length=3, p=0.5, q=2.0, weighted=True)


NUMBERED_ENDS = """ls AS (SELECT id, row_number() OVER (ORDER BY ('0x' || substr(md5(id), 1, 3))::INT % 1024, id) - 1 AS n FROM nodes WHERE type = 'order'),
rs AS (SELECT id, row_number() OVER (ORDER BY ('0x' || substr(md5(id), 1, 3))::INT % 1024, id) - 1 AS n FROM nodes WHERE type = 'part'), want AS (SELECT CAST(floor(0.01 * count(*)) AS BIGINT) AS n FROM edges)"""
FRESH = """f AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, min((src, dst)) AS m FROM met WHERE src <> dst GROUP BY ALL),
near AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edges), free AS (SELECT m[1] AS src, m[2] AS dst FROM f ANTI JOIN near USING (a, b))
SELECT src, dst FROM free ORDER BY md5('42|' || src || '|' || dst), src, dst LIMIT (SELECT n FROM want)"""
SQL["edge_split_negatives_global"] = f"""{OP}, {NUMBERED_ENDS}, tries AS (SELECT unnest(range(CAST(floor(1.5 * n) AS BIGINT) + 16)) AS id FROM want),
ends AS (SELECT CAST(floor({draw_sql(42, "'s'", "0", "id")} * (SELECT count(*) FROM ls)) AS BIGINT) AS ns, CAST(floor({draw_sql(42, "'t'", "0", "id")} * (SELECT count(*) FROM rs)) AS BIGINT) AS nt FROM tries),
met AS (SELECT ls.id AS src, rs.id AS dst FROM ends JOIN ls ON ls.n = ns JOIN rs ON rs.n = nt), {FRESH}"""
DEPTH = draw_sql(42, "'depth'", "root", "walk")
SQL["edge_split_negatives_local"] = f"""WITH RECURSIVE w AS ({walk_sql(5, OP_ADJ)}), {op_sql()}, want AS (SELECT CAST(floor(0.01 * count(*)) AS BIGINT) AS n FROM edges),
dp AS (SELECT *, CASE WHEN {DEPTH} < 0.0 THEN 1 WHEN {DEPTH} < 0.25 THEN 2 WHEN {DEPTH} < 0.75 THEN 3 ELSE 4 END AS depth FROM w),
met AS (SELECT root AS src, arg_max(node, step) AS dst FROM dp WHERE step <= depth GROUP BY root, walk, depth HAVING count(DISTINCT node) = depth + 1), {FRESH}"""


@register("train_test_split", f"""{OP}, {NUMBERED_ENDS}, good AS (SELECT eid, src, dst FROM edges ORDER BY md5('42|' || eid), eid LIMIT (SELECT n FROM want)),
tries AS (SELECT unnest(range(CAST(floor(1.5 * n) AS BIGINT) + 16)) AS id FROM want),
ends AS (SELECT CAST(floor({draw_sql(42, "'s'", "0", "id")} * (SELECT count(*) FROM ls)) AS BIGINT) AS ns, CAST(floor({draw_sql(42, "'t'", "0", "id")} * (SELECT count(*) FROM rs)) AS BIGINT) AS nt FROM tries),
met AS (SELECT ls.id AS src, rs.id AS dst FROM ends JOIN ls ON ls.n = ns JOIN rs ON rs.n = nt)
SELECT src, dst, 1 AS label, (SELECT count(*) FROM edges) - (SELECT n FROM want) AS kept FROM good UNION ALL SELECT src, dst, 0, (SELECT count(*) FROM edges) - (SELECT n FROM want) FROM ({FRESH.replace("f AS", "WITH f AS", 1)})""")
def _(spark, d):
    g, pairs = splitter.train_test_split(op_graph(spark, d), 0.01, edge_type="contains")
    return pairs.withColumn("kept", F.lit(g.number_of_edges()).cast("long"))


def _propagation(rounds: int) -> str:
    ctes = ["l0 AS (SELECT id, id AS cluster FROM nodes)"]
    for k in range(1, rounds + 1):
        ctes.append(f"v{k} AS (SELECT node, cluster, count(*) AS n FROM half JOIN l{k - 1} ON id = nbr GROUP BY ALL)")
        ctes.append(f"l{k} AS MATERIALIZED (SELECT id, coalesce(c, cluster) AS cluster FROM l{k - 1} LEFT JOIN (SELECT node, arg_min(cluster, (-n, cluster)) AS c FROM v{k} GROUP BY node) ON node = id)")
    return f"{OP},\n{HALF_SQL}, {', '.join(ctes)} SELECT id, cluster FROM l{rounds}"


SQL["label_propagation"] = _propagation(3)


# -- batches ------------------------------------------------------------------------


def _slots(df: DataFrame, *by: str) -> DataFrame:
    """(by…, slot, f): the first component of each row of a batch's tensors."""
    return df.select(*by, F.posexplode("features").alias("slot", "x")).select(*by, F.col("slot").cast("long").alias("slot"), F.round(F.col("x")[0], 6).alias("f"))


def _with_vectors(samples: str, *by: str, prefix: str = "p") -> str:
    return f"SELECT {', '.join(by)}, slot, coalesce(round(embedding[1]::DOUBLE, 6), 0.0) AS f FROM ({samples}) b LEFT JOIN embeddings ON '{prefix}' || vec_id = node AND node LIKE '{prefix}%'"


@register("graphsage_node_batches", _with_vectors(bfs_sql([3, 2]), "root", "hop"))
def _(spark, d):
    g = featured(spark, d)
    return _slots(B.graphsage_nodes(g, g.node_ids("order"), [3, 2], 4), "root", "hop")


@register("directed_graphsage_batches", _with_vectors(directed_bfs_sql(), "root", "part"))
def _(spark, d):
    g = replace(featured(spark, d), directed=True)
    return _slots(B.directed_graphsage_nodes(g, g.node_ids("order"), [2, 2], [2, 2], 4), "root", "part")


@register("hinsage_node_batches", _with_vectors(hin_sql([2, 2]), "root", "path", "node_type"))
def _(spark, d):
    g = het_graph(spark, d).with_features(features(spark, d, "p", 4), 4)
    return _slots(B.hinsage_nodes(g, g.node_ids("customer"), [2, 2], 4), "root", "path", "node_type")


def _end_samples(side: str, seed: int) -> str:
    return f"SELECT e.src, e.dst, '{side}' AS side, hop, slot, coalesce(round(embedding[1]::DOUBLE, 6), 0.0) AS f FROM (SELECT DISTINCT src, dst FROM edges) e JOIN s{side} ON root = e.{side} LEFT JOIN embeddings ON 'p' || vec_id = node"


def _from_all(sizes: list[int], seed: int) -> str:
    return bfs_sql(sizes, seed=seed).replace("FROM nodes WHERE type = 'order'", "FROM nodes")


@register("graphsage_link_batches", f"""WITH {op_sql()}, ssrc AS MATERIALIZED ({_from_all([2], 84)}), sdst AS MATERIALIZED ({_from_all([2], 85)})
{_end_samples("src", 84)} UNION ALL {_end_samples("dst", 85)}""")
def _(spark, d):
    g = featured(spark, d)
    pairs = g.edges.select("src", "dst").distinct().withColumn("label", F.lit(1))
    return _slots(B.graphsage_links(g, pairs, [2], 4), "src", "dst", "side", "hop")


@register("full_batch_attention", f"{ADJ0} SELECT i, j, v FROM a WHERE i <> j UNION ALL SELECT id, id, 1.0 FROM nodes")
def _(spark, d):
    return B.full_batch(op_graph(spark, d), "gat")[1]


@register("full_batch_transform", f"{ADJ0} SELECT i, j, v * 2 AS v FROM a")
def _(spark, d):
    return B.full_batch(op_graph(spark, d), lambda adj, nodes: adj.withColumn("v", F.col("v") * 2))[1]


@register("padded_graph_features", """WITH g AS (SELECT label AS graph_id, count(*) AS n, (row_number() OVER (ORDER BY label) - 1) // 4 AS batch FROM embeddings GROUP BY label), m AS (SELECT *, max(n) OVER (PARTITION BY batch) AS most FROM g),
r AS (SELECT label AS graph_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS row, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b FROM embeddings)
SELECT m.graph_id, x.row, x.row < m.n AS real, coalesce(round(a, 6), 0.0) AS a, coalesce(round(b, 6), 0.0) AS b FROM (SELECT *, unnest(range(most)) AS row FROM m) x JOIN m USING (graph_id) LEFT JOIN r ON r.graph_id = x.graph_id AND r.row = x.row""")
def _(spark, d):
    x = table(spark, d, "embeddings").select(F.col("label").alias("graph_id"), F.col("vec_id").alias("id"), F.slice(F.col("embedding").cast("array<double>"), 1, 2).alias("features"))
    found = B.padded_graphs(x, per_batch=4, size=2).select("graph_id", F.posexplode(F.arrays_zip("features", "mask")).alias("row", "x"))
    return found.select("graph_id", F.col("row").cast("long").alias("row"), F.col("x.mask").alias("real"), F.round(F.col("x.features")[0], 6).alias("a"), F.round(F.col("x.features")[1], 6).alias("b"))


@register("sort_pooling_values", """WITH r AS (SELECT label, embedding::DOUBLE[] AS e, row_number() OVER (PARTITION BY label ORDER BY embedding[64]::DOUBLE DESC, vec_id) - 1 AS r FROM embeddings)
SELECT label AS graph_id, r * 64 + k - 1 AS k, round(e[k], 6) AS f FROM r, range(1, 65) t(k) WHERE r < 3""")
def _(spark, d):
    x = table(spark, d, "embeddings").select(F.col("label").alias("graph_id"), F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"))
    return B.sort_pooling(x, 3, 64).select("graph_id", F.posexplode("features").alias("k", "f")).select("graph_id", F.col("k").cast("long").alias("k"), F.round("f", 6).alias("f"))


@register("mean_pooling", "SELECT label AS graph_id, k, round(avg(embedding[k]::DOUBLE), 6) AS f FROM embeddings, range(1, 65) t(k) GROUP BY ALL")
def _(spark, d):
    e = table(spark, d, "embeddings")
    pooled = layers.mean_pool(features(spark, d, ""), e.select(F.col("vec_id").cast("string").alias("id"), F.col("label").alias("graph_id")), 64)
    return pooled.select("graph_id", F.posexplode("features").alias("k", "f")).select("graph_id", (F.col("k") + 1).cast("long").alias("k"), F.round("f", 6).alias("f"))


@register("bagged_rows", f"""WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS n FROM customer), t AS (SELECT unnest(range(300)) AS id)
SELECT id % 3 AS model, c_custkey FROM t JOIN r ON n = CAST(floor({draw_sql(42, "id")} * (SELECT count(*) FROM customer)) AS BIGINT)""")
def _(spark, d):
    rows = sampling.ordered(table(spark, d, "customer").select("c_custkey"), "c_custkey")
    return calibration.bagged(rows, 3, 100).select("model", "c_custkey")


# -- layers -----------------------------------------------------------------------

WEIGHTS = f"w(k, o, w) AS (VALUES {', '.join(f'({i + 1}, {o + 1}, {W42[i][o]}::DOUBLE)' for i in range(4) for o in range(2))}), h AS (SELECT id, o, sum(f * w) AS f FROM x0 JOIN w USING (k) GROUP BY ALL)"
OWN, OTHER = [0.5, -0.25], [0.75, 0.125]
ATTENTION = f"""s AS (SELECT id, sum(f * CASE o WHEN 1 THEN {OWN[0]} ELSE {OWN[1]} END) AS a, sum(f * CASE o WHEN 1 THEN {OTHER[0]} ELSE {OTHER[1]} END) AS b FROM h GROUP BY id),
l AS (SELECT a.i, a.j, CASE WHEN x.a + y.b >= 0 THEN x.a + y.b ELSE 0.2 * (x.a + y.b) END AS l FROM a JOIN s x ON x.id = a.i JOIN s y ON y.id = a.j),
e AS (SELECT i, j, exp(l - max(l) OVER (PARTITION BY i)) AS e FROM l), z AS (SELECT i AS id, o, sum(e * f) / sum(e) AS f FROM e JOIN h ON h.id = e.j GROUP BY ALL)"""


@register("gat_layer_forward", f"{ADJ0}, {X4}, {WEIGHTS}, {ATTENTION} SELECT id, o::BIGINT AS k, round(CASE WHEN f > 0 THEN f ELSE exp(f) - 1 END, 6) + 0.0 AS f FROM z")
def _(spark, d):
    g = featured(spark, d)
    return long_form(layers.gat_layer(A.adjacency_matrix(g), g.nodes, [(W42, OWN, OTHER)]))


@register("sage_attention_layer", f"{ADJ0}, {X4}, {WEIGHTS}, {ATTENTION} SELECT id, o::BIGINT AS k, round(f, 6) + 0.0 AS f FROM h UNION ALL SELECT h.id, h.o + 2, round(coalesce(z.f, 0), 6) + 0.0 FROM h LEFT JOIN z ON z.id = h.id AND z.o = h.o")
def _(spark, d):
    g = featured(spark, d)
    return long_form(layers.sage_attention_layer(A.adjacency_matrix(g), g.nodes, W42, W42, OWN, OTHER, activation="linear"))


def _pooled(how: str) -> str:
    return f"""{ADJ0}, {X4}, {WEIGHTS}, p AS (SELECT i AS id, o, {how}(greatest(f, 0)) AS f FROM a JOIN h ON h.id = j GROUP BY ALL)
SELECT id, k, round(f, 6) + 0.0 AS f FROM x0 UNION ALL SELECT h.id, h.o + 4, round(coalesce(p.f, 0), 6) + 0.0 FROM h LEFT JOIN p ON p.id = h.id AND p.o = h.o"""


EYE4, EYE2 = ([[1.0 if i == j else 0.0 for j in range(n)] for i in range(n)] for n in (4, 2))


def _sage_pool(spark, d, how: str) -> DataFrame:
    g = featured(spark, d)
    return long_form(layers.sage_layer(A.adjacency_matrix(g), g.nodes, EYE4, EYE2, aggregator=how, pool=W42, activation="linear"))


@register("sage_maxpool_layer", _pooled("max"))
def _(spark, d):
    return _sage_pool(spark, d, "maxpool")


@register("sage_meanpool_layer", _pooled("avg"))
def _(spark, d):
    return _sage_pool(spark, d, "meanpool")


@register("directed_sage_layer", f"""{OP}, {X4}, i AS (SELECT dst AS id, k, avg(f) AS f FROM edges JOIN x0 ON id = src GROUP BY ALL), o AS (SELECT src AS id, k, avg(f) AS f FROM edges JOIN x0 ON id = dst GROUP BY ALL)
SELECT id, k, round(f, 6) + 0.0 AS f FROM x0 UNION ALL SELECT x0.id, x0.k + 4, round(coalesce(i.f, 0), 6) + 0.0 FROM x0 LEFT JOIN i ON i.id = x0.id AND i.k = x0.k UNION ALL SELECT x0.id, x0.k + 8, round(coalesce(o.f, 0), 6) + 0.0 FROM x0 LEFT JOIN o ON o.id = x0.id AND o.k = x0.k""")
def _(spark, d):
    g = replace(featured(spark, d), directed=True)
    return long_form(layers.directed_sage_layer(g, g.nodes, EYE4, EYE4, EYE4, activation="linear"))


HIN_X = """hx AS (SELECT n.id, n.type, k, CASE WHEN embedding IS NULL THEN 0.0 ELSE embedding[k]::DOUBLE END AS f FROM (SELECT id, type, unnest(range(1, 5)) AS k FROM nodes) n LEFT JOIN embeddings ON 'p' || vec_id = n.id)"""


@register("hinsage_layer", f"""{HET}, {HIN_X}, a AS (SELECT dst AS id, k, avg(f) AS f FROM edges JOIN hx ON hx.id = src WHERE edges.type = 'supplied_by' GROUP BY ALL),
b AS (SELECT src AS id, k, avg(f) AS f FROM edges JOIN hx ON hx.id = dst WHERE edges.type = 'contains' GROUP BY ALL), m AS (SELECT id, k, avg(f) AS f FROM (FROM a UNION ALL FROM b) GROUP BY ALL)
SELECT id, k, round(f, 6) + 0.0 AS f FROM hx WHERE type IN ('supplier', 'order') UNION ALL SELECT hx.id, hx.k + 4, round(coalesce(m.f, 0), 6) + 0.0 FROM hx LEFT JOIN m ON m.id = hx.id AND m.k = hx.k WHERE type IN ('supplier', 'order')""")
def _(spark, d):
    g = het_graph(spark, d).with_features(features(spark, d, "p", 4), 4)
    own = {"supplier": EYE4, "order": EYE4}
    return long_form(layers.hinsage_layer(g, g.nodes, own, {("supplier", "supplied_by", "part"): EYE4, ("order", "contains", "part"): EYE4}, activation="linear"))


@register("infomax_logits", f"""WITH x AS (SELECT vec_id, embedding[1:4]::DOUBLE[] AS e FROM embeddings), m AS (SELECT k, 1 / (1 + exp(-avg(e[k]))) AS s FROM x, range(1, 5) t(k) GROUP BY k),
w(k, o, w) AS (VALUES {', '.join(f'({i + 1}, {o + 1}, {1.0 if i == o else 0.25}::DOUBLE)' for i in range(4) for o in range(4))}), v AS (SELECT w.k, sum(w * s) AS v FROM w JOIN m ON m.k = w.o GROUP BY w.k)
SELECT CAST(vec_id AS VARCHAR) AS id, real, round(sum(CASE WHEN real THEN e[k] ELSE e[5 - k] END * v), 6) AS logit FROM x, (VALUES (true), (false)) r(real), v GROUP BY ALL""")
def _(spark, d):
    x = features(spark, d, "", 4)
    weights = [[1.0 if i == j else 0.25 for j in range(4)] for i in range(4)]
    return layers.infomax_scores(x, x.withColumn("features", F.reverse("features")), weights).withColumn("logit", F.round("logit", 6))


NATIONS = """nr AS (SELECT 'n' || n_nationkey AS i, 'r' || n_regionkey AS j FROM nation), a AS (SELECT i, j, 1.0::DOUBLE AS v FROM nr UNION ALL SELECT j, i, 1.0 FROM nr), dg AS (SELECT i, sum(v) AS d FROM a GROUP BY i)"""


def _nations(spark, d) -> Graph:
    g = het_graph(spark, d)
    return replace(g, nodes=g.nodes.where(F.col("type").isin("nation", "region")), edges=g.edges.where(F.col("type") == "in_region"))


@register("matrix_power_3", f"""WITH {NATIONS}, s AS ({"SELECT a.i, a.j, a.v / sqrt(x.d * y.d) AS v FROM a JOIN dg x ON x.i = a.i JOIN dg y ON y.i = a.j"}), q AS (SELECT x.i, y.j, sum(x.v * y.v) AS v FROM s x JOIN s y ON x.j = y.i GROUP BY ALL)
SELECT x.i, y.j, round(sum(x.v * y.v), 6) AS v FROM q x JOIN s y ON x.j = y.i GROUP BY ALL""")
def _(spark, d):
    return linalg.power(linalg.normalized(A.adjacency_matrix(_nations(spark, d))), 3).withColumn("v", F.round("v", 6))


@register("attention_over_powers", f"""WITH {NATIONS}, t AS (SELECT a.i, a.j, v / d AS v FROM a JOIN dg USING (i)), q AS (SELECT x.i, y.j, sum(x.v * y.v) AS v FROM t x JOIN t y ON x.j = y.i GROUP BY ALL)
SELECT i, j, round(sum(v), 6) AS v FROM (SELECT i, j, v * exp(1) / (exp(1) + exp(0.5)) AS v FROM t UNION ALL SELECT i, j, v * exp(0.5) / (exp(1) + exp(0.5)) FROM q) GROUP BY ALL""")
def _(spark, d):
    powers = linalg.adjacency_powers(A.adjacency_matrix(_nations(spark, d)), 2)
    return layers.attention_over_powers(powers, [1.0, 0.5]).withColumn("v", F.round("v", 6))


@register("integrated_gradients", f"""{ADJ0}, {GCN}, {X4}, t AS (SELECT g.j AS i, g.v FROM g WHERE g.i = 'o1'), r AS (SELECT g.j AS id, sum(t.v * g.v) AS v FROM t JOIN g USING (i) GROUP BY g.j)
SELECT id, round(r.v * sum(f * CASE k WHEN 1 THEN {W42[0][1]} WHEN 2 THEN {W42[1][1]} WHEN 3 THEN {W42[2][1]} ELSE {W42[3][1]} END), 6) + 0.0 AS importance FROM r JOIN x0 USING (id) GROUP BY id, r.v""")
def _(spark, d):
    g = featured(spark, d)
    found = layers.integrated_gradients(linalg.gcn_matrix(A.adjacency_matrix(g), g.nodes), g.nodes, "o1", W42, 1, 2, 4)
    return found.withColumn("importance", F.round("importance", 6))


# -- scores -----------------------------------------------------------------------


def halves(name: str) -> Column:
    return F.struct(F.slice(name, 1, 32).alias("re"), F.slice(name, 33, 32).alias("im")).alias(name)


@register("rotate_scores", f"""WITH {KG} SELECT src, dst, round(12 - list_sum(list_transform(range(1, 33), lambda k: sqrt(pow(s.e[k] * cos(r.r[k]) - s.e[k + 32] * sin(r.r[k]) - o.e[k], 2) + pow(s.e[k] * sin(r.r[k]) + s.e[k + 32] * cos(r.r[k]) - o.e[k + 32], 2)))), 6) AS score
FROM tr JOIN en s ON s.id = src JOIN en o ON o.id = dst, r""")
def _(spark, d):
    t, e, r = kg_tables(spark, d)
    return links.score_triples(t, e.select("id", halves("e")), r.select("type", F.slice("r", 1, 32).alias("r")), "rotate").select("src", "dst", F.round("score", 6).alias("score"))


def _turned(e: str, angle: str) -> str:
    """Pairs of components turned: component k from 1 of the result."""
    return f"list_transform(range(1, 63), lambda k: CASE WHEN k % 2 = 1 THEN cos({angle}[(k + 1) // 2]) * {e}[k] - sin({angle}[(k + 1) // 2]) * {e}[k + 1] ELSE sin({angle}[k // 2]) * {e}[k - 1] + cos({angle}[k // 2]) * {e}[k] END)"


def _ends(e: DataFrame, r: DataFrame) -> tuple[DataFrame, DataFrame]:
    """62 components a node and a bias, the 64th; 31 angles a relation, and a shift of 62."""
    return (
        e.select("id", F.struct(F.slice("e", 1, 62).alias("x"), F.col("e")[63].alias("bias")).alias("e")),
        r.select("type", F.struct(F.slice("r", 1, 31).alias("angle"), F.slice("r", 1, 62).alias("shift")).alias("r")),
    )


ENDS = f"{KG}, t AS (SELECT src, dst, s.e AS s, o.e AS o, {_turned('s.e', 'r.r')} AS x, r.r AS r FROM tr JOIN en s ON s.id = src JOIN en o ON o.id = dst, r)"


@register("rote_scores", f"WITH {ENDS} SELECT src, dst, round(s[64] + o[64] - list_sum(list_transform(range(1, 63), lambda k: pow(x[k] + r[k] - o[k], 2))), 5) AS score FROM t")
def _(spark, d):
    t, e, r = kg_tables(spark, d)
    return links.score_triples(t, *_ends(e, r), "rote").select("src", "dst", F.round("score", 5).alias("score"))


@register("rank_summary", f"""WITH r AS ({SQL["kg_filtered_ranks"]}) SELECT round(avg(1 / raw_rank), 6) AS raw_mrr, round(avg(1 / filtered_rank), 6) AS filtered_mrr, round(avg((raw_rank <= 10)::INT), 6) AS raw_hits_at_10, round(avg((filtered_rank <= 10)::INT), 6) AS filtered_hits_at_10 FROM r""")
def _(spark, d):
    t, e, r = kg_tables(spark, d)
    found = links.rank_summary(links.rank_triples(t, t, e, r))
    return found.select(*(F.round(c, 6).alias(c) for c in ("raw_mrr", "filtered_mrr", "raw_hits_at_10", "filtered_hits_at_10")))


@register("walk_log_likelihood", """WITH p AS (SELECT x.n_nationkey AS i, y.n_nationkey AS j, x.n_regionkey = y.n_regionkey AS near, list_sum(list_transform(range(1, 65), lambda k: u.embedding[k]::DOUBLE * v.embedding[k]::DOUBLE)) AS s
  FROM nation x, nation y, embeddings u, embeddings v WHERE u.vec_id = x.n_nationkey AND v.vec_id = y.n_nationkey) SELECT round(-sum(CASE WHEN near THEN 0.5 * -ln(1 + exp(-s)) ELSE -ln(1 + exp(s)) END), 4) AS loss FROM p""")
def _(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), "n_regionkey").join(table(spark, d, "embeddings").select(F.col("vec_id").alias("k"), F.col("embedding").cast("array<double>").alias("e")), "k")
    # 25 nations with each other: a stated query set
    p = n.select(F.col("k").alias("i"), F.col("n_regionkey").alias("a"), F.col("e").alias("u")).join(F.broadcast(n.select(F.col("k").alias("j"), F.col("n_regionkey").alias("b"), F.col("e").alias("v"))), F.lit(True))
    near = p.where("a = b").select("i", "j")
    loss = links.graph_log_likelihood(near.withColumn("v", F.lit(0.5)), near, p.select("i", "j", V.dot("u", "v").alias("s")))
    return loss.select(F.round("loss", 4).alias("loss"))


def _digest(x: Column | str) -> Column:
    """Components in order, in ten-thousandths, as one digest."""
    return F.md5(F.array_join(F.transform(V.col(x), lambda v: F.round(v * 10000).cast("bigint").cast("string")), ","))


_LISTS = {
    "l1": "list_transform(range(1, 65), lambda k: abs(u[k] - v[k]))", "l2": "list_transform(range(1, 65), lambda k: (u[k] - v[k]) * (u[k] - v[k]))",
    "hadamard": "list_transform(range(1, 65), lambda k: u[k] * v[k])", "avg": "list_transform(range(1, 65), lambda k: (u[k] + v[k]) / 2)", "concat": "list_concat(u, v)",
}


@register("link_embedding_digests", f"WITH {PAIRS} " + " UNION ALL ".join(
    f"SELECT '{m}' AS method, a, b, md5(array_to_string(list_transform({x}, lambda y: CAST(round(y * 10000) AS BIGINT)), ',')) AS digest FROM uv" for m, x in _LISTS.items()
))
def _(spark, d):
    """Every component of the array methods, in order."""
    pairs = table(spark, d, "lineitem").select(F.col("l_partkey").cast("string").alias("src"), F.col("l_suppkey").cast("string").alias("dst")).distinct()
    out = None
    for m in _LISTS:
        one = links.embedded_pairs(pairs, features(spark, d, ""), m).select(F.lit(m).alias("method"), F.col("src").cast("long").alias("a"), F.col("dst").cast("long").alias("b"), _digest("embedding").alias("digest"))
        out = one if out is None else out.unionByName(one)
    return out


@register("corrupt_features_digest", """WITH e AS (SELECT 'v' || vec_id AS id, embedding::DOUBLE[] AS f FROM embeddings), a AS (SELECT id, row_number() OVER (ORDER BY ('0x' || substr(md5(id), 1, 3))::INT % 1024, id) AS n FROM e),
h AS (SELECT f, md5('42|' || id) AS h FROM e), b AS (SELECT f, row_number() OVER (ORDER BY ('0x' || substr(md5(h), 1, 3))::INT % 1024, h) AS n FROM h)
SELECT id, md5(array_to_string(list_transform(f, lambda y: CAST(round(y * 10000) AS BIGINT)), ',')) AS digest FROM a JOIN b USING (n)""")
def _(spark, d):
    return B.corrupted(features(spark, d, "v")).select("id", _digest("features").alias("digest"))


# -- further batches, layers and files ----------------------------------------------

DENSE = "dn AS (SELECT id, row_number() OVER (ORDER BY ('0x' || substr(md5(id), 1, 3))::INT % 1024, id) - 1 AS n FROM nodes)"


def _pairs(g: Graph) -> DataFrame:
    return g.edges.select("src", "dst").distinct().withColumn("label", F.lit(1))


@register("node2vec_link_batches", f"{OP}, {DENSE} SELECT DISTINCT src, dst, x.n AS src_n, y.n AS dst_n FROM edges JOIN dn x ON x.id = src JOIN dn y ON y.id = dst")
def _(spark, d):
    g = op_graph(spark, d)
    return B.node2vec_links(g, _pairs(g)).drop("label")


@register("attri2vec_link_batches", f"{OP}, {DENSE} SELECT DISTINCT dst AS src, src AS dst, y.n, coalesce(round(embedding[1]::DOUBLE, 6), 0.0) AS f FROM edges JOIN dn y ON y.id = src LEFT JOIN embeddings ON 'p' || vec_id = dst")
def _(spark, d):
    g = featured(spark, d)
    turned = _pairs(g).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "label")
    return B.attri2vec_links(g, turned).select("src", "dst", "n", F.round(F.col("features")[0], 6).alias("f"))


@register("node2vec_node_batches", f"{OP}, {DENSE} SELECT id, n FROM dn WHERE id LIKE 'p%'")
def _(spark, d):
    g = op_graph(spark, d)
    return B.node2vec_nodes(g, g.node_ids("part"))


@register("attri2vec_node_batches", "SELECT 'p' || p_partkey AS id, coalesce(round(embedding[1]::DOUBLE, 6), 0.0) AS f FROM part LEFT JOIN embeddings ON vec_id = p_partkey")
def _(spark, d):
    g = featured(spark, d)
    return B.attri2vec_nodes(g, g.node_ids("part")).select("id", F.round(F.col("features")[0], 6).alias("f"))


def _directed_ends(side: str, seed: int) -> str:
    samples = directed_bfs_sql(seed).replace("FROM nodes WHERE type = 'order'", "FROM nodes")
    return f"SELECT e.src, e.dst, '{side}' AS side, part, slot, coalesce(round(embedding[1]::DOUBLE, 6), 0.0) AS f FROM (SELECT DISTINCT src, dst FROM edges) e JOIN ({samples}) s ON root = e.{side} LEFT JOIN embeddings ON 'p' || vec_id = node"


@register("directed_link_batches", f"WITH {op_sql()} {_directed_ends('src', 84)} UNION ALL {_directed_ends('dst', 85)}")
def _(spark, d):
    g = replace(featured(spark, d), directed=True)
    return _slots(B.directed_graphsage_links(g, _pairs(g), [2, 2], [2, 2], 4), "src", "dst", "side", "part")


CHAINS = """c AS (SELECT label AS g, vec_id AS id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS at, lead(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS nxt FROM embeddings),
b AS (SELECT g, id AS i, nxt AS j FROM c WHERE nxt IS NOT NULL UNION ALL SELECT g, nxt, id FROM c WHERE nxt IS NOT NULL UNION ALL SELECT g, id, id FROM c), dg AS (SELECT g, i, count(*) AS d FROM b GROUP BY ALL),
m AS (SELECT b.g, b.i, b.j, 1 / sqrt(x.d * y.d) AS v FROM b JOIN dg x ON x.g = b.g AND x.i = b.i JOIN dg y ON y.g = b.g AND y.i = b.j)"""


def _chains(spark, d) -> tuple[DataFrame, DataFrame]:
    """Vectors of one label as a graph, each joined to the next."""
    e = table(spark, d, "embeddings").select(F.col("label").alias("graph_id"), F.col("vec_id").alias("id"))
    after = F.lead("id").over(W.partitionBy("graph_id").orderBy("id"))
    return e, e.select("graph_id", F.col("id").alias("src"), after.alias("dst")).where("dst is not null")


@register("padded_graph_adjacency", f"WITH {CHAINS} SELECT m.g AS graph_id, x.at AS row, y.at AS col, round(v, 6) AS v FROM m JOIN c x ON x.id = i JOIN c y ON y.id = j")
def _(spark, d):
    found = B.padded_adjacency(*_chains(spark, d))
    return found.select("graph_id", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.round("v", 6).alias("v"))


@register("padded_graph_pairs", """WITH n AS (SELECT label, count(*) AS n, (row_number() OVER (ORDER BY label) - 1) // 4 AS b FROM embeddings GROUP BY label), m AS (SELECT label, n, max(n) OVER (PARTITION BY b) AS most FROM n)
SELECT x.label AS left, y.label AS right, x.n AS left_n, y.n AS right_n, x.most AS left_rows, y.most AS right_rows FROM m x JOIN m y ON y.label = x.label + 1""")
def _(spark, d):
    x = table(spark, d, "embeddings").select(F.col("label").alias("graph_id"), F.col("vec_id").alias("id"), F.slice(F.col("embedding").cast("array<double>"), 1, 2).alias("features"))
    padded = B.padded_graphs(x, per_batch=4, size=2)
    pairs = padded.select(F.col("graph_id").alias("left"), (F.col("graph_id") + 1).alias("right"))
    real = lambda c: F.size(F.filter(c, lambda m: m)).cast("long")
    return B.graph_pairs(padded, pairs).select("left", "right", *(f.alias(n) for s in ("left", "right") for n, f in ((f"{s}_n", real(f"{s}_mask")), (f"{s}_rows", F.size(f"{s}_features").cast("long")))))


@register("deep_graph_cnn", f"""WITH {CHAINS}, x AS (SELECT vec_id AS id, k, embedding[k]::DOUBLE AS f FROM embeddings, range(1, 5) t(k)), w(k, o, w) AS (VALUES {', '.join(f'({i + 1}, {o + 1}, {W42[i][o]}::DOUBLE)' for i in range(4) for o in range(2))}),
h AS (SELECT id, o, sum(f * w) AS f FROM x JOIN w USING (k) GROUP BY ALL), a AS (SELECT i AS id, o, tanh(sum(v * f)) AS f FROM m JOIN h ON h.id = j GROUP BY ALL),
z AS (SELECT i AS id, tanh(sum(v * f * CASE o WHEN 1 THEN {OWN[0]} ELSE {OWN[1]} END)) AS f FROM m JOIN a ON a.id = j GROUP BY i),
r AS (SELECT c.g, c.id, z.f AS last, row_number() OVER (PARTITION BY c.g ORDER BY round(z.f, 9) DESC, c.id) - 1 AS r FROM c JOIN z ON z.id = c.id)
SELECT g AS graph_id, r.r * 3 + o - 1 AS k, round(a.f, 5) AS f FROM r JOIN a USING (id) WHERE r < 3 UNION ALL SELECT g, r * 3 + 2, round(last, 5) FROM r WHERE r < 3""")
def _(spark, d):
    nodes, edges = _chains(spark, d)
    ends = edges.select(F.col("src").cast("string").alias("i"), F.col("dst").cast("string").alias("j"))
    both = ends.unionByName(ends.select(F.col("j").alias("i"), F.col("i").alias("j"))).withColumn("v", F.lit(1.0))
    x = features(spark, d, "", 4)
    matrix = linalg.normalized(linalg.with_self_loops(both, x))
    graphs = nodes.select(F.col("id").cast("string").alias("id"), "graph_id")
    found = layers.deep_graph_cnn(matrix, x, graphs, [(W42, None, "tanh"), ([[OWN[0]], [OWN[1]]], None, "tanh")], 3)
    return found.select("graph_id", F.posexplode("features").alias("k", "f")).select("graph_id", F.col("k").cast("long").alias("k"), F.round("f", 5).alias("f"))


@register("cluster_targets", f"{OP} SELECT ('0x' || substr(md5(id), 1, 4))::INT % 20 // 2 AS batch, id FROM nodes WHERE type = 'part'")
def _(spark, d):
    g = op_graph(spark, d)
    of = (F.conv(F.substring(F.md5("id"), 1, 4), 16, 10).cast("int") % 20 / 2).cast("int")
    return B.cluster_targets(g.nodes.select("id", of.alias("batch")), g.node_ids("part"))


@register("graphml_lines", """SELECT '<node id="n' || n_nationkey || '"><data key="type">nation</data></node>' AS line FROM nation UNION ALL SELECT '<node id="r' || r_regionkey || '"><data key="type">region</data></node>' FROM region
UNION ALL SELECT '<edge id="nr' || n_nationkey || '" source="n' || n_nationkey || '" target="r' || n_regionkey || '"><data key="type">in_region</data><data key="weight">1.0</data></edge>' FROM nation""")
def _(spark, d):
    path = folder(spark, "graphml")
    epgm.write_graphml(_nations(spark, d), path)
    return spark.read.text(path).where("value like '<node%' or value like '<edge%'").select(F.col("value").alias("line"))


@register("sage_custom_aggregator", f"""{ADJ0}, {X4}, mn AS (SELECT i AS id, k, min(f) AS f FROM a JOIN x0 ON id = j GROUP BY ALL)
SELECT id, k, round(f, 6) + 0.0 AS f FROM x0 UNION ALL SELECT x0.id, x0.k + 4, round(coalesce(mn.f, 0), 6) + 0.0 FROM x0 LEFT JOIN mn ON mn.id = x0.id AND mn.k = x0.k""")
def _(spark, d):
    g = featured(spark, d)
    return long_form(layers.sage_layer(A.adjacency_matrix(g), g.nodes, EYE4, EYE4, aggregator=F.min, activation="linear"))


@register("max_pooling", "SELECT label AS graph_id, k, round(max(embedding[k]::DOUBLE), 6) AS f FROM embeddings, range(1, 65) t(k) GROUP BY ALL")
def _(spark, d):
    e = table(spark, d, "embeddings")
    pooled = layers.mean_pool(features(spark, d, ""), e.select(F.col("vec_id").cast("string").alias("id"), F.col("label").alias("graph_id")), 64, F.max)
    return pooled.select("graph_id", F.posexplode("features").alias("k", "f")).select("graph_id", (F.col("k") + 1).cast("long").alias("k"), F.round("f", 6).alias("f"))


# -- whole graphs and whole vectors ---------------------------------------------------

X64 = X4.replace("range(1, 5)", "range(1, 65)")
W64_SQL = f"w(k, o, w) AS (VALUES {', '.join(f'({i + 1}, {o + 1}, {W642[i][o]}::DOUBLE)' for i in range(64) for o in range(2))})"
W4_SQL = f"w(k, o, w) AS (VALUES {', '.join(f'({i + 1}, {o + 1}, {W42[i][o]}::DOUBLE)' for i in range(4) for o in range(2))})"


def _all_components(name: str) -> str:
    """The named query's SQL over all 64 features, a digest a node."""
    sql = SQL[name].replace(X4, X64).replace(W4_SQL, W64_SQL).replace("x0.k + 4", "x0.k + 64")
    return f"SELECT id, md5(string_agg(CAST(CAST(round(f * 10000) AS BIGINT) AS VARCHAR), ',' ORDER BY k)) AS digest FROM ({sql}) GROUP BY id"


def _rounded_digest(df: DataFrame) -> DataFrame:
    return df.select("id", _digest(F.transform("features", lambda v: F.round(v, 6))).alias("digest"))


@register("sgc_features_digest", _all_components("sgc_features_k2"))
def _(spark, d):
    g = featured(spark, d, 64)
    return _rounded_digest(linalg.gcn_propagate_k(g, 64, 2))


@register("appnp_digest", _all_components("appnp_k3"))
def _(spark, d):
    g = featured(spark, d, 64)
    return _rounded_digest(linalg.gcn_appnp(g, 64, k=3, alpha=0.125))


@register("gcn_layer_digest", _all_components("gcn_layer_forward"))
def _(spark, d):
    g = featured(spark, d, 64)
    return _rounded_digest(layers.gcn_layer(linalg.gcn_matrix(A.adjacency_matrix(g), g.nodes), g.nodes, W642, B2))


@register("sage_mean_digest", _all_components("sage_mean_layer"))
def _(spark, d):
    g = featured(spark, d, 64)
    eye = [[1.0 if i == j else 0.0 for j in range(64)] for i in range(64)]
    return _rounded_digest(layers.sage_layer(A.adjacency_matrix(g), g.nodes, eye, eye, activation="linear"))


@register("rgcn_layer_digest", _all_components("rgcn_layer_forward"))
def _(spark, d):
    g = featured(spark, d, 64)
    return _rounded_digest(layers.rgcn_layer(g.edges, g.nodes, W642, {"contains": W642}, activation="linear"))


def _least_labels(rounds: int) -> str:
    """Components by rounds of least labels; exact where as many rounds settle them."""
    ctes = ["l0 AS (SELECT id, id AS c FROM nodes)"]
    for k in range(1, rounds + 1):
        ctes.append(f"l{k} AS MATERIALIZED (SELECT l.id, least(l.c, coalesce(m, l.c)) AS c FROM l{k - 1} l LEFT JOIN (SELECT node, min(c) AS m FROM half JOIN l{k - 1} ON id = nbr GROUP BY node) ON node = l.id)")
    return f"{OP},\n{HALF_SQL}, {', '.join(ctes)} SELECT id, c AS component, count(*) OVER (PARTITION BY c) AS size FROM l{rounds}"


SQL["connected_components_whole"] = _least_labels(20)
SQL["adjacency_power_2_whole"] = SQL["adjacency_power_2"].replace(op_sql(45), op_sql())
