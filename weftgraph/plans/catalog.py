"""The graph queries of the driver's contract and their SQL.

Every query runs over its whole tables, but for some that came first with SQL over a
part: ``connected_components`` (line items of quantity 50), ``adjacency_power_2``
(45 or more), and the layers and propagations over the first four features.  Their
``_whole`` and ``_digest`` namesakes run over all (``more`` has SQL for them).  Floats are rounded to six places
in both engines; arrays come out as text or sums, so that values can be hashed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import vectors as V
from weftgraph.functions.rng import draw_sql, slot_sql
from weftgraph.graph import Graph, infer_nodes
from weftgraph.operators import adjacency as A
from weftgraph.operators import batches as B
from weftgraph.operators import calibration, components, layers, learn, linalg, links, query, sampling, splitter, temporal, walks
from weftgraph.plans.tables import HALF_SQL, LINE_ID, TIME_SQL, adj_sql, features, het_graph, het_sql, key, line_id, op_graph, op_sql, table, time_edges

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


OP, HET = f"WITH RECURSIVE {op_sql()}", f"WITH RECURSIVE {het_sql()}"
OP_ADJ = f"{OP},\n{HALF_SQL},\n{adj_sql()}"
HET_HALF = f"{HET},\n{HALF_SQL}"


def r6(x, name: str):
    return F.round(x, 6).alias(name)


# -- graph store ---------------------------------------------------------------


@register("graph_node_counts", f"{HET} SELECT type, count(*) AS n FROM nodes GROUP BY type")
def _(spark, d):
    return het_graph(spark, d).nodes.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@register("graph_edge_counts", f"{HET} SELECT type, count(*) AS n, round(sum(weight), 6) AS total FROM edges GROUP BY type")
def _(spark, d):
    return het_graph(spark, d).edges.groupBy("type").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("weight"), "total"))


@register("infer_nodes_from_edges", f"{OP} SELECT src AS id FROM edges UNION SELECT dst FROM edges")
def _(spark, d):
    return infer_nodes(op_graph(spark, d).edges).select("id")


@register("node_types_of_edge_ends", f"{HET} SELECT DISTINCT a.type AS src_type, e.type, b.type AS dst_type FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst")
def _(spark, d):
    return query.type_triples(het_graph(spark, d))


@register("edge_metrics_by_type", f"""{HET} SELECT least(a.type, b.type) AS src_type, e.type, greatest(a.type, b.type) AS dst_type, count(*) AS n, min(weight) AS least, max(weight) AS most,
  round(avg(weight), 6) AS mean, round(stddev_samp(weight), 6) AS std FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst GROUP BY ALL""")
def _(spark, d):
    return query.edge_metrics(het_graph(spark, d)).withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@register("graph_schema_triples", f"""{HET}, t AS (SELECT DISTINCT a.type AS s, e.type AS r, b.type AS o FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst)
SELECT s AS node_type, s AS src_type, r AS type, o AS dst_type FROM t UNION SELECT o, o, r, s FROM t""")
def _(spark, d):
    return query.schema(het_graph(spark, d))


@register("node_degrees", f"{OP},\n{HALF_SQL} SELECT id, count(eid) AS degree FROM nodes LEFT JOIN half ON node = id GROUP BY id")
def _(spark, d):
    return A.degrees(op_graph(spark, d))


@register("in_out_degrees", f"""{OP} SELECT id, coalesce(i, 0) AS in_degree, coalesce(o, 0) AS out_degree FROM nodes LEFT JOIN (SELECT dst, count(*) AS i FROM edges GROUP BY dst) ON dst = id
LEFT JOIN (SELECT src, count(*) AS o FROM edges GROUP BY src) ON src = id""")
def _(spark, d):
    g = op_graph(spark, d, directed=True)
    return A.degrees(g, "in").withColumnRenamed("degree", "in_degree").join(A.degrees(g, "out").withColumnRenamed("degree", "out_degree"), "id")


@register("neighbors_weighted", f"{HET_HALF} SELECT node, nbr, type, weight FROM half")
def _(spark, d):
    return A.neighbors(het_graph(spark, d))


@register("neighbors_by_edge_type", f"{HET_HALF} SELECT node, nbr, type, weight FROM half WHERE type IN ('placed', 'lives_in')")
def _(spark, d):
    return A.neighbors(het_graph(spark, d), edge_types=["placed", "lives_in"])


@register("in_nodes", f"{HET} SELECT dst AS node, src AS nbr, type, weight FROM edges")
def _(spark, d):
    return A.neighbors(het_graph(spark, d, directed=True), direction="in")


@register("out_nodes", f"{HET} SELECT src AS node, dst AS nbr, type, weight FROM edges")
def _(spark, d):
    return A.neighbors(het_graph(spark, d, directed=True), direction="out")


@register("parallel_edge_weights", f"{OP} SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(*) AS n, string_agg(CAST(CAST(weight AS BIGINT) AS VARCHAR), ',' ORDER BY weight) AS weights FROM edges GROUP BY ALL")
def _(spark, d):
    found = A.parallel_edges(op_graph(spark, d))
    return found.withColumn("weights", F.array_join(F.transform("weights", lambda w: w.cast("bigint").cast("string")), ","))


@register("adjacency_weighted_undirected", f"{OP},\n{HALF_SQL} SELECT node AS i, nbr AS j, sum(weight) AS v FROM half GROUP BY ALL")
def _(spark, d):
    return A.adjacency_matrix(op_graph(spark, d), weighted=True)


@register("adjacency_unweighted_directed", f"{OP} SELECT src AS i, dst AS j, count(*)::DOUBLE AS v FROM edges GROUP BY ALL")
def _(spark, d):
    return A.adjacency_matrix(op_graph(spark, d, directed=True))


@register("adjacency_by_type", f"{HET_HALF} SELECT node AS i, nbr AS j, sum(weight) AS v FROM half WHERE type = 'supplied_by' GROUP BY ALL")
def _(spark, d):
    return A.adjacency_matrix(het_graph(spark, d), weighted=True, edge_type="supplied_by")


@register("typed_adjacency_lists", f"""{HET}, e AS (SELECT a.type AS src_type, e.type, b.type AS dst_type, src, dst FROM edges e JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst),
u AS (SELECT src_type, type, dst_type, src AS node, dst AS nbr FROM e UNION ALL SELECT dst_type, type, src_type, dst, src FROM e WHERE src <> dst)
SELECT src_type, type, dst_type, node, string_agg(nbr, ',' ORDER BY nbr) AS nbrs FROM u GROUP BY ALL""")
def _(spark, d):
    return A.typed_adjacency(het_graph(spark, d)).withColumn("nbrs", F.array_join("nbrs", ","))


PICKED = "picked AS (SELECT 'o' || o_orderkey AS id FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'p' || p_partkey FROM part WHERE p_size <= 25)"


@register("induced_subgraph", f"{OP}, {PICKED} SELECT eid, src, dst, weight FROM edges WHERE src IN (FROM picked) AND dst IN (FROM picked)")
def _(spark, d):
    picked = table(spark, d, "orders").where("o_orderstatus = 'F'").select(key("o", "o_orderkey").alias("id")).unionByName(table(spark, d, "part").where("p_size <= 25").select(key("p", "p_partkey").alias("id")))
    return query.induced_subgraph(op_graph(spark, d), picked).edges.select("eid", "src", "dst", "weight")


@register("khop_subgraph_2", f"""{OP},\n{HALF_SQL}, s0 AS (SELECT 'p' || p_partkey AS id FROM part WHERE p_size = 1), s1 AS (SELECT DISTINCT nbr AS id FROM half JOIN s0 ON node = id WHERE nbr NOT IN (FROM s0)),
s2 AS (SELECT DISTINCT nbr AS id FROM half JOIN s1 ON node = id WHERE nbr NOT IN (FROM s0) AND nbr NOT IN (FROM s1)) SELECT id, 0 AS hop FROM s0 UNION ALL SELECT id, 1 FROM s1 UNION ALL SELECT id, 2 FROM s2""")
def _(spark, d):
    seeds = table(spark, d, "part").where("p_size = 1").select(key("p", "p_partkey").alias("id"))
    return query.khop_nodes(op_graph(spark, d), seeds, 2)


@register("node_features_gather", """SELECT 'p' || p_partkey AS id, CASE WHEN embedding IS NULL THEN 0.0 ELSE round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 5) END AS total,
  coalesce(round(embedding[1]::DOUBLE, 6), 0.0) AS first, 64 AS n FROM part LEFT JOIN embeddings ON vec_id = p_partkey""")
def _(spark, d):
    wanted = table(spark, d, "part").select(F.col("p_partkey").alias("pos"), key("p", "p_partkey").alias("id"))
    g = op_graph(spark, d).with_features(features(spark, d, "p"), 64)
    found = query.gather_features(g, wanted, 64)
    return found.select("id", F.round(V.array_sum("features"), 5).alias("total"), F.round(F.col("features")[0], 6).alias("first"), F.size("features").alias("n"))


@register("connected_components", f"""WITH RECURSIVE {op_sql(50)},\n{HALF_SQL}, r(a, b) AS (SELECT node, nbr FROM half UNION SELECT r.a, h.nbr FROM r JOIN half h ON h.node = r.b),
c AS (SELECT id, coalesce(least(id, min(b)), id) AS component FROM nodes LEFT JOIN r ON a = id GROUP BY id) SELECT id, component, count(*) OVER (PARTITION BY component) AS size FROM c""")
def _(spark, d):
    return components.connected_components(op_graph(spark, d, least=50))


@register("connected_components_whole")
def _(spark, d):
    return components.connected_components(op_graph(spark, d))


@register("min_spanning_forest")
def _(spark, d):
    return components.spanning_forest(op_graph(spark, d)).select("eid", "src", "dst", "weight")


# -- walks and samples ----------------------------------------------------------


def walk_sql(length: int, draws: str, kind: str = "uniform", seed: int = 42) -> str:
    """Steps of n = 1 walks from all nodes as a chain of tables w0, w1, …"""
    ctes, union = ["w0 AS (SELECT id AS root, 0 AS walk, id AS node FROM nodes)"], ["SELECT root, walk, 0 AS step, node FROM w0"]
    for s in range(1, length):
        if kind == "uniform":
            on = f"a.node = w.node AND a.pos = {slot_sql(seed, 'a.degree', 'w.root', 'w.walk', str(s))}"
        else:
            u = draw_sql(seed, "w.root", "w.walk", str(s))
            on = f"a.node = w.node AND a.weight > 0 AND a.cum >= {u} * a.total AND (a.cum - a.weight < {u} * a.total OR ({u} = 0 AND a.cum = a.weight))"
        ctes.append(f"w{s} AS MATERIALIZED (SELECT w.root, w.walk, a.nbr AS node FROM w{s - 1} w JOIN adj a ON {on})")
        union.append(f"SELECT root, walk, {s}, node FROM w{s}")
    return f"{draws},\n" + ",\n".join(ctes) + "\n" + " UNION ALL ".join(union)


@register("uniform_walks", walk_sql(4, OP_ADJ))
def _(spark, d):
    g = op_graph(spark, d)
    return walks.uniform_walks(g, g.nodes, length=4)


@register("weighted_walks", walk_sql(3, OP_ADJ, "weighted"))
def _(spark, d):
    g = op_graph(spark, d)
    return walks.weighted_walks(g, g.nodes, length=3)


def biased_sql(length: int, p: float, q: float, seed: int = 42) -> str:
    ctes = ["near AS (SELECT DISTINCT node AS prev, nbr FROM half)", "w0 AS (SELECT id AS root, 0 AS walk, id AS node, CAST(NULL AS VARCHAR) AS prev FROM nodes)"]
    union = ["SELECT root, walk, 0 AS step, node FROM w0"]
    for s in range(1, length):
        ctes.append(f"""o{s} AS (SELECT w.root, w.walk, a.nbr, w.node, a.pos, CASE WHEN w.prev IS NULL THEN 1.0::DOUBLE WHEN a.nbr = w.prev THEN {1 / p} WHEN n.nbr IS NOT NULL THEN 1.0 ELSE {1 / q} END AS w
  FROM w{s - 1} w JOIN adj a ON a.node = w.node LEFT JOIN near n ON n.prev = w.prev AND n.nbr = a.nbr)""")
        ctes.append(f"c{s} AS (SELECT *, sum(w) OVER (PARTITION BY root, walk ORDER BY pos ROWS UNBOUNDED PRECEDING) AS cum, sum(w) OVER (PARTITION BY root, walk) AS total FROM o{s})")
        ctes.append(f"w{s} AS (SELECT root, walk, nbr AS node, node AS prev FROM c{s} WHERE w > 0 AND cum >= {draw_sql(seed, 'root', 'walk', str(s))} * total QUALIFY row_number() OVER (PARTITION BY root, walk ORDER BY cum) = 1)")
        union.append(f"SELECT root, walk, {s}, node FROM w{s}")
    return f"{OP_ADJ},\n" + ",\n".join(ctes) + "\n" + " UNION ALL ".join(union)


@register("node2vec_walks", biased_sql(3, 0.5, 2.0))
def _(spark, d):
    g = op_graph(spark, d)
    return walks.biased_walks(g, g.nodes, length=3, p=0.5, q=2.0)


def metapath_sql(path: list[str], length: int, seed: int = 42) -> str:
    ctes = ["thalf AS (SELECT h.*, n.type AS nbr_type FROM half h JOIN nodes n ON n.id = h.nbr)", adj_sql("thalf", "adj", "node, nbr_type"), f"w0 AS (SELECT id AS root, 0 AS walk, id AS node FROM nodes WHERE type = '{path[0]}')"]
    union = ["SELECT root, walk, 0 AS step, node FROM w0"]
    for s in range(1, length):
        want = path[1:][(s - 1) % (len(path) - 1)]
        ctes.append(f"w{s} AS MATERIALIZED (SELECT w.root, w.walk, a.nbr AS node FROM w{s - 1} w JOIN adj a ON a.node = w.node AND a.nbr_type = '{want}' AND a.pos = {slot_sql(seed, 'a.degree', 'w.root', 'w.walk', str(s))})")
        union.append(f"SELECT root, walk, {s}, node FROM w{s}")
    return f"{HET_HALF},\n" + ",\n".join(ctes) + "\n" + " UNION ALL ".join(union)


@register("metapath_walks", metapath_sql(["customer", "order", "part", "order", "customer"], 5))
def _(spark, d):
    g = het_graph(spark, d)
    return walks.metapath_walks(g, g.node_ids("customer"), ["customer", "order", "part", "order", "customer"], length=5)


def bfs_sql(sizes: list[int], weighted: bool = False, seed: int = 42) -> str:
    ctes, union = ["b0 AS (SELECT id AS root, 0 AS rep, 0::BIGINT AS slot, id AS node FROM nodes WHERE type = 'order')"], ["SELECT root, rep, 0 AS hop, slot, node FROM b0"]
    for h, size in enumerate(sizes, 1):
        ctes.append(f"k{h} AS (SELECT root, rep, slot * {size} + unnest(range({size})) AS slot, node FROM b{h - 1})")
        u = draw_sql(seed, "k.root", "k.rep", str(h), "k.slot")
        on = f"a.pos = CAST(floor({u} * a.degree) AS INT)" if not weighted else f"a.weight > 0 AND a.cum >= {u} * a.total AND (a.cum - a.weight < {u} * a.total OR ({u} = 0 AND a.cum = a.weight))"
        ctes.append(f"b{h} AS MATERIALIZED (SELECT k.root, k.rep, k.slot, a.nbr AS node FROM k{h} k LEFT JOIN adj a ON a.node = k.node AND {on})")
        union.append(f"SELECT root, rep, {h}, slot, node FROM b{h}")
    return f"{OP_ADJ},\n" + ",\n".join(ctes) + "\n" + " UNION ALL ".join(union)


@register("sampled_bfs", bfs_sql([3, 2]))
def _(spark, d):
    g = op_graph(spark, d)
    return sampling.sampled_bfs(g, g.node_ids("order"), [3, 2])


@register("sampled_bfs_weighted", bfs_sql([3], True))
def _(spark, d):
    g = op_graph(spark, d)
    return sampling.sampled_bfs(g, g.node_ids("order"), [3], weighted=True)


def directed_bfs_sql(seed: int = 42) -> str:
    ctes = [
        "ih AS (SELECT dst AS node, src AS nbr, eid, weight FROM edges)", "oh AS (SELECT src AS node, dst AS nbr, eid, weight FROM edges)",
        adj_sql("ih", "ia"), adj_sql("oh", "oa"), "b0 AS (SELECT id AS root, 0 AS rep, 0 AS part, 0::BIGINT AS slot, id AS node FROM nodes WHERE type = 'order')",
    ]
    union = ["SELECT root, rep, 0 AS hop, part, slot, node FROM b0"]
    for h in (1, 2):
        sides = []
        for side, adj in ((1, "ia"), (2, "oa")):
            ctes.append(f"k{h}{side} AS (SELECT root, rep, part * 2 + {side} AS part, slot * 2 + unnest(range(2)) AS slot, node FROM b{h - 1})")
            sides.append(f"SELECT k.root, k.rep, k.part, k.slot, a.nbr AS node FROM k{h}{side} k LEFT JOIN {adj} a ON a.node = k.node AND a.pos = {slot_sql(seed, 'a.degree', 'k.root', 'k.rep', 'k.part', 'k.slot')}")
        ctes.append(f"b{h} AS MATERIALIZED ({' UNION ALL '.join(sides)})")
        union.append(f"SELECT root, rep, {h}, part, slot, node FROM b{h}")
    return f"{OP},\n" + ",\n".join(ctes) + "\n" + " UNION ALL ".join(union)


@register("directed_bfs_slots", directed_bfs_sql())
def _(spark, d):
    g = op_graph(spark, d, directed=True)
    return sampling.directed_bfs(g, g.node_ids("order"), [2, 2], [2, 2])


def hin_sql(sizes: list[int], seed: int = 42) -> str:
    ctes = [
        "e AS (SELECT a.type AS s, e.type AS r, b.type AS o, src, dst, eid, weight FROM edges e JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst)",
        "th AS (SELECT s || '-' || r || '-' || o AS triple, src AS node, dst AS nbr, eid, weight, s AS node_type, o AS nbr_type FROM e UNION ALL SELECT o || '-' || r || '-' || s, dst, src, eid, weight, o, s FROM e WHERE src <> dst)",
        adj_sql("th", "adj", "node, triple"), "tr AS (SELECT DISTINCT node_type, triple, nbr_type FROM th)",
        "b0 AS (SELECT id AS root, 0 AS rep, '' AS path, 0::BIGINT AS slot, type AS node_type, id AS node FROM nodes WHERE type = 'customer')",
    ]
    union = ["SELECT root, rep, 0 AS hop, path, slot, node_type, node FROM b0"]
    for h, size in enumerate(sizes, 1):
        ctes.append(f"k{h} AS (SELECT root, rep, CASE WHEN path = '' THEN triple ELSE path || '/' || triple END AS path, slot * {size} + unnest(range({size})) AS slot, nbr_type AS node_type, triple, node FROM b{h - 1} JOIN tr USING (node_type))")
        ctes.append(f"b{h} AS MATERIALIZED (SELECT k.root, k.rep, k.path, k.slot, k.node_type, a.nbr AS node FROM k{h} k LEFT JOIN adj a ON a.node = k.node AND a.triple = k.triple AND a.pos = {slot_sql(seed, 'a.degree', 'k.root', 'k.rep', str(h), 'k.path', 'k.slot')})")
        union.append(f"SELECT root, rep, {h}, path, slot, node_type, node FROM b{h}")
    return f"{HET},\n" + ",\n".join(ctes) + "\n" + " UNION ALL ".join(union)


@register("hin_bfs", hin_sql([2, 2]))
def _(spark, d):
    g = het_graph(spark, d)
    return sampling.hin_bfs(g, g.node_ids("customer"), [2, 2])


@register("context_pairs", f"WITH RECURSIVE w AS ({walk_sql(4, OP_ADJ)}) SELECT root AS src, node AS dst, walk, step FROM w WHERE step > 0")
def _(spark, d):
    g = op_graph(spark, d)
    return sampling.context_pairs(walks.uniform_walks(g, g.nodes, length=4)).select("src", "dst", "walk", "step")


UNSUPERVISED_SQL = f"""WITH RECURSIVE w AS ({walk_sql(3, OP_ADJ)}), {op_sql()},\n{HALF_SQL},
g AS (SELECT node, CAST(round(pow(count(*)::DOUBLE, 0.75), 6) AS DECIMAL(18, 6)) AS w, ('0x' || substr(md5(node), 1, 3))::INT % 4096 AS bin FROM half GROUP BY node),
n AS (SELECT bin, node, sum(w) OVER (PARTITION BY bin ORDER BY node ROWS UNBOUNDED PRECEDING) - w AS lo, sum(w) OVER (PARTITION BY bin ORDER BY node ROWS UNBOUNDED PRECEDING) AS hi FROM g),
b AS (SELECT bin, sum(w) OVER (ORDER BY bin ROWS UNBOUNDED PRECEDING) - w AS blo, sum(w) OVER (ORDER BY bin ROWS UNBOUNDED PRECEDING) AS bhi, sum(w) OVER () AS total FROM (SELECT bin, sum(w) AS w FROM g GROUP BY bin)),
p AS (SELECT root AS src, node AS dst, {draw_sql(42, "'negative'", 'root', 'walk', 'step')} AS u FROM w WHERE step > 0),
q AS (SELECT src, bin, u * total::DOUBLE - blo::DOUBLE AS v FROM p JOIN b ON u * total::DOUBLE >= blo::DOUBLE AND u * total::DOUBLE < bhi::DOUBLE)
SELECT src, dst, 1 AS label FROM p UNION ALL SELECT src, node, 0 FROM q JOIN n ON n.bin = q.bin AND v >= lo::DOUBLE AND v < hi::DOUBLE"""


@register("unsupervised_samples", UNSUPERVISED_SQL)
def _(spark, d):
    g = op_graph(spark, d)
    return sampling.unsupervised_samples(g, walks.uniform_walks(g, g.nodes, length=3))


NUMBERED = "SELECT id, row_number() OVER (ORDER BY ('0x' || substr(md5(id), 1, 3))::INT % 1024, id) - 1 AS n FROM nodes"


@register("kg_negative_samples", f"""{HET}, en AS ({NUMBERED}), k AS (SELECT eid, src, type, dst, unnest(range(1, 3)) AS copy FROM edges),
c AS (SELECT *, CAST(floor({draw_sql(42, "'entity'", 'eid', 'copy')} * (SELECT count(*) FROM nodes)) AS BIGINT) AS n, {draw_sql(42, "'side'", 'eid', 'copy')} < 0.5 AS head FROM k)
SELECT eid, 0 AS copy, src, type, dst, 1 AS label FROM edges UNION ALL SELECT eid, copy, CASE WHEN head THEN id ELSE src END, type, CASE WHEN head THEN dst ELSE id END, 0 FROM c JOIN en ON en.n = c.n""")
def _(spark, d):
    g = het_graph(spark, d)
    return sampling.kg_negatives(g.edges, sampling.numbered(g.nodes.select("id"), "id"), 2)


@register("node_batches", f"{OP} SELECT id, row_number() OVER (ORDER BY md5('7|' || id), id) - 1 AS n, (row_number() OVER (ORDER BY md5('7|' || id), id) - 1) // 100 AS batch FROM nodes")
def _(spark, d):
    g = op_graph(spark, d)
    return B.node_batches(g, g.nodes, 100, epoch=7)


@register("edge_split_positives", f"{OP} SELECT eid, src, dst FROM edges ORDER BY md5('42|' || eid), eid LIMIT (SELECT CAST(floor(0.1 * count(*)) AS BIGINT) FROM edges)")
def _(spark, d):
    return splitter.positive_edges(op_graph(spark, d), 0.1).select("eid", "src", "dst")


LATE = f"late AS (SELECT {LINE_ID} AS eid FROM lineitem WHERE CAST(l_shipdate AS DATE) > DATE '1997-01-01')"


@register("edge_split_by_date", f"{OP}, {LATE}, q AS (SELECT * FROM edges WHERE eid IN (FROM late)) SELECT eid, src, dst FROM q ORDER BY md5('42|' || eid), eid LIMIT (SELECT CAST(floor(0.2 * count(*)) AS BIGINT) FROM q)")
def _(spark, d):
    g = op_graph(spark, d)
    dates = table(spark, d, "lineitem").select(line_id().alias("eid"), F.date_format("l_shipdate", "dd/MM/yyyy").alias("date"))
    return splitter.positive_edges(g, 0.2, only=query.edges_after(g, dates, "01/01/1997")).select("eid", "src", "dst")


@register("edge_split_negatives_global")
def _(spark, d):
    g = op_graph(spark, d)
    n = int(0.01 * g.number_of_edges())
    return splitter.global_negatives(g, n, sources=g.node_ids("order"), targets=g.node_ids("part"))


@register("edge_split_negatives_local")
def _(spark, d):
    g = op_graph(spark, d)
    return splitter.local_negatives(g, int(0.01 * g.number_of_edges()))


# -- time -----------------------------------------------------------------------


@register("temporal_neighbors_after", f"""WITH {TIME_SQL} SELECT e.eid, e.src, e.dst, min(l.ts) AS next_time FROM time_edges e LEFT JOIN time_edges l ON l.src = e.dst AND l.ts > e.ts GROUP BY ALL""")
def _(spark, d):
    e = time_edges(spark, d)
    found = temporal.neighbors_after(e)
    return e.join(found.withColumnRenamed("time", "ts"), ["src", "dst", "ts"]).select("eid", "src", "dst", "next_time").distinct()


@register("temporal_walks")
def _(spark, d):
    e = time_edges(spark, d)
    edges = e.select("eid", "src", "dst", "type", (F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9).alias("weight"), F.array().cast("array<double>").alias("features"))
    return walks.temporal_walks(Graph(infer_nodes(edges), edges), num_cw=200, cw_size=3, max_length=8)


@register("sliding_windows", """WITH e AS (SELECT user_id AS node, ts, event_id, CAST(round(value * 1000) AS BIGINT) AS v FROM events), w AS (SELECT node, row_number() OVER o - 1 AS start,
  list(v) OVER (PARTITION BY node ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS win, lead(v, 4) OVER o AS target FROM e WINDOW o AS (PARTITION BY node ORDER BY ts, event_id))
SELECT node, start, array_to_string(win, ',') AS win, target FROM w WHERE len(win) = 3 AND target IS NOT NULL""")
def _(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("node"), F.struct("ts", "event_id").alias("t"), F.round(F.col("value") * 1000).cast("bigint").alias("value"))
    found = temporal.sliding_windows(e, size=3, distance=2)
    return found.select("node", F.col("start").cast("long").alias("start"), F.array_join(F.transform("window", lambda v: v.cast("string")), ",").alias("win"), "target")


# -- linear algebra ---------------------------------------------------------------

ADJ0 = f"{OP},\n{HALF_SQL}, a AS (SELECT node AS i, nbr AS j, count(*)::DOUBLE AS v FROM half GROUP BY ALL), dg AS (SELECT i, sum(v) AS d FROM a GROUP BY i)"
SYM = "SELECT a.i, a.j, a.v / sqrt(x.d * y.d) AS v FROM a JOIN dg x ON x.i = a.i JOIN dg y ON y.i = a.j"
GCN = """m AS (SELECT i, j, max(v) AS v FROM (SELECT i, j, v FROM a UNION ALL SELECT j, i, v FROM a) GROUP BY ALL), l AS (SELECT * FROM m WHERE i <> j UNION ALL SELECT id, id, 1.0 FROM nodes),
ld AS (SELECT i, sum(v) AS d FROM l GROUP BY i), g AS (SELECT l.i, l.j, l.v / sqrt(x.d * y.d) AS v FROM l JOIN ld x ON x.i = l.i JOIN ld y ON y.i = l.j)"""


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("v", F.round("v", 6))


@register("sym_normalized_adjacency", f"{ADJ0} SELECT i, j, round(v, 6) AS v FROM ({SYM})")
def _(spark, d):
    return rounded(linalg.normalized(A.adjacency_matrix(op_graph(spark, d))))


@register("rw_normalized_adjacency", f"{ADJ0} SELECT a.i, a.j, round(a.v / d, 6) AS v FROM a JOIN dg USING (i)")
def _(spark, d):
    return rounded(linalg.normalized(A.adjacency_matrix(op_graph(spark, d)), symmetric=False))


@register("gcn_adjacency", f"{ADJ0}, {GCN} SELECT i, j, round(v, 6) AS v FROM g")
def _(spark, d):
    g = op_graph(spark, d)
    return rounded(linalg.gcn_matrix(A.adjacency_matrix(g), g.nodes))


@register("laplacian", f"{ADJ0} SELECT i, j, round(sum(v), 6) AS v FROM (SELECT id AS i, id AS j, 1.0::DOUBLE AS v FROM nodes UNION ALL SELECT i, j, -v FROM ({SYM})) GROUP BY i, j")
def _(spark, d):
    g = op_graph(spark, d)
    return rounded(linalg.laplacian(A.adjacency_matrix(g), g.nodes))


X4 = """x0 AS (SELECT n.id, k, CASE WHEN embedding IS NULL THEN 0.0 ELSE embedding[k]::DOUBLE END AS f FROM (SELECT id, unnest(range(1, 5)) AS k FROM nodes) n LEFT JOIN embeddings ON 'p' || vec_id = n.id)"""


def long_form(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select("id", F.posexplode("features").alias("k", "f")).select("id", (F.col("k") + 1).cast("long").alias("k"), F.round("f", digits).alias("f"))


def featured(spark, d, size: int = 4) -> Graph:
    return op_graph(spark, d).with_features(features(spark, d, "p", size), size)


@register("sgc_features_k2", f"{ADJ0}, {GCN}, {X4}, x1 AS (SELECT i AS id, k, sum(v * f) AS f FROM g JOIN x0 ON id = j GROUP BY ALL) SELECT i AS id, k, round(sum(v * f), 6) + 0.0 AS f FROM g JOIN x1 ON x1.id = j GROUP BY ALL")
def _(spark, d):
    g = featured(spark, d)
    return long_form(linalg.propagate_k(linalg.gcn_matrix(A.adjacency_matrix(g), g.nodes), g.nodes, 4, 2))


@register("sgc_features_k2_whole")
def _(spark, d):
    g = featured(spark, d, 64)
    return long_form(linalg.gcn_propagate_k(g, 64, 2))


def appnp_sql(k: int, alpha: float) -> str:
    ctes = []
    for s in range(1, k + 1):
        ctes.append(f"y{s} AS (SELECT x0.id, x0.k, coalesce(p.f, 0) * {1 - alpha} + x0.f * {alpha} AS f FROM x0 LEFT JOIN (SELECT i AS id, k, sum(v * f) AS f FROM g JOIN {'x0' if s == 1 else f'y{s - 1}'} z ON z.id = j GROUP BY ALL) p ON p.id = x0.id AND p.k = x0.k)")
    return f"{ADJ0}, {GCN}, {X4}, {', '.join(ctes)} SELECT id, k, round(f, 6) + 0.0 AS f FROM y{k}"


@register("appnp_k3", appnp_sql(3, 0.125))
def _(spark, d):
    g = featured(spark, d)
    return long_form(linalg.appnp(linalg.gcn_matrix(A.adjacency_matrix(g), g.nodes), g.nodes, 4, k=3, alpha=0.125))


@register("appnp_k3_whole")
def _(spark, d):
    g = featured(spark, d, 64)
    return long_form(linalg.gcn_appnp(g, 64, k=3, alpha=0.125))


W42, B2 = [[0.5, -0.25], [0.25, 1.0], [-1.0, 0.5], [0.75, 0.125]], [0.125, -0.0625]


@register("gcn_layer_forward", f"""{ADJ0}, {GCN}, {X4}, w(k, o, w) AS (VALUES {', '.join(f'({i + 1}, {o + 1}, {W42[i][o]}::DOUBLE)' for i in range(4) for o in range(2))}),
h AS (SELECT id, o, sum(f * w) AS f FROM x0 JOIN w USING (k) GROUP BY ALL),
z AS (SELECT i AS id, o, sum(v * f) AS f FROM g JOIN h ON h.id = j GROUP BY i, o)
SELECT id, o::BIGINT AS k, round(greatest(f + CASE o WHEN 1 THEN {B2[0]} ELSE {B2[1]} END, 0), 6) AS f FROM z""")
def _(spark, d):
    g = featured(spark, d)
    return long_form(layers.gcn_layer(linalg.gcn_matrix(A.adjacency_matrix(g), g.nodes), g.nodes, W42, B2))


#: The weights of W42 for each four of the 64 features.
W642 = W42 * 16


@register("gcn_layer_forward_whole")
def _(spark, d):
    g = featured(spark, d, 64)
    return long_form(layers.gcn_layer(linalg.gcn_matrix(A.adjacency_matrix(g), g.nodes), g.nodes, W642, B2))


@register("relational_adjacency", f"""{HET}, a AS (SELECT type, dst AS i, src AS j, count(*)::DOUBLE AS v FROM edges GROUP BY ALL), s AS (SELECT type, i, greatest(sum(v), 1) AS d FROM a GROUP BY ALL)
SELECT type, i, j, round(v / d, 6) AS v FROM a JOIN s USING (type, i)""")
def _(spark, d):
    return rounded(linalg.relational_adjacency(het_graph(spark, d).edges))


@register("adjacency_power_2", f"""WITH {op_sql(45)},\n{HALF_SQL}, a AS (SELECT node AS i, nbr AS j, count(*)::DOUBLE AS v FROM half GROUP BY ALL), dg AS (SELECT i, sum(v) AS d FROM a GROUP BY i),
t AS (SELECT i, j, v / d AS v FROM a JOIN dg USING (i)) SELECT 1 AS power, i, j, round(v, 6) AS v FROM t UNION ALL SELECT 2, x.i, y.j, round(sum(x.v * y.v), 6) FROM t x JOIN t y ON x.j = y.i GROUP BY ALL""")
def _(spark, d):
    return rounded(linalg.adjacency_powers(A.adjacency_matrix(op_graph(spark, d, least=45)), 2))


@register("adjacency_power_2_whole")
def _(spark, d):
    return rounded(linalg.adjacency_powers(A.adjacency_matrix(op_graph(spark, d)), 2))


CLUSTERS = "cl AS (SELECT id, ('0x' || substr(md5(id), 1, 4))::INT % 20 AS cluster FROM nodes)"


def hashed_clusters(g: Graph) -> DataFrame:
    return g.nodes.select("id", (F.conv(F.substring(F.md5("id"), 1, 4), 16, 10).cast("int") % 20).alias("cluster"))


@register("cluster_batches_normalized", f"""{ADJ0}, {CLUSTERS}, c AS (SELECT id, cluster // 2 AS batch FROM cl), n AS (SELECT x.batch, i, j, v FROM a JOIN c x ON x.id = i JOIN c y ON y.id = j WHERE x.batch = y.batch),
s AS (SELECT i, sum(v) AS d FROM n GROUP BY i), f AS (SELECT batch, id AS i, coalesce(d, 0) AS d FROM c LEFT JOIN s ON s.i = id)
SELECT n.batch::BIGINT AS batch, n.i, n.j, round(v / (d + 1), 6) AS v FROM n JOIN f USING (i) UNION ALL SELECT batch, i, i, round(0.1 / (d + 1) * (1 + 1 / 0.1), 6) FROM f""")
def _(spark, d):
    g = op_graph(spark, d)
    return rounded(linalg.cluster_batches(A.adjacency_matrix(g), hashed_clusters(g), per_batch=2, lam=0.1))


@register("cluster_internal_external_edges", f"""{OP}, {CLUSTERS}, e AS (SELECT x.cluster AS a, y.cluster AS b FROM edges JOIN cl x ON x.id = src JOIN cl y ON y.id = dst), u AS (SELECT a AS cluster, a = b AS own FROM e UNION ALL SELECT b, false FROM e WHERE a <> b)
SELECT cluster, count(*) FILTER (own)::BIGINT AS internal, count(*) FILTER (NOT own)::BIGINT AS external, round(count(*) FILTER (NOT own) / greatest(count(*) FILTER (own), 1), 6) AS ratio FROM u GROUP BY cluster""")
def _(spark, d):
    g = op_graph(spark, d)
    return query.cluster_edge_counts(g, hashed_clusters(g)).withColumn("ratio", F.round("ratio", 6))


# -- links and scores ---------------------------------------------------------------

PAIRS = "pr AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem), uv AS (SELECT a, b, u.embedding::DOUBLE[] AS u, v.embedding::DOUBLE[] AS v FROM pr JOIN embeddings u ON u.vec_id = a JOIN embeddings v ON v.vec_id = b)"
LINK_SQL = {
    "ip": "list_sum(list_transform(range(1, 65), lambda k: u[k] * v[k]))", "l1": "list_sum(list_transform(range(1, 65), lambda k: abs(u[k] - v[k])))",
    "l2": "list_sum(list_transform(range(1, 65), lambda k: (u[k] - v[k]) * (u[k] - v[k])))", "hadamard": "list_sum(list_transform(range(1, 65), lambda k: u[k] * v[k]))",
    "avg": "list_sum(list_transform(range(1, 65), lambda k: (u[k] + v[k]) / 2))", "concat": "list_sum(u) + list_sum(v)",
}
LINK_SIZE = {"ip": 1, "concat": 128}


def _link(method: str) -> Callable:
    def run(spark, d):
        pairs = table(spark, d, "lineitem").select(F.col("l_partkey").cast("string").alias("src"), F.col("l_suppkey").cast("string").alias("dst")).distinct()
        found = links.embedded_pairs(pairs, features(spark, d, ""), method)
        return found.select(F.col("src").cast("long").alias("a"), F.col("dst").cast("long").alias("b"), F.size("embedding").alias("n"), F.round(V.array_sum("embedding"), 5).alias("total"))

    return run


for _m, _expr in LINK_SQL.items():
    QUERIES[f"link_embedding_{_m}"] = _link(_m)
    SQL[f"link_embedding_{_m}"] = f"WITH {PAIRS} SELECT a, b, {LINK_SIZE.get(_m, 64)} AS n, round({_expr}, 5) AS total FROM uv"

REL = [round(0.1 * (k % 7) - 0.25, 2) for k in range(64)]
REL_SQL = "[" + ", ".join(f"{x}::DOUBLE" for x in REL) + "]"


def kg_tables(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(supplier–nation triples, entities, relations), embeddings borrowed by key."""
    s = table(spark, d, "supplier")
    triples = s.select(key("s", "s_suppkey").alias("src"), F.lit("located_in").alias("type"), key("n", "s_nationkey").alias("dst"))
    e = features(spark, d, "s").join(triples.select(F.col("src").alias("id")), "id", "left_semi").unionByName(features(spark, d, "n").join(table(spark, d, "nation").select(key("n", "n_nationkey").alias("id")), "id", "left_semi"))
    relations = spark.range(1).select(F.lit("located_in").alias("type"), F.array(*(F.lit(x) for x in REL)).alias("r"))
    return triples, e.select("id", F.col("features").alias("e")), relations


KG = f"""tr AS (SELECT 's' || s_suppkey AS src, 'n' || s_nationkey AS dst FROM supplier), en AS (SELECT 's' || vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings WHERE 's' || vec_id IN (SELECT src FROM tr)
  UNION ALL SELECT 'n' || vec_id, embedding::DOUBLE[] FROM embeddings JOIN nation ON n_nationkey = vec_id), r AS (SELECT {REL_SQL} AS r)"""
DISTMULT = "list_sum(list_transform(range(1, 65), lambda k: s.e[k] * r.r[k] * o.e[k]))"


@register("distmult_scores", f"WITH {KG} SELECT src, dst, round({DISTMULT}, 6) AS score FROM tr JOIN en s ON s.id = src JOIN en o ON o.id = dst, r")
def _(spark, d):
    t, e, r = kg_tables(spark, d)
    return links.score_triples(t, e, r).select("src", "dst", F.round("score", 6).alias("score"))


@register("kg_filtered_ranks", f"""WITH {KG}, sc AS (SELECT s.id AS src, o.id AS dst, {DISTMULT} AS score FROM en s, en o, r WHERE s.id IN (SELECT src FROM tr)), tt AS (SELECT tr.src, tr.dst AS truth, score AS ts FROM tr JOIN sc USING (src, dst)),
k AS (SELECT DISTINCT src, dst FROM tr) SELECT tt.src, 'located_in' AS type, truth AS dst, 1 + count(*) FILTER (score > ts) AS raw_rank, 1 + count(*) FILTER (score > ts AND k.dst IS NULL) AS filtered_rank
FROM tt JOIN sc USING (src) LEFT JOIN k ON k.src = sc.src AND k.dst = sc.dst GROUP BY ALL""")
def _(spark, d):
    t, e, r = kg_tables(spark, d)
    return links.rank_triples(t, t, e, r)


# -- features, calibration, pooling ----------------------------------------------


@register("min_max_scaled", "SELECT c_custkey, round((c_acctbal - lo) / (hi - lo), 6) AS scaled FROM customer, (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer)")
def _(spark, d):
    return temporal.min_max_scaled(table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("scaled")), "scaled").withColumn("scaled", F.round("scaled", 6))


@register("one_hot_features", "SELECT c_custkey, array_to_string(list_transform((SELECT list(s ORDER BY s) FROM (SELECT DISTINCT c_mktsegment AS s FROM customer)), lambda x: CASE WHEN x = c_mktsegment THEN '1' ELSE '0' END), '') AS hot FROM customer")
def _(spark, d):
    c = table(spark, d, "customer")
    kinds = sorted(r[0] for r in c.select("c_mktsegment").distinct().collect())  # a few segments
    return c.select("c_custkey", F.concat(*(F.when(F.col("c_mktsegment") == k, "1").otherwise("0") for k in kinds)).alias("hot"))


@register("expected_calibration_error", """WITH p AS (SELECT (doc_id * 37 % 100) / 100.0 AS prob, quality AS label FROM labels), b AS (SELECT least(floor(prob * 10), 9) AS bin, count(*) AS n, avg(prob) AS c, avg(label) AS a FROM p GROUP BY 1)
SELECT round(sum(n * abs(a - c)) / sum(n), 6) AS ece FROM b""")
def _(spark, d):
    p = table(spark, d, "labels").select((F.col("doc_id") * 37 % 100 / 100.0).alias("prob"), F.col("quality").alias("label"))
    return calibration.expected_calibration_error(p).withColumn("ece", F.round("ece", 6))


@register("reliability_bins", """WITH p AS (SELECT (doc_id * 37 % 100) / 100.0 AS prob, quality AS label FROM labels) SELECT CAST(least(floor(prob * 10), 9) AS INT) AS bin, count(*) AS n, round(avg(prob), 6) AS confidence, round(avg(label), 6) AS accuracy FROM p GROUP BY 1""")
def _(spark, d):
    p = table(spark, d, "labels").select((F.col("doc_id") * 37 % 100 / 100.0).alias("prob"), F.col("quality").alias("label"))
    return calibration.reliability(p).withColumns({"confidence": F.round("confidence", 6), "accuracy": F.round("accuracy", 6)})


@register("sort_pooling_topk", """WITH r AS (SELECT label, vec_id, embedding::DOUBLE[] AS e, row_number() OVER (PARTITION BY label ORDER BY embedding[64]::DOUBLE DESC, vec_id) AS r FROM embeddings)
SELECT label AS graph_id, round(sum(list_sum(e)), 5) AS total, 192 AS n FROM r WHERE r <= 3 GROUP BY label""")
def _(spark, d):
    x = table(spark, d, "embeddings").select(F.col("label").alias("graph_id"), F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"))
    return B.sort_pooling(x, 3, 64).select("graph_id", F.round(V.array_sum("features"), 5).alias("total"), F.size("features").alias("n"))


@register("corrupt_features", """WITH e AS (SELECT 'v' || vec_id AS id, embedding[1]::DOUBLE AS f FROM embeddings), a AS (SELECT id, row_number() OVER (ORDER BY ('0x' || substr(md5(id), 1, 3))::INT % 1024, id) AS n FROM e),
h AS (SELECT f, md5('42|' || id) AS h FROM e), b AS (SELECT f, row_number() OVER (ORDER BY ('0x' || substr(md5(h), 1, 3))::INT % 1024, h) AS n FROM h) SELECT id, round(f, 6) AS first FROM a JOIN b USING (n)""")
def _(spark, d):
    return B.corrupted(features(spark, d, "v")).select("id", F.round(F.col("features")[0], 6).alias("first"))


@register("label_propagation")
def _(spark, d):
    g = op_graph(spark, d)
    return learn.label_propagation(A.half_edges(g), g.nodes, rounds=3)


@register("padded_graph_batches", """WITH g AS (SELECT label AS graph_id, count(*) AS n, row_number() OVER (ORDER BY label) - 1 AS r FROM embeddings GROUP BY label), b AS (SELECT *, r // 4 AS batch FROM g)
SELECT batch, graph_id, max(n) OVER (PARTITION BY batch) AS rows, n AS real FROM b""")
def _(spark, d):
    x = table(spark, d, "embeddings").select(F.col("label").alias("graph_id"), F.col("vec_id").alias("id"), F.slice(F.col("embedding").cast("array<double>"), 1, 4).alias("features"))
    found = B.padded_graphs(x, per_batch=4, size=4)
    return found.select("batch", "graph_id", F.size("features").cast("long").alias("rows"), F.size(F.filter("mask", lambda m: m)).cast("long").alias("real"))


# -- further layers, scores and summaries -------------------------------------------

EYE = [[1.0 if i == j else 0.0 for j in range(4)] for i in range(4)]


@register("sage_mean_layer", f"""{ADJ0}, {X4}, mn AS (SELECT i AS id, k, avg(f) AS f FROM a JOIN x0 ON id = j GROUP BY ALL)
SELECT id, k, round(f, 6) + 0.0 AS f FROM x0 UNION ALL SELECT x0.id, x0.k + 4, round(coalesce(mn.f, 0), 6) + 0.0 FROM x0 LEFT JOIN mn ON mn.id = x0.id AND mn.k = x0.k""")
def _(spark, d):
    g = featured(spark, d)
    return long_form(layers.sage_layer(A.adjacency_matrix(g), g.nodes, EYE, EYE, activation="linear"))


@register("sage_mean_layer_whole")
def _(spark, d):
    g = featured(spark, d, 64)
    eye = [[1.0 if i == j else 0.0 for j in range(64)] for i in range(64)]
    return long_form(layers.sage_layer(A.adjacency_matrix(g), g.nodes, eye, eye, activation="linear"))


@register("rgcn_layer_forward", f"""{OP}, {X4}, w(k, o, w) AS (VALUES {', '.join(f'({i + 1}, {o + 1}, {W42[i][o]}::DOUBLE)' for i in range(4) for o in range(2))}),
h AS (SELECT id, o, sum(f * w) AS f FROM x0 JOIN w USING (k) GROUP BY ALL), a AS (SELECT dst AS i, src AS j, count(*)::DOUBLE AS v FROM edges GROUP BY ALL), s AS (SELECT i, greatest(sum(v), 1) AS d FROM a GROUP BY i),
t AS (SELECT a.i AS id, o, sum(v / d * f) AS f FROM a JOIN s ON s.i = a.i JOIN h ON h.id = a.j GROUP BY a.i, o)
SELECT h.id, h.o::BIGINT AS k, round(h.f + coalesce(t.f, 0), 6) + 0.0 AS f FROM h LEFT JOIN t ON t.id = h.id AND t.o = h.o""")
def _(spark, d):
    g = featured(spark, d)
    return long_form(layers.rgcn_layer(g.edges, g.nodes, W42, {"contains": W42}, activation="linear"))


@register("rgcn_layer_forward_whole")
def _(spark, d):
    g = featured(spark, d, 64)
    return long_form(layers.rgcn_layer(g.edges, g.nodes, W642, {"contains": W642}, activation="linear"))


@register("complex_scores", f"""WITH {KG} SELECT src, dst, round(list_sum(list_transform(range(1, 33), lambda k: (s.e[k] * r.r[k] - s.e[k + 32] * r.r[k + 32]) * o.e[k] + (s.e[k] * r.r[k + 32] + s.e[k + 32] * r.r[k]) * o.e[k + 32])), 6) AS score
FROM tr JOIN en s ON s.id = src JOIN en o ON o.id = dst, r""")
def _(spark, d):
    t, e, r = kg_tables(spark, d)

    def halves(name: str):
        return F.struct(F.slice(name, 1, 32).alias("re"), F.slice(name, 33, 32).alias("im")).alias(name)

    return links.score_triples(t, e.select("id", halves("e")), r.select("type", halves("r")), "complex").select("src", "dst", F.round("score", 6).alias("score"))


@register("self_adversarial_weights", """SELECT event_id, round(exp(s - m) / sum(exp(s - m)) OVER w, 6) AS weight FROM (SELECT event_id, user_id, value / 100 AS s, max(value / 100) OVER (PARTITION BY user_id) AS m FROM events) WINDOW w AS (PARTITION BY user_id)""")
def _(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("eid"), "event_id", (F.col("value") / 100).alias("score"), F.lit(0).alias("label"))
    return links.self_adversarial_weights(e).select("event_id", F.round("weight", 6).alias("weight"))


@register("ensemble_summary", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM events GROUP BY event_type")
def _(spark, d):
    return calibration.ensemble_summary(table(spark, d, "events"), ["event_type"]).withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@register("group_attribute_summary", "SELECT c_nationkey, c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY ALL")
def _(spark, d):
    return table(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@register("feature_id_check", """SELECT 'p' || vec_id AS id, 'extra' AS problem FROM embeddings WHERE vec_id NOT IN (SELECT p_partkey FROM part) UNION ALL SELECT 'p' || p_partkey, 'missing' FROM part WHERE p_partkey NOT IN (SELECT vec_id FROM embeddings)""")
def _(spark, d):
    return query.id_differences(table(spark, d, "part").select(key("p", "p_partkey").alias("id")), features(spark, d, "p").select("id"))


@register("edge_ends_by_degree", f"""{OP},\n{HALF_SQL}, dg AS (SELECT node, count(*) AS d FROM half GROUP BY node), b AS (SELECT x.d AS a, y.d AS b FROM edges JOIN dg x ON x.node = src JOIN dg y ON y.node = dst)
SELECT a AS src_degree, b AS dst_degree, count(*) AS n FROM b GROUP BY ALL""")
def _(spark, d):
    g = op_graph(spark, d)
    deg = A.degrees(g)
    return (
        g.edges.join(deg.select(F.col("id").alias("src"), F.col("degree").alias("src_degree")), "src").join(deg.select(F.col("id").alias("dst"), F.col("degree").alias("dst_degree")), "dst")
        .groupBy("src_degree", "dst_degree").agg(F.count(F.lit(1)).alias("n"))
    )


@register("sequences_for_forecasts", """WITH e AS (SELECT user_id AS node, ts, event_id, CAST(round(value * 1000) AS BIGINT) AS v FROM events), w AS (SELECT node, row_number() OVER o - 1 AS start,
  list(v) OVER (PARTITION BY node ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS x, lead(v, 5) OVER o AS y FROM e WINDOW o AS (PARTITION BY node ORDER BY ts, event_id))
SELECT node, start, array_to_string(x, ',') AS x, y FROM w WHERE len(x) = 4 AND y IS NOT NULL""")
def _(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("node"), F.struct("ts", "event_id").alias("t"), F.round(F.col("value") * 1000).cast("bigint").alias("value"))
    found = temporal.sequences(e, seq_len=4, pre_len=2)
    return found.select("node", F.col("start").cast("long").alias("start"), F.array_join(F.transform("x", lambda v: v.cast("string")), ",").alias("x"), "y")


from weftgraph.plans import more  # noqa: E402, F401  registers its queries too
