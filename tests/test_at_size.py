"""Plans and results of what failed on larger tables: less moved and less computed, the same found."""

from __future__ import annotations

import random
import re
from dataclasses import replace

from pyspark.sql import functions as F

from weftgraph.operators import adjacency, batches, layers, linalg, links, sampling
from weftgraph.plans import staging


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ranks_score_in_blocks_with_ties(spark):
    r = random.Random(3)
    vectors = [[r.choice((-1.5, 0.1, 0.7)) for _ in range(5)] for _ in range(20)]
    e = spark.createDataFrame([(f"n{k}", vectors[k % 20]) for k in range(50)], "id string, e array<double>")
    rel = spark.createDataFrame([("r", [0.3, -0.2, 0.9, 0.1, 1.1])], "type string, r array<double>")
    known = spark.createDataFrame([(f"n{k}", "r", f"n{(k * 7 + j) % 50}") for k in range(50) for j in range(3)], "src string, type string, dst string")
    for tie in ("top", "bottom", "random"):
        found = links.rank_triples(known, known, e, rel, tie=tie)
        assert "NestedLoop" not in plan(found)
        want = links.rank_triples(known, known, e, rel, lambda s, t, o: links.distmult(s, t, o), tie=tie)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    holes = e.selectExpr("id", "case when id = 'n3' then array(1.0D, null, 1.0D, 1.0D, 1.0D) else e end as e")
    found = links.rank_triples(known, known, holes, rel)
    want = links.rank_triples(known, known, holes, rel, lambda s, t, o: links.distmult(s, t, o))
    assert sorted(map(str, found.collect())) == sorted(map(str, want.collect()))


def test_hin_bfs_numbers_reached_edges_only(spark, make_graph, tmp_path, monkeypatch):
    monkeypatch.setattr(staging, "shared_dir", lambda _: str(tmp_path))
    kinds = {f"a{k}": "a" for k in range(3)} | {f"b{k}": "b" for k in range(3)} | {f"c{k}": "c" for k in range(3)}
    edges = [(f"a{k}", f"b{k % 2}", "ab") for k in range(3)] + [(f"b{k}", f"c{k}", "bc") for k in range(3)] + [("a0", "lost", "ab"), ("b0", "a0", "ab")]
    found = sampling.hin_bfs(make_graph(kinds, edges), spark.createDataFrame([("a0",), ("a1",)], "id string"), [2, 1])
    assert {p.name.split("-")[0] for p in tmp_path.iterdir()} == {"triples", "hop"}
    rows = found.collect()
    assert all(r.node != "lost" for r in rows)
    assert {r.path for r in rows if r.hop == 1} == {"a-ab-b"}


def folders(path):
    return sorted(p.name.split("-")[0] for p in path.iterdir())


def sparse_case(spark):
    adj = spark.createDataFrame([("a", "b", 0.5), ("b", "a", 0.5), ("b", "c", 2.0), ("c", "c", 1.0)], "i string, j string, v double")
    return adj, spark.createDataFrame([("a", [0.0, 0.0]), ("b", [0.0, 0.0]), ("c", [1.0, -2.0])], "id string, features array<double>")


def test_propagation_keeps_the_last_round_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(staging, "shared_dir", lambda _: str(tmp_path))
    found = linalg.propagate_k(*sparse_case(spark), 2, 2)
    assert folders(tmp_path) == ["propagated"]
    assert {r.id: r.features for r in found.collect()} == {"a": [1.0, -2.0], "b": [2.0, -4.0], "c": [1.0, -2.0]}


def test_personalised_propagation_keeps_the_last_round_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(staging, "shared_dir", lambda _: str(tmp_path))
    found = linalg.appnp(*sparse_case(spark), 2, k=2, alpha=0.5)
    assert folders(tmp_path) == ["propagated"]
    assert {r.id: r.features for r in found.collect()} == {"a": [0.25, -0.5], "b": [1.0, -2.0], "c": [1.0, -2.0]}


def test_sparse_weights_are_written_out(spark):
    eye = [[1.0 if i == j else 0.0 for j in range(8)] for i in range(8)]
    adj = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "a")], "i string, j string")
    x = spark.createDataFrame([("a", [1.0] * 8), ("b", [0.0] * 8), ("c", [3.0] * 8)], "id string, features array<double>")
    found = layers.sage_layer(adj, x, eye, eye, activation="linear")
    assert "aggregate(" not in plan(found)
    assert {r.id: (r.features[0], r.features[8]) for r in found.collect()} == {"a": (1.0, 1.5), "b": (0.0, 1.0), "c": (3.0, 0.0)}


def test_last_power_is_not_written(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(staging, "shared_dir", lambda _: str(tmp_path))
    monkeypatch.setattr(linalg, "LIST_ENTRIES", 2, raising=False)
    adj = spark.createDataFrame([("h", f"x{k}", 1.0) for k in range(5)] + [(f"x{k}", "h", 1.0) for k in range(5)], "i string, j string, v double")
    found = linalg.adjacency_powers(adj, 2)
    assert folders(tmp_path) == ["transition"]
    two = {(r.i, r.j): r.v for r in found.where("power = 2").collect()}
    assert len(two) == 26 and abs(two["h", "h"] - 1) < 1e-12 and abs(two["x1", "x4"] - 0.2) < 1e-12


def without_matrix(spark, make_graph, tmp_path, monkeypatch, found, want):
    """found(graph) makes no matrix and stores nodes reached only; it equals want(graph)."""
    edges = [("a", "b"), ("a", "b"), ("b", "a"), ("b", "c"), ("c", "c"), ("d", "e"), ("e", "f")]
    graph = make_graph({k: ("n", [1.0, -2.0] if k == "c" else [0.0, 0.0]) for k in "abcdefg"}, edges)
    lost = make_graph({k: ("n", [1.0, -2.0]) for k in "abc"}, edges)
    values = [{r.id: [round(v, 12) for v in r.features] for r in want(g).collect()} for g in (graph, lost)]
    assert {r.id: [round(v, 12) for v in r.features] for r in found(lost).collect()} == values[1]
    monkeypatch.setattr(staging, "shared_dir", lambda _: str(tmp_path))
    monkeypatch.setattr(linalg, "gcn_matrix", None)
    rows = found(graph)
    assert folders(tmp_path) == ["propagated"]
    assert {r.id for r in spark.read.parquet(str(next(tmp_path.iterdir()))).collect()} <= {"a", "b", "c"}
    assert {r.id: [round(v, 12) for v in r.features] for r in rows.collect()} == values[0]


def test_convolutions_are_simplified_without_the_matrix(spark, make_graph, tmp_path, monkeypatch):
    matrix = lambda g: linalg.gcn_matrix(adjacency.adjacency_matrix(g), g.nodes)
    without_matrix(spark, make_graph, tmp_path, monkeypatch, lambda g: linalg.gcn_propagate_k(g, 2, 2), lambda g: linalg.propagate_k(matrix(g), g.nodes, 2, 2))


def test_personalised_propagation_without_the_matrix(spark, make_graph, tmp_path, monkeypatch):
    matrix = lambda g: linalg.gcn_matrix(adjacency.adjacency_matrix(g), g.nodes)
    without_matrix(spark, make_graph, tmp_path, monkeypatch, lambda g: linalg.gcn_appnp(g, 2, k=2, alpha=0.125), lambda g: linalg.appnp(matrix(g), g.nodes, 2, k=2, alpha=0.125))


def path_with_vectors(make_graph, seeds):
    vectors = {n: [float(n), -1.5, 0.0, 0.25 * n, 1.0, 2.0, -3.0, 1 / (n + 1)] for n in seeds}
    return make_graph({str(n): ("n", vectors.get(n, [0.0] * 8)) for n in range(12)}, [(n, n + 1) for n in range(9)] + [(0, 1), (1, 0), (3, 3)])


def by_node(df):
    return {r.id: [round(v, 12) for v in r.features] for r in df.collect()}


def by_matrix(graph, k, alpha):
    return by_node(linalg.appnp(linalg.gcn_matrix(adjacency.adjacency_matrix(graph), graph.nodes), graph.nodes, 8, k=k, alpha=alpha))


def test_personalised_propagation_stores_no_vectors_but_those_given(spark, make_graph, tmp_path, monkeypatch):
    graph = path_with_vectors(make_graph, (2, 3, 11))
    want = by_matrix(graph, 3, 0.125)
    assert len(want) == 12
    for most, hashes in ((200_000, 10), (0, 10), (0, 0)):
        path = tmp_path / f"{most}-{hashes}"
        path.mkdir()
        monkeypatch.setattr(staging, "shared_dir", lambda _: str(path))
        monkeypatch.setattr(linalg, "BROADCAST_ROWS", most, raising=False)
        monkeypatch.setattr(linalg, "ID_HASHES", hashes, raising=False)
        found = linalg.gcn_appnp(graph, 8, k=3, alpha=0.125)
        assert folders(path) == ["coefficients", "degrees", "seeds"]
        assert by_node(found) == want


def test_personalised_propagation_takes_vectors_where_coefficients_are_many(spark, make_graph, tmp_path, monkeypatch):
    cases = [(range(12), 6, 0.1), (range(12), 1, 0.0), ((5,), 2, 1.0), ((), 2, 0.1), ((5,), 0, 0.1)]
    graphs = [path_with_vectors(make_graph, seeds) for seeds, _, _ in cases]
    wants = [by_matrix(graph, k, alpha) for graph, (_, k, alpha) in zip(graphs, cases)]
    monkeypatch.setattr(staging, "shared_dir", lambda _: str(tmp_path))
    found = linalg.gcn_appnp(graphs[0], 8, k=6, alpha=0.1)
    assert folders(tmp_path) == ["propagated"] and by_node(found) == wants[0]
    for graph, want, (_, k, alpha) in list(zip(graphs, wants, cases))[1:]:
        assert by_node(linalg.gcn_appnp(graph, 8, k=k, alpha=alpha)) == want
    odd = graphs[2].nodes.withColumn("features", F.when(F.col("id") == "5", F.transform("features", lambda v: F.when(v > -3, v))).otherwise(F.col("features")))
    graph = replace(graphs[2], nodes=odd)
    want = [str(r) for r in linalg.appnp(linalg.gcn_matrix(adjacency.adjacency_matrix(graph), graph.nodes), graph.nodes, 8, k=2, alpha=0.1).orderBy("id").collect()]
    assert [str(r) for r in linalg.gcn_appnp(graph, 8, k=2, alpha=0.1).orderBy("id").collect()] == want


def test_personalised_propagation_sends_coefficients_without_a_factor(spark, make_graph):
    graph = path_with_vectors(make_graph, (2, 3, 11))
    found = linalg.gcn_appnp(graph, 8, k=3, alpha=0.125)
    assert "REPARTITION_BY_NUM" in plan(found) and not re.search(r"\bw#", plan(found))
    assert by_node(found) == by_matrix(graph, 3, 0.125)


def test_degrees_shuffle_one_end_of_the_edges_at_a_time(make_graph, monkeypatch):
    written = []
    monkeypatch.setattr(linalg, "stored", lambda df, label: written.append(plan(df)) or staging.stored(df, label))
    graph = make_graph({k: "n" for k in "abcd"}, [("a", "b"), ("a", "b"), ("b", "a"), ("c", "c"), ("b", "c")])
    assert {r.id: r.d for r in linalg.GcnColumns.of(graph).degrees.collect()} == {"a": 4.0, "b": 5.0, "c": 2.0, "d": 1.0}
    assert [p.count("ExistingRDD[eid") for p in written] == [1, 1]
    assert linalg.GcnColumns.of(make_graph({"a": "n"}, [("a", "lost")])) is None and linalg.GcnColumns.of(make_graph({"a": "n"}, [("lost", "a")])) is None
    holes = replace(graph, edges=graph.edges.withColumn("dst", F.when(F.col("dst") != "c", F.col("dst"))))
    assert linalg.GcnColumns.of(holes) is None


def test_hinsage_moves_reached_edges_and_features_other_than_0(spark, make_graph, monkeypatch):
    kinds = {f"a{k}": ("a", [0.0, 0.0]) for k in range(3)} | {f"b{k}": ("b", [float(k), 1.0]) for k in range(3)}
    graph = make_graph(kinds, [(f"a{k}", f"b{j}", "ab") for k in range(3) for j in range(k + 1)])
    heads = spark.createDataFrame([("a0",), ("a2",)], "id string")
    want = sorted(map(str, batches.hinsage_nodes(graph, heads, [2, 2], 2).collect()))
    monkeypatch.setattr(sampling, "BROADCAST_ROWS", 0, raising=False)
    reached = heads.selectExpr("id as node", "'a' as node_type")
    assert "xxhash64" in plan(sampling.typed_halves(graph, sampling.type_triples(graph), reached, graph.nodes.select("id", "type")))
    found = batches.hinsage_nodes(graph, heads, [2, 2], 2)
    assert sorted(map(str, found.collect())) == want and len(want) == 6
