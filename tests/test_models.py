from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph import GraphError
from weftgraph.functions import hyperbolic as H
from weftgraph.functions import vectors as V
from weftgraph.operators import adjacency as A
from weftgraph.operators import batches as B
from weftgraph.operators import calibration, layers, learn, linalg, links

EDGES = [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d")]
NODES = {"a": ("x", [1.0, 1.0]), "b": ("x", [1.0, 0.0]), "c": ("x", [0.0, 1.0]), "d": ("x", [2.0, -1.0])}
IDS = sorted(NODES)
X = np.array([NODES[k][1] for k in IDS])


@pytest.fixture(scope="module")
def g(make_graph):
    return make_graph(NODES, EDGES)


@pytest.fixture(scope="module")
def gcn_matrix():
    m = np.eye(4)
    for a, b in EDGES:
        m[IDS.index(a), IDS.index(b)] = m[IDS.index(b), IDS.index(a)] = 1
    d = m.sum(1)
    return m / np.sqrt(np.outer(d, d))


def dense(df):
    m = np.zeros((4, 4))
    for r in df.collect():
        m[IDS.index(r.i), IDS.index(r.j)] = r.v
    return m


def features(df):
    found = {r.id: list(r.features) for r in df.collect()}
    return np.array([found[k] for k in IDS])


def test_normalised_matrices(g, gcn_matrix):
    adj = A.adjacency_matrix(g)
    assert np.allclose(dense(linalg.gcn_matrix(adj, g.nodes)), gcn_matrix)
    lap = dense(linalg.laplacian(adj, g.nodes))
    values = np.linalg.eigvalsh(lap)
    assert values.min() > -1e-9 and values.max() < 2 + 1e-9
    assert abs(linalg.largest_eigenvalue(linalg.laplacian(adj, g.nodes)) - values.max()) < 1e-4
    assert np.allclose(dense(linalg.power(linalg.gcn_matrix(adj, g.nodes), 3)), np.linalg.matrix_power(gcn_matrix, 3))


def test_propagation(g, gcn_matrix):
    m = linalg.gcn_matrix(A.adjacency_matrix(g), g.nodes)
    assert np.allclose(features(linalg.propagate_k(m, g.nodes, 2, 2)), gcn_matrix @ gcn_matrix @ X)
    h = X.copy()
    for _ in range(4):
        h = 0.9 * gcn_matrix @ h + 0.1 * X
    assert np.allclose(features(linalg.appnp(m, g.nodes, 2, k=4, alpha=0.1)), h)
    ppr = dense(linalg.ppr_matrix(m, g.nodes, alpha=0.3))
    assert np.allclose(ppr, 0.3 * np.linalg.inv(np.eye(4) - 0.7 * gcn_matrix), atol=1e-6)


def test_layers(g, gcn_matrix):
    m = linalg.gcn_matrix(A.adjacency_matrix(g), g.nodes)
    w, b = [[1.0, -1.0, 0.5], [0.5, 2.0, -1.0]], [0.1, 0.2, 0.3]
    assert np.allclose(features(layers.gcn_layer(m, g.nodes, w, b)), np.maximum(gcn_matrix @ X @ np.array(w) + b, 0))
    own, nbr = [[1.0, 0.0], [0.0, 1.0]], [[1.0], [1.0]]
    adj = (gcn_matrix > 0).astype(float) - np.eye(4)
    mean = adj @ X / adj.sum(1, keepdims=True)
    got = features(layers.sage_layer(A.adjacency_matrix(g), g.nodes, own, nbr, activation="linear"))
    assert np.allclose(got, np.hstack([X, mean @ np.array(nbr)]))
    wn, ao, an = np.array([[1.0, -0.5], [0.25, 2.0]]), np.array([0.2, -0.1]), np.array([0.5, 0.3])
    z = (X @ ao)[:, None] + (X @ wn @ an)[None, :]
    z = np.where(adj > 0, np.exp(np.where(z >= 0, z, 0.2 * z)), 0)
    got = features(layers.sage_attention_layer(A.adjacency_matrix(g), g.nodes, own, wn.tolist(), ao.tolist(), an.tolist(), activation="linear"))
    assert np.allclose(got, np.hstack([X, (z / z.sum(1, keepdims=True)) @ X @ wn]))
    loops = linalg.with_self_loops(A.adjacency_matrix(g), g.nodes)
    wa, s, o = np.array([[1.0, 0.5], [-0.5, 1.0]]), [0.3, -0.2], [0.1, 0.4]
    h = X @ wa
    logit = (h @ s)[:, None] + (h @ o)[None, :]
    logit = np.where(logit >= 0, logit, 0.2 * logit)
    e = np.where(gcn_matrix > 0, np.exp(logit), 0)
    want = (e / e.sum(1, keepdims=True)) @ h
    assert np.allclose(features(layers.gat_head(loops, g.nodes, wa.tolist(), s, o, activation="linear")), want)
    r = features(layers.rgcn_layer(g.edges, g.nodes, own, {"default": own}, activation="linear"))
    a = np.zeros((4, 4))
    for x, y in EDGES:
        a[IDS.index(y), IDS.index(x)] = 1
    assert np.allclose(r, X + (a / np.maximum(a.sum(1, keepdims=True), 1)) @ X)
    grad = {x.id: x.importance for x in layers.integrated_gradients(m, g.nodes, "a", w, 1, 2, 2).collect()}
    want = (gcn_matrix @ gcn_matrix)[0] * (X @ np.array(w)[:, 1])
    assert all(abs(grad.get(k, 0) - want[n]) < 1e-9 for n, k in enumerate(IDS))


def test_graphwave_runs(g):
    found = linalg.graphwave(A.adjacency_matrix(g), g.nodes, scales=[0.5], sample_points=[0.0, 1.0], degree=8).collect()
    lap = np.diag([2, 2, 3, 1]).astype(float)
    for a, b in EDGES:
        lap[IDS.index(a), IDS.index(b)] = lap[IDS.index(b), IDS.index(a)] = -1
    val, vec = np.linalg.eigh(lap)
    psi = vec @ np.diag(np.exp(-0.5 * val)) @ vec.T
    for r in found:
        col = psi[:, IDS.index(r.id)]
        assert abs(r.re - np.cos(r.t * col).mean()) < 1e-3 and abs(r.im - np.sin(r.t * col).mean()) < 1e-3
    assert len(found) == 8


@pytest.mark.parametrize("method, want", [("ip", [11.0]), ("l1", [2.0, 2.0]), ("l2", [4.0, 4.0]), ("mul", [3.0, 8.0]), ("avg", [2.0, 3.0]), ("concat", [1.0, 2.0, 3.0, 4.0])])
def test_link_embeddings(spark, method, want):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0])], "u array<double>, v array<double>")
    assert list(df.select(links.link_embedding("u", "v", method).alias("e")).first().e) == want
    with pytest.raises(GraphError, match="link method"):
        links.link_embedding("u", "v", "other")


def test_scores(spark):
    s, r, o = np.array([1 + 2j, 0.5 - 1j]), np.array([0.3 + 1j, 2 - 0.5j]), np.array([1 - 1j, 0.2 + 0.1j])
    two = lambda z: {"re": list(map(float, z.real)), "im": list(map(float, z.imag))}
    kind = "struct<re:array<double>,im:array<double>>"
    df = spark.createDataFrame([(two(s), two(r), two(o), [0.3, 0.7])], f"s {kind}, r {kind}, o {kind}, p array<double>")
    found = df.select(links.complex_score(F.col("s"), F.col("r"), F.col("o")).alias("c"), links.rotate(F.col("s"), F.col("p"), F.col("o")).alias("t")).first()
    assert abs(found.c - (s * r * o.conj()).sum().real) < 1e-9
    assert abs(found.t - (12 - np.abs(s * np.exp(1j * np.array([0.3, 0.7])) - o).sum())) < 1e-9


def test_rotation_scores(spark):
    end = "struct<x:array<double>,bias:double>"
    df = spark.createDataFrame([(([0.1, 0.2], 0.5), ([0.3], [0.05, -0.1]), ([0.2, -0.1], 0.25))], f"s {end}, r struct<angle:array<double>,shift:array<double>>, o {end}")
    found = df.select(links.rote(F.col("s"), F.col("r"), F.col("o")).alias("e"), links.roth(F.col("s"), F.col("r"), F.col("o")).alias("h")).first()
    c, d = np.cos(0.3), np.sin(0.3)
    turned = np.array([c * 0.1 - d * 0.2, d * 0.1 + c * 0.2])
    assert abs(found.e - (0.75 - ((turned + [0.05, -0.1] - np.array([0.2, -0.1])) ** 2).sum())) < 1e-9
    assert found.h < 0.75


def test_hyperbolic_identities(spark):
    df = spark.createDataFrame([([0.1, -0.2], [0.3, 0.05])], "x array<double>, y array<double>")
    zero = F.array(F.lit(0.0), F.lit(0.0))
    r = df.select(H.mobius_add("x", zero, 1.0).alias("same"), H.distance("x", "x", 1.0).alias("none"), H.distance("x", "y", 1.0).alias("a"), H.distance("y", "x", 1.0).alias("b"), V.norm(H.exp_map(F.array(F.lit(9.0), F.lit(9.0)), 1.0)).alias("edge")).first()
    assert np.allclose(r.same, [0.1, -0.2]) and abs(r.none) < 1e-7 and abs(r.a - r.b) < 1e-9 and r.edge < 1


def test_ranks_and_ties(spark):
    e = spark.createDataFrame([(str(k), [float(v)]) for k, v in enumerate([1, 2, 2, 3])], "id string, e array<double>")
    r = spark.createDataFrame([("t", [1.0])], "type string, r array<double>")
    test = spark.createDataFrame([("0", "t", "1")], "src string, type string, dst string")
    known = spark.createDataFrame([("0", "t", "1"), ("0", "t", "3")], "src string, type string, dst string")
    top = links.rank_triples(test, known, e, r).first()
    low = links.rank_triples(test, known, e, r, tie="bottom").first()
    assert (top.raw_rank, top.filtered_rank, low.raw_rank, low.filtered_rank) == (2, 1, 3, 2)
    mid = links.rank_triples(test, known, e, r, tie="random").first()
    assert 2 <= mid.raw_rank <= 3
    head = links.rank_triples(test, known, e, r, side="src").first()
    assert head.raw_rank == 4
    assert links.rank_summary(links.rank_triples(test, known, e, r)).first().filtered_mrr == 1.0


def test_calibration(spark):
    rng = np.random.default_rng(0)
    p = rng.random(400)
    y = (rng.random(400) < p).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y)], "prob double, label int")
    bins = np.minimum((p * 10).astype(int), 9)
    want = sum((bins == b).mean() * abs(y[bins == b].mean() - p[bins == b].mean()) for b in range(10) if (bins == b).any())
    assert abs(calibration.expected_calibration_error(df).first().ece - want) < 1e-9
    logits = spark.createDataFrame([([3 * float(np.log(a / (1 - a))), 0.0], 1 - int(b)) for a, b in zip(np.clip(p, 0.01, 0.99), y)], "logits array<double>, label int")
    assert 2 < calibration.temperature(logits, rounds=12) < 4.5
    slope, _ = calibration.platt(df.withColumnRenamed("prob", "score"))
    assert slope > 1
    probs = df.select(F.array(1 - F.col("prob"), "prob").alias("probs"), "label")
    out = calibration.isotonic(probs, probs, classes=2).select("calibrated").collect()
    assert all(abs(sum(r.calibrated) - 1) < 1e-9 for r in out)


def test_batches(make_graph, spark):
    g = make_graph(NODES, EDGES)
    hops = {(r.root, r.hop): len(r.features) for r in B.graphsage_nodes(g, g.nodes, [2, 2], 2).collect()}
    assert hops[("a", 0)] == 1 and hops[("a", 1)] == 2 and hops[("a", 2)] == 4
    d = make_graph({0: ("x", [1.0]), 1: ("x", [2.0]), 2: ("x", [3.0])}, [])
    shuffled = sorted(r.features[0] for r in B.corrupted(d.nodes).collect())
    assert shuffled == [1.0, 2.0, 3.0]
    rows = spark.createDataFrame([(0, "a", [1.0, 5.0]), (0, "b", [2.0, 7.0]), (0, "c", [3.0, 6.0]), (1, "a", [4.0, 1.0])], "graph_id int, id string, features array<double>")
    pooled = {r.graph_id: list(r.features) for r in B.sort_pooling(rows, 2, 2).collect()}
    assert pooled == {0: [2.0, 7.0, 3.0, 6.0], 1: [4.0, 1.0, 0.0, 0.0]}
    padded = {r.graph_id: (list(map(list, r.features)), list(r["mask"])) for r in B.padded_graphs(rows, per_batch=2, size=2).collect()}
    assert padded[1] == ([[4.0, 1.0], [0.0, 0.0], [0.0, 0.0]], [True, False, False])
    assert len(B.hin_layout([("a", "r", "b"), ("b", "r", "a")], ["a", "b"], 2)) == 6


def test_learning(make_graph, spark):
    edges = [(a, b) for c in (0, 10) for a in range(c, c + 8) for b in range(a + 1, c + 8)]
    g = make_graph({k: ("x", [1.0 if k < 10 else 0.0, float(k % 3)]) for k in [*range(8), *range(10, 18)]}, edges)
    from weftgraph.operators import walks

    table = learn.walk_embeddings(walks.uniform_walks(g, g.nodes, n=8, length=6), size=8, epochs=2)
    assert table.count() == 16
    labels = g.nodes.select("id", (F.col("features")[0]).alias("label"))
    m = linalg.gcn_matrix(A.adjacency_matrix(g), g.nodes)
    model, x = learn.sgc_classifier(m, g.nodes, labels, 2)
    done = model.transform(x.join(labels, "id")).where("prediction = label").count()
    assert done == 16
    pairs = g.edges.select("src", "dst", F.lit(1.0).alias("label"))
    fitted = learn.link_regressor(pairs, g.nodes, "avg", low=0.0, high=1.0)[1]
    assert fitted.where("abs(prediction - 1) > 0.05").count() == 0
    kg = learn.fit_distmult(g.edges, size=8, epochs=3)
    assert len(kg.entities) == 16
    clusters = learn.label_propagation(A.half_edges(g), g.nodes, rounds=4).select("cluster").distinct().count()
    assert clusters == 2


def test_distmult_learns_all_triples(spark):
    import pytest

    from weftgraph.graph import GraphError

    triples = spark.range(200_100).selectExpr("concat('a', id) as src", "concat('r', id % 3) as type", "concat('b', id % 7) as dst")
    kg = learn.fit_distmult(triples, size=2, epochs=0)
    assert len(kg.entities) == 200_107 and sorted(kg.relations) == ["r0", "r1", "r2"]
    with pytest.raises(GraphError):
        learn.fit_distmult(triples, size=2, epochs=1, most_triples=200_099)


def test_attri2vec_tells_context_from_chance(spark):
    from pyspark.sql import functions as F

    from weftgraph.operators import learn

    rows = [(f"n{k}", [1.0, 0.0] if k % 2 else [0.0, 1.0]) for k in range(40)]
    table = spark.createDataFrame(rows, "id string, features array<double>")
    pairs = [(f"n{a}", f"n{b}", int((a - b) % 2 == 0)) for a in range(40) for b in range(0, 40, 5)]
    w = learn.fit_attri2vec(spark.createDataFrame(pairs, "src string, dst string, label int"), table, size=4, epochs=200)
    found = {r.id: r.features for r in learn.attri2vec_embeddings(table, w).collect()}
    assert found["n1"] == found["n3"] != found["n2"]
    assert sum(abs(a - b) for a, b in zip(found["n1"], found["n2"])) > 0.2
    empty = spark.createDataFrame([], "src string, dst string, label int")
    try:
        learn.fit_attri2vec(empty, table.where(F.lit(False)))
        raise AssertionError
    except ValueError:
        pass


def test_full_batch_page_rank_is_the_inverse(g):
    import numpy as np

    from weftgraph.operators import batches

    ids = sorted(r.id for r in g.nodes.collect())
    at = {x: k for k, x in enumerate(ids)}

    def dense(df):
        m = np.zeros((len(ids), len(ids)))
        for r in df.collect():
            m[at[r.i], at[r.j]] = r.v
        return m

    a = dense(batches.full_batch(g, "gcn")[1])
    assert np.allclose(dense(batches.full_batch(g, "ppnp", teleport=0.2)[1]), 0.2 * np.linalg.inv(np.eye(len(ids)) - 0.8 * a), atol=1e-6)
