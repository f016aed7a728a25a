from __future__ import annotations

import pytest

from weftgraph import Graph, GraphError
from weftgraph.operators import adjacency as A
from weftgraph.operators import components, query

HIN_NODES = {0: "A", 1: "A", 2: "A", 3: "A", 4: "B", 5: "B", 6: "B"}
HIN = [(4, 0, "R"), (1, 5, "R"), (1, 4, "R"), (2, 4, "R"), (5, 3, "R"), (4, 5, "F", 10)]
LOOPS = [(5, 5, "R"), (5, 5, "F", 11), (5, 5, "F", 12)]


def test_degrees(make_graph, as_rows):
    assert as_rows(A.degrees(make_graph(HIN_NODES, HIN))) == [("0", 1), ("1", 2), ("2", 1), ("3", 1), ("4", 4), ("5", 3), ("6", 0)]


def test_neighbors_of_multigraph(make_graph, as_rows, spark):
    g = make_graph({0: "A", 1: "A", 2: "B", 3: "B"}, [(0, 1, "AA", 0), (0, 1, "AA", 1), (1, 2, "AB", 10), (1, 3, "AB", 10)])
    one = spark.createDataFrame([("1",)], "id string")
    assert as_rows(A.neighbors(g, one), "nbr", "weight") == [("0", 0.0), ("0", 1.0), ("2", 10.0), ("3", 10.0)]
    assert as_rows(A.neighbors(g, one, edge_types=["AB"]), "nbr") == [("2",), ("3",)]


def test_weighted_adjacency(make_graph, as_rows):
    g = make_graph(HIN_NODES, HIN + LOOPS)
    found = {(i, j): v for i, j, v in as_rows(A.adjacency_matrix(g, weighted=True))}
    assert found[("4", "5")] == found[("5", "4")] == 10 and found[("5", "5")] == 24 and found[("0", "4")] == 1
    d = {(i, j): v for i, j, v in as_rows(A.adjacency_matrix(make_graph(HIN_NODES, HIN + LOOPS, True), weighted=True))}
    assert d[("5", "5")] == 24 and ("0", "4") not in d and d[("4", "0")] == 1
    assert {(i, j): v for i, j, v in as_rows(A.adjacency_matrix(g))}[("5", "5")] == 3
    assert as_rows(A.adjacency_matrix(g, edge_type="F")) == [("4", "5", 1.0), ("5", "4", 1.0), ("5", "5", 2.0)]


def test_typed_adjacency_directed(make_graph, as_rows):
    found = {(a, r, b, n): list(x) for a, r, b, n, x in as_rows(A.typed_adjacency(make_graph(HIN_NODES, HIN, True)))}
    assert found == {
        ("A", "R", "B", "1"): ["4", "5"], ("A", "R", "B", "2"): ["4"], ("B", "R", "A", "4"): ["0"], ("B", "R", "A", "5"): ["3"], ("B", "F", "B", "4"): ["5"],
    }


def test_components(make_graph, as_rows):
    for directed in (False, True):
        g = make_graph(dict.fromkeys(range(6), "x"), [(0, 2), (2, 5), (1, 4)], directed)
        assert as_rows(components.connected_components(g)) == [("0", "0", 3), ("1", "1", 2), ("2", "0", 3), ("3", "3", 1), ("4", "1", 2), ("5", "0", 3)]


def test_edge_metrics_and_info(make_graph, as_rows):
    edges = [(0, 1, "R"), (0, 2, "R"), (0, 3, "S", 2), (0, 3, "S", 2), (0, 4, "T", 2), (0, 5, "T", 2), (0, 6, "T", 2), (1, 2, "U", 2), (1, 3, "U", 3), (1, 4, "U", 4), (1, 5, "U", 4), (6, 1, "U", 5)]
    g = make_graph({k: "A" if k < 4 else "B" for k in range(7)}, edges)
    found = {(r.src_type, r.type, r.dst_type): r for r in query.edge_metrics(g).collect()}
    u = found[("A", "U", "B")]
    assert (u.n, u.least, u.most) == (3, 4, 5) and round(u["mean"], 5) == 4.33333 and round(u["std"], 5) == 0.57735
    assert found[("A", "S", "A")].n == 2
    text = query.info(g)
    assert "A-T->B: [3]" in text and "Weights: all 2" in text and "range=[4, 5], mean=4.33333, std=0.57735" in text


def test_schema_mirrors_when_undirected(make_graph, as_rows):
    assert as_rows(query.schema(make_graph(HIN_NODES, HIN)), "src_type", "type", "dst_type") == [("A", "R", "B"), ("B", "F", "B"), ("B", "R", "A")]


def test_subgraph_and_khop(make_graph, as_rows, spark):
    g = make_graph(dict.fromkeys(range(6), "x"), [(k, k + 1) for k in range(5)])
    ids = spark.createDataFrame([("0",), ("1",), ("3",)], "id string")
    assert as_rows(query.induced_subgraph(g, ids).edges, "src", "dst") == [("0", "1")]
    with pytest.raises(GraphError, match="known node ids"):
        query.induced_subgraph(g, spark.createDataFrame([("9",)], "id string"))
    assert as_rows(query.khop_nodes(g, spark.createDataFrame([("0",)], "id string"), 2)) == [("0", 0), ("1", 1), ("2", 2)]


def test_from_tables(spark, as_rows):
    nodes = spark.createDataFrame([(1, 1.0, 2.0), (2, 3.0, 4.0)], "id int, a double, b double")
    edges = spark.createDataFrame([(1, 2, 0.5), (2, 2, None)], "source int, target int, weight double")
    g = Graph.from_tables({"x": nodes}, {"y": edges})
    assert as_rows(g.edges, "src", "dst", "type", "weight") == [("1", "2", "y", 0.5), ("2", "2", "y", 1.0)]
    assert as_rows(g.feature_sizes()) == [("x", 2)] and g.unique_type() == "x"
    inferred = Graph.from_tables(edges=edges)
    assert as_rows(inferred.node_ids()) == [("1",), ("2",)]


def test_validation_names_the_rows(spark):
    edges = spark.createDataFrame([(1, 2), (3, 9)], "source int, target int")
    with pytest.raises(GraphError, match="some missing: '9'"):
        Graph.from_tables(spark.createDataFrame([(1,), (2,), (3,)], "id int"), edges)
    with pytest.raises(GraphError, match="repeated: '1'"):
        Graph.from_tables(spark.createDataFrame([(1,), (1,), (2,), (3,), (9,)], "id int"), edges)
    with pytest.raises(GraphError, match="lacks columns: 'target'"):
        Graph.from_tables(edges=edges.select("source"))
    with pytest.raises(GraphError, match="numeric feature columns"):
        Graph.from_tables(spark.createDataFrame([(1, "x")], "id int, a string"))


def test_empty_graph(make_graph, as_rows):
    g = make_graph({1: "x"}, [])
    assert as_rows(A.degrees(g)) == [("1", 0)] and as_rows(components.connected_components(g)) == [("1", "1", 1)]
    assert components.spanning_forest(g).count() == 0


def kruskal(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    total, n = 0.0, 0
    for w, _, a, b in sorted(edges):
        if (x := find(a)) != (y := find(b)):
            parent[x] = y
            total, n = total + w, n + 1
    return total, n


def test_spanning_forest_against_kruskal(make_graph):
    import random

    r = random.Random(4)
    edges = [(r.randrange(40), r.randrange(40), "t", r.randrange(1, 6)) for _ in range(90)]
    g = make_graph(dict.fromkeys(range(45), "x"), edges)
    found = components.spanning_forest(g).collect()
    want = kruskal([(float(e[3]), k, str(e[0]), str(e[1])) for k, e in enumerate(edges)])
    assert (sum(x.weight for x in found), len(found)) == want
