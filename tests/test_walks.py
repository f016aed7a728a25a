from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from weftgraph import GraphError
from weftgraph.operators import sampling, splitter, temporal, walks

LINE = [(k, k + 1) for k in range(9)]


def paths(df):
    return {(r.root, r.walk): list(r.nodes) for r in walks.as_arrays(df).collect()}


def test_uniform_walks_follow_edges(make_graph):
    g = make_graph({**dict.fromkeys(range(10), "x"), "lone": "x"}, LINE)
    found = paths(walks.uniform_walks(g, g.nodes, n=3, length=9, seed=1))
    assert len(found) == 33 and found[("lone", 0)] == ["lone"]
    for (root, _), nodes in found.items():
        assert nodes[0] == root and (root == "lone" or len(nodes) == 9)
        assert all(abs(int(a) - int(b)) == 1 for a, b in zip(nodes, nodes[1:]))


def test_same_seed_same_walks_on_any_partitioning(make_graph):
    g = make_graph(dict.fromkeys(range(10), "x"), LINE)
    a = paths(walks.uniform_walks(g, g.nodes, length=5, seed=3))
    b = paths(walks.uniform_walks(g, g.nodes.repartition(7), length=5, seed=3))
    assert a == b and a != paths(walks.uniform_walks(g, g.nodes, length=5, seed=4))


TREE = [(0, 1, "t", 1), (0, 2, "t", 5), (1, 3, "t", 20), (1, 4, "t", 1), (2, 5, "t", 1), (2, 6, "t", 0)]


def test_weighted_draws(make_graph, spark):
    g = make_graph(dict.fromkeys(range(7), "x"), TREE)
    root = spark.createDataFrame([("0",), ("1",), ("2",)], "id string")
    seen = {r.node: r["count"] for r in walks.weighted_walks(g, root, n=80, length=2).where("step = 1").groupBy("node").count().collect()}
    assert seen["3"] > seen["4"] and seen.get("2", 0) > 0 and "6" not in seen
    bfs = sampling.sampled_bfs(g, root, [40], weighted=True).where("hop = 1 and node = '6'")
    assert bfs.count() == 0


def test_biased_walks_extremes(make_graph):
    g = make_graph(dict.fromkeys(range(4), "x"), [(0, 1), (1, 2), (2, 3)])
    back = paths(walks.biased_walks(g, g.nodes, length=5, p=1e-6, q=1.0))
    assert all(nodes[k] == nodes[k - 2] for nodes in back.values() for k in range(2, len(nodes)))
    away = paths(walks.biased_walks(g, g.nodes.where("id = '0'"), length=4, p=1e9, q=1.0))
    assert away[("0", 0)] == ["0", "1", "2", "3"]
    with pytest.raises(GraphError, match="1/p"):
        walks.biased_walks(g, g.nodes, p=-1.0)


def test_metapath(make_graph):
    g = make_graph({0: "a", 1: "a", 2: "b", 3: "b"}, [(0, 2), (1, 2), (1, 3), (0, 1)])
    found = paths(walks.metapath_walks(g, g.nodes, ["a", "b", "a"], length=5))
    assert set(found) == {("0", 0), ("1", 0)}
    for nodes in found.values():
        assert [int(n) >= 2 for n in nodes] == [False, True, False, True, False]
    with pytest.raises(GraphError, match="metapath"):
        walks.metapath_walks(g, g.nodes, ["a", "b"])


def test_temporal_walks_reach_exactly_three(make_graph):
    g = make_graph(dict.fromkeys(range(1, 7), "x"), [(1, 2, "t", 5), (2, 3, "t", 2), (2, 4, "t", 10), (4, 5, "t", 3), (4, 6, "t", 12)])
    found = walks.temporal_walks(g, num_cw=60, cw_size=3, max_length=4, attempts=200, seed=2)
    seen = {"".join(r.n) for r in found.groupBy("walk").agg(F.array_sort(F.collect_list(F.struct("step", "node"))).alias("s")).select(F.col("s.node").alias("n")).collect()}
    assert {"246", "1246"} <= seen <= {"124", "246", "1246"}  # the last walk may be cut
    assert found.groupBy("walk").agg(F.max("step").alias("m")).where("m < 2").count() == 0
    biased = walks.temporal_walks(g, num_cw=10, cw_size=3, max_length=4, attempts=100, initial_bias="exponential", walk_bias="exponential")
    assert biased.count() > 0


def test_bfs_pads_below_nothing(make_graph, as_rows):
    g = make_graph({0: "x", 1: "x", "lone": "x"}, [(0, 1)])
    found = as_rows(sampling.sampled_bfs(g, g.nodes.where("id <> '1'"), [2, 3]).groupBy("root", "hop").agg(F.count("*").alias("n"), F.count("node").alias("real")))
    assert found == [("0", 0, 1, 1), ("0", 1, 2, 2), ("0", 2, 6, 6), ("lone", 0, 1, 1), ("lone", 1, 2, 0), ("lone", 2, 6, 0)]
    with pytest.raises(GraphError, match="sizes"):
        sampling.sampled_bfs(g, g.nodes, [-1])


def test_directed_bfs_tree(make_graph, as_rows):
    g = make_graph(dict.fromkeys("rabc", "x"), [("r", "a"), ("r", "b"), ("a", "c")], True)
    found = {r.part: r.node for r in sampling.directed_bfs(g, g.nodes.where("id = 'a'"), [1, 1], [1, 1]).collect()}
    assert found[0] == "a" and found[1] == "r" and found[2] == "c" and found[3] is None and found[4] in ("a", "b") and found[5] == "a" and found[6] is None


def test_split_keeps_connected(make_graph):
    edges = [(a, b) for a in range(8) for b in range(a + 1, 8)]
    g = make_graph(dict.fromkeys(range(8), "x"), edges[:20])
    rest, pairs = splitter.train_test_split(g, 0.2, keep_connected=True, seed=5)
    by = {r.label: r["count"] for r in pairs.groupBy("label").count().collect()}
    assert by == {0: 4, 1: 4} and rest.number_of_edges() == 16
    from weftgraph.operators.components import connected_components

    assert connected_components(rest).select("component").distinct().count() == connected_components(g).select("component").distinct().count()
    have = {frozenset((r.src, r.dst)) for r in g.edges.collect()}
    assert all(frozenset((r.src, r.dst)) not in have for r in pairs.where("label = 0").collect())
    with pytest.raises(GraphError, match="could not sample"):
        splitter.positive_edges(g, 0.95, keep_connected=True)
    local = splitter.local_negatives(make_graph(dict.fromkeys(range(10), "x"), LINE), 4, seed=3)
    assert all(abs(int(r.src) - int(r.dst)) > 1 for r in local.collect())


@pytest.mark.parametrize("longest", [1, 3, 8])
def test_simple_ends_are_those_of_uniform_walks(make_graph, longest):
    """Loops, parallel edges, an end, a node without edges, and walks longer than one plan."""
    g = make_graph(dict.fromkeys(range(12), "x"), [*LINE, (0, 0), (3, 4), (3, 4), (0, 5), (2, 9), (1, 7), (4, 10)])
    walked = paths(walks.uniform_walks(g, g.nodes, n=6, length=longest + 1, seed=5))
    depth_of = lambda root, walk: 1 + (int(root) + walk) % longest
    want = []
    for (root, walk), nodes in walked.items():
        upto = nodes[: depth_of(root, walk) + 1]
        if len(set(upto)) == depth_of(root, walk) + 1:
            want.append((root, upto[-1]))
    depth = (1 + (F.col("root").cast("int") + F.col("walk")) % longest).cast("int")
    found = walks.simple_ends(walks.step_table(g), g.nodes, depth, longest, n=6, seed=5)
    assert sorted((r.root, r.node) for r in found.collect()) == sorted(want) and want


def test_sampler_balances(make_graph):
    g = make_graph(dict.fromkeys(range(10), "x"), LINE)
    found = {r.label: r["count"] for r in sampling.unsupervised_samples(g, walks.uniform_walks(g, g.nodes, n=2, length=2)).groupBy("label").count().collect()}
    assert found == {0: 20, 1: 20}


def test_windows(spark, as_rows):
    df = spark.createDataFrame([(n, t, n * 10 + t) for n in (0, 1) for t in range(4)], "node int, t int, value int")
    found = as_rows(temporal.sliding_windows(df, size=2, distance=1))
    assert [(n, s, list(w), y) for n, s, w, y in found][:2] == [(0, 0, [0, 1], 2), (0, 1, [1, 2], 3)] and len(found) == 4
    assert temporal.sliding_windows(df, size=5).count() == 0


def test_neighbors_after_are_strictly_later(spark, as_rows):
    e = spark.createDataFrame([("a", "b", 1), ("b", "c", 1), ("b", "d", 3), ("b", "e", 2)], "src string, dst string, ts int")
    found = {(r.src, r.dst): (r.next, r.next_time) for r in temporal.neighbors_after(e).collect()}
    assert found == {("a", "b"): ("e", 2), ("b", "c"): (None, None), ("b", "d"): (None, None), ("b", "e"): (None, None)}


def test_numbering_is_dense(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("id"))
    for found in (sampling.numbered(df, "id"), sampling.ordered(df, "id"), sampling.batches(df, 64, shuffle_seed=1)):
        assert sorted(r.n for r in found.collect()) == list(range(500))


def test_typed_splits(make_graph):
    kinds = {k: "a" if k < 6 else "b" for k in range(12)}
    edges = [(a, b, "ab") for a in range(6) for b in range(6, 12) if (a + b) % 2] + [(a, a + 1, "aa") for a in range(5)]
    g = make_graph(kinds, edges)
    for method in ("global", "local"):
        _, pairs = splitter.train_test_split(g, 0.2, edge_type="ab", method=method, seed=3)
        found = pairs.collect()
        assert sum(r.label for r in found) * 2 == len(found)
        assert all(int(r.src) < 6 <= int(r.dst) for r in found)
