from __future__ import annotations

import json

from pyspark.sql import functions as F

from weftgraph.sources import epgm, objects, store, text
from weftgraph.streaming import edges as streaming


def put(folder, name, content):
    (folder / name).write_text(content)
    return str(folder / name)


def test_citations(spark, tmp_path, as_rows):
    content = put(tmp_path, "c.content", "1\t1\t0\tX\n2\t0\t1\tY\n3\t1\t1\tX\n")
    cites = put(tmp_path, "c.cites", "1\t2\n2\t3\n9\t3\n")
    g, labels = text.citation_graph(spark, content, cites)
    assert as_rows(g.edges, "src", "dst") == [("2", "1"), ("3", "2")] and as_rows(labels) == [("1", "X"), ("2", "Y"), ("3", "X")]


def test_sparse_lines(spark, tmp_path):
    path = put(tmp_path, "n.tab", "NODE\theader\ncat=1\n7\tlabel=2\tw-a=0.5\tsummary=x\n")
    r = text.sparse_nodes(spark, path, ["w-a", "w-b"]).first()
    assert (r.id, r.label, list(r.features)) == ("7", "2", [0.5, 0.0])


def test_triples_and_rdf(spark, tmp_path, as_rows):
    a, b = put(tmp_path, "train.txt", "x\tr\ty\n"), put(tmp_path, "test.txt", "y\tq\tx\n")
    g = text.triples_graph(spark, {"train": a, "test": b})
    assert as_rows(g.edges, "src", "type", "dst") == [("x", "r", "y"), ("y", "q", "x")]
    nt = put(tmp_path, "g.nt", '<a> <p> <b> .\n# no\n<a> <is> "one"@en .\n<b> <p> _:c .\n')
    g, held = text.ntriples_graph(spark, nt, label_relations=("is",))
    assert as_rows(g.edges, "src", "dst") == [("<a>", "<b>"), ("<b>", "_:c")] and as_rows(held) == [("<a>", "<is>", '"one"@en')]


def test_kernel_bundle_and_matrix(spark, tmp_path, as_rows):
    for name, body in (("A", "1, 2\n3, 4\n"), ("graph_indicator", "1\n1\n2\n2\n"), ("graph_labels", "1\n-1\n"), ("node_labels", "0\n1\n0\n2\n")):
        put(tmp_path, f"M_{name}.txt", body)
    nodes, links, labels = text.kernel_graphs(spark, str(tmp_path / "M"))
    assert as_rows(links) == [(1, "1", "2"), (2, "3", "4")] and as_rows(labels) == [(1, "1"), (2, "-1")] and nodes.count() == 4
    series = text.matrix_series(spark, put(tmp_path, "s.csv", "a,b\n1,2\n3,4\n"))
    assert as_rows(series) == [("a", 0, 1.0), ("a", 1, 3.0), ("b", 0, 2.0), ("b", 1, 4.0)]
    assert as_rows(text.matrix_edges(spark, put(tmp_path, "m.csv", "0,0.5\n1,0\n"), ["a", "b"])) == [("a", "b", 0.5), ("b", "a", 1.0)]


def test_ratings_and_prefixes(spark, tmp_path, as_rows):
    users = spark.createDataFrame([(1, 20, "m"), (2, 40, "f")], "user int, age int, sex string")
    items = spark.createDataFrame([(1, 1)], "item int, drama int")
    ratings = spark.createDataFrame([(1, 1, 5)], "user int, item int, rating int")
    g = text.ratings_graph(users, items, ratings, user_numeric=["age"], user_categories=["sex"], item_features=["drama"])
    assert as_rows(g.nodes, "id", "features") == [("m_1", [1.0]), ("u_1", [-1.0, 0.0, 1.0]), ("u_2", [1.0, 1.0, 0.0])]
    n, m = put(tmp_path, "n.csv", "1\n2\n"), put(tmp_path, "g.csv", "1\n")
    e = put(tmp_path, "e.csv", "1,1\n")
    g = text.prefixed_csv_graph(spark, {"user": (n, "u"), "group": (m, "g")}, {"in": (e, "u", "g")})
    assert as_rows(g.edges, "src", "dst") == [("u1", "g1")]
    t = text.timed_edges_graph(spark, put(tmp_path, "t.edges", "% c\n1 2 1 77\n"))
    assert as_rows(t.edges, "src", "dst", "weight") == [("1", "2", 77.0)]


def test_epgm_round_trip_and_append(spark, tmp_path, as_rows):
    def lines(name, rows):
        (tmp_path / name).write_text("\n".join(map(json.dumps, rows)))

    lines("graphs.json", [{"id": "g1", "data": {}, "meta": {"label": "cora"}}])
    lines("vertices.json", [{"id": x, "data": {"w": "2"}, "meta": {"label": "paper", "graphs": ["g1"]}} for x in "ab"])
    lines("edges.json", [{"id": "e", "data": {}, "meta": {"label": "cites", "graphs": ["g1"]}, "source": "a", "target": "b"}])
    found = epgm.Epgm.read(spark, str(tmp_path))
    gid = found.graph_id("cor")
    assert as_rows(found.node_attributes(gid, "pap")) == [("w",)] and as_rows(found.adjacency(gid)) == [("a", ["b"])]
    assert as_rows(found.to_graph(gid, ["w", "z"]).nodes, "id", "features") == [("a", [2.0, 0.0]), ("b", [2.0, 0.0])]
    found.write(str(tmp_path / "out"))
    again = epgm.Epgm.read(spark, str(tmp_path / "out"))
    assert as_rows(again.edge_list(gid)) == as_rows(found.edge_list(gid))
    other = epgm.Epgm(found.graphs, found.vertices.where("id = 'a'").withColumn("meta", F.struct(F.lit("paper").alias("label"), F.array(F.lit("g2")).alias("graphs"))), found.edges)
    both = found.append(other).vertices.select("id", F.col("meta.graphs").alias("g"))
    assert as_rows(both) == [("a", ["g1", "g2"]), ("b", ["g1"])]


class Toy:
    def __init__(self):
        self.n, self.e = {}, []

    def add_node(self, k, **d):
        self.n[k] = d

    def add_edge(self, a, b, **d):
        self.e.append((a, b, d))

    def nodes(self, data=True):
        return list(self.n.items())

    def edges(self, data=True):
        return self.e

    def is_directed(self):
        return False


def test_objects_and_store(make_graph, spark, tmp_path, as_rows):
    g = make_graph({"a": ("x", [1.0]), "b": ("y", [2.0])}, [("a", "b", "r", 3)])
    toy = objects.to_object(g, Toy, features="f")
    back = objects.from_object(spark, toy, features="f")
    assert as_rows(back.nodes) == as_rows(g.nodes) and as_rows(back.edges, "src", "dst", "type", "weight") == [("a", "b", "r", 3.0)]
    store.write(g, str(tmp_path / "s"))
    assert as_rows(store.read(spark, str(tmp_path / "s")).edges) == as_rows(g.edges)


def test_stream(spark, tmp_path, as_rows):
    events = spark.createDataFrame([(1, "c", "2024-01-01 00:10:00", 1.0), (1, "c", "2024-01-01 00:20:00", 2.0), (2, "c", "2024-01-01 09:00:00", 1.0)], "u int, k string, s string, value double").withColumn("ts", F.to_timestamp("s"))
    events.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = streaming.append_edges(streaming.edge_counts(source, src="u", dst="k", ts="ts"), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert as_rows(spark.read.parquet(str(tmp_path / "out")), "src", "dst", "n", "weight") == [("1", "c", 2, 3.0)]


def test_object_features_in_every_form(spark):
    import pandas as pd
    import pytest

    from weftgraph.graph import GraphError

    toy = Toy()
    for n, kind in (("a", "x"), ("b", "x"), ("c", "y")):
        toy.add_node(n, label=kind)
    toy.add_edge("a", "b", label="r", weight=1.0)
    for features in ({"a": [1], "b": [2]}, [("a", [1]), ("b", [2])], pd.DataFrame({"f": [1, 2]}, index=["a", "b"]), {"x": {"a": [1], "b": [2]}}):
        g = objects.from_object(spark, toy, features=features)
        assert sorted((r.id, list(r.features)) for r in g.nodes.collect()) == [("a", [1.0]), ("b", [2.0]), ("c", [])]
    with pytest.raises(GraphError, match="missing: 'b'"):
        objects.from_object(spark, toy, features={"a": [1]})
    with pytest.raises(GraphError, match="extra: 'z'"):
        objects.from_object(spark, toy, features={"a": [1], "b": [2], "z": [3]})


def test_largest_component_of_citations(spark, tmp_path, as_rows):
    content = put(tmp_path, "c.content", "1\t1\tX\n2\t0\tY\n3\t1\tX\n4\t1\tX\n5\t1\tZ\n")
    cites = put(tmp_path, "c.cites", "1\t2\n2\t3\n4\t5\n")
    g, labels = text.citation_graph(spark, content, cites, largest_component=True)
    assert as_rows(g.nodes, "id") == [("1",), ("2",), ("3",)] and as_rows(labels) == [("1", "X"), ("2", "Y"), ("3", "X")]
    assert as_rows(g.edges, "src", "dst") == [("2", "1"), ("3", "2")]


def test_line_numbers_follow_the_file(spark, tmp_path, as_rows):
    path = put(tmp_path, "lines.txt", "".join(f"line {k}\n" for k in range(1, 2001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        assert as_rows(text.line_numbered(spark, path)) == [(k, f"line {k}") for k in range(1, 2001)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_edge_ids_are_the_same_on_any_partitioning(spark, as_rows):
    from weftgraph import Graph

    rows = [(str(k % 7), str(k % 5), float(k % 3)) for k in range(200)]
    e = spark.createDataFrame(rows, "source string, target string, weight double")
    one, two = (Graph.from_tables(None, df).edges for df in (e.repartition(1), e.repartition(7)))
    assert as_rows(one, "eid", "src", "dst", "weight") == as_rows(two, "eid", "src", "dst", "weight") and one.select("eid").distinct().count() == 200
