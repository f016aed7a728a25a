"""The queries over the whole line-item graph and the whole features against brute force."""

from __future__ import annotations

import os
from collections import Counter

import duckdb
import numpy as np
import pytest

from weftgraph.operators import linalg
from weftgraph.plans import catalog, staging

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def graph():
    """(ids, position of an id, src, dst, features) of all orders, parts and line items."""
    c = duckdb.connect()

    def read(columns, name):
        return c.sql(f"SELECT {columns} FROM read_parquet('{SF}/{name}.parquet')").fetchall()

    ids = [x for x, in read("'o' || o_orderkey", "orders") + read("'p' || p_partkey", "part")]
    at = {x: k for k, x in enumerate(ids)}
    edges = read("'o' || l_orderkey, 'p' || l_partkey", "lineitem")
    x = np.zeros((len(ids), 64))
    for k, e in read("'p' || vec_id, embedding", "embeddings"):
        if k in at and e is not None:
            x[at[k]] = e
    return ids, at, np.array([at[a] for a, _ in edges]), np.array([at[b] for _, b in edges]), x


@pytest.fixture(scope="module")
def matrix(graph):
    ids, _, src, dst, _ = graph
    a = np.zeros((len(ids), len(ids)))
    np.add.at(a, (src, dst), 1)
    np.add.at(a, (dst, src), 1)
    return a


def found_features(spark, graph, name, size):
    rows = catalog.QUERIES[name](spark, SF).collect()
    out = np.full((len(graph[0]), size), np.nan)
    for r in rows:
        out[graph[1][r.id], r.k - 1] = r.f
    assert len(rows) == out.size
    return out


def gcn(a):
    m = a.copy()
    np.fill_diagonal(m, 1)
    d = m.sum(1)
    return m / np.sqrt(d[:, None] * d[None, :])


def test_connected_components(spark, graph):
    ids, _, src, dst, _ = graph
    root = list(range(len(ids)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in zip(src, dst):
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y, key=lambda k: ids[k])] = min(x, y, key=lambda k: ids[k])
    names = [ids[find(k)] for k in range(len(ids))]
    size = Counter(names)
    found = sorted(tuple(r) for r in catalog.QUERIES["connected_components_whole"](spark, SF).select("id", "component", "size").collect())
    assert found == sorted((i, n, size[n]) for i, n in zip(ids, names))


def test_label_propagation(spark, graph):
    ids, _, src, dst, _ = graph
    near = [[] for _ in ids]
    for a, b in zip(src, dst):
        near[a].append(b)
        near[b].append(a)
    label = list(ids)
    for _ in range(3):
        votes = [Counter(label[j] for j in n) for n in near]
        label = [min(v, key=lambda c: (-v[c], c)) if v else old for v, old in zip(votes, label)]
    assert {r.id: r.cluster for r in catalog.QUERIES["label_propagation"](spark, SF).collect()} == dict(zip(ids, label))


def test_adjacency_power_2(spark, graph, matrix):
    t = matrix / np.maximum(matrix.sum(1), 1)[:, None]
    want = {1: t, 2: t @ t}
    got = {k: np.zeros_like(t) for k in want}
    rows = catalog.QUERIES["adjacency_power_2_whole"](spark, SF).toPandas()
    for power, i, j, v in rows[["power", "i", "j", "v"]].itertuples(index=False):
        got[power][graph[1][i], graph[1][j]] = v
    for k in want:
        assert (rows["power"] == k).sum() == np.count_nonzero(want[k])
        assert np.abs(got[k] - want[k]).max() < 2e-6


def test_propagations(spark, graph, matrix):
    x, g = graph[4], gcn(matrix)
    assert np.abs(found_features(spark, graph, "sgc_features_k2_whole", 64) - g @ g @ x).max() < 2e-6
    y = x
    for _ in range(3):
        y = 0.875 * g @ y + 0.125 * x
    assert np.abs(found_features(spark, graph, "appnp_k3_whole", 64) - y).max() < 2e-6


def test_layers(spark, graph, matrix):
    _, _, src, dst, x = graph
    w = np.tile(np.array(catalog.W42), (16, 1))
    want = np.maximum(gcn(matrix) @ x @ w + np.array(catalog.B2), 0)
    assert np.abs(found_features(spark, graph, "gcn_layer_forward_whole", 2) - want).max() < 2e-6
    into = np.zeros_like(matrix)
    np.add.at(into, (dst, src), 1)
    want = x @ w + into / np.maximum(into.sum(1), 1)[:, None] @ x @ w
    assert np.abs(found_features(spark, graph, "rgcn_layer_forward_whole", 2) - want).max() < 2e-6
    near = (matrix > 0) / np.maximum((matrix > 0).sum(1), 1)[:, None]
    assert np.abs(found_features(spark, graph, "sage_mean_layer_whole", 128) - np.hstack([x, near @ x])).max() < 2e-6


def test_propagations_make_no_matrix(spark, monkeypatch):
    monkeypatch.setattr(linalg, "gcn_matrix", None)
    assert catalog.QUERIES["appnp_k3_whole"](spark, SF).count() == 64 * catalog.op_graph(spark, SF).nodes.count()


def test_personalised_propagation_stores_no_round_of_vectors(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(staging, "shared_dir", lambda _: str(tmp_path))
    found = catalog.QUERIES["appnp_k3_whole"](spark, SF.replace("sf0.001", "sf0.01"))
    assert sorted(p.name.split("-")[0] for p in tmp_path.iterdir()) == ["coefficients", "degrees", "seeds"]
    assert found.select("id").distinct().count() == 17_000
