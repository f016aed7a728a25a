from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from weftgraph import Graph  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    found = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.default.parallelism", "4").getOrCreate()
    )
    found.sparkContext.setLogLevel("ERROR")
    yield found


@pytest.fixture(scope="session")
def make_graph(spark):
    def make(nodes, edges, directed=False):
        """nodes: id → (type, features) or type; edges: (src, dst[, type[, weight]])."""
        rows = [(str(k), *(v if isinstance(v, tuple) else (v, []))) for k, v in nodes.items()]
        links = [(f"e{n:03d}", str(e[0]), str(e[1]), e[2] if len(e) > 2 else "default", float(e[3]) if len(e) > 3 else 1.0, []) for n, e in enumerate(edges)]
        n = spark.createDataFrame(rows, "id string, type string, features array<double>")
        e = spark.createDataFrame(links, "eid string, src string, dst string, type string, weight double, features array<double>")
        return Graph(n, e, directed)

    return make


def rows(df, *columns):
    """Rows as sorted tuples."""
    return sorted(tuple(r) for r in df.select(*(columns or df.columns)).collect())


@pytest.fixture(scope="session")
def as_rows():
    return rows
