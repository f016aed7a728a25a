"""The driver's tables as graphs, in Spark and as DuckDB text.

``op``: orders and parts joined by line items (weight: quantity).  ``het``:
regions, nations, customers, suppliers, orders and parts.  Edge ids are digests
of the whole row, so no task has to number all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.graph import Graph

EMPTY = "array<double>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key(prefix: str, column: str) -> Column:
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def cents(column: str) -> Column:
    return F.round(F.col(column) * 100).cast("bigint").cast("string")


def line_id() -> Column:
    return F.md5(F.concat_ws(
        "|", *(F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")),
        *(cents(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")), "l_returnflag", "l_linestatus", F.date_format("l_shipdate", "yyyy-MM-dd"),
    ))


LINE_ID = (
    "md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(round(l_quantity * 100) AS BIGINT), CAST(round(l_extendedprice * 100) AS BIGINT), "
    "CAST(round(l_discount * 100) AS BIGINT), CAST(round(l_tax * 100) AS BIGINT), l_returnflag, l_linestatus, strftime(l_shipdate, '%Y-%m-%d')))"
)


def bare(df: DataFrame) -> DataFrame:
    return df.withColumn("features", F.array().cast(EMPTY))


def op_graph(spark: SparkSession, sf_dir: str, *, directed: bool = False, least: float = 0) -> Graph:
    """Order–part graph of the line items with a quantity of ``least`` or more."""
    nodes = table(spark, sf_dir, "orders").select(key("o", "o_orderkey").alias("id"), F.lit("order").alias("type")).unionByName(
        table(spark, sf_dir, "part").select(key("p", "p_partkey").alias("id"), F.lit("part").alias("type"))
    )
    edges = table(spark, sf_dir, "lineitem").where(F.col("l_quantity") >= least).select(
        line_id().alias("eid"), key("o", "l_orderkey").alias("src"), key("p", "l_partkey").alias("dst"), F.lit("contains").alias("type"), F.col("l_quantity").alias("weight")
    )
    return Graph(bare(nodes), bare(edges), directed)


def op_sql(least: float = 0) -> str:
    return f"""nodes AS (SELECT 'o' || o_orderkey AS id, 'order' AS type FROM orders UNION ALL SELECT 'p' || p_partkey, 'part' FROM part),
edges AS (SELECT {LINE_ID} AS eid, 'o' || l_orderkey AS src, 'p' || l_partkey AS dst, 'contains' AS type, l_quantity AS weight FROM lineitem WHERE l_quantity >= {least})"""


#: (type, table, node id prefix and key)
HET_NODES = (("region", "region", "r", "r_regionkey"), ("nation", "nation", "n", "n_nationkey"), ("customer", "customer", "c", "c_custkey"), ("supplier", "supplier", "s", "s_suppkey"), ("order", "orders", "o", "o_orderkey"), ("part", "part", "p", "p_partkey"))
#: (type, table, edge id prefix and key or None for line items, source, target, weight)
HET_EDGES = (
    ("in_region", "nation", "nr", "n_nationkey", ("n", "n_nationkey"), ("r", "n_regionkey"), None),
    ("lives_in", "customer", "cn", "c_custkey", ("c", "c_custkey"), ("n", "c_nationkey"), None),
    ("located_in", "supplier", "sn", "s_suppkey", ("s", "s_suppkey"), ("n", "s_nationkey"), None),
    ("placed", "orders", "co", "o_orderkey", ("c", "o_custkey"), ("o", "o_orderkey"), None),
    ("contains", "lineitem", "op", None, ("o", "l_orderkey"), ("p", "l_partkey"), "l_quantity"),
    ("supplied_by", "lineitem", "ps", None, ("p", "l_partkey"), ("s", "l_suppkey"), "l_quantity"),
)


def het_graph(spark: SparkSession, sf_dir: str, *, directed: bool = False) -> Graph:
    nodes = edges = None
    for kind, name, prefix, column in HET_NODES:
        part = table(spark, sf_dir, name).select(key(prefix, column).alias("id"), F.lit(kind).alias("type"))
        nodes = part if nodes is None else nodes.unionByName(part)
    for kind, name, prefix, column, a, b, weight in HET_EDGES:
        eid = F.concat(F.lit(prefix), line_id() if column is None else F.col(column).cast("string"))
        part = table(spark, sf_dir, name).select(
            eid.alias("eid"), key(*a).alias("src"), key(*b).alias("dst"), F.lit(kind).alias("type"), (F.col(weight) if weight else F.lit(1.0)).alias("weight")
        )
        edges = part if edges is None else edges.unionByName(part)
    return Graph(bare(nodes), bare(edges), directed)


def het_sql() -> str:
    nodes = " UNION ALL ".join(f"SELECT '{p}' || {c} AS id, '{k}' AS type FROM {n}" for k, n, p, c in HET_NODES)
    edges = " UNION ALL ".join(
        f"SELECT '{p}' || {LINE_ID if c is None else c} AS eid, '{a[0]}' || {a[1]} AS src, '{b[0]}' || {b[1]} AS dst, '{k}' AS type, {w or '1.0::DOUBLE'} AS weight FROM {n}"
        for k, n, p, c, a, b, w in HET_EDGES
    )
    return f"nodes AS ({nodes}),\nedges AS ({edges})"


HALF_SQL = """half AS MATERIALIZED (SELECT src AS node, dst AS nbr, eid, type, weight FROM edges UNION ALL SELECT dst, src, eid, type, weight FROM edges WHERE src <> dst)"""


def adj_sql(source: str = "half", name: str = "adj", by: str = "node") -> str:
    return f"""{name} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY eid, nbr) - 1 AS pos, count(*) OVER (PARTITION BY {by}) AS degree,
  sum(weight) OVER (PARTITION BY {by} ORDER BY eid, nbr ROWS UNBOUNDED PRECEDING) AS cum, sum(weight) OVER (PARTITION BY {by}) AS total FROM {source})"""


def features(spark: SparkSession, sf_dir: str, prefix: str, size: int | None = None) -> DataFrame:
    """(id, features): embeddings by vec_id, their first ``size`` components if given."""
    x = F.col("embedding").cast(EMPTY)
    return table(spark, sf_dir, "embeddings").select(key(prefix, "vec_id").alias("id"), (F.slice(x, 1, size) if size else x).alias("features"))


def time_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(eid, src, dst, type, ts): from each event's user to the user of the day's next event of its type."""
    from pyspark.sql import Window as W

    e = table(spark, sf_dir, "events")
    then = W.partitionBy("event_type", F.to_date("ts")).orderBy("ts", "event_id")
    rows = e.select("event_id", "user_id", "event_type", "ts", F.lead("user_id").over(then).alias("next")).where("next is not null")
    return rows.select(F.col("event_id").cast("string").alias("eid"), key("u", "user_id").alias("src"), key("u", "next").alias("dst"), F.col("event_type").alias("type"), "ts")


TIME_SQL = """time_edges AS (SELECT CAST(event_id AS VARCHAR) AS eid, 'u' || user_id AS src, 'u' || next AS dst, event_type AS type, ts FROM
  (SELECT *, lead(user_id) OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts, event_id) AS next FROM events) WHERE next IS NOT NULL)"""
