"""Time-ordered edges and sliding windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftgraph.graph import GraphError


def neighbors_after(edges: DataFrame, *, time: str = "ts") -> DataFrame:
    """(src, dst, time, next, next_time): for each edge the earliest later edge that leaves its
    target; a strict inequality found by a window over the target's edges, not by pairing them."""
    marks = edges.select(F.col("dst").alias("node"), F.col(time).alias("t"), F.lit(1).alias("kind"), F.struct("src", "dst").alias("edge"), F.lit(None).cast("string").alias("nbr"))
    leave = edges.select(F.col("src").alias("node"), F.col(time).alias("t"), F.lit(0).alias("kind"), F.lit(None).cast("struct<src:string,dst:string>").alias("edge"), F.col("dst").alias("nbr"))
    # backwards in time, marks before departures of the same time: the last departure seen is the
    # next one, strictly later; a frame that only grows is kept up row by row
    seen = W.partitionBy("node").orderBy(F.desc("t"), F.desc("kind")).rowsBetween(W.unboundedPreceding, -1)
    last = F.last(F.when(F.col("kind") == 0, F.struct("t", "nbr")), ignorenulls=True).over(seen)
    return marks.unionByName(leave).withColumn("n", last).where("kind = 1").select("edge.src", "edge.dst", F.col("t").alias("time"), F.col("n.nbr").alias("next"), F.col("n.t").alias("next_time"))


def sliding_windows(series: DataFrame, *, node: str = "node", t: str = "t", value: str = "value", size: int, distance: int | None = None) -> DataFrame:
    """(node, start, window[, target]): each run of ``size`` values in time order, and the value
    ``distance`` steps after its end.  Incomplete windows fall out."""
    if size < 1 or (distance is not None and distance < 1):
        raise GraphError("expected a window size, and a distance if any, of 1 at least")
    order = W.partitionBy(node).orderBy(t)
    rows = series.select(
        node, (F.row_number().over(order) - 1).alias("start"), F.collect_list(value).over(order.rowsBetween(0, size - 1)).alias("window"),
        *([F.lead(F.struct(value), size + distance - 1).over(order).alias("__t")] if distance is not None else []),
    )
    rows = rows.where(F.size("window") == size)
    if distance is None:
        return rows
    return rows.where("__t is not null").select(node, "start", "window", F.col(f"__t.{value}").alias("target"))


def sequences(series: DataFrame, *, node: str = "node", t: str = "t", value: str = "value", seq_len: int, pre_len: int) -> DataFrame:
    """(node, start, x, y): seq_len values, and the last of the pre_len values that follow."""
    found = sliding_windows(series, node=node, t=t, value=value, size=seq_len, distance=pre_len)
    return found.select(node, "start", F.col("window").alias("x"), F.col("target").alias("y"))


def min_max_scaled(df: DataFrame, column: str, train: DataFrame | None = None) -> DataFrame:
    """The column scaled to [0, 1] by the extremes of ``train`` (or its own)."""
    ends = (train if train is not None else df).agg(F.min(column).alias("__lo"), F.max(column).alias("__hi"))
    span = F.col("__hi") - F.col("__lo")
    return df.join(F.broadcast(ends)).withColumn(column, F.when(span > 0, (F.col(column) - F.col("__lo")) / span).otherwise(0.0)).drop("__lo", "__hi")


def chronological_split(df: DataFrame, time: str, share: float) -> tuple[DataFrame, DataFrame]:
    """Rows up to the time quantile ``share``, and those after it."""
    cut = df.agg(F.percentile(F.unix_micros(F.col(time).cast("timestamp")), F.lit(share)).alias("cut")).first().cut
    at = F.unix_micros(F.col(time).cast("timestamp"))
    return df.where(at <= cut), df.where(at > cut)
