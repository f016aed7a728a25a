"""Edges from an event stream (an addition: the reference has no streams)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def edge_counts(events: DataFrame, *, src: str, dst: str, ts: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, src, dst, n, weight): interactions by window, late ones within the watermark
    included.  The state holds a row for each edge and open window."""
    return (
        events.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), F.col(src).cast("string").alias("src"), F.col(dst).cast("string").alias("dst"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("weight")).select(F.col("w.start").alias("start"), "src", "dst", "n", "weight")
    )


def append_edges(counts: DataFrame, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Closed windows appended to a Parquet folder, once each: a batch writes to a folder of its
    number, so a repeated batch replaces itself."""
    def put(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    return counts.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(put).trigger(**(trigger or {"availableNow": True})).start()
