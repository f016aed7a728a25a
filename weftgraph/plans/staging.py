"""Writing intermediate frames to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.session import deleted, shuffles_dropped

#: A counted side up to this many rows is broadcast; a larger one is shuffled.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written out and read back: lineage ends here, and a lost executor costs
    no recomputation.  The write's shuffle files go with it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Deletes what ``stored`` wrote for these frames, which nothing reads any more."""
    for df in frames:
        path = getattr(df, "staged_at", None)
        if path:
            deleted(df.sparkSession, path)


def if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marked for broadcast only when its counted rows are within ``rows``."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
