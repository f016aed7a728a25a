"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from weftgraph.session import deleted, shuffles_dropped

#: Rows and bytes an Arrow batch may hold; with long texts a larger batch would not fit a worker.
ARROW_ROWS = 1024
ARROW_BYTES = 8_000_000
#: A side is broadcast only when its measured bytes stay at or below this.
BROADCAST_BYTES = 1_500_000
#: A key is hot with more than one of so many shares of all rows, so fewer keys than this are hot.
HOT_SHARE = 2000
HOT_ROWS = 100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_limits(spark: SparkSession) -> None:
    """Small Arrow batches, so that a worker's memory doesn't follow the text length."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only in local mode (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage, survives
    a lost executor, and is computed once however often it is used.  The write's shuffle
    files go with it."""
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
        deleted(df.sparkSession, df.staged_at)


def bucketed(df: DataFrame, label: str, *keys: str) -> DataFrame:
    """``df`` stored in buckets of the keys: later joins on them move the other side only."""
    spark = df.sparkSession
    n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"{label}_{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.repartition(n, *keys).write.bucketBy(n, *keys).option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


#: What a Python worker keeps from task to task: of one operator at a time.
_held: dict[str, Any] = {}


def worker_state(name: str, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, made once in a worker and kept until another name is asked for."""
    if name not in _held:
        fresh_worker()
        _held[name] = make()
    return _held[name]


def fresh_worker() -> None:
    """Frees what another operator's tasks have left in this worker, which Spark reuses."""
    _held.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)  # hands freed memory back; absent outside glibc
    except (AttributeError, OSError):
        pass


def widened(df: DataFrame, **columns: str | DataType) -> StructType:
    """The schema of ``df`` with columns added (a DataFrame's own schema object is shared,
    and ``add`` would change it)."""
    schema = StructType(list(df.schema.fields))
    for name, kind in columns.items():
        schema = schema.add(name, kind)
    return schema


def measured(df: DataFrame) -> int:
    """Bytes of the rows: fixed-width columns by their count, strings and arrays by their lengths."""
    size = F.lit(0).cast("long")
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        if kind in ("string", "binary"):
            size += F.coalesce(F.octet_length(f.name), F.lit(0))
        elif kind == "array":
            size += F.greatest(F.size(f.name), F.lit(0)) * 8
    each = 16 + 8 * len(df.columns)
    return df.select((size + each).alias("b")).agg(F.coalesce(F.sum("b"), F.lit(0)).alias("b")).first().b


def if_small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast when its measured bytes are within ``most``; beyond
    that the join shuffles both sides and adaptive execution splits hot keys."""
    return F.broadcast(df) if measured(df) <= most else df


def split_join(rows: DataFrame, side: DataFrame, on: list[str], weight: str, how: str = "inner") -> DataFrame:
    """``rows`` joined ('inner' or 'left_semi') with ``side``, whose column ``weight``, which
    is dropped, counts the rows of each key.  Keys with more than a share of 1 in HOT_SHARE
    of all rows, fewer than HOT_SHARE by that definition, are broadcast, so that no task
    gets all their rows; the others are shuffled."""
    total = side.agg(F.coalesce(F.sum(weight), F.lit(0)).alias("n")).first().n
    hot = F.col(weight) > max(HOT_ROWS, total // HOT_SHARE)
    few = F.broadcast(side.where(hot).drop(weight))
    rest = rows.join(F.broadcast(side.where(hot).select(*on)), on, "left_anti")
    return rows.join(few, on, how).unionByName(rest.join(side.where(~hot).drop(weight), on, how))


def crc_class(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n: the split between learning and held-out rows."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(n)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, per_class: int, max_chars: int) -> DataFrame:
    """A bounded sample (text, y) for fitting: per label value the ``per_class`` ids
    first in hash order whose crc class isn't ``held``; rows with null label, null
    text or a text over ``max_chars`` are not learnt from; of repeated ids one row is."""
    ids = (
        labels.where(F.col(label).isin(0, 1) & (crc_class(F.col("doc_id"), modulus) != held))
        .groupBy("doc_id").agg(F.max(label).alias("y"))
    )
    picked = [
        ids.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)
    ]
    chosen = F.broadcast(picked[0].unionByName(picked[1]))  # two times per_class ids
    found = docs.select("doc_id", "text").where(F.length("text") <= max_chars).join(chosen, "doc_id")
    return found.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y")
