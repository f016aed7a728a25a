"""A Spark session with settings that suit the engine."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

#: Whether a finished write deletes its shuffle files, which otherwise wait for the driver's garbage collection.
FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def session(app: str = "weftgraph", **conf: str) -> SparkSession:
    """The running session, or a new one with adaptive execution and skew handling."""
    builder = SparkSession.builder.appName(app)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }
    return builder.config(map={**defaults, **conf}).getOrCreate()


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Writes within delete their shuffle files when they have finished."""
    before = spark.conf.get(FILE_CLEANUP, None)
    spark.conf.set(FILE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FILE_CLEANUP)
        else:
            spark.conf.set(FILE_CLEANUP, before)


def deleted(spark: SparkSession, path: str) -> None:
    """Deletes a folder by the file system that Spark reads it with."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
