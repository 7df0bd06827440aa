"""Small helpers that the text operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import written as materialize

__all__ = ["WORD", "bounded_batches", "materialize", "partitions", "read", "slices", "small_side"]

#: White space of the word rule: space and the bytes 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
#: A side is broadcast only after its rows were counted and found to be at most this many.
BROADCAST_ROWS = 200_000


def small_side(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` with a broadcast hint if it has few (narrow) rows, else as it is (shuffle join)."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def bounded_batches(spark: SparkSession) -> None:
    """Let texts reach Python in batches of 4 MB, where the session has Spark's own default (64 MB).

    A batch is held several times over, in the JVM's buffers and in the worker, for each task of an executor;
    kernels look at far less at a time, so larger ones gain nothing.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == "67108864b":
        spark.conf.set(name, "4m")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def slices(offsets, limit: int):
    """Cut rows into runs of at most ``limit`` bytes (a longer row is a run of its own).

    offsets: start of each row, and the end of the last. Yields (first row, row after the last).
    """
    first, n = 0, len(offsets) - 1
    while first < n:
        last = first + 1
        while last < n and offsets[last + 1] - offsets[first] <= limit:
            last += 1
        yield first, last
        first = last
