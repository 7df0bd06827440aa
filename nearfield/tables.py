"""Where intermediate tables go, and when a side may be broadcast."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only after it was counted and found to have at most this many rows.
BROADCAST_ROWS = 50_000

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; where it is unset, on one machine, a temporary one."""
    global _own_dir
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if _own_dir is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        _own_dir = tempfile.mkdtemp(prefix="nearfield-")
    return _own_dir


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: it cuts the lineage and survives lost executors.

    by: a column by whose values the table is laid out, so that filters and joins on it prune folders.
    """
    path = f"{shared_dir(df.sparkSession)}/tables/{name}-{uuid.uuid4().hex}"
    if by is None:
        df.write.parquet(path)
    else:
        df.hint("rebalance", by).write.partitionBy(by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def small(df: DataFrame) -> DataFrame:
    """With a broadcast hint if it is counted to be small, else as it is, for a shuffle join."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt out by a key, two tasks a core: a table in one file would be one task."""
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism, key)
