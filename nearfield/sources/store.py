"""Saved indexes: Parquet tables beside a one-row table of what they are."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1


def save_tables(path: str, kind: str, tables: dict[str, DataFrame], **about) -> None:
    """Write tables and, last, their description, so that a half-written index isn't read."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(VERSION, kind, json.dumps(about), sorted(tables))], "version int, kind string, about string, tables array<string>").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def load_tables(spark: SparkSession, path: str, kind: str) -> tuple[dict[str, DataFrame], dict]:
    meta = spark.read.parquet(f"{path}/meta").first()
    if meta["version"] != VERSION or meta["kind"] != kind:
        raise ValueError(f"{path} isn't a {kind} index of version {VERSION}")
    return {n: spark.read.parquet(f"{path}/{n}") for n in meta["tables"]}, json.loads(meta["about"])


def build_or_load(spark: SparkSession, path: str, kind: str, build, force: bool = False) -> tuple[dict[str, DataFrame], dict]:
    """What is saved at ``path``; if nothing is, or force is set, what ``build()`` gives (tables, description), saved there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/meta")
    if force or not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        tables, about = build()
        save_tables(path, kind, tables, **about)
    return load_tables(spark, path, kind)


def save_brute_force(path: str, data: DataFrame, metric: str, metric_arg: float = 2.0) -> None:
    from ..functions.metrics import norm2

    rows = data.select("vec_id", "embedding", norm2(F.col("embedding")).alias("norm2"))
    save_tables(path, "brute_force", {"rows": rows}, metric=metric, metric_arg=metric_arg)


def save_graph(path: str, edges: DataFrame, data: DataFrame | None, metric: str) -> None:
    """A graph, with or without its vectors."""
    save_tables(path, "graph", {"edges": edges} | ({"rows": data} if data is not None else {}), metric=metric)
