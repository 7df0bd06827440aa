"""Sweeps over search parameters: throughput, recall and the frontier between them."""

from __future__ import annotations

import itertools
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import stats
from ..operators.filters import valid_sweep


def combinations(build: dict[str, list], search: dict[str, list], k: int, dim: int):
    """(build, search) parameters that fit together."""
    for b in itertools.product(*build.values()):
        for s in itertools.product(*search.values()):
            one, two = dict(zip(build, b, strict=True)), dict(zip(search, s, strict=True))
            if valid_sweep(one, two, k, dim):
                yield one, two


def timed(run: Callable[[], DataFrame], queries: int, runs: int = 3, warm: int = 1) -> tuple[float, float]:
    """(seconds a run, queries a second) of evaluating a result completely."""
    for _ in range(warm):
        run().write.format("noop").mode("overwrite").save()
    began = time.perf_counter()
    for _ in range(runs):
        run().write.format("noop").mode("overwrite").save()
    took = (time.perf_counter() - began) / runs
    return took, queries / took


def sweep(spark, settings: list[tuple[str, Callable[[], DataFrame]]], truth: DataFrame, queries: int, runs: int = 1) -> DataFrame:
    """(setting, seconds, qps, recall)."""
    rows = []
    for name, run in settings:
        seconds, qps = timed(run, queries, runs)
        rows.append((name, seconds, qps, stats.recall(run(), truth).first()[0]))
    return spark.createDataFrame(rows, "setting string, seconds double, qps double, recall double")


def frontier(results: DataFrame, recall: str = "recall", qps: str = "qps") -> DataFrame:
    """Rows whose recall is above that of every faster row: a running maximum in order of speed."""
    order = Window.orderBy(F.desc(qps), F.desc(recall)).rowsBetween(Window.unboundedPreceding, -1)
    return results.withColumn("best", F.max(recall).over(order)).filter(F.col("best").isNull() | (F.col("best") < F.col(recall))).drop("best")
