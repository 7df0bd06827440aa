"""Logistic regression in numpy, and what a bounded sample of labelled rows needs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_side


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 25) -> np.ndarray:
    """Weights, the last one the intercept, by Newton steps on the penalised likelihood."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), l2)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = sigmoid(x @ w)
        slope = x.T @ (p - y) + penalty * w
        curve = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
        move = np.linalg.solve(curve, slope)
        w -= move * min(1.0, 8 / (np.abs(move).max() + 1e-12))
        if np.abs(move).max() < 1e-6:
            break
    return w


def score(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Log-odds."""
    return x @ w[:-1] + w[-1]


def folds(n: int, k: int, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).permutation(n) % k


def out_of_fold(x: np.ndarray, y: np.ndarray, k: int = 4, l2: float = 1.0) -> np.ndarray:
    """Log-odds of each row by a model that hasn't seen it."""
    out, part = np.zeros(len(y)), folds(len(y), k)
    for f in range(k):
        out[part == f] = score(x[part == f], fit(x[part != f], y[part != f], l2))
    return out


def best_bar(p: np.ndarray, y: np.ndarray) -> float:
    """The bar on p with the best F1 for y = 1; in the middle of the widest gap among equals."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + max(y.sum(), 1))
    top = np.flatnonzero(f1 >= f1.max() - 1e-12)
    after = np.append(p[order][1:], 0.0)
    gaps = p[order][top] - after[top]
    k = top[int(np.argmax(gaps))]
    return float((p[order][k] + after[k]) / 2)


def place_of(columns: list[str]) -> Column:
    """A number in [0, 2^62) that is fixed by the columns."""
    return F.shiftrightunsigned(F.xxhash64(*columns, F.lit("sample")), 2)


def bounded_sample(rows: DataFrame, group: str, columns: list[str], cap: int | Column) -> DataFrame:
    """The ``cap`` rows of each non-null value of ``group`` whose hash of ``columns`` is least: the same in every run.

    Exactly cap distinct rows of a group, or all of its rows if it has fewer; rows that are equal in ``columns`` count once.
    Nothing comes to the driver. The bar of each group is found by a histogram of the hashes in bins that
    widen by a 16th of an octave, so only about 1.05 cap hashes of a group are sorted, whatever its size. cap may be a column of the group.
    """
    marks = rows.filter(F.col(group).isNotNull()).select(group, place_of(columns).alias("place")).distinct()
    marks = materialize(marks.withColumn("bin", F.floor(16 * F.log2(F.col("place") + 1.0)).cast("int")), "sample-marks")
    upto = Window.partitionBy(group).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = marks.groupBy(group, "bin").count().withColumn("before", F.coalesce(F.sum("count").over(upto), F.lit(0)))
    last = bins.filter(F.col("before") < cap).groupBy(group).agg(F.max("bin").alias("last"))
    last = small_side(materialize(last, "sample-last"))  # a row for each group: sent to the hashes, so that these stay where they are
    near = marks.join(last, group).filter(F.col("bin") <= F.col("last"))
    order = F.row_number().over(Window.partitionBy(group).orderBy("place"))
    bars = near.withColumn("order", order).filter(F.col("order") <= cap).groupBy(group).agg(F.max("place").alias("bar"))
    bars = materialize(bars.withColumnRenamed(group, "of_group"), "sample-bars")
    picked = rows.withColumn("place", place_of(columns)).join(small_side(bars), F.col(group) == F.col("of_group"))
    return picked.filter(F.col("place") <= F.col("bar")).dropDuplicates([group, "place"]).select(*rows.columns)


def training_rows(docs: DataFrame, labels: DataFrame, key: str, label: str, columns: list[str], cap: int, pool: int = 0) -> DataFrame:
    """(y, columns) of at most ``cap`` labelled documents of each class, and with y = -1 ``pool`` documents without a label.

    A key with several labels has the greatest. Keys are chosen first, among those of ``docs``, so texts are read once and
    never shuffled; rows that repeat a chosen key are bounded by a second choice. Rows without a key aren't used.
    """
    keys = docs.select(F.col(key).alias("of")).filter("of is not null")
    known = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("of")).agg(F.max(F.col(label).cast("int")).alias("y"))
    marked = keys.join(known, "of", "left").withColumn("y", F.coalesce("y", F.lit(-1))) if pool else known.join(keys, "of", "left_semi")
    most = F.when(F.col("y") < 0, pool).otherwise(cap)
    chosen = materialize(bounded_sample(marked, "y", ["of"], most).select("of", "y"), "training-keys")
    n = chosen.count()
    rows = docs.join(small_side(chosen, n), F.col(key) == F.col("of")).select("y", "of", *columns)
    rows = materialize(rows, "training-rows")
    if rows.count() > n:  # a key repeats
        rows = materialize(bounded_sample(rows, "y", ["of", *columns], most), "training-sample")
    return rows.select("y", *columns)
