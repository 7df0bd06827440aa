"""k-means and what goes with it.

An iteration reads the rows once: each task assigns its rows to the (broadcast) centroids with
numpy and sends one partial sum per cluster, so the shuffle carries tasks x clusters rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import distance, metric_name
from ..tables import small
from .knn import _matrix
from .topk import sample_rows


@dataclass
class Centroids:
    """k x dim centers, with what the fit reports."""

    centers: np.ndarray
    inertia: float = math.nan
    iterations: int = 0

    def frame(self, spark) -> DataFrame:
        return spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(self.centers)], "cluster int, center array<double>")


def _assign(v: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Closest center and squared distance of each row, ties to the smaller cluster."""
    rough = (v * v).sum(1)[:, None] + (centers * centers).sum(1) - 2 * (v @ centers.T)
    best = rough.min(1, keepdims=True)
    label, d = np.zeros(len(v), np.int64), np.zeros(len(v))
    near = rough <= best + 1e-9 * (1 + np.abs(best))
    single = near.sum(1) == 1
    label[single] = near[single].argmax(1)
    for i in np.flatnonzero(~single):
        at = np.flatnonzero(near[i])
        label[i] = at[((centers[at] - v[i]) ** 2).sum(1).argmin()]
    d = ((v - centers[label]) ** 2).sum(1)
    return label, d


def _sums(rows: DataFrame, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Weighted sums and weights by cluster, and the cost. rows: (v, w)."""
    sent = rows.sparkSession.sparkContext.broadcast(centers)

    def run(batches):
        c = sent.value
        total, weight, cost = np.zeros(c.shape), np.zeros(len(c)), np.zeros(len(c))
        for batch in batches:
            if not batch.num_rows:
                continue
            v, w = _matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False)
            label, d = _assign(v, c)
            np.add.at(total, label, v * w[:, None])
            weight += np.bincount(label, weights=w, minlength=len(c))
            cost += np.bincount(label, weights=w * d, minlength=len(c))
        has = np.flatnonzero(weight > 0)
        yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(list(total[has]), pa.list_(pa.float64())), pa.array(weight[has]), pa.array(cost[has])], ["cluster", "total", "weight", "cost"])

    partial = rows.mapInArrow(run, "cluster long, total array<double>, weight double, cost double")
    sums = partial.select("cluster", "weight", "cost", F.posexplode("total").alias("pos", "x")).groupBy("cluster", "pos").agg(F.sum("x").alias("x"), F.sum("weight").alias("weight"), F.sum("cost").alias("cost"))
    total, weight, cost = np.zeros(centers.shape), np.zeros(len(centers)), np.zeros(len(centers))
    for c, pos, x, w, e in sums.collect():  # clusters x dim numbers
        total[c, pos], weight[c], cost[c] = x, w, e
    return total, weight, float(cost.sum())


def _rows(data: DataFrame, vector: str, weight: str | None) -> DataFrame:
    return data.select(F.col(vector).alias("v"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"))


def initial(data: DataFrame, k: int, init: str | np.ndarray = "k-means++", vector: str = "embedding", seed: int = 0, oversampling: float = 2.0, sample: int = 20_000) -> np.ndarray:
    """Starting centers: given ones, random rows, k-means++ on a sample of at most ``sample`` rows, or k-means||."""
    if not isinstance(init, str):
        return np.array(init, float)
    if init == "random":
        got = sample_rows(data.select("vec_id", vector), k, seed=seed).collect()
        return np.array([r[1] for r in got], float)
    rng = np.random.default_rng(seed)
    if init == "k-means||":
        centers = initial(data, 1, "random", vector, seed)
        cost = _sums(_rows(data, vector, None), centers)[2]
        for step in range(max(1, min(8, math.ceil(math.log(max(cost, math.e)))))):
            sent = data.sparkSession.sparkContext.broadcast(centers)
            phi, want = max(cost, 1e-300), oversampling * k

            def run(batches, sent=sent, phi=phi, want=want, step=step):
                for batch in batches:
                    if batch.num_rows:
                        _, d = _assign(_matrix(batch.column(1)), sent.value)
                        u = np.array([np.random.default_rng([seed, step, abs(int(i))]).random() for i in batch.column(0).to_pylist()])
                        yield batch.append_column("u", pa.array(u)).filter(pa.array(u < want * d / phi))

            more = data.select("vec_id", F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, "vec_id long, v array<double>, u double").orderBy("u", "vec_id").limit(int(8 * want) + 8).collect()
            if more:
                centers = np.vstack([centers, np.array([r.v for r in more])])
            cost = _sums(_rows(data, vector, None), centers)[2]
        weight = _sums(_rows(data, vector, None), centers)[1]
        pool, share = centers, weight
    else:
        pool = np.array([r[1] for r in sample_rows(data.select("vec_id", vector), sample, seed=seed).collect()], float)
        share = np.ones(len(pool))
    if len(pool) <= k:
        return pool
    centers = [pool[rng.choice(len(pool), p=share / share.sum())]]
    near = ((pool - centers[0]) ** 2).sum(1)
    for _ in range(k - 1):
        p = near * share
        trials = rng.choice(len(pool), 2 + math.ceil(math.log(k)), p=p / p.sum() if p.sum() > 0 else None)
        costs = [(np.minimum(near, ((pool - pool[t]) ** 2).sum(1)) * share).sum() for t in trials]
        centers.append(pool[trials[int(np.argmin(costs))]])
        near = np.minimum(near, ((pool - centers[-1]) ** 2).sum(1))
    return np.array(centers)


def fit(data: DataFrame, k: int = 8, init: str | np.ndarray = "k-means++", max_iter: int = 300, tol: float = 1e-4, n_init: int = 1, weight: str | None = None, vector: str = "embedding", seed: int = 0, oversampling: float = 2.0, inertia_check: bool = False) -> Centroids:
    """Lloyd's iterations until the centers move less than tol (sum of squares); a cluster without weight keeps its center."""
    best: Centroids | None = None
    rows = _rows(data, vector, weight)
    for run in range(n_init):
        centers = initial(data, k, init, vector, seed + run, oversampling)
        before, done = math.inf, 0
        for _ in range(max_iter):
            total, w, cost = _sums(rows, centers)
            new = np.where(w[:, None] > 0, total / np.maximum(w, 1e-300)[:, None], centers)
            moved, centers, done = float(((new - centers) ** 2).sum()), new, done + 1
            if moved < tol or inertia_check and before < math.inf and cost / max(before, 1e-300) > 1 - tol:
                break
            before = cost
        got = Centroids(centers, _sums(rows, centers)[2], done)
        if best is None or got.inertia < best.inertia:
            best = got
    return best


def predict(data: DataFrame, model: Centroids, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(vec_id, cluster, distance): the closest center and the squared distance to it."""
    sent = data.sparkSession.sparkContext.broadcast(model.centers)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                label, d = _assign(_matrix(batch.column(1)), sent.value)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(label.astype(np.int32)), pa.array(d)], [key, "cluster", "distance"])

    return data.select(F.col(key).cast("long").alias(key), F.col(vector).alias("v")).mapInArrow(run, f"{key} long, cluster int, distance double")


def transform(data: DataFrame, model: Centroids, vector: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance) to every center."""
    centers = F.broadcast(model.frame(data.sparkSession))
    return data.crossJoin(centers).select("vec_id", "cluster", distance(F.col(vector), F.col("center"), "l2_expanded").alias("distance"))


def cluster_cost(data: DataFrame, model: Centroids, vector: str = "embedding") -> DataFrame:
    """(cluster, size, cost)."""
    return predict(data, model, vector).groupBy("cluster").agg(F.count("*").alias("size"), F.sum("distance").alias("cost"))


def fit_balanced(data: DataFrame, k: int, n_iters: int = 20, metric: str = "l2_expanded", vector: str = "embedding", seed: int = 0) -> Centroids:
    """Hierarchical balanced k-means: about sqrt(k) coarse clusters, each split in proportion to its size, then a common fit.

    After each round, clusters with under a quarter of the average take over rows' places in the largest cluster.
    """
    metric_name(metric)
    n = data.count()
    if k <= 1 or n <= k:
        return fit(data, min(k, max(n, 1)), "random", 1, vector=vector, seed=seed)
    meso = fit(data, max(1, round(math.sqrt(k))), "random", n_iters, vector=vector, seed=seed)
    parts = predict(data, meso, vector).groupBy("cluster").count().collect()
    sizes = {r["cluster"]: r["count"] for r in parts}
    shares = {c: max(1, int(k * s / n)) for c, s in sizes.items()}
    while sum(shares.values()) < k:
        c = max(shares, key=lambda c: sizes[c] / shares[c])
        shares[c] += 1
    while sum(shares.values()) > k:
        c = max(shares, key=lambda c: (shares[c] > 1, -sizes[c] / shares[c]))
        shares[c] -= 1
    labelled = data.join(predict(data, meso, vector).select("vec_id", "cluster"), "vec_id")
    centers = np.vstack([initial(labelled.filter(F.col("cluster") == c), s, "random", vector, seed) for c, s in sorted(shares.items())])
    rows = _rows(data, vector, None)
    for step in range(n_iters):
        total, w, _ = _sums(rows, centers)
        centers = np.where(w[:, None] > 0, total / np.maximum(w, 1e-300)[:, None], centers)
        poor = np.flatnonzero(w < 0.25 * n / len(centers))
        if not len(poor) or step == n_iters - 1:
            continue
        rich = int(w.argmax())
        rng = np.random.default_rng([seed, step])
        centers[poor] = centers[rich] + rng.normal(0, 1e-2, (len(poor), centers.shape[1])) * (np.abs(centers[rich]).mean() + 1e-9)
    return Centroids(centers, _sums(rows, centers)[2], n_iters)


def calinski_harabasz(data: DataFrame, model: Centroids, vector: str = "embedding") -> float:
    """(n - k) // (k - 1) times dispersion over inertia; the first factor is a whole-number division."""
    total, w, cost = _sums(_rows(data, vector, None), model.centers)
    n, k = int(w.sum()), len(model.centers)
    mean = total.sum(0) / n
    dispersion = float((w * ((model.centers - mean) ** 2).sum(1)).sum())
    return (n - k) // max(k - 1, 1) * dispersion / max(cost, 1e-300)


def find_k(data: DataFrame, kmax: int, kmin: int = 2, max_iter: int = 100, tol: float = 1e-3, vector: str = "embedding", seed: int = 0) -> Centroids:
    """The number of clusters between kmin and kmax with the best Calinski-Harabasz value, by bisection."""
    tried: dict[int, tuple[float, Centroids]] = {}

    def value(k: int) -> float:
        if k not in tried:
            model = fit(data, k, "k-means++", max_iter, tol, vector=vector, seed=seed)
            tried[k] = (calinski_harabasz(data, model, vector), model)
        return tried[k][0]

    low, high = kmin, kmax
    while high - low > 2:
        mid = (low + high) // 2
        if value(mid) >= value(mid + 1):
            high = mid
        else:
            low = mid + 1
    best = max(range(low, high + 1), key=value)
    return tried[best][1]


def kmeans_frame(data: DataFrame, centers: DataFrame, metric: str = "l2_expanded", vector: str = "embedding") -> DataFrame:
    """Assignment as a plain DataFrame: (vec_id, cluster, distance) by min_by over (cluster, center)."""
    both = data.crossJoin(small(centers)).select("vec_id", "cluster", distance(F.col(vector), F.col("center"), metric).alias("distance"))
    return both.groupBy("vec_id").agg(F.min_by(F.struct("cluster", "distance"), F.struct("distance", "cluster")).alias("s")).select("vec_id", "s.cluster", "s.distance")
