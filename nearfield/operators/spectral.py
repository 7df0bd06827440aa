"""Spectral embedding and partitions of a weighted graph (src, dst, weight), both directions given.

Eigenvectors come from repeated products of the graph with a few vectors. Small graphs (up to
``DENSE`` nodes) are solved densely on the driver, and those with up to ``EDGES`` edges by filtered subspace
iteration there (24 bytes an edge); larger ones by such an iteration in which each product is a join of the
edges with the vectors (n x components numbers). Both end when the residuals are small.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import written
from . import kmeans

DENSE = 3000
EDGES = 2_000_000
#: Residuals at the end, over the spectrum's bound (the reference's solver: 0.01), and products at most (the reference: 4,000).
TOLERANCE, PRODUCTS = 1e-6, 4000
_STATE = "vec_id long, d double, x array<double>, y array<double>"


def _solve(edges: DataFrame, nodes: DataFrame, k: int, kind: str) -> DataFrame:
    """(vec_id, x): k leading vectors of the normalised adjacency (laplacian) or of the modularity matrix."""
    spark = edges.sparkSession
    n = nodes.count()
    if n <= DENSE:
        ids = [r[0] for r in nodes.select("vec_id").orderBy("vec_id").collect()]
        place = {v: i for i, v in enumerate(ids)}
        a = np.zeros((n, n))
        for r in edges.groupBy("src", "dst").agg(F.sum("weight").alias("w")).collect():
            a[place[r["src"]], place[r["dst"]]] = r["w"]
        a = (a + a.T) / 2
        d = a.sum(1)
        if kind == "modularity":
            m = a - np.outer(d, d) / max(d.sum(), 1e-300)
            values, vectors = np.linalg.eigh(m)
            x = vectors[:, np.argsort(-values)[:k]]
        else:
            half = 1 / np.sqrt(np.maximum(d, 1e-300))
            values, vectors = np.linalg.eigh(np.eye(n) - half[:, None] * a * half)
            x = vectors[:, np.argsort(values)[:k]] * (half[:, None] if kind == "embedding" else 1)
        x = x * np.where(x[np.abs(x).argmax(0), np.arange(x.shape[1])] < 0, -1, 1)
        return spark.createDataFrame([(v, [float(y) for y in x[i]]) for v, i in place.items()], "vec_id long, x array<double>")
    both = edges.select("src", "dst", "weight").union(edges.select("dst", "src", "weight")).groupBy("src", "dst").agg((F.sum("weight") / 2).alias("weight"))
    both = written(both.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), "weight"), "spectral-edges")
    if both.count() <= EDGES:
        return _local(both, nodes, k, kind)
    return _iterated(both, nodes, n, k, kind)


def leading(product, n: int, k: int, seed: int = 0) -> np.ndarray:
    """The k leading vectors of a symmetric matrix, given as its product with a block of vectors, by subspace iteration with Chebyshev filters."""
    r = np.random.default_rng(seed)
    # a few Lanczos steps bound the spectrum from below and above
    v, before, beta, alphas, betas = r.normal(size=(n, 1)), np.zeros((n, 1)), 0.0, [], []
    v /= np.linalg.norm(v)
    for _ in range(min(n, 20)):
        w = product(v) - beta * before
        alphas.append((w * v).sum())
        w -= alphas[-1] * v
        beta = np.linalg.norm(w)
        betas.append(beta)
        if beta < 1e-12:
            break
        before, v = v, w / beta
    ends = np.linalg.eigvalsh(np.diag(alphas) + np.diag(betas[:-1], 1) + np.diag(betas[:-1], -1))
    low, scale = ends[0] - beta, max(abs(ends[0]), abs(ends[-1])) + beta
    x = np.linalg.qr(r.normal(size=(n, min(n, 2 * k + 4))))[0]
    products = 0
    while True:
        y = product(x)
        products += 1
        ritz, turn = np.linalg.eigh((x.T @ y + y.T @ x) / 2)
        ritz, turn = ritz[::-1], turn[:, ::-1]
        x, y = x @ turn, y @ turn
        left = np.linalg.norm(y[:, :k] - x[:, :k] * ritz[:k], axis=0).max()
        if left <= TOLERANCE * scale or x.shape[1] == n:
            return x[:, :k]
        if products >= PRODUCTS:
            raise RuntimeError(f"residual {left:.1e} after {products} products")
        low = min(low, ritz[-1] - 1e-3 * scale)
        e, c = (ritz[-1] - low) / 2, (ritz[-1] + low) / 2
        # scaled, so that the leading vector keeps its length
        first = at = e / (ritz[0] - c)
        old, x = x, (y - c * x) * (at / e)
        for _ in range(49):
            after = 1 / (2 / first - at)
            old, x = x, (product(x) - c * x) * (2 * after / e) - at * after * old
            at = after
            products += 1
        x = np.linalg.qr(x)[0]


def _local(both: DataFrame, nodes: DataFrame, k: int, kind: str) -> DataFrame:
    """As _iterated(), on the driver. both: (src, dst, weight), symmetric."""
    ids = np.sort(nodes.select(F.col("vec_id").cast("long")).toArrow().column(0).to_numpy())
    table = both.toArrow()
    a, b = (np.searchsorted(ids, table.column(c).to_numpy()).astype(np.int32) for c in ("src", "dst"))
    w, n = table.column("weight").to_numpy(), len(ids)
    d = np.maximum(np.bincount(a, w, n), 1e-300)
    if kind != "modularity":
        w = w / np.sqrt(d[a] * d[b])

    def product(x: np.ndarray) -> np.ndarray:
        out = np.stack([np.bincount(a, w * x[b, j], n) for j in range(x.shape[1])], 1)
        return out - d[:, None] * (d @ x / d.sum()) if kind == "modularity" else out

    x = leading(product, n, k)
    x = x / np.sqrt(d)[:, None] if kind == "embedding" else x
    x = x * np.where(x[np.abs(x).argmax(0), np.arange(k)] < 0, -1, 1)
    return both.sparkSession.createDataFrame(pa.table({"vec_id": ids, "x": pa.array(list(x), pa.list_(pa.float64()))}), "vec_id long, x array<double>")


def _by_row(rows: DataFrame, f, schema: str) -> DataFrame:
    """``rows`` (vec_id, d, and arrays), the arrays as matrices through ``f``."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                whole = [np.array(c.to_pylist(), float) for c in batch.columns[2:]]
                yield from f(batch, *whole)

    return rows.mapInArrow(run, schema)


def _arrays(batch, **columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(list(c), pa.list_(pa.float64())) for c in columns.values())], ["vec_id", "d", *columns])


def _iterated(both: DataFrame, nodes: DataFrame, n: int, k: int, kind: str) -> DataFrame:
    """The same vectors of a symmetric edge table by subspace iteration with Chebyshev filters, until the residuals are under ``TOLERANCE``.

    A filter damps the eigenvalues below the block's least Ritz value; its degree is such that the
    first vector grows by at most 1e4, so that the k x k matrices stay well conditioned.
    """
    degree = both.groupBy(F.col("src").alias("vec_id")).agg(F.sum("weight").alias("d"))
    base = written(nodes.join(degree, "vec_id", "left").select("vec_id", F.greatest(F.coalesce("d", F.lit(0.0)), F.lit(1e-300)).alias("d")), "spectral-degrees")
    total, most, squares = base.agg(F.sum("d"), F.max("d"), F.sum(F.col("d") * F.col("d"))).first()
    modular = kind == "modularity"
    low = -(most + squares / total) if modular else -1.0  # no eigenvalue is less
    ends = both.join(base.select(F.col("vec_id").alias("dst"), F.col("d").alias("dd")), "dst").join(base.select(F.col("vec_id").alias("src"), F.col("d").alias("ds")), "src")
    scaled = written(ends.select("src", "dst", (F.col("weight") if modular else F.col("weight") / F.sqrt(F.col("ds") * F.col("dd"))).alias("w")), "spectral-steps")
    q = min(n, 2 * k + 4)
    products = 0

    def product(x: DataFrame, f=lambda z, x, y: (x, z)) -> DataFrame:
        """(vec_id, d, x, y) after f(matrix times x, x, y)."""
        nonlocal products
        products += 1
        flow = scaled.join(x.select(F.col("vec_id").alias("dst"), "x"), "dst").groupBy(F.col("src").alias("vec_id")).agg(*[F.sum(F.col("w") * F.col("x")[j]).alias(f"z{j}") for j in range(q)])
        dots = x.agg(*[F.sum(F.col("d") * F.col("x")[j]) for j in range(q)]).first() if modular else [0.0] * q
        z = F.array(*[F.coalesce(f"z{j}", F.lit(0.0)) - F.col("d") * float(dots[j] / total) for j in range(q)])
        moved = x.join(flow, "vec_id", "left").select("vec_id", "d", "x", "y", z.alias("z"))

        def run(batch, x, y, z):
            new = f(z, x, y)
            yield _arrays(batch, x=new[0], y=new[1])

        return written(_by_row(moved, run, _STATE), "spectral-x")

    start = F.array(*[F.cos(F.pmod(F.xxhash64("vec_id", F.lit(j)), F.lit(100_000)) / 1e4) for j in range(q)])
    x = product(base.select("vec_id", "d", start.alias("x"), start.alias("y")))
    while True:
        # Rayleigh-Ritz: y is the matrix times x
        def grams(batch, x, y):
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([(x.T @ x).ravel(), (x.T @ y).ravel(), (y.T @ y).ravel()])], pa.list_(pa.float64()))], ["g"])

        g, h, s = np.sum([r[0] for r in _by_row(x, grams, "g array<double>").collect()], axis=0).reshape(3, q, q)
        unit = 1 / np.sqrt(np.maximum(np.diag(g), 1e-300))
        values, turn = np.linalg.eigh(unit[:, None] * g * unit)
        good = values > 1e-11 * values.max()
        basis = unit[:, None] * turn[:, good] / np.sqrt(values[good])
        ritz, turn = np.linalg.eigh(basis.T @ ((h + h.T) / 2) @ basis)
        ritz, u = ritz[::-1], (basis @ turn)[:, ::-1]
        left = np.sqrt(np.maximum(np.diag(u.T @ s @ u) - ritz**2, 0))
        if len(ritz) < k:
            raise RuntimeError(f"only {len(ritz)} of {k} vectors are independent")
        if left[:k].max() <= TOLERANCE * -low:
            break
        if products >= PRODUCTS:
            raise RuntimeError(f"residual {left[:k].max():.1e} after {products} products")
        q = len(ritz)
        cut = min(max(ritz[-1], low * (1 - 1e-3)), ritz[0] + 1e-3 * low)
        e, c = (cut - low) / 2, (cut + low) / 2
        grow = max((ritz[0] - c) / e, 1 + 1e-9)
        first = 1 / grow
        steps = int(np.clip(np.arccosh(1e4) / np.arccosh(grow), 2, 200))

        def begin(batch, x, y, u=u, c=c, by=first / e):
            yield _arrays(batch, x=(y @ u - c * (x @ u)) * by, y=x @ u)

        x = written(_by_row(x, begin, _STATE), "spectral-x")
        at = first
        for _ in range(steps - 1):
            after = 1 / (2 / first - at)
            x = product(x, lambda z, x, y, c=c, a=2 * after / e, b=at * after: (a * (z - c * x) - b * y, x))
            at = after
        x = product(x)

    def end(batch, x, y):
        yield _arrays(batch, x=x @ u[:, :k])

    x = written(_by_row(x, end, "vec_id long, d double, x array<double>"), "spectral-x")
    out = x.select("vec_id", (F.transform("x", lambda v: v / F.sqrt("d")) if kind == "embedding" else F.col("x")).alias("x"))
    ends = out.agg(*[F.max_by(F.col("x")[j], F.struct(F.abs(F.col("x")[j]), -F.col("vec_id"))) for j in range(k)]).first()
    return out.select("vec_id", F.array(*[F.col("x")[j] * (-1.0 if ends[j] < 0 else 1.0) for j in range(k)]).alias("x"))


def embedding(edges: DataFrame, nodes: DataFrame, n_components: int) -> DataFrame:
    """(vec_id, x): the n_components vectors after the first; signs so that each one's largest entry is positive."""
    return _solve(edges, nodes, n_components + 1, "embedding").select("vec_id", F.slice("x", 2, n_components).alias("x"))


def partition(edges: DataFrame, nodes: DataFrame, n_clusters: int, n_vectors: int | None = None, seed: int = 0) -> DataFrame:
    """(vec_id, label): k-means on the leading eigenvectors."""
    x = written(_solve(edges, nodes, n_vectors or n_clusters, "partition"), "spectral")
    model = kmeans.fit(x, n_clusters, "k-means++", 100, 1e-6, vector="x", seed=seed)
    return kmeans.predict(x, model, "x").select("vec_id", F.col("cluster").alias("label"))


def modularity_partition(edges: DataFrame, nodes: DataFrame, n_clusters: int, seed: int = 0) -> DataFrame:
    """(vec_id, label): k-means on the leading vectors of the modularity matrix."""
    x = written(_solve(edges, nodes, n_clusters, "modularity"), "spectral")
    unit = x.select("vec_id", F.transform("x", lambda v: v / F.sqrt(F.aggregate("x", F.lit(1e-300), lambda a, b: a + b * b))).alias("x"))
    model = kmeans.fit(unit, n_clusters, "k-means++", 100, 1e-6, vector="x", seed=seed)
    return kmeans.predict(unit, model, "x").select("vec_id", F.col("cluster").alias("label"))


def analyze_partition(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(edge_cut, cost): weight between clusters (each pair once), and the sum over clusters of cut over size."""
    both = _labelled(edges, labels)
    cut = F.sum(F.when(F.col("la") != F.col("lb"), F.col("weight")).otherwise(0.0))
    per = both.groupBy(F.col("la").alias("label")).agg(cut.alias("cut")).join(labels.groupBy("label").agg(F.count("*").alias("n")), "label")
    return per.agg((F.sum("cut") / 2).alias("edge_cut"), F.sum(F.col("cut") / F.col("n")).alias("cost"))


def analyze_modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(modularity): within-cluster weight share less what degrees would give."""
    both = _labelled(edges, labels)
    per = both.groupBy(F.col("la").alias("label")).agg(F.sum(F.when(F.col("la") == F.col("lb"), F.col("weight")).otherwise(0.0)).alias("own"), F.sum("weight").alias("degree"))
    sums = per.agg(F.sum("own").alias("own"), F.sum("degree").alias("m2"), F.sum(F.col("degree") * F.col("degree")).alias("sq"))
    return sums.select((F.col("own") / F.col("m2") - F.col("sq") / (F.col("m2") * F.col("m2"))).alias("modularity"))


def _labelled(edges: DataFrame, labels: DataFrame) -> DataFrame:
    a = labels.select(F.col("vec_id").alias("src"), F.col("label").alias("la"))
    b = labels.select(F.col("vec_id").alias("dst"), F.col("label").alias("lb"))
    return edges.join(a, "src").join(b, "dst")
