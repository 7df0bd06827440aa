"""Inverted-file indexes: whole vectors (flat) and product-quantised ones.

Lists are rows with a ``list_id``, stored by list when they are built or extended; a search takes the closest
``n_probes`` centers of each query and joins the lists on ``list_id``, so only what is probed is read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.metrics import distance, is_min_close, metric_name, normalized
from ..tables import small, written
from . import kmeans, knn
from .filters import bitset_filter
from .topk import sample_rows, top_k

METRICS = ("l2_expanded", "l2_unexpanded", "l2_sqrt_expanded", "l2_sqrt_unexpanded", "inner_product", "cosine")


def _train_rows(data: DataFrame, fraction: float, n_lists: int, most: int = 2_000_000) -> DataFrame:
    n = data.count()
    if n < n_lists:
        raise ValueError("fewer rows than lists")
    want = min(n, max(n_lists, int(n * fraction)), most)
    return data if want >= n else sample_rows(data, want)


def _unit(data: DataFrame, vector: str) -> DataFrame:
    return data.withColumn(vector, normalized(F.col(vector)))


class IvfFlat:
    """centers (cluster, center) on the driver; lists (list_id, vec_id, v)."""

    def __init__(self, centers: np.ndarray, lists: DataFrame, metric: str, adaptive: bool = False):
        self.centers, self.lists, self.metric, self.adaptive = centers, lists, metric, adaptive

    @classmethod
    def build(cls, data: DataFrame, n_lists: int = 1024, n_iters: int = 20, fraction: float = 0.5, metric: str = "l2_expanded", adaptive: bool = False, add: bool = True, init: np.ndarray | None = None, vector: str = "embedding") -> IvfFlat:
        metric = metric_name(metric)
        if metric not in METRICS:
            raise ValueError(f"unsupported metric: {metric}")
        train = _unit(_train_rows(data, fraction, n_lists), vector) if metric == "cosine" else _train_rows(data, fraction, n_lists)
        model = kmeans.fit(train, n_lists, init, n_iters, 0.0, vector=vector) if init is not None else kmeans.fit_balanced(train, n_lists, n_iters, vector=vector)
        index = cls(model.centers, None, metric, adaptive)
        index.lists = written(index._placed(data if add else data.limit(0), vector), "ivf-lists", "list_id")
        return index

    def _placed(self, data: DataFrame, vector: str) -> DataFrame:
        sent = data.sparkSession.sparkContext.broadcast(self.centers)
        unit = self.metric in ("cosine", "inner_product")

        def run(batches):
            c = sent.value
            for batch in batches:
                if batch.num_rows:
                    v = knn._matrix(batch.column(1))
                    if self_metric == "cosine":
                        v = v / np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-300)
                    label, _ = kmeans._assign(v, c)
                    yield pa.RecordBatch.from_arrays([pa.array(label.astype(np.int32)), batch.column(0), batch.column(1)], ["list_id", "vec_id", "v"])

        self_metric = self.metric if unit else ""
        return data.select(F.col("vec_id").cast("long"), F.col(vector).cast("array<float>").alias("v")).mapInArrow(run, "list_id int, vec_id long, v array<float>")

    def sizes(self) -> DataFrame:
        return self.lists.groupBy("list_id").agg(F.count("*").alias("size"))

    def extend(self, data: DataFrame, vector: str = "embedding") -> IvfFlat:
        """With new rows; adaptive indexes move each center to the mean of its old weight and its new rows."""
        fresh = written(self._placed(data, vector), "ivf-lists", "list_id")
        centers = self.centers
        if self.adaptive:
            old = np.zeros(len(centers))
            for r in self.sizes().collect():
                old[r["list_id"]] = r["size"]
            total, w, _ = kmeans._sums(kmeans._rows(_unit(data, vector) if self.metric == "cosine" else data, vector, None), centers)
            centers = np.where((old + w)[:, None] > 0, (centers * old[:, None] + total) / np.maximum(old + w, 1)[:, None], centers)
        return IvfFlat(centers, self.lists.unionByName(fresh), self.metric, self.adaptive)

    def probes(self, queries: DataFrame, n_probes: int) -> DataFrame:
        """(query_id, list_id) of the closest centers."""
        centers = F.broadcast(kmeans.Centroids(self.centers).frame(queries.sparkSession))
        rough = "inner_product" if self.metric == "inner_product" else "cosine" if self.metric == "cosine" else "l2_expanded"
        pairs = queries.crossJoin(centers).select("query_id", F.col("cluster").alias("list_id"), distance(F.col("q"), F.col("center"), rough).alias("distance"))
        return top_k(pairs, min(n_probes, len(self.centers)), id_="list_id", select_min=is_min_close(rough)).select("query_id", "list_id")

    def search(self, queries: DataFrame, k: int, n_probes: int = 20, allowed: DataFrame | None = None) -> DataFrame:
        """(query_id, rank, vec_id, distance); a filter acts in the probed lists only, so fewer than k may be found."""
        rows = self.lists if allowed is None else bitset_filter(self.lists, allowed)
        asked = self.probes(queries, n_probes).join(small(queries.select("query_id", "q")), "query_id")
        pairs = rows.join(small(asked), "list_id").select("query_id", "vec_id", distance(F.col("q"), F.col("v"), self.metric).alias("distance"))
        return top_k(pairs, k, select_min=is_min_close(self.metric)).select("query_id", "rank", "vec_id", "distance")

    def reset(self) -> IvfFlat:
        return IvfFlat(self.centers, self.lists.limit(0), self.metric, self.adaptive)

    def save(self, path: str) -> None:
        spark = self.lists.sparkSession
        self.lists.repartition("list_id").write.mode("overwrite").partitionBy("list_id").parquet(f"{path}/lists")
        kmeans.Centroids(self.centers).frame(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/centers")
        spark.createDataFrame([(1, "ivf_flat", self.metric, self.adaptive)], "version int, kind string, metric string, adaptive boolean").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> IvfFlat:
        meta = spark.read.parquet(f"{path}/meta").first()
        if meta["version"] != 1 or meta["kind"] != "ivf_flat":
            raise ValueError("not an index of this kind and version")
        centers = np.array([r["center"] for r in spark.read.parquet(f"{path}/centers").orderBy("cluster").collect()])
        return cls(centers, spark.read.parquet(f"{path}/lists").select("list_id", "vec_id", "v"), meta["metric"], meta["adaptive"])


def auto_pq_dim(dim: int) -> int:
    """The default number of subspaces: a multiple of 32 where one fits, else a power of two.

    What has to fit is the dimension, from 128 on half of it.
    """
    room = dim if dim < 128 else dim // 2
    return room - room % 32 if room >= 32 else 1 << (room.bit_length() - 1)


def rotation_matrix(dim: int, pq_dim: int, force: bool = False, seed: int = 7) -> np.ndarray:
    """(pq_dim * pq_len) x dim: the identity if the subspaces fit, else orthonormal columns by QR."""
    rot = math.ceil(dim / pq_dim) * pq_dim
    if rot == dim and not force:
        return np.eye(dim)
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(rot, rot)))
    return q[:, :dim]


def _pq_encode(r: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Codes of residuals (n x dim) by books (pq_dim x codes x pq_len)."""
    pq_dim, _, length = books.shape
    parts = r.reshape(len(r), pq_dim, length)
    return np.stack([((parts[:, s, None, :] - books[s]) ** 2).sum(-1).argmin(1) for s in range(pq_dim)], 1).astype(np.int16)


def _lloyd(x: np.ndarray, k: int, iters: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(iters):
        label, _ = kmeans._assign(x, c)
        n = np.bincount(label, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, label, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


class IvfPq:
    """centers, rotation and codebooks on the driver (bounded by parameters); lists (list_id, vec_id, codes)."""

    def __init__(self, centers, rotation, books, per_cluster: bool, lists: DataFrame, metric: str):
        self.centers, self.rotation, self.books, self.per_cluster, self.lists, self.metric = centers, rotation, books, per_cluster, lists, metric

    @classmethod
    def build(cls, data: DataFrame, n_lists: int = 1024, n_iters: int = 20, fraction: float = 0.5, pq_bits: int = 8, pq_dim: int = 0, codebook: str = "per_subspace", force_rotation: bool = False, metric: str = "l2_expanded", train_rows: int = 65_536, vector: str = "embedding", seed: int = 0) -> IvfPq:
        metric = metric_name(metric)
        if metric not in METRICS or not 4 <= pq_bits <= 8:
            raise ValueError("unsupported metric or number of bits")
        dim = len(data.select(vector).first()[0])
        pq_dim = pq_dim or auto_pq_dim(dim)
        if pq_bits * pq_dim % 8:
            raise ValueError("pq_bits * pq_dim must be a multiple of 8")
        train = _train_rows(data, fraction, n_lists)
        if metric == "cosine":
            train = _unit(train, vector)
        centers = kmeans.fit_balanced(train, n_lists, n_iters, vector=vector, seed=seed).centers
        rotation = rotation_matrix(dim, pq_dim, force_rotation)
        index = cls(centers, rotation, None, codebook == "per_cluster", None, metric)
        # a bounded sample trains the codebooks
        rows = np.array([r[0] for r in sample_rows(train.select("vec_id", vector), train_rows).select(vector).collect()], float)
        label, _ = kmeans._assign(rows, centers)
        r = (rows - centers[label]) @ rotation.T
        codes, length = 1 << pq_bits, r.shape[1] // pq_dim
        if index.per_cluster:
            books = []
            for c in range(len(centers)):
                own = r[label == c].reshape(-1, length)
                books.append(_lloyd(own, codes, n_iters, seed) if len(own) else np.zeros((codes, length)))
            index.books = np.array(books)
        else:
            index.books = np.array([_lloyd(r[:, s * length : (s + 1) * length], codes, n_iters, seed) for s in range(pq_dim)])
        index.lists = written(index.encode(data, vector), "pq-lists", "list_id")
        return index

    @property
    def pq_dim(self) -> int:
        return self.rotation.shape[0] // self.books.shape[2]

    def _books_of(self, list_id: int) -> np.ndarray:
        return np.repeat(self.books[list_id][None], self.pq_dim, 0) if self.per_cluster else self.books

    def encode(self, data: DataFrame, vector: str = "embedding") -> DataFrame:
        """(list_id, vec_id, codes)."""
        sent, unit = data.sparkSession.sparkContext.broadcast(self._state()), self.metric == "cosine"

        def run(batches):
            own = IvfPq(*sent.value, None, "")
            for batch in batches:
                if not batch.num_rows:
                    continue
                v = knn._matrix(batch.column(1))
                if unit:
                    v = v / np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-300)
                label, _ = kmeans._assign(v, own.centers)
                r = (v - own.centers[label]) @ own.rotation.T
                if own.per_cluster:
                    codes = np.zeros((len(v), own.pq_dim), np.int16)
                    for c in np.unique(label):
                        codes[label == c] = _pq_encode(r[label == c], own._books_of(c))
                else:
                    codes = _pq_encode(r, own.books)
                yield pa.RecordBatch.from_arrays([pa.array(label.astype(np.int32)), batch.column(0), pa.array(list(codes), pa.list_(pa.int16()))], ["list_id", "vec_id", "codes"])

        return data.select(F.col("vec_id").cast("long"), F.col(vector).alias("v")).mapInArrow(run, "list_id int, vec_id long, codes array<smallint>")

    def _state(self) -> tuple:
        return self.centers, self.rotation, self.books, self.per_cluster

    def extend(self, data: DataFrame, vector: str = "embedding") -> IvfPq:
        return IvfPq(*self._state(), self.lists.unionByName(written(self.encode(data, vector), "pq-lists", "list_id")), self.metric)

    def extend_list(self, list_id: int, coded: DataFrame) -> IvfPq:
        """With rows (vec_id, codes) put in one list."""
        fresh = coded.select(F.lit(list_id).alias("list_id"), "vec_id", "codes")
        return IvfPq(*self._state(), self.lists.unionByName(fresh), self.metric)

    def erase_list(self, list_id: int) -> IvfPq:
        return IvfPq(*self._state(), self.lists.filter(F.col("list_id") != list_id), self.metric)

    def reconstruct(self) -> DataFrame:
        """(vec_id, v): the vectors that the codes stand for."""
        sent = self.lists.sparkSession.sparkContext.broadcast(self._state())

        def run(batches):
            own = IvfPq(*sent.value, None, "")
            for batch in batches:
                out = []
                for c, codes in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    books = own._books_of(c)
                    out.append(own.centers[c] + np.concatenate([books[s, x] for s, x in enumerate(codes)]) @ own.rotation)
                yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(out, pa.list_(pa.float64()))], ["vec_id", "v"])

        return self.lists.select("list_id", "vec_id", "codes").mapInArrow(run, "vec_id long, v array<double>")

    def search(self, queries: DataFrame, k: int, n_probes: int = 20, allowed: DataFrame | None = None, refine: tuple[DataFrame, int] | None = None) -> DataFrame:
        """Distances by look-up tables of each probed list; refine: (data, candidates) re-ranks so many candidates exactly."""
        flat = IvfFlat(self.centers, None, self.metric)
        asked = flat.probes(queries, n_probes).join(small(queries.select("query_id", "q")), "query_id")
        sent, metric = queries.sparkSession.sparkContext.broadcast(self._state()), self.metric

        def tables(batches):
            own = IvfPq(*sent.value, None, "")
            for batch in batches:
                out = []
                for c, q in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    q = np.array(q, float)
                    if metric == "cosine":
                        q = q / max(np.sqrt((q * q).sum()), 1e-300)
                    books = own._books_of(c)
                    if metric in ("inner_product", "cosine"):
                        base = -(q @ own.centers[c]) / own.pq_dim
                        lut = base - np.einsum("sd,scd->sc", (own.rotation @ q).reshape(own.pq_dim, -1), books)
                    else:
                        lut = (((own.rotation @ (q - own.centers[c])).reshape(own.pq_dim, 1, -1) - books) ** 2).sum(-1)
                    out.append(lut.ravel())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.float64()))], ["query_id", "list_id", "lut"])

        luts = asked.select("query_id", "list_id", "q").mapInArrow(tables, "query_id long, list_id int, lut array<double>")
        rows = self.lists if allowed is None else bitset_filter(self.lists, allowed)
        width = self.books.shape[1]
        picked = F.transform("codes", lambda c, s: F.get(F.col("lut"), s * width + c.cast("int")))
        score = F.aggregate(picked, F.lit(0.0), lambda a, x: a + x)
        pairs = rows.join(luts, "list_id").select("query_id", "vec_id", score.alias("distance"))
        if refine is not None:
            data, candidates = refine
            return knn.refine(data, queries, top_k(pairs, max(k, candidates)).select("query_id", "vec_id"), k, self.metric)
        shown = {"inner_product": -F.col("distance"), "cosine": 1 + F.col("distance")}.get(self.metric, F.sqrt("distance") if "sqrt" in self.metric else F.col("distance"))
        return top_k(pairs, k).select("query_id", "rank", "vec_id", shown.alias("distance"))

    def graph(self, data: DataFrame, k: int, vector: str = "embedding", refine_ratio: float = 2.0) -> DataFrame:
        """Neighbour graph of the rows by querying them all, with exact re-ranking."""
        queries = data.select(F.col("vec_id").alias("query_id"), F.col(vector).alias("q"))
        near = self.search(queries, k + 1, max(1, len(self.centers) // 4), refine=(data, int((k + 1) * refine_ratio)))
        edges = near.filter("query_id != vec_id").select(F.col("query_id").alias("src"), F.col("vec_id").alias("dst"), "distance")
        return top_k(edges, k, "src", id_="dst", select_min=is_min_close(self.metric)).select("src", "rank", "dst", "distance")

    def save(self, path: str) -> None:
        spark = self.lists.sparkSession
        self.lists.repartition("list_id").write.mode("overwrite").partitionBy("list_id").parquet(f"{path}/lists")
        arrays = [("centers", self.centers), ("rotation", self.rotation), ("books", self.books)]
        rows = [(n, [int(x) for x in a.shape], [float(x) for x in a.ravel()]) for n, a in arrays]
        spark.createDataFrame(rows, "name string, shape array<int>, data array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/arrays")
        spark.createDataFrame([(1, "ivf_pq", self.metric, self.per_cluster)], "version int, kind string, metric string, per_cluster boolean").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> IvfPq:
        meta = spark.read.parquet(f"{path}/meta").first()
        if meta["version"] != 1 or meta["kind"] != "ivf_pq":
            raise ValueError("not an index of this kind and version")
        a = {r["name"]: np.array(r["data"]).reshape(r["shape"]) for r in spark.read.parquet(f"{path}/arrays").collect()}
        return cls(a["centers"], a["rotation"], a["books"], meta["per_cluster"], spark.read.parquet(f"{path}/lists").select("list_id", "vec_id", "codes"), meta["metric"])


def vpq(data: DataFrame, vq_centers: int = 0, pq_dim: int = 0, pq_bits: int = 8, n_iters: int = 25, vector: str = "embedding") -> IvfPq:
    """Compression by one coarse codebook and product codes: about sqrt(n) centers rounded to 8, a quarter of the dimension."""
    n, dim = data.count(), len(data.select(vector).first()[0])
    return IvfPq.build(data, min(n, vq_centers or max(8, round(math.sqrt(n) / 8) * 8)), n_iters, 1.0, pq_bits, pq_dim or math.ceil(dim / 4), vector=vector)


def compressed(data: DataFrame, index: IvfPq, vector: str = "embedding") -> DataFrame:
    """(vec_id, vq, codes)."""
    return written(index.encode(data, vector), "vpq").select("vec_id", F.col("list_id").alias("vq"), "codes")
