"""Graphs of bounded shards: the form in which graphs are searched at scale.

The rows of a label (or of the whole table, as one label) are dealt into shards of about
``SHARD`` rows. A shard's rows, vectors and optimised graph are packed into one row of a table, so
a task searches a shard without further joins or rounds, and its memory is bounded by the shard. A
query is searched in each shard of its label, and the shards' results are merged by top-k.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import is_min_close, metric_name
from ..tables import small
from . import knn
from .topk import top_k

SHARD = 8192
QUERIES = 1024
SCHEMA = "label int, shard int, ids binary, vectors binary, edges binary"


def neighbour_lists(v: np.ndarray, k: int, metric: str) -> np.ndarray:
    """Places of the k nearest other rows of each row, by distance and place."""
    n = len(v)
    out = np.zeros((n, k), np.int32)
    for at in range(0, n, 1024):
        rough = knn._rough(v[at : at + 1024], v, metric)
        rough[np.arange(len(rough)), np.arange(at, at + len(rough))] = np.inf
        near = np.argpartition(rough, k - 1, axis=1)[:, :k] if k < n else np.tile(np.arange(n), (len(rough), 1))
        near.sort(axis=1)
        order = np.argsort(np.take_along_axis(rough, near, 1), axis=1, kind="stable")
        out[at : at + len(rough)] = np.take_along_axis(near, order, 1)
    return out


def optimized(lists: np.ndarray, degree: int) -> np.ndarray:
    """Pruned lists (n x degree, -1 where empty): fewest detours first, the better half fixed, then reverse edges."""
    n, k = lists.shape
    degree = min(degree, k)
    detours = np.zeros((n, k), np.int32)
    for at in range(0, n, 512):
        own = lists[at : at + 512]
        around = lists[own]
        for j in range(1, k):
            detours[at : at + 512, j] = (around[:, :j] == own[:, j, None, None]).any(2).sum(1)
    kept = np.take_along_axis(lists, np.argsort(detours, axis=1, kind="stable")[:, :degree], 1)
    half = degree // 2
    place, source, target = np.tile(np.arange(degree), n), np.repeat(np.arange(n), degree), kept.ravel()
    order = np.lexsort((source, place, target))
    heads = np.searchsorted(target[order], np.arange(n + 1))
    back = source[order]
    out = np.full((n, degree), -1, np.int32)
    for i in range(n):
        every = np.concatenate([kept[i, :half], back[heads[i] : heads[i + 1]][: degree - half], kept[i, half:]])
        _, first = np.unique(every, return_index=True)
        every = every[np.sort(first)][:degree]
        out[i, : len(every)] = every
    return out


def beam(v: np.ndarray, edges: np.ndarray, q: np.ndarray, itopk: int, width: int, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances of the beam when no row of it is left to expand, closest first."""
    sign = 1 if is_min_close(metric) else -1
    n = len(v)
    seen = np.zeros(n, bool)
    at = np.unique(np.linspace(0, n - 1, min(n, max(itopk, 32))).astype(np.int64))
    seen[at] = True
    d = sign * knn._exact(q, v[at], metric)
    open_ = np.ones(len(at), bool)
    while True:
        order = np.lexsort((at, d))[:itopk]
        at, d, open_ = at[order], d[order], open_[order]
        parents = np.flatnonzero(open_)[:width]
        if not len(parents):
            return at, sign * d
        open_[parents] = False
        near = edges[at[parents]].ravel()
        near = np.unique(near[near >= 0])
        near = near[~seen[near]]
        if len(near):
            seen[near] = True
            at, open_ = np.concatenate([at, near]), np.concatenate([open_, np.ones(len(near), bool)])
            d = np.concatenate([d, sign * knn._exact(q, v[near], metric)])


def pack(rows: DataFrame, degree: int, intermediate: int | None = None, metric: str = "l2_expanded", shard_rows: int = SHARD) -> DataFrame:
    """Packed shards (label, shard, ids, vectors, edges) of rows (label, vec_id, v)."""
    metric = metric_name(metric)
    counts = rows.groupBy("label").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards"))
    dealt = rows.join(small(counts), "label").select(F.col("label").cast("int").alias("label"), F.pmod(F.xxhash64("vec_id"), F.col("shards")).cast("int").alias("shard"), F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast("array<float>").alias("v"))

    def build(table: pa.Table) -> pa.Table:
        ids = table.column("vec_id").to_numpy()
        ids, first = np.unique(ids, return_index=True)
        v = knn._matrix(table.column("v"))[first]
        k = min(intermediate or 2 * degree, len(ids) - 1)
        edges = optimized(neighbour_lists(v, k, metric), degree) if k > 0 else np.full((len(ids), 1), -1, np.int32)
        return pa.table([table.column("label")[:1], table.column("shard")[:1], *(pa.array([x.tobytes()], pa.binary()) for x in (ids, v.astype(np.float32), edges))], ["label", "shard", "ids", "vectors", "edges"])

    return dealt.groupBy("label", "shard").applyInArrow(build, SCHEMA)


def search(packed: DataFrame, queries: DataFrame, k: int, itopk: int = 64, width: int = 4, metric: str = "l2_expanded") -> DataFrame:
    """(query_id, rank, vec_id, distance) of queries (query_id, q, label), each in all shards of its label."""
    metric = metric_name(metric)
    if k > itopk:
        raise ValueError("k must be at most itopk")
    block = F.floor((F.row_number().over(_by_label()) - 1) / QUERIES)
    blocks = queries.withColumn("block", block).groupBy("label", "block").agg(F.collect_list("query_id").alias("query_ids"), F.flatten(F.collect_list(F.col("q").cast("array<float>"))).alias("qs"))
    pairs = packed.join(small(blocks.select("label", "query_ids", "qs")), "label").select("ids", "vectors", "edges", "query_ids", "qs")

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], np.int64)
                v = np.frombuffer(row["vectors"], np.float32).reshape(len(ids), -1).astype(float)
                edges = np.frombuffer(row["edges"], np.int32).reshape(len(ids), -1)
                qs = np.array(row["qs"], float).reshape(len(row["query_ids"]), -1)
                out = [[], [], []]
                for query_id, q in zip(row["query_ids"], qs, strict=True):
                    at, d = beam(v, edges, q, itopk, width, metric)
                    out[0].append(np.full(min(k, len(at)), query_id))
                    out[1].append(ids[at[:k]])
                    out[2].append(d[:k])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["query_id", "vec_id", "distance"])

    found = pairs.mapInArrow(run, "query_id long, vec_id long, distance double")
    return top_k(found, k, select_min=is_min_close(metric)).select("query_id", "rank", "vec_id", "distance")


def _by_label():
    from pyspark.sql import Window

    return Window.partitionBy("label").orderBy("query_id")
