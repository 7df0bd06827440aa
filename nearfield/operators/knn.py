"""Exact nearest neighbours.

At most ``QUERIES`` queries are broadcast as one block; each task computes a block of distances with
numpy and keeps k rows per query, so the shuffle carries k rows per query and task, whatever the data.
More queries are packed into blocks where they are, and every block meets every block of rows.
Distances of what is kept are computed anew from differences in double precision: the matrix
product only chooses, with a margin for its rounding.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import blocks
from ..functions.metrics import distance, is_min_close, metric_name
from ..tables import small, spread, written
from . import filters
from .topk import top_k

#: Metrics with a matrix form.
BLOCK = ("l2_expanded", "l2_unexpanded", "l2_sqrt_expanded", "l2_sqrt_unexpanded", "inner_product", "cosine")
#: Queries that travel together.
QUERIES = 4096
#: Rows in a block where every block meets every other, and distances in a batch that is given back.
BLOCK_ROWS, BATCH = 4096, 1 << 16
#: Rows of a block that are compared with another block at once, so that the matrix stays near the processor.
STRIP = 64


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    if n and flat.size % n:
        raise ValueError("vectors of different dimension")
    return flat.reshape(n, -1) if n else np.zeros((0, 0))


def _exact(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    """Distances of one query to rows, from the definition."""
    if metric == "inner_product":
        return (v * q).sum(1)
    if metric == "cosine":
        size = np.sqrt((q * q).sum()) * np.sqrt((v * v).sum(1))
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(size > 0, 1 - (v * q).sum(1) / size, np.nan)
    d = blocks.squared(v, q[None])
    return np.sqrt(d) if "sqrt" in metric else d


def _rough(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    """Keys (queries x rows) that sort as the distances do, up to rounding; smaller is closer."""
    if metric == "inner_product":
        return -(q @ v.T)
    if metric == "cosine":
        norm = lambda x: x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)
        return -(norm(q) @ norm(v).T)
    return (q * q).sum(1)[:, None] + (v * v).sum(1) - 2 * (q @ v.T)


def block_top_k(ids: np.ndarray, v: np.ndarray, q_ids: np.ndarray, q: np.ndarray, k: int, metric: str, keep: np.ndarray | None = None, metric_arg: float = 2.0):
    """(query ids, ids, distances) of the k closest rows to each query; keep: queries x rows."""
    out = []
    sign = 1 if is_min_close(metric) else -1
    for at in range(0, len(q), 256):
        part = q[at : at + 256]
        if metric == "l1" and part.size and v.size and part.shape[1] == v.shape[1]:
            row, column, d = blocks.closest_l1(part, v, ids, k, None if keep is None else keep[at : at + 256])
            out.append((q_ids[at + row], ids[column], d))
            continue
        if metric not in BLOCK:
            d = blocks.matrix(part, v, metric, metric_arg)
            if keep is not None:
                d = np.where(keep[at : at + 256], d, np.nan)
            row, column = blocks.top_of_strip(d, ids, k)
            out.append((q_ids[at + row], ids[column], d[row, column]))
            continue
        rough = _rough(part, v, metric)
        if keep is not None:
            rough = np.where(keep[at : at + 256], rough, np.inf)
        off = blocks.slack(part, v)
        for j in range(len(part)):
            row = rough[j]
            if k < len(row):
                bar = np.partition(row, k - 1)[k - 1]
                near = np.flatnonzero(row <= bar + max(1e-9 * (1 + abs(bar)), off[j]))
            else:
                near = np.arange(len(row))
            near = near[np.isfinite(row[near])]
            d = _exact(part[j], v[near], metric)
            near, d = near[~np.isnan(d)], d[~np.isnan(d)]
            order = np.lexsort((ids[near], sign * d))[:k]
            out.append((np.full(len(order), q_ids[at + j]), ids[near[order]], d[order]))
    return tuple(np.concatenate(x) if x else np.zeros(0) for x in zip(*out, strict=True)) if out else (np.zeros(0),) * 3


def packed_blocks(rows: DataFrame, id_: str, vector: str, names: tuple[str, ...], size: int, *more: str) -> DataFrame:
    """Rows as blocks of at most ``size`` of them: (ids, vectors, and a column for each of ``more``, whole numbers), binary columns, made where the rows are."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                whole = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in (part.column(0), *part.columns[2:])]
                columns = [whole[0], _matrix(part.column(1)), *whole[1:]]
                yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], list(names))

    return rows.select(F.col(id_).cast("long"), F.col(vector), *(F.col(c).cast("long") for c in more)).mapInArrow(run, ", ".join(f"{n} binary" for n in names))


def block_pairs(batches, *kinds):
    """Rows of packed blocks as arrays; kinds: of each column, np.int64 or, for vectors, the place of the column with their ids."""
    for batch in batches:
        for r in range(batch.num_rows):
            raw = [c[r].as_buffer() for c in batch.columns]
            yield [np.frombuffer(b).reshape(len(raw[kind]) // 8, -1) if isinstance(kind, int) else np.frombuffer(b, kind) for b, kind in zip(raw, kinds, strict=True)]


def _every(x: DataFrame, y: DataFrame, make, name: str) -> DataFrame:
    """(x_id, y_id, value) for all pairs; make() gives, in each task, a function of a block of x, one of y and a number: the matrix for so many rows of x at a time. Where it is NaN for other reasons than its input the value is null."""
    types = x.schema["x_id"].dataType, y.schema["y_id"].dataType
    left = packed_blocks(spread(x, "x_id"), "x_id", "x", ("x_ids", "xs"), BLOCK_ROWS)
    right = packed_blocks(spread(y, "y_id"), "y_id", "y", ("y_ids", "ys"), BLOCK_ROWS)
    left, right = written(left, "x-blocks"), written(right, "y-blocks")
    pairs = right.crossJoin(left).select("x_ids", "xs", "y_ids", "ys")  # a block of y meets those of x one after the other

    def run(batches):
        strips = make()
        for x_ids, u, y_ids, v in block_pairs(batches, np.int64, 0, np.int64, 2):
            odd = ~np.isfinite(v).all(1)
            step = max(1, BATCH // max(1, len(y_ids)))
            for top, whole in zip(range(0, len(x_ids), 256), strips(u, v, 256), strict=True):
                null = np.isnan(whole) & ~odd & np.isfinite(u[top : top + 256]).all(1)[:, None]
                for at in range(0, len(whole), step):
                    d = whole[at : at + step]
                    columns = [pa.array(np.repeat(x_ids[top + at : top + at + len(d)], len(y_ids))), pa.array(np.tile(y_ids, len(d))), pa.array(d.ravel(), mask=null[at : at + step].ravel())]
                    yield pa.RecordBatch.from_arrays(columns, ["x_id", "y_id", name])

    got = pairs.mapInArrow(run, f"x_id long, y_id long, {name} double")
    return got.select(F.col("x_id").cast(types[0]), F.col("y_id").cast(types[1]), name)


def _many(rows: DataFrame, queries: DataFrame, query: str, k: int, metric: str, metric_arg: float) -> DataFrame:
    """(query_id, vec_id, distance): every block of queries against every block of rows, on the executors.

    Each pair of blocks gives k rows a query; a task cuts its own to k before they are shuffled.
    """
    asked = written(packed_blocks(queries, "query_id", query, ("q_ids", "qs"), QUERIES), "query-blocks")
    pairs = written(packed_blocks(rows, "vec_id", "v", ("ids", "vs"), 2 * QUERIES), "row-blocks").crossJoin(asked)

    def run(batches):
        for ids, v, q_ids, q in block_pairs(batches, np.int64, 0, np.int64, 2):
            if v.shape[1] != q.shape[1]:
                raise ValueError("vectors of different dimension")
            got = block_top_k(ids, v, q_ids, q, k, metric, metric_arg=metric_arg)
            yield pa.RecordBatch.from_arrays([pa.array(got[0].astype(np.int64)), pa.array(got[1].astype(np.int64)), pa.array(got[2].astype(float))], ["query_id", "vec_id", "distance"])

    return pairs.mapInArrow(run, "query_id long, vec_id long, distance double")


def search(data: DataFrame, queries: DataFrame, k: int, metric: str = "l2_expanded", metric_arg: float = 2.0, allowed: DataFrame | Column | None = None, pairs: DataFrame | Column | None = None, vector: str = "embedding", query: str = "q") -> DataFrame:
    """Exact (query_id, rank, vec_id, distance); a query with fewer rows has fewer neighbours.

    allowed: allow-list of ids, or a boolean column over data; pairs: allow-list of (query_id, vec_id), or a boolean column over both sides.
    """
    metric = metric_name(metric)
    if allowed is not None:
        data = filters.bitset_filter(data, allowed)
    if isinstance(pairs, DataFrame):
        both = pairs.select("query_id", "vec_id").distinct().join(small(queries.select("query_id", query)), "query_id").join(data.select("vec_id", F.col(vector).alias("v")), "vec_id")
        both = both.select("query_id", "vec_id", distance(F.col(query), F.col("v"), metric, metric_arg).alias("distance"))
        return top_k(both, k, select_min=is_min_close(metric)).select("query_id", "rank", "vec_id", "distance")
    n = queries.count()
    if pairs is not None:
        both = data.select("vec_id", F.col(vector).alias("v"), *[c for c in data.columns if c not in ("vec_id", vector)]).crossJoin(F.broadcast(queries) if n <= QUERIES else queries)
        both = filters.bitmap_filter(both, pairs)
        both = both.select("query_id", "vec_id", distance(F.col(query), F.col("v"), metric, metric_arg).alias("distance"))
        return top_k(both, k, select_min=is_min_close(metric)).select("query_id", "rank", "vec_id", "distance")
    spark = data.sparkSession
    rows = spread(data.select(F.col("vec_id").cast("long"), F.col(vector).alias("v")), "vec_id")
    if n > QUERIES:
        found = _many(rows, queries, query, k, metric, metric_arg)
        return top_k(found, k, select_min=is_min_close(metric)).select("query_id", "rank", "vec_id", "distance")
    block = queries.select("query_id", query).toArrow()
    sent = spark.sparkContext.broadcast((block.column(0).to_numpy(), _matrix(block.column(1))))

    def run(batches):
        q_ids, q = sent.value
        held: tuple | None = None
        for batch in batches:
            if not batch.num_rows or not len(q_ids):
                continue
            ids, v = batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(1))
            if v.shape[1] != q.shape[1]:
                raise ValueError("vectors of different dimension")
            got = block_top_k(ids, v, q_ids, q, k, metric, metric_arg=metric_arg)
            held = got if held is None else tuple(np.concatenate(x) for x in zip(held, got, strict=True))
            if len(held[0]) > 8 * k * len(q_ids):
                held = _cut(held, k, metric)
        if held is not None:
            held = _cut(held, k, metric)
            yield pa.RecordBatch.from_arrays([pa.array(held[0].astype(np.int64)), pa.array(held[1].astype(np.int64)), pa.array(held[2].astype(float))], ["query_id", "vec_id", "distance"])

    found = rows.mapInArrow(run, "query_id long, vec_id long, distance double")
    return top_k(found, k, select_min=is_min_close(metric)).select("query_id", "rank", "vec_id", "distance")


def _by_label(batches):
    """Blocks of rows (label, id, vector, ...) that have one label."""
    for batch in batches:
        labels = batch.column(0).to_numpy()
        for label in np.unique(labels):
            part = batch.filter(pa.array(labels == label))
            for at in range(0, part.num_rows, QUERIES):
                some = part.slice(at, QUERIES)
                columns = [some.column(1).to_numpy(), _matrix(some.column(2)), *(c.to_numpy() for c in some.columns[3:])]
                yield pa.RecordBatch.from_arrays([pa.array([label], pa.int64()), *(pa.array([c.tobytes()], pa.binary()) for c in columns)], ["label", "ids", "vs", "bounds"][: len(columns) + 1])


def label_blocks(rows: DataFrame) -> DataFrame:
    """(label, ids, vs): packed blocks of rows (label, vec_id, v), each of one label."""
    every = spread(rows.select(F.col("label").cast("long"), F.col("vec_id").cast("long"), "v"), "vec_id").sortWithinPartitions("label")
    return written(every.mapInArrow(_by_label, "label long, ids binary, vs binary"), "label-blocks")


def lists_by_label(rows: DataFrame, k: int, metric: str = "l2_expanded") -> DataFrame:
    """(label, src, rank, dst, distance): the k nearest other rows of each row of (label, vec_id, v) under its label."""
    every = label_blocks(rows)
    pairs = every.join(every.select("label", F.col("ids").alias("q_ids"), F.col("vs").alias("qs")), "label").select("label", "ids", "vs", "q_ids", "qs")

    def run(batches):
        for batch in batches:
            for label, (ids, v, q_ids, q) in zip(batch.column(0).to_pylist(), block_pairs([batch.select(batch.schema.names[1:])], np.int64, 0, np.int64, 2), strict=True):
                src, dst, d = block_top_k(ids, v, q_ids, q, k + 1, metric)
                own = src != dst
                yield pa.RecordBatch.from_arrays([pa.array(np.full(own.sum(), label, np.int64)), *(pa.array(c[own].astype(t)) for c, t in ((src, np.int64), (dst, np.int64), (d, float)))], ["label", "src", "dst", "distance"])

    found = pairs.mapInArrow(run, "label long, src long, dst long, distance double").withColumn("label", F.col("label").cast(rows.schema["label"].dataType))
    return top_k(found, k, ["label", "src"], id_="dst", select_min=is_min_close(metric)).select("label", "src", "rank", "dst", "distance")


def checked(found: DataFrame, rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The exact (query_id, rank, vec_id, distance) from those that an approximate search found, by squared Euclidean distance.

    found: (query_id, vec_id, distance); rows (label, vec_id, v) and queries (query_id, q, label): a query's rows are those of its label.
    The k-th distance found is a bound: blocks of a label's rows give only what is as close, the matrix product deciding
    with a margin and the distances being taken anew. A row that is given twice counts once.
    """
    bounds = found.groupBy("query_id").agg(F.max("distance").alias("bound"), F.countDistinct("vec_id").alias("n"))
    bounds = queries.select("query_id", "q", F.col("label").cast("long").alias("label")).join(bounds, "query_id", "left")
    bounds = bounds.select("query_id", "q", "label", F.when(F.col("n") >= k, F.col("bound")).otherwise(F.lit(float("inf"))).alias("bound"))

    asked = bounds.filter("label is not null").select("label", F.col("query_id").cast("long"), "q", "bound").repartition("label").mapInArrow(_by_label, "label long, ids binary, vs binary, bounds binary")
    asked = written(asked.toDF("label", "q_ids", "qs", "bounds"), "checked-queries")
    every = label_blocks(rows)

    def run(batches):
        for ids, v, q_ids, q, bound in block_pairs(batches, np.int64, 0, np.int64, 2, np.float64):
            ids, first = np.unique(ids, return_index=True)
            v, norm = v[first], (v[first] * v[first]).sum(1)
            off = blocks.slack(q, v)
            for at in range(0, len(q), 256):
                part = q[at : at + 256]
                rough = (part * part).sum(1)[:, None] + norm - 2 * (part @ v.T)
                bar = (bound + off)[at : at + 256]
                if k < len(ids):
                    bar = np.minimum(bar, np.partition(rough, k - 1, axis=1)[:, k - 1] + 2 * off[at : at + 256])
                i, j = np.nonzero(rough <= bar[:, None])
                for x in range(0, len(i), BATCH):
                    some, other = i[x : x + BATCH], j[x : x + BATCH]
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids[at + some]), pa.array(ids[other]), pa.array(blocks.squared(v[other], part[some]))], ["query_id", "vec_id", "distance"])

    pairs = every.join(asked, "label").select("ids", "vs", "q_ids", "qs", "bounds")
    got = pairs.mapInArrow(run, "query_id long, vec_id long, distance double").dropDuplicates(["query_id", "vec_id"])
    return top_k(got, k).select("query_id", "rank", "vec_id", "distance")


def _cut(held: tuple, k: int, metric: str) -> tuple:
    sign = 1 if is_min_close(metric) else -1
    order = np.lexsort((held[1], sign * held[2], held[0]))
    q, v, d = (x[order] for x in held)
    heads = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
    place = np.arange(len(q)) - np.repeat(heads, np.diff(np.append(heads, len(q))))
    return q[place < k], v[place < k], d[place < k]


def pairwise(x: DataFrame, y: DataFrame, metric: str, metric_arg: float = 2.0, digits: int | None = None) -> DataFrame:
    """The matrix of distances, long: (x_id, y_id, distance) from (x_id, x) and (y_id, y); digits: to round to."""
    metric = metric_name(metric)
    return _every(x, y, lambda: blocks.rounded_strips(metric, metric_arg, digits), "distance")


def gram(x: DataFrame, y: DataFrame, kind: str, digits: int | None = None, **parameters) -> DataFrame:
    whole = lambda d: d if digits is None else blocks.rounded(d, digits)
    return _every(x, y, lambda: lambda u, v, size: (whole(blocks.kernel(u[top : top + size], v, kind, **parameters)) for top in range(0, len(u), size)), "value")


def nearest(x: DataFrame, y: DataFrame, metric: str = "l2_expanded") -> DataFrame:
    """Fused distance and arg-min: (x_id, y_id, distance) of the closest y of each x, ties to the smaller y_id."""
    both = pairwise(x, y, metric)
    best = F.min_by(F.struct("y_id", "distance"), F.struct("distance", "y_id")) if is_min_close(metric) else F.min_by(F.struct("y_id", "distance"), F.struct(-F.col("distance"), "y_id"))
    return both.groupBy("x_id").agg(best.alias("s")).select("x_id", "s.y_id", "s.distance")


def masked_nearest(x: DataFrame, y: DataFrame, adjacency: DataFrame, metric: str = "l2_expanded") -> DataFrame:
    """Arg-min over the groups of y that each x may see: adjacency (x_id, group_id), y (y_id, y, group_id)."""
    seen = x.join(adjacency.distinct(), "x_id").join(small(y), "group_id")
    seen = seen.select("x_id", "y_id", distance(F.col("x"), F.col("y"), metric).alias("distance"))
    return seen.groupBy("x_id").agg(F.min_by(F.struct("y_id", "distance"), F.struct("distance", "y_id")).alias("s")).select("x_id", "s.y_id", "s.distance")


def refine(data: DataFrame, queries: DataFrame, candidates: DataFrame, k: int, metric: str = "l2_expanded", vector: str = "embedding") -> DataFrame:
    """Re-rank candidates (query_id, vec_id) by exact distance; ids that don't exist are dropped."""
    if metric_name(metric) not in ("l2_expanded", "inner_product", "l2_unexpanded", "l2_sqrt_expanded", "cosine"):
        raise ValueError(f"refine doesn't support {metric}")
    wanted = candidates.select("query_id", "vec_id").distinct()
    both = wanted.join(data.select("vec_id", F.col(vector).alias("v")), "vec_id").join(small(queries.select("query_id", "q")), "query_id")
    both = both.select("query_id", "vec_id", distance(F.col("q"), F.col("v"), metric).alias("distance"))
    return top_k(both, k, select_min=is_min_close(metric)).select("query_id", "rank", "vec_id", "distance")


def knn_graph(data: DataFrame, k: int, metric: str = "l2_expanded", vector: str = "embedding", keep_self: bool = False) -> DataFrame:
    """(src, rank, dst, distance): every row against all rows, in query blocks."""
    own = data.select(F.col("vec_id").alias("query_id"), F.col(vector).alias("q"))
    near = search(data, own, k + (0 if keep_self else 1), metric, vector=vector)
    edges = near.select(F.col("query_id").alias("src"), F.col("vec_id").alias("dst"), "distance")
    if not keep_self:
        edges = edges.filter("src != dst")
    return top_k(edges, k, "src", id_="dst", select_min=is_min_close(metric)).select("src", "rank", "dst", "distance")


def mutual_reachability(data: DataFrame, min_samples: int, alpha: float = 1.0) -> DataFrame:
    """(src, dst, weight): greatest of both core distances and distance / alpha, over both directions of the neighbour graph.

    The core distance is that to the min_samples-th neighbour, the row itself counted.
    """
    near = written(knn_graph(data, min_samples, "l2_sqrt_expanded", keep_self=True), "reach")
    core = near.groupBy("src").agg(F.max("distance").alias("core"))
    edges = near.filter("src != dst").join(core, "src").join(core.select(F.col("src").alias("dst"), F.col("core").alias("core_b")), "dst")
    edges = edges.select("src", "dst", F.greatest("core", "core_b", F.col("distance") / alpha).alias("weight"))
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    return both.groupBy("src", "dst").agg(F.max("weight").alias("weight"))


def _first(code, src, dst, d) -> tuple[np.ndarray, ...]:
    """Of each code the entry with the least distance, ties to the smaller ids; sorted by code."""
    order = np.lexsort((dst, src, d, code))
    first = order[np.flatnonzero(np.append(True, code[order][1:] != code[order][:-1]))] if len(order) else order
    return code[first], src[first], dst[first], d[first]


NONE = (np.zeros(0, np.int64),) * 3 + (np.zeros(0),)


def nearest_other(ids, color, v, other_ids, other_color, w, held=NONE) -> tuple[np.ndarray, ...]:
    """(color, src, dst, squared distance): for each color the closest pair with another color, ties to the smaller ids.

    Pairs have one row in v and one in w, and count for the colors of both. held: what earlier blocks gave, which is
    the bound for what is looked at and taken up in the result.
    """
    sides = []
    for own, x, y in ((color, v, w), (other_color, w, v)):
        names, code = np.unique(own, return_inverse=True)
        best, at = np.full(len(names), np.inf), np.searchsorted(held[0], names)
        known = at < len(held[0])
        known[known] = held[0][at[known]] == names[known]
        best[known] = held[3][at[known]]  # the least upper bound of each color's distance
        sides.append((names, code, best, blocks.slack(x, y)))
    (names, code, best, off), (others, other_code, other_best, other_off) = sides
    size = lambda x: (x * x).sum(1)[:, None]
    left, right = np.hstack((-2 * v, size(v), np.ones((len(v), 1)))), np.hstack((w, np.ones((len(w), 1)), size(w))).T
    kept = [held]
    for at in range(0, len(v), STRIP):
        rough, own, own_off = left[at : at + STRIP] @ right, code[at : at + STRIP], off[at : at + STRIP]
        np.copyto(rough, np.inf, where=color[at : at + STRIP, None] == other_color)
        least, other_least = rough.min(1), rough.min(0)
        np.minimum.at(best, own, least + own_off)
        np.minimum.at(other_best, other_code, other_least + other_off)
        i = np.flatnonzero((least <= best[own] + own_off) & np.isfinite(least))
        x, y = np.nonzero(rough[i] <= np.minimum(best[own] + own_off, np.finfo(float).max)[i, None])
        j = np.flatnonzero((other_least <= other_best[other_code] + other_off) & np.isfinite(other_least))
        s, t = np.nonzero(rough[:, j] <= np.minimum(other_best[other_code] + other_off, np.finfo(float).max)[j])
        for row, column, back in ((i[x], y, False), (s, j[t], True)):
            for some in range(0, len(row), BATCH):
                m, n = at + row[some : some + BATCH], column[some : some + BATCH]
                d = blocks.squared(v[m], w[n])
                kept.append(_first(*((other_color[n], other_ids[n], ids[m], d) if back else (color[m], ids[m], other_ids[n], d))))
    return _first(*(np.concatenate(x) for x in zip(*kept, strict=True)))


def cross_component_nearest(data: DataFrame, colors: DataFrame, vector: str = "embedding") -> DataFrame:
    """(color, src, dst, distance): for each component its closest pair with another component.

    colors: (vec_id, color), whole numbers. Distances are squared Euclidean. Of a component's copies only the one with
    the least id can be in a result, so the others are left out first. Every two blocks of rows meet once, for the
    components of both, and a task gives a row for each component. A row whose vector is null or not finite is in no pair.
    """
    kind = colors.schema["color"].dataType
    rows = data.select("vec_id", F.col(vector).alias("v")).join(colors.select("vec_id", F.col("color").cast("long").alias("color")).filter("color is not null"), "vec_id")
    rows = rows.filter("v is not null").groupBy("color", "v").agg(F.min(F.col("vec_id").cast("long")).alias("vec_id"))
    packed = packed_blocks(spread(rows, "vec_id"), "vec_id", "v", ("ids", "vs", "colors"), BLOCK_ROWS, "color")
    packed = written(packed.withColumn("block", F.monotonically_increasing_id()), "color-blocks")
    a, b = F.col("block"), F.col("other_block")
    once = (a == b) | ((a < b) == (F.xxhash64(F.least(a, b), F.greatest(a, b)) % 2 == 0))
    pairs = packed.crossJoin(packed.select(*(F.col(c).alias(f"other_{c}") for c in packed.columns))).filter(once).drop("block", "other_block")

    def run(batches):
        held = NONE
        for ids, v, color, other_ids, w, other_color in block_pairs(batches, np.int64, 0, np.int64, np.int64, 3, np.int64):
            if v.shape[1] != w.shape[1]:
                raise ValueError("vectors of different dimension")
            fit, other_fit = np.isfinite(v).all(1), np.isfinite(w).all(1)
            if fit.any() and other_fit.any():
                held = nearest_other(ids[fit], color[fit], v[fit], other_ids[other_fit], other_color[other_fit], w[other_fit], held)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], ["color", "src", "dst", "distance"])

    best = F.min_by(F.struct("src", "dst", "distance"), F.struct("distance", "src", "dst"))
    found = pairs.mapInArrow(run, "color long, src long, dst long, distance double").groupBy("color").agg(best.alias("s"))
    return found.select(F.col("color").cast(kind), "s.src", "s.dst", "s.distance")


def sparse_top_k(data: DataFrame, queries: DataFrame, k: int, metric: str = "inner_product") -> DataFrame:
    """kNN over long-form sparse rows: data (vec_id, col_id, value), queries (query_id, col_id, value).

    Only columns that both sides have meet in the join. For the Euclidean and cosine metrics, rows
    without a common column take part through their norms; for the inner product theirs is 0, and they are looked
    at only for queries with fewer than k positive products. A row without any entry isn't in the long form.
    """
    metric = metric_name(metric)
    common = data.join(small(queries.withColumnRenamed("value", "q")), "col_id").groupBy("query_id", "vec_id").agg(F.sum(F.col("value").cast("double") * F.col("q").cast("double")).alias("dot"))
    if metric == "inner_product":
        common = written(common.withColumnRenamed("dot", "distance"), "sparse-common")
        asked, few = queries.select("query_id").distinct(), F.coalesce("positive", F.lit(0)) < k
        short = asked.join(common.filter("distance > 0").groupBy("query_id").agg(F.count("*").alias("positive")), "query_id", "left").filter(few).select("query_id")
        none = data.select("vec_id").distinct().crossJoin(small(short)).join(common, ["query_id", "vec_id"], "left_anti").select("query_id", "vec_id", F.lit(0.0).alias("distance"))
        return top_k(common.unionByName(none), k, select_min=False).select("query_id", "rank", "vec_id", "distance")
    size = lambda rows, key, name: rows.groupBy(key).agg(F.sum(F.col("value").cast("double") * F.col("value").cast("double")).alias(name))
    both = size(data, "vec_id", "vv").crossJoin(small(size(queries, "query_id", "qq"))).join(common, ["query_id", "vec_id"], "left").withColumn("dot", F.coalesce("dot", F.lit(0.0)))
    forms = {"l2_expanded": F.greatest(F.lit(0.0), F.col("vv") + F.col("qq") - 2 * F.col("dot")), "cosine": 1 - F.col("dot") / F.sqrt(F.col("vv") * F.col("qq"))}
    forms["l2_unexpanded"], forms["l2_sqrt_expanded"] = forms["l2_expanded"], F.sqrt(forms["l2_expanded"])
    if metric not in forms:
        raise ValueError(f"unsupported sparse metric: {metric}")
    return top_k(both.withColumn("distance", forms[metric]), k).select("query_id", "rank", "vec_id", "distance")


def sparse_pairwise(x: DataFrame, y: DataFrame, dim: int, metric: str, metric_arg: float = 2.0) -> DataFrame:
    """Distances of long-form sparse rows (x_id | y_id, col_id, value): rows become arrays of ``dim`` first."""
    def dense(rows, key, name):
        entries = rows.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("col_id", "value"))).alias("m"))
        return entries.select(key, F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at("m", i.cast("int")).cast("double"), F.lit(0.0))).alias(name))

    return pairwise(dense(x, "x_id", "x"), dense(y, "y_id", "y"), metric, metric_arg)


def ground_truth(data: DataFrame, queries: DataFrame, k: int, metric: str = "l2_expanded", subset: int | None = None) -> DataFrame:
    """Exact neighbours over all rows, or over the first ``subset`` ids."""
    return search(data if subset is None else data.filter(F.col("vec_id") < subset), queries, k, metric)
