"""Neighbour graphs: building, pruning, connecting, searching and extending them.

A graph is an edge table (src, rank, dst, distance); per-label graphs have a label column before
it. All steps are joins and per-source top-k; nothing collects a graph to the driver but the links of
components, up to a fixed number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import blocks
from ..functions.metrics import distance, is_min_close
from ..tables import small, written
from . import knn
from .topk import top_k

#: Links whose components are found on the driver.
LINKS = 500_000
#: Of the hash by which a search chooses its first rows.
SEED = 20_011


def nn_descent(data: DataFrame, k: int, intermediate: int | None = None, iterations: int = 20, termination: float = 1e-4, metric: str = "l2_expanded", vector: str = "embedding", sample: int | None = None, seed: int = 1234) -> DataFrame:
    """Approximate neighbour graph: lists start with rows of a few random buckets, then neighbours of neighbours compete.

    In each round the rows of every list, both directions, meet each other where the list's row is; it ends when
    fewer than ``termination`` of all list places change.
    """
    wide = intermediate or max(2 * k, k + 8)
    rows = written(data.select("vec_id", F.col(vector).alias("v")), "descent-rows")
    n = rows.count()
    wide = min(wide, n - 1)
    if wide < 1:
        return rows.select(F.col("vec_id").alias("src"), F.lit(1).alias("rank"), F.col("vec_id").alias("dst"), F.lit(0.0).alias("distance")).limit(0)

    def best(edges: DataFrame, size: int) -> DataFrame:
        return top_k(edges, size, "src", id_="dst", select_min=is_min_close(metric)).select("src", "rank", "dst", "distance")

    # buckets of about wide + 1 rows by two hashes
    starts = None
    for turn in range(2):
        bucket = F.pmod(F.xxhash64("vec_id", F.lit(seed + turn)), F.lit(max(1, n // (wide + 1))))
        own = rows.select((2 * bucket + turn).alias("pivot"), "vec_id")
        starts = own if starts is None else starts.union(own)
    ends = rows.select("vec_id", "v", F.lit(None).cast("double").alias("bar"))
    lists = written(best(_compete(starts, ends, wide, metric).dropDuplicates(["src", "dst"]), wide), "descent-lists")
    for _ in range(iterations):
        out = lists.select("src", "dst")
        around = out.union(out.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
        limit = sample or wide
        order = Window.partitionBy("src").orderBy(F.xxhash64("dst", F.lit(seed)))
        around = around.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= 2 * limit)
        around = around.select(F.col("src").alias("pivot"), F.col("dst").alias("vec_id")).union(rows.select(F.col("vec_id").alias("pivot"), "vec_id"))
        bars = lists.filter(F.col("rank") == wide).select(F.col("src").alias("vec_id"), F.col("distance").alias("bar"))
        fresh = _compete(around, rows.join(bars, "vec_id", "left"), wide, metric)
        new = written(best(lists.select("src", "dst", "distance").unionByName(fresh).dropDuplicates(["src", "dst"]), wide), "descent-lists")
        changed = new.select("src", "dst").join(out, ["src", "dst"], "left_anti").count()
        lists = new
        if changed <= termination * n * wide:
            break
    return lists.filter(F.col("rank") <= k)


def _compete(groups: DataFrame, rows: DataFrame, k: int, metric: str) -> DataFrame:
    """(src, dst, distance): the rows (vec_id) of each group (pivot) that are no farther from another than its bar; of each task at most k a row.

    rows: (vec_id, v, bar), bar null where all rows are wanted. A group's rows are in one task; pairs may repeat in other tasks.
    """
    near = is_min_close(metric)
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * rows.sparkSession.sparkContext.defaultParallelism)
    members = groups.join(rows, "vec_id").select("pivot", F.col("vec_id").cast("long"), "v", F.col("bar").cast("double"))
    members = members.repartition(parts, "pivot").sortWithinPartitions("pivot")

    def cut(held):
        src, dst, d = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.lexsort((dst, d if near else -d, src))
        src, dst, d = src[order], dst[order], d[order]
        once = np.append(True, (src[1:] != src[:-1]) | (dst[1:] != dst[:-1]))[: len(src)]
        return knn._cut((src[once], dst[once], d[once]), k, metric)

    def run(batches):
        held, size, rest = [], 0, None

        def groups_of(table):
            pivot = table.column(0).to_numpy()
            heads = np.flatnonzero(np.append(True, pivot[1:] != pivot[:-1]))
            return heads, np.append(heads[1:], len(pivot))

        def met(ids, v, bar):
            d = blocks.matrix(v, v, metric)
            ok = ~np.isnan(d) & ((d <= bar[:, None]) if near else (d >= bar[:, None])) & (ids[:, None] != ids)
            a, b = np.nonzero(ok)
            return ids[a], ids[b], d[a, b]

        for batch in batches_with_end(batches):
            table = rest if batch is None else pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            if table is None or not table.num_rows:
                continue
            table = table.combine_chunks()
            heads, ends = groups_of(table)
            done = len(heads) if batch is None else len(heads) - 1
            if done:
                ids, v = table.column(1).to_numpy(), knn._matrix(table.column(2))
                bar = table.column(3).to_numpy(zero_copy_only=False)
                bar = np.where(np.isnan(bar), np.inf if near else -np.inf, bar)
            for x, y in zip(heads[:done].tolist(), ends[:done].tolist(), strict=True):
                held.append(met(ids[x:y], v[x:y], bar[x:y]))
                size += len(held[-1][0])
                if size > 2_000_000:
                    held = [cut(held)]
                    size = len(held[0][0])
            rest = None if batch is None else table.slice(heads[-1])
        if held:
            src, dst, d = cut(held)
            for x in range(0, len(src), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(c[x : x + (1 << 16)]) for c in (src, dst, d)], ["src", "dst", "distance"])

    return members.mapInArrow(run, "src long, dst long, distance double")


def batches_with_end(batches):
    yield from batches
    yield None


def optimize(edges: DataFrame, degree: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Prune to ``degree``: edges with the fewest two-hop detours through shorter edges stay, the first half of them for certain; free places go to reverse edges.

    A detour of A to B is A to D to B with rank(A, D) < rank(A, B) and D in A's list.
    keys: columns that separate graphs (a label).
    """
    edges = edges.select(*keys, "src", "rank", "dst", "distance")
    first = edges.select(*keys, "src", F.col("rank").alias("rank_d"), F.col("dst").alias("via"))
    second = edges.select(*keys, F.col("src").alias("via"), "dst")
    through = first.join(second, [*keys, "via"])
    detours = edges.join(through, [*keys, "src", "dst"]).filter(F.col("rank_d") < F.col("rank")).groupBy(*keys, "src", "dst").agg(F.count("*").alias("detours"))
    counted = edges.join(detours, [*keys, "src", "dst"], "left").withColumn("detours", F.coalesce("detours", F.lit(0)))
    place = F.row_number().over(Window.partitionBy(*keys, "src").orderBy("detours", "rank"))
    pruned = counted.withColumn("place", place).filter(F.col("place") <= degree)
    half = degree // 2
    fixed = pruned.filter(F.col("place") <= half).select(*keys, "src", "dst", F.lit(0).alias("kind"), "place", "distance")
    rest = pruned.filter(F.col("place") > half).select(*keys, "src", "dst", F.lit(2).alias("kind"), "place", "distance")
    back = pruned.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).alias("kind"), "place", "distance")
    back = back.withColumn("r", F.row_number().over(Window.partitionBy(*keys, "src").orderBy("place", "dst"))).filter(F.col("r") <= degree - half).drop("r")
    every = fixed.unionByName(back).unionByName(rest)
    once = every.groupBy(*keys, "src", "dst").agg(F.min(F.struct("kind", "place", "distance")).alias("s")).select(*keys, "src", "dst", "s.*")
    final = F.row_number().over(Window.partitionBy(*keys, "src").orderBy("kind", "place", "dst"))
    return once.withColumn("rank", final).filter(F.col("rank") <= degree).select(*keys, "src", "rank", "dst", "distance")


def build(data: DataFrame, degree: int = 64, intermediate: int = 128, algorithm: str = "auto", metric: str = "l2_expanded", connect: bool = False, vector: str = "embedding", exact_rows: int = 50_000) -> DataFrame:
    """Optimised graph over an exact neighbour graph (few rows), one by descent, or one by inverted lists."""
    n = data.count()
    intermediate = min(intermediate, max(n - 1, 0))
    degree = min(degree, intermediate)
    if algorithm == "auto":
        algorithm = "exact" if n <= exact_rows else "nn_descent"
    if algorithm == "exact":
        lists = knn.knn_graph(data, intermediate, metric, vector)
    elif algorithm == "nn_descent":
        lists = nn_descent(data, intermediate, metric=metric, vector=vector)
    elif algorithm == "ivf_pq":
        from .ivf import IvfPq

        lists = IvfPq.build(data, max(1, round(n**0.5)), metric=metric, vector=vector).graph(data, intermediate, vector)
    else:
        raise ValueError(f"unknown algorithm: {algorithm}")
    edges = written(optimize(written(lists, "graph-lists"), degree), "graph")
    return connected(data, edges, vector) if connect else edges


def united(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, least id that each reaches) of the ids in links, by passing minima along links and jumping ahead."""
    ids, place = np.unique(np.concatenate([src, dst]), return_inverse=True)
    a, b = place[: len(src)], place[len(src) :]
    comp = np.arange(len(ids))
    while len(a):
        low = np.minimum(comp[a], comp[b])
        new = comp.copy()
        for end in (comp[a], comp[b]):  # whole components take the lesser name
            np.minimum.at(new, end, low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        new = new[comp]
        a, b = a[new[a] != new[b]], b[new[a] != new[b]]
        comp = new
    return ids, ids[comp]


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(vec_id, comp): the least id that links (src, dst) reach. Up to ``LINKS`` links are united on the driver (16 bytes each), more by joins."""
    links = written(links.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).filter("src != dst"), "links")
    if links.count() <= LINKS:
        table = links.toArrow()
        found = dict(zip(("vec_id", "comp"), united(*(table.column(c).to_numpy() for c in ("src", "dst"))), strict=True))
        named = nodes.sparkSession.createDataFrame(pa.table(found), "vec_id long, comp long") if links.count() else None
        if named is None:
            return nodes.select("vec_id", F.col("vec_id").alias("comp"))
        return written(nodes.select("vec_id").join(named, "vec_id", "left").select("vec_id", F.coalesce("comp", "vec_id").alias("comp")), "comp")
    both = written(links.select("src", "dst").union(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "comp-links")
    comp = written(nodes.select("vec_id", F.col("vec_id").alias("comp")), "comp")
    while True:
        near = both.join(comp, F.col("dst") == F.col("vec_id")).groupBy(F.col("src").alias("vec_id")).agg(F.min("comp").alias("near"))
        moved = comp.join(near, "vec_id", "left").select("vec_id", F.col("comp").alias("old"), F.least("comp", "near").alias("mid"))
        ahead = comp.select(F.col("vec_id").alias("mid"), F.col("comp").alias("next"))
        new = written(moved.join(ahead, "mid").select("vec_id", F.col("next").alias("comp"), (F.col("next") != F.col("old")).alias("moved")), "comp")
        comp = new.select("vec_id", "comp")
        if new.filter("moved").isEmpty():
            return comp


def connected(data: DataFrame, edges: DataFrame, vector: str = "embedding") -> DataFrame:
    """``edges`` with bridges between the nearest rows of its components, until there is one component."""
    while True:
        colors = written(components(data.select("vec_id"), edges).withColumnRenamed("comp", "color"), "colors")
        if colors.select("color").distinct().count() <= 1:
            return edges
        bridge = written(knn.cross_component_nearest(data, colors, vector).select("src", "dst", "distance"), "bridges")
        both = bridge.unionByName(bridge.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "distance")).distinct()
        after = edges.groupBy("src").agg(F.max("rank").alias("last"))
        place = F.row_number().over(Window.partitionBy("src").orderBy("distance", "dst"))
        more = both.join(edges.select("src", "dst"), ["src", "dst"], "left_anti").withColumn("r", place).join(after, "src", "left")
        edges = written(edges.unionByName(more.select("src", (F.coalesce("last", F.lit(0)) + F.col("r")).cast("int").alias("rank"), "dst", "distance")), "graph")


def iterations_for(itopk: int, width: int) -> int:
    """Rounds of a beam search: 1 + min(1.1 w, w + 10) with w = itopk / width."""
    w = itopk / width
    return int(1 + min(w * 1.1, w + 10))


def _beam(rows: DataFrame, edges: DataFrame, queries: DataFrame, k: int, itopk: int, width: int, max_iterations: int | None, seeds: int, metric: str, keys: tuple[str, ...], allowed: DataFrame | None) -> DataFrame:
    """rows (keys, vec_id, v), edges (keys, src, dst), queries (keys, query_id, q)."""
    if k > itopk:
        raise ValueError("k must be at most itopk")
    near = is_min_close(metric)
    scored = lambda c: c.select(*keys, "query_id", "vec_id", distance(F.col("q"), F.col("v"), metric).alias("distance"))
    # seeds: the rows of each graph that come first by a hash
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64("vec_id", F.lit(SEED)), "vec_id")) if keys else None
    first = rows.withColumn("place", place).filter(F.col("place") <= seeds).drop("place") if keys else rows.orderBy(F.xxhash64("vec_id", F.lit(SEED)), "vec_id").limit(seeds)
    start = first.join(small(queries), list(keys)) if keys else first.crossJoin(small(queries))
    beam = written(top_k(scored(start), itopk, select_min=near).withColumn("open", F.lit(True)), "beam")
    seen = beam.select("query_id", "vec_id")
    for _ in range(max_iterations or iterations_for(itopk, width)):
        order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("distance").asc() if near else F.col("distance").desc(), "vec_id"))
        parents = written(beam.filter("open").withColumn("r", order).filter(F.col("r") <= width).select(*keys, "query_id", F.col("vec_id").alias("src")), "beam-parents")
        if parents.isEmpty():
            break
        children = edges.join(small(parents), [*keys, "src"]).select(*keys, "query_id", F.col("dst").alias("vec_id")).distinct().join(seen, ["query_id", "vec_id"], "left_anti")
        fresh = written(scored(rows.join(small(children), [*keys, "vec_id"]).join(small(queries), [*keys, "query_id"])).withColumn("open", F.lit(True)), "beam-new")
        closed = beam.drop("rank").join(parents.select("query_id", F.col("src").alias("vec_id"), F.lit(True).alias("done")), ["query_id", "vec_id"], "left")
        closed = closed.withColumn("open", F.col("open") & F.col("done").isNull()).select(*keys, "query_id", "vec_id", "distance", "open")
        beam = written(top_k(closed.unionByName(fresh), itopk, select_min=near), "beam")
        seen = written(seen.unionByName(fresh.select("query_id", "vec_id")), "beam-seen")
    found = beam if allowed is None else beam.join(allowed, "vec_id", "left_semi")
    return top_k(found.select("query_id", "vec_id", "distance"), k, select_min=near).select("query_id", "rank", "vec_id", "distance")


def search(data: DataFrame, edges: DataFrame, queries: DataFrame, k: int, itopk: int = 64, width: int = 4, max_iterations: int | None = None, seeds: int = 128, metric: str = "l2_expanded", vector: str = "embedding", allowed: DataFrame | None = None) -> DataFrame:
    """Beam search: the open rows of each query's beam that are closest are expanded, until none is open or the rounds are over.

    allowed: rows that may be found (the beam passes through the others). Children are looked up by
    joins on the source, so each round reads only the beams' edges and rows.
    """
    rows = data.select("vec_id", F.col(vector).alias("v"))
    return _beam(rows, edges.select("src", "dst"), queries.select("query_id", "q"), k, itopk, width, max_iterations, max(seeds, itopk), metric, (), None if allowed is None else allowed.select("vec_id"))


def label_graphs(rows: DataFrame, degree: int) -> DataFrame:
    """One optimised graph per label over rows (label, vec_id, v): blocks of a label's rows meet each other."""
    pairs = rows.dropDuplicates(["label", "vec_id"])
    lists = knn.lists_by_label(pairs, 2 * degree)
    return optimize(written(lists, "label-lists"), degree, ("label",))


def label_beam_search(rows: DataFrame, edges: DataFrame, queries: DataFrame, k: int, itopk: int, width: int = 4) -> DataFrame:
    """Beam search of each query in the graph of its label."""
    asked = queries.select(F.col("query_label").alias("label"), "query_id", "q")
    return _beam(rows.select("label", "vec_id", "v").dropDuplicates(["label", "vec_id"]), edges.select("label", "src", "dst"), asked, k, itopk, width, None, max(itopk, 32), "l2_expanded", ("label",), None)


def extend(data: DataFrame, edges: DataFrame, fresh: DataFrame, degree: int, metric: str = "l2_expanded", vector: str = "embedding") -> DataFrame:
    """Graph with new rows: each gets its nearest old and new rows, and those link back, the worst edges making way."""
    every = data.select("vec_id", F.col(vector).alias("embedding")).unionByName(fresh.select("vec_id", F.col(vector).alias("embedding")))
    queries = fresh.select(F.col("vec_id").alias("query_id"), F.col(vector).alias("q"))
    near = knn.search(every, queries, degree + 1, metric).filter("query_id != vec_id")
    out = top_k(near.drop("rank").select(F.col("query_id").alias("src"), F.col("vec_id").alias("dst"), "distance"), degree, "src", id_="dst", select_min=is_min_close(metric))
    out = written(out.select("src", "rank", "dst", "distance"), "extend")
    back = out.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "distance").join(queries.select(F.col("query_id").alias("src")), "src", "left_anti")
    room = max(1, degree // 2)
    back = top_k(back, room, "src", id_="dst", select_min=is_min_close(metric)).withColumn("fresh", F.lit(0))
    old = edges.select("src", "rank", "dst", "distance").withColumn("fresh", F.lit(1))
    touched = back.select("src").distinct()
    kept = old.join(touched, "src", "left_anti").drop("fresh")
    mixed = old.join(touched, "src", "left_semi").unionByName(back).dropDuplicates(["src", "dst"])
    place = F.row_number().over(Window.partitionBy("src").orderBy("fresh", "rank", "dst"))
    mixed = mixed.withColumn("rank", place).filter(F.col("rank") <= degree).drop("fresh")
    return kept.unionByName(mixed.select("src", "rank", "dst", "distance")).unionByName(out)


def robust_prune(candidates: DataFrame, data: DataFrame, degree: int, alpha: float = 1.2, vector: str = "embedding") -> DataFrame:
    """From candidates (src, dst, distance): repeatedly keep the closest, and drop those that are alpha times closer to it than to src.

    One round per kept edge, all sources at once.
    """
    rows = data.select("vec_id", F.col(vector).alias("v"))
    left = written(candidates.filter("src != dst").dropDuplicates(["src", "dst"]).select("src", "dst", "distance"), "prune")
    kept = None
    for rank in range(1, degree + 1):
        star = left.groupBy("src").agg(F.min_by(F.struct("dst", "distance"), F.struct("distance", "dst")).alias("s")).select("src", F.col("s.dst").alias("star"), F.col("s.distance").alias("distance"))
        star = written(star, "prune-star")
        if star.isEmpty():
            break
        one = star.select("src", F.lit(rank).alias("rank"), F.col("star").alias("dst"), "distance")
        kept = one if kept is None else kept.unionByName(one)
        both = left.join(star.select("src", "star"), "src").filter("dst != star")
        both = both.join(rows.select(F.col("vec_id").alias("dst"), F.col("v").alias("a")), "dst").join(rows.select(F.col("vec_id").alias("star"), F.col("v").alias("b")), "star")
        left = written(both.filter(alpha * distance(F.col("a"), F.col("b"), "l2_expanded") > F.col("distance")).select("src", "dst", "distance"), "prune")
    return kept if kept is not None else left.select("src", F.lit(1).alias("rank"), "dst", "distance")


def vamana(data: DataFrame, degree: int = 32, visited: int = 64, alpha: float = 1.2, vector: str = "embedding") -> DataFrame:
    """Pruned graph: nearest ``visited`` rows of each row, pruned; reverse edges added and pruned again."""
    n = data.count()
    lists = written(knn.knn_graph(data, min(visited, max(n - 1, 1)), vector=vector), "vamana-lists")
    edges = written(robust_prune(lists, data, degree, alpha, vector), "vamana")
    both = edges.select("src", "dst", "distance").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "distance"))
    return robust_prune(both, data, degree, alpha, vector)


def adjacency(edges: DataFrame) -> DataFrame:
    """Array form, for export: (src, neighbours in rank order)."""
    return edges.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("rank", "dst"))).alias("s")).select("src", F.col("s.dst").alias("neighbours"))
