"""Single-linkage clustering: a minimum spanning tree by rounds of nearest edges, then merges in order.

The tree's rounds are joins of an edge table or, for all pairs, searches in which every block of rows
meets every block and which keep a row per component: pairs are never stored. The tree's n - 1 edges, sorted, are merged by one union-find (the result of
single linkage is a sequence), which is why ``MAX_ROWS`` bounds the rows that can be clustered.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import distance, metric_name
from ..tables import written
from . import graph, knn

MAX_ROWS = 2_000_000


def distance_graph(data: DataFrame, linkage: str = "knn_graph", c: int = 15, metric: str = "l2_sqrt_expanded", vector: str = "embedding") -> DataFrame:
    """(src, dst, distance) with src < dst: all pairs, or those of each row's log2(n) + c neighbours."""
    if linkage == "pairwise":
        rows = data.select(F.col("vec_id").alias("src"), F.col(vector).alias("a"))
        pairs = rows.join(data.select(F.col("vec_id").alias("dst"), F.col(vector).alias("b")), F.col("src") < F.col("dst"))
        return pairs.select("src", "dst", distance(F.col("a"), F.col("b"), metric).alias("distance"))
    n = data.count()
    near = knn.knn_graph(data, max(1, min(n - 1, int(math.log(max(n, 2))) + c)), metric, vector)
    return near.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "distance").dropDuplicates(["src", "dst"])


def all_pairs_tree(data: DataFrame, metric: str = "l2_sqrt_expanded", vector: str = "embedding") -> DataFrame:
    """spanning_tree() over all pairs, for Euclidean distances.

    Rows with equal vectors are linked to the one with the least id, and only this one is searched for.
    """
    rows = written(data.select("vec_id", F.col(vector).alias("embedding")), "mst-rows")
    least = rows.groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    firsts = written(least.select(F.col("least").alias("vec_id"), "embedding", "copies"), "mst-firsts")
    copies = rows.join(firsts.filter("copies > 1").select("embedding", F.col("vec_id").alias("src")), "embedding").filter("vec_id != src")
    tree = written(copies.select("src", F.col("vec_id").alias("dst"), F.lit(0.0).alias("distance")), "mst-copies")
    d = F.sqrt("distance") if "sqrt" in metric else F.col("distance")
    colors = firsts.select("vec_id", F.col("vec_id").alias("color"))
    while True:
        near = knn.cross_component_nearest(firsts, colors)
        best = written(near.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), d.alias("distance")).distinct(), "mst-best")
        if best.isEmpty():
            return tree
        tree = tree.unionByName(best)
        ends = best.join(colors.select(F.col("vec_id").alias("src"), F.col("color").alias("a")), "src").join(colors.select(F.col("vec_id").alias("dst"), F.col("color").alias("b")), "dst")
        merged = graph.components(colors.select(F.col("color").alias("vec_id")).distinct(), ends.select(F.col("a").alias("src"), F.col("b").alias("dst")))
        colors = written(colors.join(merged.select(F.col("vec_id").alias("color"), "comp"), "color").select("vec_id", F.col("comp").alias("color")), "mst-colors")


def spanning_tree(data: DataFrame, edges: DataFrame | None, metric: str = "l2_sqrt_expanded", vector: str = "embedding") -> DataFrame:
    """(src, dst, distance) of a minimum spanning tree; components without an edge between them are bridged by their nearest rows. edges: None for all pairs."""
    if edges is None and metric_name(metric).startswith("l2"):
        return all_pairs_tree(data, metric_name(metric), vector)
    edges = distance_graph(data, "pairwise", metric=metric, vector=vector) if edges is None else edges
    nodes = written(data.select("vec_id"), "mst-nodes")
    edges = written(edges.select("src", "dst", "distance"), "mst-edges")
    comp = nodes.select("vec_id", F.col("vec_id").alias("comp"))
    tree = None
    while True:
        a = comp.select(F.col("vec_id").alias("src"), F.col("comp").alias("ca"))
        b = comp.select(F.col("vec_id").alias("dst"), F.col("comp").alias("cb"))
        open_ = edges.join(a, "src").join(b, "dst").filter("ca != cb")
        ends = open_.select(F.col("ca").alias("comp"), "src", "dst", "distance").unionByName(open_.select(F.col("cb").alias("comp"), "src", "dst", "distance"))
        best = ends.groupBy("comp").agg(F.min_by(F.struct("src", "dst", "distance"), F.struct("distance", "src", "dst")).alias("s")).select("s.*").distinct()
        best = written(best, "mst-best")
        if best.isEmpty():
            if comp.select("comp").distinct().count() <= 1:
                break
            bridges = knn.cross_component_nearest(data, comp.withColumnRenamed("comp", "color"), vector)
            d = F.sqrt("distance") if "sqrt" in metric else F.col("distance")
            more = bridges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), d.alias("distance"))
            edges = written(edges.unionByName(more).dropDuplicates(["src", "dst"]), "mst-edges")
            continue
        tree = best if tree is None else tree.unionByName(best)
        comp = graph.components(nodes, tree)
    return tree if tree is not None else edges.limit(0)


def dendrogram(tree: DataFrame, nodes: DataFrame) -> tuple[DataFrame, dict[int, int], list]:
    """(merge_id, left, right, delta, size), with leaves numbered by id order and merge i making cluster n + i."""
    if nodes.count() > MAX_ROWS:
        raise ValueError("too many rows for single linkage")
    ids = [r[0] for r in nodes.select("vec_id").orderBy("vec_id").collect()]
    place = {v: i for i, v in enumerate(ids)}
    n = len(ids)
    parent, size, merges = list(range(2 * n)), [1] * n + [0] * n, []

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for src, dst, d in sorted(((r["src"], r["dst"], r["distance"]) for r in tree.collect()), key=lambda e: (e[2], e[0], e[1])):
        left, right = find(place[src]), find(place[dst])
        if left == right:
            continue
        new = n + len(merges)
        parent[left] = parent[right] = new
        size[new] = size[left] + size[right]
        merges.append((len(merges), left, right, float(d), size[new]))
    frame = nodes.sparkSession.createDataFrame(merges, "merge_id int, left int, right int, delta double, size int")
    return frame, place, merges


def flat_labels(place: dict[int, int], merges: list, n_clusters: int) -> list[tuple[int, int]]:
    """(id, label) after all but the last n_clusters - 1 merges; labels in order of the smallest id."""
    n = len(place)
    parent = list(range(n + len(merges)))

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for i, left, right, *_ in merges[: max(0, n - n_clusters)]:
        parent[left] = parent[right] = n + i
    names: dict[int, int] = {}
    return [(v, names.setdefault(find(i), len(names))) for v, i in sorted(place.items())]


def single_linkage(data: DataFrame, n_clusters: int, linkage: str = "knn_graph", c: int = 15, metric: str = "l2_sqrt_expanded", vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(vec_id, label) and the dendrogram."""
    tree = written(spanning_tree(data, None if linkage == "pairwise" else distance_graph(data, linkage, c, metric, vector), metric, vector), "mst")
    frame, place, merges = dendrogram(tree, data.select("vec_id"))
    return data.sparkSession.createDataFrame(flat_labels(place, merges, n_clusters), "vec_id long, label int"), frame
