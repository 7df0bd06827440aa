"""Searches and matrices by blocks: the values of the definitions, and no pair by pair evaluation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.functions import blocks, metrics
from nearfield.operators import graph, knn, label_index, linkage, sharded, spectral, stats

BINARY = ("hamming", "russellrao", "jaccard", "dice")
SHARES = ("hellinger", "kl_divergence", "jensenshannon")


def vectors(spark, n, dim, seed=0):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, dim)).astype(np.float32)
    x[n // 2 : n // 2 + n // 10] = x[3]  # copies
    return x, spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id long, embedding array<float>")


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["cosine", "jaccard", "jensenshannon", "correlation", "kl_divergence", "l1", "linf", "l2_expanded", "l2_sqrt_unexpanded", "inner_product", "canberra", "lp", "hamming", "russellrao", "hellinger", "dice"])
def test_matrix_of_distances(spark, monkeypatch, name):
    monkeypatch.setattr(blocks, "TILE", (3, 5))
    monkeypatch.setattr(knn, "BATCH", 7)
    r = np.random.default_rng(1)
    x = np.abs(r.normal(size=(11, 9)))
    x[1, :4], x[2] = 0, 0
    x[5] = x[4]
    if name in BINARY:
        x = (x > 0.5).astype(float)
    if name in SHARES:
        x[x.sum(1) > 0] /= x[x.sum(1) > 0].sum(1, keepdims=True)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "x_id int, x array<double>")
    got = knn.pairwise(rows, rows.select(F.col("x_id").cast("long").alias("y_id"), F.col("x").alias("y")), name, 3.0)
    assert "zip_with" not in plan(got) and got.dtypes == [("x_id", "int"), ("y_id", "bigint"), ("distance", "double")]
    want = rows.crossJoin(rows.toDF("y_id", "y")).select("x_id", "y_id", metrics.distance(F.col("x"), F.col("y"), name, 3.0).alias("d"))
    got, want = ({(a, b): d for a, b, d in rows.collect()} for rows in (got, want))
    assert len(got) == 121 and {p for p in got if got[p] is None} == {p for p in want if want[p] is None}
    for p in got:
        assert got[p] is None or got[p] == pytest.approx(want[p], abs=2e-8), p


@pytest.mark.parametrize("spread_", [1.0, 4.0])
def test_rounded_jensenshannon(monkeypatch, spread_):
    """Every rounded value is that of the definition, and few pairs take a logarithm for each element."""
    r = np.random.default_rng(3)
    x = np.abs(r.normal(size=(300, 64))) ** spread_
    x[4, 3:], x[5], x[6, :9], x[7] = 0, x[8], 0, x[8] * (1 + 1e-9)
    x /= x.sum(1, keepdims=True)
    x[9] = 0
    want = blocks.rounded(blocks.matrix(x[:100], x, "jensenshannon"), 6)
    taken, log = [], blocks._log
    monkeypatch.setattr(blocks, "_log", lambda s: taken.append(s.size) or log(s))
    got = np.vstack(list(blocks.rounded_strips("jensenshannon", 2.0, 6)(x[:100], x, 37)))
    assert np.array_equal(got, want) and got[5, 8] == 0 and sum(taken) < 0.25 * 100 * x.size
    assert np.array_equal(np.vstack(list(blocks.rounded_strips("jensenshannon")(x[:2], x, 1))), blocks.matrix(x[:2], x, "jensenshannon"))
    a, b = r.random((2, 4000)) ** 9  # elements of all sizes, alone: the error stated is that found
    left, right = (blocks._factors(v[:, None], 1.0) for v in (a, b))
    assert np.abs((left * blocks._split()[1] * right).sum(1) - blocks._mixture(a, b)).max() < blocks.SPLIT[3]


@pytest.mark.parametrize("name", blocks.PRODUCTS)
def test_strips_of_products(monkeypatch, name):
    """What depends on y alone is made once for the blocks that meet it; odd rows give what matrix() gives."""
    r = np.random.default_rng(6)
    x = np.abs(r.normal(size=(70, 9)))
    x[3], x[4], x[5, 2] = 0, 0.25, np.nan
    if name in BINARY:
        x = (x > 0.5).astype(float)
    made, product = [], blocks._product
    monkeypatch.setattr(blocks, "_product", lambda *a: made.append(1) or product(*a))
    strips = blocks.rounded_strips(name, 2.0, 6)
    got = np.vstack([d for top in (0, 40) for d in strips(x[top : top + 40], x[:50], 33)])
    assert len(made) == 1
    assert np.allclose(got, blocks.rounded(blocks.matrix(x, x[:50], name), 6), rtol=0, atol=1.01e-6, equal_nan=True)
    again = np.vstack(list(strips(x[:9], x[50:], 33)))
    assert np.allclose(again, blocks.rounded(blocks.matrix(x[:9], x[50:], name), 6), rtol=0, atol=1.01e-6, equal_nan=True)


def test_rounding():
    x = np.array([0.0000005, -0.0000005, 1.0000004, -0.0000001, np.nan, np.inf, 2.5])
    got = blocks.rounded(x, 6)
    halves = np.array([0.5, 1.5, 2.5, -0.5, -1.5, 0.49999999999999994, 2.0**52 + 1, -(2.0**53)])
    assert np.array_equal(blocks.rounded(halves, 0), [1, 2, 3, -1, -2, 0, 2.0**52 + 1, -(2.0**53)])
    assert np.array_equal(got, [0.000001, -0.000001, 1.0, 0.0, np.nan, np.inf, 2.5], equal_nan=True) and not np.signbit(got[3])


@pytest.mark.parametrize("queries", [7, 4096])
def test_l1_search(spark, monkeypatch, queries):
    monkeypatch.setattr(knn, "QUERIES", queries)
    x, data = vectors(spark, 120, 6)
    asked = data.filter("vec_id % 4 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    found = knn.search(data, asked, 5, "l1")
    assert "zip_with" not in plan(found)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.distance) for r in found.collect()}
    for q in range(0, 120, 4):
        d = np.abs(x.astype(float) - x[q].astype(float)).sum(1)
        for rank, i in enumerate(np.lexsort((np.arange(120), d))[:5], 1):
            assert got[q, rank] == (i, pytest.approx(d[i]))
    assert len(got) == 150


@pytest.mark.parametrize("scale", [1.0, 1e-30, 1e-42, 1e39, 1e300])
def test_l1_in_single_precision(monkeypatch, scale):
    """Chosen by sums in single precision, with the distances, ties and order of double precision: near copies that differ in the last place, copies, a mask, a row that isn't finite."""
    r = np.random.default_rng(5)
    x = r.normal(size=(90, 7))
    x[10:40] = x[3] * (1 + 1e-12 * r.integers(0, 9, (30, 7)))
    x[50:60] = x[4]
    x, ids = x * scale, r.permutation(90)
    keep = r.random((20, 90)) < 0.5
    matrix, whole = blocks.matrix, []
    want = matrix(x[:20], x, "l1")
    monkeypatch.setattr(blocks, "matrix", lambda *a: whole.append(1) or matrix(*a))
    for k in (1, 5, 90):
        for mask in (None, keep):
            row, column, d = blocks.closest_l1(x[:20], x, ids, k, mask)
            masked = want if mask is None else np.where(mask, want, np.nan)
            for i in range(20):
                best = [j for j in np.lexsort((ids, masked[i])) if not np.isnan(masked[i, j])][:k]
                assert list(column[row == i]) == best and np.array_equal(d[row == i], want[i, best])
    assert scale <= 1e38 or whole
    spread = r.normal(size=(90, 64))
    whole.clear()
    assert len(blocks.closest_l1(spread[:20], spread, ids, 5)[0]) == 100 and not whole
    x[70] = np.nan
    row, column, d = blocks.closest_l1(x[:20], x, ids, 90)
    assert len(row) == 20 * 89 and 70 not in column and whole


def test_closest_pairs_of_components(spark, monkeypatch):
    monkeypatch.setattr(knn, "BLOCK_ROWS", 13)
    x, data = vectors(spark, 90, 4)
    colors = data.select("vec_id", F.when(F.col("vec_id") != 80, F.col("vec_id") % 7).cast("int").alias("color"))
    near = knn.cross_component_nearest(data, colors)
    assert "zip_with" not in plan(near) and dict(near.dtypes)["color"] == "int"
    d = ((x[:, None].astype(float) - x[None].astype(float)) ** 2).sum(2)
    for r in near.collect():
        want = min((d[i, j], i, j) for i in range(90) for j in range(90) if i % 7 == r.color and j % 7 != r.color and 80 not in (i, j))
        assert (r.src, r.dst) == want[1:] and r.distance == pytest.approx(want[0])
    assert near.count() == 7


def test_closest_pairs_among_copies(spark, monkeypatch):
    """A component's copies are one row, and every two blocks meet once; a vector that isn't finite hides no other."""
    monkeypatch.setattr(knn, "BLOCK_ROWS", 13)
    met = spark.sparkContext.accumulator(0)
    nearest_other = knn.nearest_other

    def counted(ids, color, v, *other):
        met.add(len(ids) * len(other[0]))
        return nearest_other(ids, color, v, *other)

    monkeypatch.setattr(knn, "nearest_other", counted)
    x = np.random.default_rng(2).integers(0, 3, (160, 4)).astype(float)
    x[20:120] = x[5]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(200, [float("nan")] * 4)]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    near = knn.cross_component_nearest(data, data.select("vec_id", (F.col("vec_id") % 4).alias("color"))).collect()
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    for r in near:
        want = min((d[i, j], i, j) for i in range(160) for j in range(160) if i % 4 == r.color and j % 4 != r.color)
        assert (r.distance, r.src, r.dst) == want
    assert len(near) == 4
    firsts = len({(i % 4, *v) for i, v in enumerate(x)})
    assert 0 < met.value < 0.75 * firsts * firsts and firsts < 80


def kruskal(x):
    d = np.sqrt(((x[:, None].astype(float) - x[None].astype(float)) ** 2).sum(2))
    parent, out = list(range(len(x))), []

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for w, i, j in sorted((d[i, j], i, j) for i in range(len(x)) for j in range(i + 1, len(x))):
        if find(i) != find(j):
            parent[find(i)] = find(j)
            out.append((i, j, w))
    return sorted(out)


@pytest.mark.parametrize("links", [0, 500_000])
def test_tree_of_all_pairs(spark, monkeypatch, links):
    """With copies, and without an edge table of all pairs."""
    monkeypatch.setattr(graph, "LINKS", links)
    monkeypatch.setattr(linkage, "distance_graph", None)
    x, data = vectors(spark, 60, 5)
    got = sorted((r.src, r.dst, r.distance) for r in linkage.spanning_tree(data, None).collect())
    want = kruskal(x)
    assert [e[:2] for e in got] == [e[:2] for e in want] and [e[2] for e in got] == pytest.approx([e[2] for e in want], abs=1e-6)
    labels, merges = linkage.single_linkage(data, 3, "pairwise")
    assert labels.count() == 60 and [r.delta for r in merges.orderBy("merge_id").collect()] == pytest.approx(sorted(e[2] for e in want), abs=1e-6)


def test_components_of_few_links_take_few_rounds(spark, monkeypatch):
    """A path of 300 rows, as links and by joins."""
    nodes = spark.range(302).withColumnRenamed("id", "vec_id")
    links = spark.createDataFrame([(i, i + 1) for i in range(300)][::-1], "src long, dst long")
    calls = []
    monkeypatch.setattr(graph, "written", lambda df, name, by=None: calls.append(name) or df)
    got = {r.vec_id: r.comp for r in graph.components(nodes, links).collect()}
    assert got == {i: 0 if i <= 300 else 301 for i in range(302)} and len(calls) <= 2


def test_ranks_of_neighbours(spark, monkeypatch):
    monkeypatch.setattr(knn, "BLOCK_ROWS", 17)
    x, data = vectors(spark, 70, 6)
    embedded = data.select("vec_id", F.slice("embedding", 1, 2).alias("embedding"))
    pairs = knn.knn_graph(embedded, 4).select(F.col("src").alias("i"), F.col("dst").alias("j"))
    found = stats.ranks_of(data, pairs, root=True)
    d = np.sqrt(((x[:, None].astype(float) - x[None].astype(float)) ** 2).sum(2))
    order = {i: {j: r for r, j in enumerate((j for j in np.lexsort((np.arange(70), d[i])) if j != i), 1)} for i in range(70)}
    got = {(r.i, r.j): r["rank"] for r in found.collect()}
    assert len(got) == 280 and all(order[i][j] == rank for (i, j), rank in got.items())
    over = sum(max(0, rank - 4) for rank in got.values())
    score = stats.trustworthiness(data, embedded, 4)
    assert "Window" not in plan(score).split("Physical Plan")[0].split("rank-asked")[-1]
    assert score.first()[0] == pytest.approx(1 - 2 / (70 * 4 * (140 - 12 - 1)) * over)


def without_edges(shards):
    empty = F.udf(lambda ids, edges: np.full(len(edges) // 4, -1, np.int32).tobytes(), "binary")
    return shards.withColumn("edges", empty("ids", "edges"))


def test_checked_search_is_exact(spark):
    """Also where the beam misses rows, or finds fewer than k."""
    x, data = vectors(spark, 300, 8)
    rows = data.select(F.lit(4).alias("label"), "vec_id", F.col("embedding").alias("v"))
    asked = data.filter("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), F.lit(4).alias("label"))
    shards = without_edges(sharded.pack(rows, 8))
    poor = sharded.search(shards, asked, 5, 5)
    truth = {(r.query_id, r["rank"]): r.vec_id for r in knn.search(data, asked, 5).collect()}
    assert stats.recall(poor, knn.search(data, asked, 5)).first()[0] < 0.9
    for found in (poor, poor.limit(0), poor.filter("rank < 3")):
        got = {(r.query_id, r["rank"]): r.vec_id for r in knn.checked(found, rows.union(rows.limit(9)), asked, 5).collect()}
        assert got == truth


def test_label_search_with_the_check(spark):
    x, data = vectors(spark, 400, 8)
    data = data.withColumn("labels", F.when(F.col("vec_id") < 350, F.array(F.lit(1))).otherwise(F.array(F.lit(2), F.lit(2))))
    asked = data.filter("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), (1 + F.col("vec_id") % 3).cast("int").alias("query_label"))
    index = label_index.LabelIndex.build(data, 200)
    index.shards = without_edges(index.shards)
    same = lambda rows: sorted((r.query_id, r["rank"], r.vec_id, round(r.distance, 9)) for r in rows.collect())
    assert same(index.search(asked, 6, 32)) != same(index.ground_truth(asked, 6)) == same(index.search(asked, 6, 32, exact=True))


def test_descent_carries_no_vectors_for_each_pair(spark):
    x, data = vectors(spark, 400, 6)
    near = graph.nn_descent(data, 5, 16)
    assert "zip_with" not in plan(near) and near.columns == ["src", "rank", "dst", "distance"]
    truth = knn.knn_graph(data, 5)
    ids = lambda e: e.select(F.col("src").alias("query_id"), F.col("dst").alias("vec_id"), "distance")
    assert stats.recall_with_ties(ids(near), ids(truth)).first()[0] > 0.95
    rows = near.collect()
    assert len({(r.src, r.dst) for r in rows}) == len(rows) == 2000 and all(r.src != r.dst for r in rows)
    assert all(r.distance == pytest.approx(((x[r.src].astype(float) - x[r.dst].astype(float)) ** 2).sum()) for r in rows)
    members = data.select(F.lit(1).alias("pivot"), "vec_id").limit(50)
    assert "zip_with" not in plan(graph._compete(members, data.select("vec_id", F.col("embedding").alias("v"), F.lit(None).alias("bar")), 4, "l2_expanded"))


def test_label_lists_by_blocks(spark):
    x, data = vectors(spark, 90, 5)
    rows = data.select((F.col("vec_id") % 4).cast("int").alias("label"), "vec_id", F.col("embedding").alias("v"))
    found = knn.lists_by_label(rows, 3)
    assert "zip_with" not in plan(found) and dict(found.dtypes)["label"] == "int"
    d = ((x[:, None].astype(float) - x[None].astype(float)) ** 2).sum(2)
    got = {(r.src, r["rank"]): r.dst for r in found.collect()}
    for i in range(90):
        want = sorted((d[i, j], j) for j in range(i % 4, 90, 4) if j != i)[:3]
        assert [got[i, r] for r in (1, 2, 3)] == [j for _, j in want]


@pytest.mark.parametrize("kind", ["modularity", "embedding"])
def test_graphs_beyond_the_dense_size_need_no_joins(spark, monkeypatch, kind):
    """A graph with a hub, whose degree is far above the spectrum's other end."""
    r = np.random.default_rng(3)
    pairs = [(i, j) for i in range(200) for j in range(i) if j == 0 or (i % 4 == j % 4 and r.random() < 0.3)]
    edges = spark.createDataFrame([e for i, j in pairs for e in ((i, j, 1.0), (j, i, 1.0))], "src long, dst long, weight double").cache()
    nodes = spark.range(200).withColumnRenamed("id", "vec_id")
    solve = lambda: np.array([x.x for x in spectral._solve(edges, nodes, 3, kind).orderBy("vec_id").collect()])
    want = solve()
    monkeypatch.setattr(spectral, "DENSE", 0)
    monkeypatch.setattr(spectral, "_iterated", None)
    got = solve()
    assert np.abs(np.linalg.svd(got.T @ got)[1] - np.linalg.svd(want.T @ want)[1]).max() < 1e-3 * (want**2).sum()
    basis = np.linalg.qr(want)[0]
    assert np.abs(got - basis @ (basis.T @ got)).max() < 1e-3 * np.abs(want).max()
