import math
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nearfield.functions import metrics, quantize
from nearfield.operators import filters, graph, ivf, kmeans, knn, label_index, linkage, sharded, stats, topk
from nearfield.plans import measure
from nearfield.sources import bins, store
from nearfield.streaming import batching

RNG = np.random.default_rng(0)


def frame(spark, v, ids=None):
    return bins.from_arrays(spark, v, ids)


def asked(spark, q):
    return frame(spark, q).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


def brute(v, q, k, metric="l2_expanded", keep=None):
    out = {}
    for i, x in enumerate(q):
        d = knn._exact(x.astype(float), v.astype(float), metric)
        order = sorted((j for j in range(len(v)) if (keep is None or keep(i, j)) and not math.isnan(d[j])), key=lambda j: (d[j] if metric != "inner_product" else -d[j], j))
        out[i] = [(j, d[j]) for j in order[:k]]
    return out


def found(rows):
    out = {}
    for r in sorted(rows.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.distance))
    return out


def same(got, want):
    assert {q: [i for i, _ in rows] for q, rows in got.items()} == {q: [i for i, _ in rows] for q, rows in want.items() if rows}
    for q, rows in got.items():
        assert [d for _, d in rows] == pytest.approx([d for _, d in want[q]], abs=1e-9)


@pytest.fixture(scope="module")
def v():
    x = RNG.normal(size=(400, 12)).astype(np.float32)
    x[50:60] = x[40]  # repeated vectors
    x[70] = 0
    return x


def reference_distance(name, a, b):
    a, b = a.astype(float), b.astype(float)
    log = lambda x: np.where(x > 0, np.log(np.where(x > 0, x, 1)), 0)
    m = (a + b) / 2
    return {
        "l1": np.abs(a - b).sum(), "linf": np.abs(a - b).max(), "l2_expanded": ((a - b) ** 2).sum(), "l2_sqrt_expanded": np.sqrt(((a - b) ** 2).sum()), "inner_product": a @ b,
        "cosine": 1 - a @ b / np.sqrt((a @ a) * (b @ b)), "canberra": sum(abs(x - y) / (abs(x) + abs(y)) for x, y in zip(a, b, strict=True) if x or y), "lp": (np.abs(a - b) ** 3).sum() ** (1 / 3),
        "correlation": 1 - np.corrcoef(a, b)[0, 1], "hamming": (a != b).mean(), "russellrao": (len(a) - a @ b) / len(a), "hellinger": np.sqrt(max(0, 1 - np.sqrt(np.abs(a * b)).sum())),
        "kl_divergence": 0.5 * (a * (log(a) - log(b))).sum(), "jensenshannon": np.sqrt(max(0, 0.5 * (a * (log(a) - log(m)) + b * (log(b) - log(m))).sum())),
        "jaccard": 1 - a @ b / ((a == 1).sum() + (b == 1).sum() - a @ b) if (a == 1).any() or (b == 1).any() else 0.0, "dice": 1 - 2 * (a @ b) / ((a == 1).sum() + (b == 1).sum()) if (a == 1).any() or (b == 1).any() else 0.0,
    }[name]


@pytest.mark.parametrize("name", ["l1", "linf", "l2_expanded", "l2_sqrt_expanded", "inner_product", "cosine", "canberra", "lp", "correlation", "hamming", "russellrao", "hellinger", "kl_divergence", "jensenshannon", "jaccard", "dice"])
def test_distances(spark, name):
    x = np.abs(RNG.normal(size=(6, 9)))
    x[1, :4] = 0
    if name in ("hamming", "russellrao", "jaccard", "dice"):
        x = (x > 0.5).astype(float)
    if name in ("hellinger", "kl_divergence", "jensenshannon"):
        x /= x.sum(1, keepdims=True)
    rows = spark.createDataFrame([(i, j, x[i].tolist(), x[j].tolist()) for i in range(6) for j in range(6)], "i int, j int, x array<double>, y array<double>")
    for r in rows.select("i", "j", metrics.distance(F.col("x"), F.col("y"), name, 3.0).alias("d")).collect():
        assert r.d == pytest.approx(reference_distance(name, x[r.i], x[r.j]), abs=1e-7), (r.i, r.j)


def test_distance_edges(spark):
    one = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0], [1.0])], "a array<double>, b array<double>, c array<double>")
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    assert one.select(metrics.distance(a, b, "cosine")).first()[0] is None
    assert one.select(metrics.distance(a, a, "canberra")).first()[0] == 0
    with pytest.raises(Exception, match="dimension"):
        one.select(metrics.distance(a, c)).collect()
    with pytest.raises(ValueError, match="braycurtis"):
        metrics.distance(a, b, "braycurtis")
    assert not metrics.is_min_close("inner_product") and metrics.is_min_close("cosine")
    half = one.select(metrics.distance(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(math.pi)), "haversine")).first()[0]
    assert half == pytest.approx(math.pi)


@pytest.mark.parametrize("metric", ["l2_expanded", "l2_sqrt_expanded", "cosine", "inner_product"])
@pytest.mark.parametrize("k", [1, 5, 500])
def test_exact_search(spark, v, metric, k):
    same(found(knn.search(frame(spark, v).repartition(3), asked(spark, v[35:45]), k, metric)), brute(v, v[35:45], k, metric))


def test_filtered_search(spark, v):
    data, queries = frame(spark, v), asked(spark, v[:6])
    same(found(knn.search(data, queries, 4, allowed=F.col("vec_id") % 3 != 0)), brute(v, v[:6], 4, keep=lambda i, j: j % 3))
    same(found(knn.search(data, queries, 4, allowed=data.filter("vec_id % 3 != 0"))), brute(v, v[:6], 4, keep=lambda i, j: j % 3))
    pairs = data.select("vec_id").crossJoin(queries.select("query_id")).filter("(vec_id + query_id) % 90 = 0")
    same(found(knn.search(data, queries, 10, pairs=pairs)), brute(v, v[:6], 10, keep=lambda i, j: (i + j) % 90 == 0))
    assert knn.search(data.limit(0), queries, 3).collect() == [] and knn.search(data, queries.limit(0), 3).collect() == []


def test_many_query_blocks(spark, v, monkeypatch):
    monkeypatch.setattr(knn, "QUERIES", 7)
    same(found(knn.search(frame(spark, v), asked(spark, v[:30]), 3)), brute(v, v[:30], 3))


def test_sparse_search(spark, v):
    rows = frame(spark, v).select("vec_id", F.posexplode("embedding").alias("col_id", "value")).filter("abs(cast(value as double)) > 0.7")
    z = np.where(np.abs(v) > 0.7, v, 0)
    got = found(knn.sparse_top_k(rows, rows.filter("vec_id < 5").withColumnRenamed("vec_id", "query_id"), 6, "l2_expanded"))
    has = (z != 0).any(1)
    same(got, {i: r for i, r in brute(z, z[:5], 6, keep=lambda i, j: has[j]).items() if has[i]})


def test_refine_and_unknown_ids(spark, v):
    candidates = spark.createDataFrame([(q, i) for q in range(3) for i in (q, 5, 9, 9, 99999)], "query_id long, vec_id long")
    got = found(knn.refine(frame(spark, v), asked(spark, v[:3]), candidates, 10))
    same(got, brute(v, v[:3], 10, keep=lambda i, j: j in (i, 5, 9)))


def test_select_k(spark):
    rows = spark.createDataFrame([(1, [3.0, 1.0, None, 1.0], [10, 20, 30, 40], 4), (2, [5.0], [7], 1), (3, [], [], 0), (4, [9.0, 1.0], [1, 2], 1)], "row_id int, values array<double>, names array<int>, n int")
    got = [tuple(r) for r in topk.select_k(rows, 2, ids="names", lengths="n").orderBy("row_id", "rank").collect()]
    assert got == [(1, 1, 20, 1.0), (1, 2, 40, 1.0), (2, 1, 7, 5.0), (4, 1, 1, 9.0)]


def test_label_index(spark, v, tmp_path):
    labels = [[i % 7] + ([100] if i % 40 == 0 else []) + ([i % 7] if i % 50 == 0 else []) for i in range(len(v))]
    labels[3] = []
    data = frame(spark, v).join(spark.createDataFrame(list(enumerate(labels)), "vec_id long, labels array<int>"), "vec_id")
    stats_ = {r.label: (r.freq, r.tier) for r in label_index.label_stats(label_index.invert(data), 20).collect()}
    assert stats_[100] == (10, "scan") and stats_[1][1] == "graph" and sum(f for f, _ in stats_.values()) == sum(map(len, labels))
    exact = {r.label: r.tier for r in label_index.label_stats(label_index.invert(data), stats_[100][0]).collect()}
    assert exact[100] == "scan"  # at the threshold
    queries = asked(spark, v[:8]).withColumn("query_label", F.when(F.col("query_id") == 7, 555).when(F.col("query_id") == 6, 100).otherwise((F.col("query_id") % 7).cast("int")))
    index = label_index.LabelIndex.build(data, 20, 16, path=str(tmp_path / "index"))
    want = brute(v, v[:8], 5, keep=lambda i, j: i != 7 and (100 if i == 6 else i % 7) in labels[j])
    got = found(index.search(queries, 5, 64))
    same(found(index.ground_truth(queries, 5)), want)
    assert 7 not in got
    same({6: got[6]}, {6: want[6]})
    assert stats.recall(index.search(queries, 5, 64), index.ground_truth(queries, 5)).first()[0] > 0.95
    again = label_index.LabelIndex.build(data.limit(0), 99, path=str(tmp_path / "index"))
    assert again.threshold == 20 and found(again.search(queries, 5, 64)) == got
    every = asked(spark, v[:2]).withColumn("query_label", F.lit(-1))
    same(found(label_index.inline_filter(data, every, 5)), brute(v, v[:2], 5))


def test_label_list_filter(spark):
    rows = spark.createDataFrame([([1, 2], 2), ([1], 2), ([], 2), ([], -1), (None, 3)], "labels array<int>, q int")
    assert [r[0] for r in rows.select(filters.label_filter(F.col("labels"), F.col("q"))).collect()] == [True, False, False, True, False]
    last = spark.createDataFrame([([5, 1, 99],), ([99],)], "l array<int>").select(filters.last_valid_label(F.col("l"), 10))
    assert [r[0] for r in last.collect()] == [1, None]


def test_sharded_graph(spark, v):
    rows = frame(spark, v).select(F.lit(1).alias("label"), "vec_id", F.col("embedding").alias("v"))
    packed = sharded.pack(rows, 12, 24, shard_rows=100).cache()
    assert packed.count() == 4
    queries = asked(spark, v[:40]).withColumn("label", F.lit(1))
    near = sharded.search(packed, queries, 5, 64)
    truth = knn.search(frame(spark, v), queries, 5)
    assert stats.recall_with_ties(near, truth).first()[0] > 0.95
    with pytest.raises(ValueError):
        sharded.search(packed, queries, 10, 5)


def brute_optimize(lists, degree):
    n, k = lists.shape
    kept = []
    for a in range(n):
        detours = [sum(b in lists[d] for d in lists[a][:r]) for r, b in enumerate(lists[a])]
        kept.append([lists[a][r] for r in sorted(range(k), key=lambda r: (detours[r], r))[:degree]])
    half, out = degree // 2, []
    for a in range(n):
        back = [s for _, s in sorted((kept[s].index(a), s) for s in range(n) if a in kept[s])][: degree - half]
        out.append(list(dict.fromkeys(kept[a][:half] + back + kept[a][half:]))[:degree])
    return out


def test_graph_optimize(spark, v):
    lists = sharded.neighbour_lists(v[:60].astype(float), 10, "l2_expanded")
    want = brute_optimize(lists.tolist() and lists, 6)
    assert [[x for x in row if x >= 0] for row in sharded.optimized(lists, 6).tolist()] == [[int(x) for x in row] for row in want]
    edges = spark.createDataFrame([(i, r + 1, int(j), 0.0) for i, row in enumerate(lists) for r, j in enumerate(row)], "src long, rank int, dst long, distance double")
    got = {r.src: r.neighbours for r in graph.adjacency(graph.optimize(edges, 6)).collect()}
    assert [got[i] for i in range(60)] == [[int(x) for x in row] for row in want]


def test_components_and_connection(spark, v):
    links = spark.createDataFrame([(1, 2), (2, 3), (7, 8), (9, 9)], "src long, dst long")
    got = {r.vec_id: r.comp for r in graph.components(spark.range(1, 11).withColumnRenamed("id", "vec_id"), links).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7, 8: 7, 9: 9, 10: 10}


def test_robust_prune(spark):
    x = np.array([[0, 0], [1, 0], [2, 0], [0, 3]], np.float32)
    data = frame(spark, x)
    edges = knn.knn_graph(data, 3)
    kept = [(r.src, r.dst) for r in graph.robust_prune(edges, data, 3, 1.2).orderBy("src", "rank").collect() if r.src == 0]
    assert kept == [(0, 1), (0, 3)]  # 2 is closer to 1 than to 0


def test_inverted_lists(spark, v, tmp_path):
    data, queries = frame(spark, v), asked(spark, v[:10])
    index = ivf.IvfFlat.build(data, 8, 5, 1.0)
    same(found(index.search(queries, 5, 8)), brute(v, v[:10], 5))
    assert index.sizes().agg(F.sum("size")).first()[0] == len(v)
    index.save(str(tmp_path / "flat"))
    same(found(ivf.IvfFlat.load(spark, str(tmp_path / "flat")).search(queries, 5, 3)), found(index.search(queries, 5, 3)))
    more = index.extend(frame(spark, v[:5] + 0.001, np.arange(1000, 1005)))
    assert more.lists.count() == len(v) + 5
    with pytest.raises(ValueError):
        ivf.IvfFlat.build(data.limit(3), 8)
    with pytest.raises(ValueError):
        ivf.IvfFlat.build(data, 8, metric="l1")


def test_product_quantisation(spark, v, tmp_path):
    data, queries = frame(spark, v), asked(spark, v[:10])
    truth = knn.search(data, queries, 5)
    for book in ("per_subspace", "per_cluster"):
        index = ivf.IvfPq.build(data, 4, 6, 1.0, pq_bits=6, pq_dim=4, codebook=book, force_rotation=book == "per_cluster")
        assert stats.recall(index.search(queries, 5, 4, refine=(data, 60)), truth).first()[0] > 0.8
        back = index.reconstruct().join(data, "vec_id").select(metrics.distance(F.col("v"), F.col("embedding")).alias("d")).agg(F.avg("d")).first()[0]
        assert back < 0.6 * float(v.var(0).sum())
    index.save(str(tmp_path / "pq"))
    same(found(ivf.IvfPq.load(spark, str(tmp_path / "pq")).search(queries, 5, 2)), found(index.search(queries, 5, 2)))
    assert index.erase_list(0).lists.filter("list_id = 0").count() == 0
    assert [ivf.auto_pq_dim(d) for d in (8, 31, 64, 128, 200, 768)] == [8, 16, 64, 64, 96, 384]


def test_kmeans(spark):
    blobs = np.concatenate([RNG.normal(c, 0.1, (40, 3)) for c in (-3, 0, 3)]).astype(np.float32)
    data = frame(spark, blobs)
    for init in ("k-means++", "k-means||"):
        model = kmeans.fit(data, 3, init)
        label = {r.vec_id: r.cluster for r in kmeans.predict(data, model).collect()}
        assert len({tuple(sorted(i for i in label if label[i] == c)) for c in range(3)} & {tuple(range(0, 40)), tuple(range(40, 80)), tuple(range(80, 120))}) == 3
    assert len(kmeans.find_k(data, 6, max_iter=20).centers) == 3
    sizes = [r["count"] for r in kmeans.predict(data, kmeans.fit_balanced(data, 6)).groupBy("cluster").count().collect()]
    assert len(sizes) == 6 and min(sizes) >= 5
    weighted = data.withColumn("w", F.when(F.col("vec_id") < 40, 0.0).otherwise(1.0))
    assert kmeans.fit(weighted, 1, blobs[:1], 5, weight="w").centers[0] == pytest.approx(blobs[40:].mean(0), abs=1e-5)


def test_single_linkage(spark):
    blobs = np.concatenate([RNG.normal(c, 0.05, (12, 2)) for c in (-4, 0, 5)]).astype(np.float32)
    for kind in ("pairwise", "knn_graph"):
        labels, merges = linkage.single_linkage(frame(spark, blobs), 3, kind, 2)
        got = {r.vec_id: r.label for r in labels.collect()}
        assert [got[i] for i in range(36)] == [0] * 12 + [1] * 12 + [2] * 12
        rows = merges.orderBy("merge_id").collect()
        assert len(rows) == 35 and rows[-1]["size"] == 36 and [r.delta for r in rows] == sorted(r.delta for r in rows)


def test_recalls(spark):
    truth = spark.createDataFrame([(1, 1, 0.1), (1, 2, 0.2)], "query_id long, vec_id long, distance double")
    near = spark.createDataFrame([(1, 1, 0.1), (1, 9, 0.2), (2, 5, 0.3)], "query_id long, vec_id long, distance double")
    assert stats.recall(near, truth).first()[0] == 0.75  # a query without true neighbours counts as 1
    assert stats.recall_at(near, truth, 4).first()[0] == 0.25
    assert stats.recall_with_ties(near, truth).first()[0] == 1.0


def test_silhouette_single_rows(spark):
    rows = frame(spark, np.array([[0], [1], [9]], np.float32)).withColumn("label", F.when(F.col("vec_id") < 2, 0).otherwise(1))
    got = [r.silhouette for r in stats.silhouette_samples(rows).orderBy("vec_id").collect()]
    assert got == pytest.approx([(81 - 1) / 81, (64 - 1) / 64, 0])


@settings(max_examples=20, deadline=None)
@given(st.lists(st.floats(-5, 5, width=32), min_size=2, max_size=40))
def test_quantizer(spark, values):
    rows = frame(spark, np.array([values], np.float32))
    both = rows.crossJoin(quantize.train_scalar(rows, 1.0)).select("embedding", "low", "high", quantize.to_int8(F.col("embedding"), F.col("low"), F.col("high")).alias("c"))
    r = both.select("*", quantize.from_int8(F.col("c"), F.col("low"), F.col("high")).alias("back")).first()
    assert (r.low, r.high) == (min(r.embedding), max(r.embedding)) and all(-128 <= c <= 127 for c in r.c)
    if r.high > r.low:
        assert max(abs(a - b) for a, b in zip(r.embedding, r.back, strict=True)) <= (r.high - r.low) / 255 + 1e-6


@pytest.mark.parametrize("bits", [4, 5, 6, 7, 8])
def test_packing(spark, bits):
    codes = RNG.integers(0, 1 << bits, 8).tolist()
    row = spark.createDataFrame([(codes,)], "c array<int>").select(quantize.pack_codes(F.col("c"), bits).alias("p")).select("p", quantize.unpack_codes(F.col("p"), bits, 8).alias("u")).first()
    assert row.u == codes and len(row.p) == bits and bytes(row.p) == sum(c << (i * bits) for i, c in enumerate(codes)).to_bytes(bits, "little")


@pytest.mark.parametrize("suffix", ["fbin", "f16bin", "ibin", "u8bin", "i8bin"])
def test_matrix_files(spark, tmp_path, suffix):
    x = RNG.integers(0, 100, (50, 4)).astype(bins.TYPES[suffix])
    rows = spark.createDataFrame([(i, [float(y) if x.dtype.kind == "f" else int(y) for y in r]) for i, r in enumerate(x)], f"vec_id long, embedding array<{'float' if x.dtype.kind == 'f' else 'int'}>")
    path = str(tmp_path / f"m.{suffix}")
    bins.write_matrix(rows.repartition(3), path)
    with open(path, "rb") as f:
        assert f.read() == struct.pack("<ii", 50, 4) + x.tobytes()
    assert [r.embedding for r in bins.read_matrix(spark, path).orderBy("vec_id").collect()] == x.tolist()
    assert [r.vec_id for r in bins.read_matrix(spark, path, start=10, rows=5).orderBy("vec_id").collect()] == [10, 11, 12, 13, 14]
    with open(path, "r+b") as f:
        f.truncate(20)
    with pytest.raises(ValueError, match="early"):
        bins.read_matrix(spark, path)


def test_label_files(spark, tmp_path):
    (tmp_path / "l.txt").write_text("1,2\n-1\n\n7\n")
    assert [r.labels for r in bins.read_labels(spark, str(tmp_path / "l.txt")).orderBy("vec_id").collect()] == [[1, 2], [], [], [7]]
    rows = bins.read_labels(spark, str(tmp_path / "l.txt"))
    bins.write_spmat(rows, str(tmp_path / "l.spmat"), 8)
    assert [r.labels for r in bins.read_labels(spark, str(tmp_path / "l.spmat")).orderBy("vec_id").collect()] == [[1, 2], [], [], [7]]
    bins.write_labels_txt(rows, str(tmp_path / "m.txt"))
    assert (tmp_path / "m.txt").read_text() == "1,2\n-1\n-1\n7\n"
    with pytest.raises(ValueError):
        bins.read_labels(spark, "l.csv")


def test_stored_tables(spark, v, tmp_path):
    path = str(tmp_path / "index")
    calls = []

    def build():
        calls.append(1)
        return {"rows": frame(spark, v)}, {"metric": "l1"}

    for force, want in ((False, 1), (False, 1), (True, 2)):
        tables, about = store.build_or_load(spark, path, "brute_force", build, force)
        assert len(calls) == want and about == {"metric": "l1"} and tables["rows"].count() == len(v)
    with pytest.raises(ValueError):
        store.load_tables(spark, path, "graph")


def test_streamed_requests(spark, v, tmp_path):
    data, queries = frame(spark, v), asked(spark, v[:9])
    queries.repartition(3).write.parquet(str(tmp_path / "requests"))
    stream = spark.readStream.schema(queries.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "requests"))
    batching.serve(stream, lambda batch: knn.search(data, batch, 3), str(tmp_path / "out"), str(tmp_path / "check"), once=True).awaitTermination()
    same(found(spark.read.parquet(str(tmp_path / "out"))), brute(v, v[:9], 3))


def test_sweeps(spark):
    got = list(measure.combinations({"nlist": [4, 16]}, {"nprobe": [1, 8], "itopk": [5, 20]}, 10, 64))
    assert got == [({"nlist": 4}, {"nprobe": 1, "itopk": 20}), ({"nlist": 16}, {"nprobe": 1, "itopk": 20}), ({"nlist": 16}, {"nprobe": 8, "itopk": 20})]
    rows = spark.createDataFrame([("a", 10.0, 0.5), ("b", 5.0, 0.4), ("c", 4.0, 0.9), ("d", 3.0, 0.9)], "setting string, qps double, recall double")
    assert {r.setting for r in measure.frontier(rows).collect()} == {"a", "c"}


def without_edges(shards):
    """The same shards, every graph emptied."""
    import numpy as np

    empty = F.udf(lambda ids, edges: np.full(len(edges) // 4, -1, np.int32).tobytes(), "binary")
    return shards.withColumn("edges", empty("ids", "edges"))


def test_label_search_needs_its_graphs(spark):
    """Labels of 1,000 rows, a beam of 32: the recall is high, and falls when the graphs lose their edges."""
    r = np.random.default_rng(5)
    v = r.normal(size=(2000, 12))
    data = spark.createDataFrame([(i, x.tolist(), [i % 2]) for i, x in enumerate(v)], "vec_id long, embedding array<float>, labels array<int>")
    queries = data.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), F.lit(1).alias("query_label"))
    index = label_index.LabelIndex.build(data, 50, degree=16)
    truth = index.ground_truth(queries, 10)
    assert stats.recall(index.search(queries, 10, itopk=32), truth).first()[0] >= 0.95
    index.shards = without_edges(index.shards)
    assert stats.recall(index.search(queries, 10, itopk=32), truth).first()[0] < 0.5


def test_sparse_inner_product_counts_rows_without_a_common_column(spark):
    data = spark.createDataFrame([(1, 0, 1.0), (2, 5, 3.0), (3, 0, -1.0), (4, 6, 1.0)], "vec_id long, col_id int, value double")
    queries = spark.createDataFrame([(7, 0, 1.0), (8, 5, 1.0), (8, 0, 1.0)], "query_id long, col_id int, value double")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.distance) for r in knn.sparse_top_k(data, queries, 2).collect()}
    assert got == {(7, 1): (1, 1.0), (7, 2): (2, 0.0), (8, 1): (2, 3.0), (8, 2): (1, 1.0)}


def test_many_queries_meet_all_rows_in_blocks(spark, monkeypatch):
    r = np.random.default_rng(6)
    data = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(r.normal(size=(300, 5)))], "vec_id long, embedding array<float>").repartition(3)
    queries = data.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    for metric in ("l2_expanded", "inner_product"):
        one = sorted(map(tuple, knn.search(data, queries, 4, metric).collect()))
        monkeypatch.setattr(knn, "QUERIES", 17)
        assert sorted(map(tuple, knn.search(data, queries, 4, metric).collect())) == one and len(one) == 1200
        monkeypatch.undo()


def test_a_matrix_is_read_by_many_tasks_at_their_offsets(spark, tmp_path, monkeypatch):
    x = np.arange(1000 * 7, dtype="<f4").reshape(1000, 7)
    path = f"{tmp_path}/x.fbin"
    with open(path, "wb") as f:
        f.write(np.array([1000, 7], "<i4").tobytes() + x.tobytes())
    monkeypatch.setattr(bins, "BLOCK_BYTES", 28 * 64)
    got = bins.read_matrix(spark, path)
    assert got.rdd.getNumPartitions() == 16
    assert {r.vec_id: r.embedding for r in got.collect()} == {i: x[i].tolist() for i in range(1000)}
    part = bins.read_matrix(spark, path, rows=130, start=70)
    assert part.rdd.getNumPartitions() == 3 and sorted(r.vec_id for r in part.collect()) == list(range(70, 200))


def test_samples_have_their_size_and_repeat(spark):
    rows = spark.range(5000).withColumnRenamed("id", "vec_id")
    for n in (0, 1, 37, 4999, 5000, 9000):
        got = sorted(r.vec_id for r in topk.sample_rows(rows, n).collect())
        assert len(got) == min(n, 5000) and got == sorted(r.vec_id for r in topk.sample_rows(rows.repartition(7), n).collect())
    few = [r.vec_id for r in topk.sample_rows(rows, 500).collect()]
    assert 2000 < np.mean(few) < 3000


def test_built_lists_are_stored_by_list(spark):
    r = np.random.default_rng(7)
    data = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(r.normal(size=(200, 8)))], "vec_id long, embedding array<float>")
    for index in (ivf.IvfFlat.build(data, 4, 3, 1.0, metric="cosine"), ivf.IvfPq.build(data, 4, 3, 1.0, pq_dim=4, pq_bits=4)):
        plan = index.lists.filter("list_id = 2")._jdf.queryExecution().toString()
        assert "PartitionFilters: [isnotnull(list_id" in plan and "MapInArrow" not in plan
