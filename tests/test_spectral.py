import numpy as np
import pytest

from nearfield.operators import spectral


@pytest.mark.parametrize("kind", ["embedding", "modularity"])
def test_large_graphs_as_small_ones(spark, monkeypatch, kind):
    r = np.random.default_rng(5)
    n, k = 150, 3
    at = np.sort(r.random(n))
    # a strip of near neighbours: small eigengaps
    pairs = [(i, j, float(1 + r.random())) for i in range(n) for j in range(i) if abs(at[i] - at[j]) < 0.12]
    edges = spark.createDataFrame([x for i, j, w in pairs for x in ((i, j, w), (j, i, w))], "src long, dst long, weight double").coalesce(2).cache()
    nodes = spark.range(n).withColumnRenamed("id", "vec_id").coalesce(2)

    def solve():
        return np.array([x.x for x in spectral._solve(edges, nodes, k, kind).orderBy("vec_id").collect()])

    want = solve()
    monkeypatch.setattr(spectral, "DENSE", 0)
    got = solve()
    assert np.abs(got - want).max() < 1e-3 * np.abs(want).max()
