import duckdb
import pytest

import __spark_entry__
from nearfield.plans import queries as engine

SF = "/root/testdata/sf0.001"
QUICK = ["distance_l1", "knn_l2", "knn_bitmap", "label_stats", "label_scan", "graph_optimize", "kmeans_fit_predict", "ivf_flat_search", "silhouette_score", "quantizer_transform", "pareto_frontier"]


def values(rows):
    def plain(x):
        if hasattr(x, "__len__") and not isinstance(x, str):
            return tuple(plain(y) for y in x)
        return round(float(x), 5) if isinstance(x, float) else int(x) if hasattr(x, "item") else x

    return sorted(str(tuple(plain(x) for x in r)) for r in rows)


@pytest.mark.parametrize("name", QUICK)
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    got = engine.queries()[name](spark, SF).toPandas()
    want = con.execute(engine.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert values(got[columns].itertuples(index=False)) == values(want[columns].itertuples(index=False))


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["query_id", "rank", "vec_id", "distance"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
