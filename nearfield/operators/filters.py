"""Filters of search candidates. A filter says what is kept; None keeps everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import small


def no_filter(data: DataFrame) -> DataFrame:
    return data


def bitset_filter(data: DataFrame, allowed: DataFrame | Column, key: str = "vec_id") -> DataFrame:
    """One allow-list for all queries: a DataFrame of ids or a boolean column."""
    return data.filter(allowed) if isinstance(allowed, Column) else data.join(small(allowed.select(key).distinct()), key, "left_semi")


def bitmap_filter(pairs: DataFrame, allowed: DataFrame | Column, query: str = "query_id", key: str = "vec_id") -> DataFrame:
    """An allow-list per query: a DataFrame of (query, id) or a boolean column over both."""
    return pairs.filter(allowed) if isinstance(allowed, Column) else pairs.join(allowed.select(query, key).distinct(), [query, key], "left_semi")


def label_filter(labels: Column, query_label: Column) -> Column:
    """Whether a row's label list has the query's label; -1 accepts all, an empty list nothing else."""
    return (query_label == -1) | F.coalesce(F.array_contains(labels, query_label), F.lit(False))


def label_bitmap(queries: DataFrame, data: DataFrame, query_label: str = "query_label", labels: str = "labels") -> DataFrame:
    """(query_id, vec_id) pairs where the row has the query's label: an equi-join on the exploded labels."""
    inverted = data.select("vec_id", F.explode(F.array_distinct(labels)).alias("label"))
    return inverted.join(small(queries.select("query_id", F.col(query_label).alias("label"))), "label").select("query_id", "vec_id")


def last_valid_label(query_labels: Column, n_labels: int) -> Column:
    """Of a query's label list, the last label in range decides (later rows overwrite earlier ones)."""
    return F.try_element_at(F.filter(query_labels, lambda x: (x >= 0) & (x < n_labels)), F.lit(-1))


def valid_candidates(candidates: DataFrame, data: DataFrame, key: str = "vec_id") -> DataFrame:
    """Candidates whose id exists."""
    return candidates.join(data.select(key), key, "left_semi")


def valid_sweep(build: dict, search: dict, k: int, dim: int) -> bool:
    """Whether parameters fit together: those of an index that are given are checked."""
    def get(name):
        return search.get(name, build.get(name))

    rules = (
        get("itopk") is None or get("itopk") >= k,
        None in (get("graph_degree"), get("intermediate_graph_degree")) or get("graph_degree") <= get("intermediate_graph_degree"),
        None in (get("nlist"), get("nprobe")) or get("nlist") >= get("nprobe"),
        get("pq_dim") is None or get("pq_dim") <= dim,
        get("pq_bits") is None or 4 <= get("pq_bits") <= 8 and get("pq_bits") * (get("pq_dim") or dim) % 8 == 0,
        get("ef") is None or get("ef") >= k,
        get("refine_ratio") is None or get("refine_ratio") >= 1,
    )
    return all(rules)
