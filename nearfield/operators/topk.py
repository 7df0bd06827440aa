"""Top-k selection and merging. Ties go to the smaller id.

Spark plans ``row_number() <= k`` as a partial and a final group limit, so each task sends at most
k rows of a group through the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_k(rows: DataFrame, k: int, by: str | list[str] = "query_id", value: str = "distance", id_: str = "vec_id", select_min: bool = True, rank: str = "rank") -> DataFrame:
    """The k rows of each group with the least (or greatest) value, ranked from 1."""
    order = F.col(value).asc_nulls_last() if select_min else F.col(value).desc_nulls_last()
    window = Window.partitionBy(*([by] if isinstance(by, str) else by)).orderBy(order, F.col(id_).asc())
    return rows.filter(F.col(value).isNotNull()).withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def select_k(matrix: DataFrame, k: int, row: str = "row_id", values: str = "values", ids: str | None = None, lengths: str | None = None, select_min: bool = True) -> DataFrame:
    """Per-row top-k of an array column, as (row, rank, id, value).

    ids: array column of payload ids (else the 0-based position); lengths: column with the number
    of leading values that count. Each row is handled where it is: no shuffle.
    """
    order = F.when(F.lit(select_min), 1.0).otherwise(-1.0)
    pick = F.transform(F.col(values), lambda v, i: F.struct((order * v.cast("double")).alias("k"), (F.get(F.col(ids), i) if ids else i).cast("long").alias("id"), i.alias("pos"), v.cast("double").alias("value")))
    if lengths:
        pick = F.filter(pick, lambda s: s["pos"] < F.col(lengths))
    best = F.slice(F.array_sort(F.filter(pick, lambda s: s["value"].isNotNull())), 1, k)
    return matrix.select(row, F.posexplode(best).alias("at", "s")).select(row, (F.col("at") + 1).alias("rank"), F.col("s.id").alias("id"), F.col("s.value").alias("value"))


def merge_parts(parts: list[DataFrame], k: int, translations: list[int] | None = None, select_min: bool = True) -> DataFrame:
    """One top-k from the (query_id, vec_id, distance) lists of several partitions; translations: added to each part's ids."""
    moved = [p.select("query_id", (F.col("vec_id") + (translations[i] if translations else 0)).alias("vec_id"), "distance") for i, p in enumerate(parts)]
    every = moved[0]
    for p in moved[1:]:
        every = every.unionByName(p)
    return top_k(every, k, select_min=select_min)


def sample_rows(rows: DataFrame, n: int, key: str = "vec_id", seed: int = 137) -> DataFrame:
    """n rows without replacement, by a hash of the key: the same in every run. Rows that share a key are taken together.

    A histogram of the hashes (at most 64 bins an octave, 4,000 in all) tells in which bin the n-th row is; only that bin
    is sorted, for the bar under which rows are taken. No row moves.
    """
    place = F.shiftrightunsigned(F.xxhash64(F.col(key), F.lit(seed)), 2)
    bin_ = F.floor(64 * F.log2(place + 1.0)).cast("int")
    before = 0
    for b, count in sorted((r[0], r[1]) for r in rows.groupBy(bin_.alias("bin")).count().collect()):
        if before + count >= n:
            break
        before += count
    else:
        return rows
    if n <= before:
        return rows.limit(0)
    end = rows.filter(bin_ == b).select(place.alias("place"), F.col(key).alias("key")).orderBy("place", "key").limit(n - before)
    last = end.agg(F.max(F.struct("place", "key")).alias("s")).select("s.*").first()
    return rows.filter((place < last["place"]) | (place == last["place"]) & (F.col(key) <= last["key"]))


def sorted_lists(neighbours: DataFrame, by: str = "query_id") -> DataFrame:
    """Array form: one row per query with ids and distances in rank order."""
    both = F.sort_array(F.collect_list(F.struct("rank", "vec_id", "distance")))
    return neighbours.groupBy(by).agg(both.alias("s")).select(by, F.col("s.vec_id").alias("ids"), F.col("s.distance").alias("distances"))
