"""Search, graph, clustering and statistics operators over DataFrames.

Vectors are rows (vec_id, embedding), queries rows (query_id, q), results rows (query_id, rank,
vec_id, distance) ranked from 1; ties go to the smaller id, and queries may have fewer than k rows.
"""
