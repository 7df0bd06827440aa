"""Quantizers and conversions of vector elements."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


SAMPLE = 1_000_000


def train_scalar(vectors: DataFrame, quantile: float = 0.99, column: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(low, high): the order statistics of the elements between which int8 is spread.

    With n elements in order, high is number ceil((0.5 + quantile / 2) n) and low mirrors it. Over
    ``SAMPLE`` elements, rows are sampled by a hash of their key, so that the sort stays bounded.
    """
    if not 0 < quantile <= 1:
        raise ValueError("quantile must be in (0, 1]")
    n = vectors.agg(F.sum(F.size(column))).first()[0] or 0
    if n > SAMPLE:
        vectors = vectors.filter(F.pmod(F.xxhash64(key, F.lit(137)), F.lit(1 << 30)) < int(SAMPLE / n * (1 << 30)))
        n = vectors.agg(F.sum(F.size(column))).first()[0] or 0
    if not n:
        return vectors.sparkSession.createDataFrame([(None, None)], "low double, high double")
    high = min(max(math.ceil((0.5 + 0.5 * quantile) * n) - 1, 0), n - 1)
    place = [(n - high - 1) / max(n - 1, 1), high / max(n - 1, 1)]
    both = vectors.select(F.explode(F.col(column).cast("array<double>")).alias("x")).agg(F.percentile("x", F.array(*map(F.lit, place))).alias("p"))
    return both.select(F.col("p")[0].alias("low"), F.col("p")[1].alias("high"))


def to_int8(x: Column, low: Column, high: Column) -> Column:
    """Array of int8 codes: at most low is -128, at least high is 127, between them linear, halves away from zero.

    If high isn't above low, the scale is 1.
    """
    scale = F.when(high > low, F.lit(255.0) / (high - low)).otherwise(1.0)
    shift = F.lit(-128.0) - low * scale

    def one(v):
        v = v.cast("double")
        return F.when(v <= low, -128).when(v >= high, 127).otherwise(F.round(scale * v + shift).cast("int"))

    return F.transform(x, lambda v: one(v).cast("int"))


def from_int8(codes: Column, low: Column, high: Column) -> Column:
    scale = F.when(high > low, F.lit(255.0) / (high - low)).otherwise(1.0)
    shift = F.lit(-128.0) - low * scale
    return F.transform(codes, lambda c: (c.cast("double") - shift) / scale)


def int_to_unit(x: Column, kind: str) -> Column:
    """int8 over 128, uint8 over 256."""
    over = {"int8": 128.0, "uint8": 256.0}[kind]
    return F.transform(x, lambda v: v.cast("double") / over)


def unit_to_int(x: Column, kind: str) -> Column:
    by, low, high = {"int8": (128.0, -128, 127), "uint8": (256.0, 0, 255)}[kind]
    return F.transform(x, lambda v: F.least(F.lit(high), F.greatest(F.lit(low), F.round(v.cast("double") * by).cast("int"))))


def pack_codes(codes: Column, bits: int) -> Column:
    """Codes of 4 to 8 bits as one array of bytes (0 to 255), least significant bits first."""
    n = F.size(codes)

    def byte(k):
        def bit(j):
            at = k * 8 + j
            code = F.get(codes, F.floor(at / bits).cast("int")).cast("int")
            odd = F.call_function("shiftright", F.coalesce(code, F.lit(0)), (at % bits).cast("int")).bitwiseAND(1)
            return F.call_function("shiftleft", odd, j.cast("int"))

        return F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0), lambda a, j: a + bit(j))

    return F.transform(F.sequence(F.lit(0), F.ceil(n * bits / 8).cast("int") - 1), byte)


def unpack_codes(packed: Column, bits: int, n: int) -> Column:
    def code(i):
        def bit(j):
            at = i * bits + j
            odd = F.call_function("shiftright", F.get(packed, F.floor(at / 8).cast("int")).cast("int"), (at % 8).cast("int")).bitwiseAND(1)
            return F.call_function("shiftleft", odd, j.cast("int"))

        return F.aggregate(F.sequence(F.lit(0), F.lit(bits - 1)), F.lit(0), lambda a, j: a + bit(j))

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), code)
