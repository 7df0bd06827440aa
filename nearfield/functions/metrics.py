"""Distances between array columns, as expressions that Catalyst evaluates.

All sums are taken in double precision over the elements as given. Unequal lengths raise an
error, since ``zip_with`` would pad. Names and the meaning of zeros follow the tables below.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names by which callers may ask for a metric.
NAMES = {
    "sqeuclidean": "l2_expanded", "l2_expanded": "l2_expanded", "l2_unexpanded": "l2_unexpanded",
    "euclidean": "l2_sqrt_expanded", "l2": "l2_sqrt_expanded", "l2_sqrt_expanded": "l2_sqrt_expanded", "l2_sqrt_unexpanded": "l2_sqrt_unexpanded",
    "cosine": "cosine", "l1": "l1", "cityblock": "l1", "manhattan": "l1", "inner_product": "inner_product",
    "linf": "linf", "chebyshev": "linf", "canberra": "canberra", "lp": "lp", "minkowski": "lp", "correlation": "correlation",
    "jaccard": "jaccard", "hellinger": "hellinger", "haversine": "haversine", "jensenshannon": "jensenshannon",
    "hamming": "hamming", "kl_divergence": "kl_divergence", "russellrao": "russellrao", "dice": "dice",
}


def metric_name(name: str) -> str:
    """The metric behind a name; Bray-Curtis is a known name without a definition here."""
    if name.lower() not in NAMES:
        raise ValueError(f"unsupported metric: {name}")
    return NAMES[name.lower()]


def is_min_close(metric: str) -> bool:
    """Whether smaller values are closer: for all metrics but the inner product."""
    return metric_name(metric) != "inner_product"


def doubles(x: Column) -> Column:
    return F.transform(x, lambda v: v.cast("double"))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def _pairs(x: Column, y: Column, f) -> Column:
    return F.zip_with(x, y, lambda a, b: f(a.cast("double"), b.cast("double")))


def dot(x: Column, y: Column) -> Column:
    return total(_pairs(x, y, lambda a, b: a * b))


def norm2(x: Column) -> Column:
    """Sum of squares."""
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))


def norm(x: Column) -> Column:
    return F.sqrt(norm2(x))


def normalized(x: Column) -> Column:
    """x over its Euclidean norm; a zero vector stays."""
    over = lambda n: F.transform(x, lambda v: F.when(n > 0, v.cast("double") / n).otherwise(v.cast("double")))
    return F.transform(F.array(norm(x)), over)[0]  # the norm is taken once a row


def _log(v: Column) -> Column:
    return F.when(v > 0, F.ln(v)).otherwise(0.0)


def _sq(x, y, p):
    return total(_pairs(x, y, lambda a, b: (a - b) * (a - b)))


def _cosine(x, y, p):
    size = norm(x) * norm(y)
    return F.when(size > 0, 1 - dot(x, y) / size)


def _canberra(x, y, p):
    return total(_pairs(x, y, lambda a, b: F.when(F.abs(a) + F.abs(b) == 0, 0.0).otherwise(F.abs(a - b) / (F.abs(a) + F.abs(b)))))


def _correlation(x, y, p):
    k, sx, sy = F.size(x), total(doubles(x)), total(doubles(y))
    below = F.sqrt((k * norm2(x) - sx * sx) * (k * norm2(y) - sy * sy))
    return F.when(below > 0, 1 - (k * dot(x, y) - sx * sy) / below)


def _ones(x: Column) -> Column:
    return F.size(F.filter(x, lambda v: v.cast("double") == 1.0)).cast("double")


def _jaccard(x, y, p):
    both = dot(x, y)
    return F.when(_ones(x) + _ones(y) == 0, 0.0).otherwise(1 - both / (_ones(x) + _ones(y) - both))


def _dice(x, y, p):
    return F.when(_ones(x) + _ones(y) == 0, 0.0).otherwise(1 - 2 * dot(x, y) / (_ones(x) + _ones(y)))


def _js(x, y, p):
    def term(a, b):
        m = (a + b) / 2
        return a * (_log(a) - _log(m)) + b * (_log(b) - _log(m))

    return F.sqrt(F.greatest(F.lit(0.0), 0.5 * total(_pairs(x, y, term))))


def _haversine(x, y, p):
    lat, lon = [(F.get(x, i).cast("double") - F.get(y, i).cast("double")) / 2 for i in (0, 1)]
    inside = F.sin(lat) * F.sin(lat) + F.cos(F.get(x, 0).cast("double")) * F.cos(F.get(y, 0).cast("double")) * F.sin(lon) * F.sin(lon)
    return 2 * F.asin(F.sqrt(F.least(F.lit(1.0), inside)))


_FORMULAS = {
    "l2_expanded": _sq, "l2_unexpanded": _sq,
    "l2_sqrt_expanded": lambda x, y, p: F.sqrt(_sq(x, y, p)), "l2_sqrt_unexpanded": lambda x, y, p: F.sqrt(_sq(x, y, p)),
    "cosine": _cosine, "inner_product": lambda x, y, p: dot(x, y),
    "l1": lambda x, y, p: total(_pairs(x, y, lambda a, b: F.abs(a - b))),
    "linf": lambda x, y, p: F.array_max(_pairs(x, y, lambda a, b: F.abs(a - b))),
    "canberra": _canberra, "lp": lambda x, y, p: F.pow(total(_pairs(x, y, lambda a, b: F.pow(F.abs(a - b), F.lit(p)))), F.lit(1.0 / p)),
    "correlation": _correlation, "jaccard": _jaccard, "dice": _dice,
    "hellinger": lambda x, y, p: F.sqrt(F.greatest(F.lit(0.0), 1 - total(_pairs(x, y, lambda a, b: F.sqrt(a * b))))),
    "jensenshannon": _js, "haversine": _haversine,
    "hamming": lambda x, y, p: total(_pairs(x, y, lambda a, b: (a != b).cast("double"))) / F.size(x),
    "kl_divergence": lambda x, y, p: 0.5 * total(_pairs(x, y, lambda a, b: a * (_log(a) - _log(b)))),
    "russellrao": lambda x, y, p: (F.size(x) - dot(x, y)) / F.size(x),
}


def distance(x: Column, y: Column, metric: str = "l2_expanded", metric_arg: float = 2.0) -> Column:
    """Distance of two array columns.

    Cosine and correlation of a vector without spread are null; 0/0 in Canberra counts as 0;
    logarithms of 0 count as 0; Jaccard and Dice count elements equal to 1. KL has the factor 1/2.
    """
    name = metric_name(metric)
    same = F.size(x) == F.size(y) if name != "haversine" else (F.size(x) == 2) & (F.size(y) == 2)
    return F.when(same, _FORMULAS[name](x, y, float(metric_arg))).otherwise(F.raise_error(F.lit("vectors of different or unfit dimension")).cast("double"))


def kernel(x: Column, y: Column, kind: str = "linear", degree: int = 3, gamma: float = 1.0, coef0: float = 0.0) -> Column:
    """Gram kernels: linear, polynomial, tanh and rbf."""
    if kind == "linear":
        return dot(x, y)
    if kind == "polynomial":
        return F.pow(gamma * dot(x, y) + coef0, F.lit(float(degree)))
    if kind == "tanh":
        return F.tanh(gamma * dot(x, y) + coef0)
    if kind == "rbf":
        return F.exp(-gamma * _sq(x, y, 2.0))
    raise ValueError(f"unsupported kernel: {kind}")
