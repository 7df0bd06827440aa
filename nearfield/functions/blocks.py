"""Distances and kernels between two blocks of vectors, as numpy matrices.

The definitions are those of ``metrics``. What is a sum over elements of differences is added up element
by element, in their order; what follows from products is a matrix product.
"""

from __future__ import annotations

from functools import cache

import numpy as np

from .metrics import metric_name

#: Rows of each side that are worked on at once, so that a tile stays in the processor's cache.
TILE = (64, 1024)
#: Rows of x whose distances to a block are worked on at once, pass by pass.
THIN = 32
#: As TILE, for sums in single precision.
L1_TILE = (64, 512)
#: Metrics whose value is null for a vector without spread.
UNDEFINED = ("cosine", "correlation")
#: Metrics that follow from a matrix product.
PRODUCTS = ("inner_product", "cosine", "correlation", "jaccard", "dice", "russellrao", "hellinger", "kl_divergence")
#: Of the products that stand for x + y times its logarithm: power of the variable, terms before and after they are cut, error of an element.
SPLIT = (6, 48, 24, 4e-10)


def _log(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, np.log(np.where(x > 0, x, 1.0)), 0.0)


def _over(above: np.ndarray, below: np.ndarray) -> np.ndarray:
    """1 - above / below, NaN where below isn't positive; in the place of above."""
    with np.errstate(divide="ignore", invalid="ignore"):
        none = ~(below > 0)
        above /= below
    np.subtract(1, above, out=above)
    above[none] = np.nan
    return above


def _haversine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    lat, lon = ((x[:, i, None] - y[:, i]) / 2 for i in (0, 1))
    inside = np.sin(lat) * np.sin(lat) + np.cos(x[:, 0, None]) * np.cos(y[:, 0]) * np.sin(lon) * np.sin(lon)
    return 2 * np.arcsin(np.sqrt(np.minimum(1.0, inside)))


def _term(name: str, p: float):
    """What each element adds, from a column (rows x 1) of x and a row of y, into a tile."""
    if name.startswith("l2"):
        return lambda a, b: np.square(a - b)
    if name == "lp":
        return lambda a, b: np.abs(a - b) ** p
    if name == "hamming":
        return lambda a, b: (a != b).astype(float)
    if name == "canberra":

        def canberra(a, b):
            below = np.abs(a) + np.abs(b)
            return np.abs(a - b) / np.where(below == 0, 1.0, below)

        return canberra
    return lambda a, b: np.abs(a - b)


def _jensenshannon(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    total = (x * _log(x)).sum(1)[:, None] + (y * _log(y)).sum(1)
    positive = len(x) > 0 and len(y) > 0 and min(x.min(), y.min()) > 0
    mixed = np.empty((len(x), len(y)))
    for t in range(x.shape[1]):
        s = x[:, t, None] + y[:, t]
        if positive:
            np.multiply(s, 0.5, out=mixed)
            np.log(mixed, out=mixed)
            mixed *= s
            total -= mixed
        else:
            total -= s * _log(s / 2)
    return np.sqrt(np.maximum(0.0, 0.5 * total))


def _tile(x: np.ndarray, y: np.ndarray, name: str, p: float) -> np.ndarray:
    if name == "jensenshannon":
        return _jensenshannon(x, y)
    term, out, at = _term(name, p), np.zeros((len(x), len(y))), np.empty((len(x), len(y)))
    columns = np.ascontiguousarray(y.T)
    for t in range(x.shape[1]):
        if name == "l1" or name == "linf" or name.startswith("l2"):
            np.subtract(x[:, t, None], columns[t], out=at)
            (np.square if name.startswith("l2") else np.abs)(at, out=at)
            (np.maximum if name == "linf" else np.add)(out, at, out=out)
        else:
            out += term(x[:, t, None], columns[t])
    if "sqrt" in name:
        return np.sqrt(out)
    if name == "lp":
        return out ** (1.0 / p)
    return out / x.shape[1] if name == "hamming" else out


def _product(y: np.ndarray, name: str):
    """A function of x that gives the distances to y, of which all that doesn't depend on x is made once."""
    k = y.shape[1]
    if name == "hellinger":
        roots = np.sqrt(y).T
        return lambda x: np.sqrt(np.maximum(0.0, 1 - np.sqrt(x) @ roots))
    if name == "kl_divergence":
        logs = _log(y).T

        def divergence(x):
            out = (x * _log(x)).sum(1)[:, None] - x @ logs
            out *= 0.5
            return out

        return divergence
    if name in ("jaccard", "dice"):
        ones = (y == 1).sum(1).astype(float)

        def share(x):
            both, all_ = x @ y.T, (x == 1).sum(1).astype(float)[:, None] + ones
            none = all_ == 0
            if name == "jaccard":
                both /= np.subtract(all_, both, out=all_)
            else:
                both *= 2
                both /= all_
            np.subtract(1, both, out=both)
            both[none] = 0.0
            return both

        def quiet(x):
            with np.errstate(divide="ignore", invalid="ignore"):
                return share(x)

        return quiet
    if name == "inner_product":
        return lambda x: x @ y.T
    if name == "russellrao":
        return lambda x: (k - x @ y.T) / k
    yy, sy = (y * y).sum(1), y.sum(1)
    if name == "cosine":
        size = np.sqrt(yy)
        return lambda x: _over(x @ y.T, np.sqrt((x * x).sum(1))[:, None] * size)
    with np.errstate(invalid="ignore"):
        spread = k * yy - sy * sy

    def correlation(x):
        sx = x.sum(1)
        with np.errstate(invalid="ignore"):
            above, below = x @ y.T, (k * (x * x).sum(1) - sx * sx)[:, None] * spread
            above *= k
            above -= sx[:, None] * sy
            return _over(above, np.sqrt(below, out=below))

    return correlation


def matrix(x: np.ndarray, y: np.ndarray, metric: str = "l2_expanded", metric_arg: float = 2.0) -> np.ndarray:
    """Distances (rows of x by rows of y); NaN where ``metrics.distance`` is null."""
    name = metric_name(metric)
    if len(x) and len(y) and (x.shape[1] != y.shape[1] or name == "haversine" and x.shape[1] != 2):
        raise ValueError("vectors of different or unfit dimension")
    if not len(x) or not len(y):
        return np.zeros((len(x), len(y)))
    if name == "haversine":
        return _haversine(x, y)
    if name in PRODUCTS:
        return _product(y, name)(x)
    out = np.empty((len(x), len(y)))
    for i in range(0, len(x), TILE[0]):
        for j in range(0, len(y), TILE[1]):
            out[i : i + TILE[0], j : j + TILE[1]] = _tile(x[i : i + TILE[0]], y[j : j + TILE[1]], name, metric_arg)
    return out


def _mixture(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(a + b) ln(a + b) - a ln a - b ln b, which is 0 where one of them is."""
    return (a + b) * _log(a + b) - a * _log(a) - b * _log(b)


@cache
def _split() -> tuple[np.ndarray, np.ndarray]:
    """_mixture on [0, 1]^2 as a sum of products f(a) f(b): coefficients (Chebyshev terms x products) and their signs.

    The terms are in z, a = z^p, which flattens the corner at 0; of the eigenvectors of their matrix the greatest are kept.
    """
    power, terms, products, _ = SPLIT
    angle = np.pi * (np.arange(terms) + 0.5) / terms
    nodes = ((1 + np.cos(angle)) / 2) ** power
    change = np.cos(np.outer(np.arange(terms), angle)) * 2 / terms
    change[0] /= 2
    core = change @ _mixture(nodes[:, None], nodes[None]) @ change.T
    weight, vector = np.linalg.eigh((core + core.T) / 2)
    most = np.argsort(-np.abs(weight))[:products]
    return vector[:, most] * np.sqrt(np.abs(weight[most])), np.sign(weight[most])


def _factors(x: np.ndarray, most: float) -> np.ndarray:
    """Each element's factors of ``_split``, a row per row of x; elements from 0 to most."""
    f, _ = _split()
    out = np.empty((len(x), x.shape[1] * f.shape[1]))
    for at in range(0, len(x), TILE[0]):
        part = x[at : at + TILE[0]]
        z = 2 * (part.ravel() / most) ** (1 / SPLIT[0]) - 1
        out[at : at + TILE[0]] = (np.polynomial.chebyshev.chebvander(z, len(f) - 1) @ f).reshape(len(part), -1)
    return out


class _Mixtures:
    """rounded(matrix()) for "jensenshannon": a matrix product bounds each distance, logarithms are taken where the bounds are rounded differently."""

    def __init__(self, y: np.ndarray, most: float) -> None:
        self.y, self.most = y, most
        self.near, self.own, self.size = _factors(y, most).T, (y * _log(y)).sum(1), np.log(2) * y.sum(1)
        self.signs = np.tile(-most * _split()[1], y.shape[1])
        self.off = y.shape[1] * most * SPLIT[3] + 1e-13 * (1 + most * y.shape[1])

    def rounded(self, x: np.ndarray, digits: int) -> np.ndarray:
        root = lambda total: np.sqrt(np.maximum(0.0, 0.5 * total))
        own, out = (x * _log(x)).sum(1), (_factors(x, self.most) * self.signs) @ self.near
        for at in range(0, len(x), THIN):
            total = out[at : at + THIN]
            total += self.size
            total += np.log(2) * x[at : at + THIN].sum(1)[:, None]
            high, total[:] = rounded(root(total + self.off), digits), rounded(root(total - self.off), digits)
            row, column = np.nonzero(high != total)
            for some in range(0, len(row), 4096):
                i, j = row[some : some + 4096] + at, column[some : some + 4096]
                s = x[i] + self.y[j]
                s *= _log(s / 2)
                exact = own[i] + self.own[j]
                for t in range(s.shape[1]):
                    exact -= s[:, t]
                out[i, j] = rounded(root(exact), digits)
        return out


def rounded_strips(metric: str = "l2_expanded", metric_arg: float = 2.0, digits: int | None = None):
    """A function that gives the distances of blocks x and y as matrix() does, rounded, for ``size`` rows of x at a time.

    It keeps what it made of the last y, so blocks that meet the same one should follow each other.
    """
    name, kept = metric_name(metric), None

    def strips(x: np.ndarray, y: np.ndarray, size: int):
        nonlocal kept
        thin = name in PRODUCTS and x.size and y.size and x.shape[1] == y.shape[1]
        if thin and (kept is None or not np.array_equal(kept[0], y, equal_nan=True)):
            kept = y, _product(y, name)
        bounded = digits is not None and name == "jensenshannon" and x.size and y.size and x.shape[1] == y.shape[1] and min(x.min(), y.min()) >= 0 and 0 < max(x.max(), y.max()) < 1e100
        if bounded:
            most = max(x.max(), y.max())
            if kept is None or not most <= kept.most <= 2 * most or not np.array_equal(kept.y, y):
                kept = _Mixtures(y, 1.1 * most)
        for top in range(0, len(x), size):
            part = x[top : top + size]
            if thin:
                d = np.empty((len(part), len(y)))
                for at in range(0, len(part), THIN):
                    some = kept[1](part[at : at + THIN])
                    d[at : at + THIN] = some if digits is None else rounded(some, digits)
                yield d
            else:
                d = kept.rounded(part, digits) if bounded else matrix(part, y, name, metric_arg)
                yield d if bounded or digits is None else rounded(d, digits)

    return strips


def kernel(x: np.ndarray, y: np.ndarray, kind: str = "linear", degree: int = 3, gamma: float = 1.0, coef0: float = 0.0) -> np.ndarray:
    """Gram kernels: linear, polynomial, tanh and rbf."""
    if kind == "rbf":
        return np.exp(-gamma * matrix(x, y))
    if kind not in ("linear", "polynomial", "tanh"):
        raise ValueError(f"unsupported kernel: {kind}")
    both = matrix(x, y, "inner_product")
    return both if kind == "linear" else (gamma * both + coef0) ** float(degree) if kind == "polynomial" else np.tanh(gamma * both + coef0)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of row i of x and row i of y, added up element by element."""
    if not x.shape[0] or not x.shape[1]:
        return np.zeros(len(x))
    return np.add.accumulate(np.square(x - y), axis=1)[:, -1]


def slack(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each row of x, by how much its squared distances to y from a matrix product may be off."""
    far = (y * y).sum(1).max() if len(y) else 0.0
    return 16 * (x.shape[1] + 4) * np.finfo(float).eps * ((x * x).sum(1) + far)


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Half away from zero, without a negative zero."""
    with np.errstate(invalid="ignore", over="ignore"):
        y = x * 10.0**digits
        whole = np.rint(y)
        off = np.subtract(y, whole, out=np.empty_like(whole))
        half = np.abs(off, out=off) == 0.5  # rint goes to the even one
        if half.any():
            whole[half] = np.trunc(y[half]) + np.sign(y[half])
        whole /= 10.0**digits
        if not np.isfinite(y).all():
            whole = np.where(np.isfinite(y), whole, x)
        whole += 0.0
        return whole


def closest_l1(x: np.ndarray, y: np.ndarray, ids: np.ndarray, k: int, keep: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(row, column, distance) of the k closest rows of y to each row of x by "l1", ties to the smaller ids, NaN left out.

    Sums in single precision choose, with a margin for their rounding; what they choose is added up in double precision.
    """
    n, wide = x.shape[1], L1_TILE
    with np.errstate(over="ignore", invalid="ignore"):
        size, other = np.abs(x).sum(1), np.abs(y).sum(1)
        a, b, rough = x.astype(np.float32), np.ascontiguousarray(y.T.astype(np.float32)), np.empty((len(x), len(y)), np.float32)
        for i in range(0, len(x), wide[0]):
            for j in range(0, len(y), wide[1]):
                out = rough[i : i + wide[0], j : j + wide[1]]
                sums, at = np.zeros_like(out), np.empty_like(out)  # of the greater elements: |a - b| = 2 max(a, b) - a - b
                for t in range(n):
                    np.maximum(a[i : i + wide[0], t, None], b[t, j : j + wide[1]], out=at)
                    sums += at
                out[:] = 2 * sums - a[i : i + wide[0]].sum(1)[:, None] - b[:, j : j + wide[1]].sum(0)
        off = 2.0**-21 * (n + 4) * (size + other.max()) + 1e-36 * n
    fit = bool(np.isfinite(rough).all())  # else too large for single precision, or no numbers
    if fit:
        if keep is not None:
            rough[~keep] = np.inf
        bar = np.partition(rough, k - 1, axis=1)[:, k - 1].astype(float) if k < rough.shape[1] else np.full(len(x), np.inf)
        near = rough <= np.minimum(bar + 2 * off, np.finfo(np.float32).max)[:, None]
        fit = np.count_nonzero(near) <= max(k * len(x), near.size // 8)
    if not fit:
        d = matrix(x, y, "l1")
        row, column = top_of_strip(d if keep is None else np.where(keep, d, np.nan), ids, k)
        return row, column, d[row, column]
    row, column = np.nonzero(near)
    d = np.empty(len(row))
    for some in range(0, len(row), 1 << 14):
        i, j = row[some : some + (1 << 14)], column[some : some + (1 << 14)]
        d[some : some + (1 << 14)] = np.add.accumulate(np.abs(x[i] - y[j]), axis=1)[:, -1]
    order = np.lexsort((ids[column], d, row))
    row, column, d = row[order], column[order], d[order]
    heads = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
    least = np.arange(len(row)) - np.repeat(heads, np.diff(np.append(heads, len(row)))) < k
    return row[least], column[least], d[least]


def top_of_strip(d: np.ndarray, ids: np.ndarray, k: int, most: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k least (or greatest) entries of each row by value and id, NaN left out."""
    key = -d if most else d
    if k < d.shape[1]:
        key = np.where(np.isnan(key), np.inf, key)
        bar = np.partition(key, k - 1, axis=1)[:, k - 1]
        row, column = np.nonzero(key <= bar[:, None])
    else:
        row, column = np.indices(d.shape).reshape(2, -1)
    keep = ~np.isnan(d[row, column])
    row, column = row[keep], column[keep]
    order = np.lexsort((ids[column], key[row, column], row))
    row, column = row[order], column[order]
    heads = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
    place = np.arange(len(row)) - np.repeat(heads, np.diff(np.append(heads, len(row))))
    return row[place < k], column[place < k]
