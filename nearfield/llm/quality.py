"""Quality by co-training of two views.

The text view looks at the words: kinds of characters, word lengths, repetition, word shapes. The
page view looks at what is known about the page and its layout: language, source, length, sizes of
lines; it looks at no word, sentence or punctuation, the text view at no line.
Each view has a logistic regression. Over ``rounds`` rounds each labels the unlabelled sample, and
the rows it is most sure of join the other's training rows. At the end each view is calibrated on
labelled rows by out-of-fold predictions, and a small model of both log-odds scores all documents.

Training uses bounded samples (``cap`` labelled rows of each class and ``pool`` unlabelled rows, by
hash, the unlabelled ones by an anti-join with all labels); every whole text is scored.

Defined cases: null or empty text is rejected (its quality score is 0); null labels are not used; a
key with several labels takes the best; without rows of both classes every other text is kept; a
null source or language is a value of its own; a null key is kept; repeated rows are scored each.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linear
from . import textarrays as ta
from .common import slices

_KIND = np.zeros(256, np.uint8)  # 0: symbol
_KIND[[*range(97, 123), *range(128, 256)]] = 1
_KIND[65:91] = 2
_KIND[48:58] = 3
_KIND[[9, 10, 11, 12, 13, 32]] = 4
_KIND[[ord(c) for c in ".,;:!?'\"()-"]] = 5
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?"]] = True
SHAPES = 48
TEXT, PAGE = 6 + 12 + SHAPES, 10 + 16 + 32


def _text_view(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    n = len(starts)
    kinds = _KIND[data]
    share = np.bincount(kinds, minlength=6) / max(len(data), 1)
    x = np.zeros(TEXT)
    x[:6] = share
    if not n:
        return x
    size = ends - starts
    distinct, times = np.unique(h, return_counts=True)
    pairs = np.unique(h[1:] * np.uint64(3) + h[:-1]) if n > 1 else h
    letters = share[1] + share[2]
    x[6:18] = (
        np.log1p(n), size.mean() / 10, size.std() / 10, len(distinct) / n, np.log(len(distinct)) / np.log(n + 1), times.max() / n, len(pairs) / max(n - 1, 1),
        share[2] / max(letters, 1e-9), _END[data[ends - 1]].mean(), (_KIND[data[ends - 1]] == 0).mean(), (size == 1).mean(), (_KIND[data[starts]] == 2).mean(),
    )
    x[18:] = np.sqrt(np.bincount(shapes, minlength=SHAPES) / n)
    return x


def _one_hot(x: np.ndarray, at: int, size: int, value: str | None) -> None:
    x[at + zlib.crc32(("" if value is None else "=" + value).encode()) % size] = 1


def _page_view(data: np.ndarray, n_chars: int | None, lang: str | None, source: str | None) -> np.ndarray:
    x = np.zeros(PAGE)
    raw = data.tobytes()
    lines = raw.split(b"\n")
    full = [s for s in lines if s.strip()]
    sizes = np.array([len(s) for s in full] or [0])
    x[:10] = (
        np.log1p(len(data)), np.log1p(n_chars or 0), np.log1p(len(full)), np.log1p(sizes.mean()), np.log1p(sizes.max()), np.log1p(sizes.std()),
        len(set(full)) / max(len(full), 1), 1 - len(full) / len(lines), (sizes < 40).mean(), len(data) / max(n_chars or len(data), 1) - 1,
    )
    _one_hot(x, 10, 16, lang)
    _one_hot(x, 26, 32, source)
    return x


def views(data: np.ndarray, offsets: np.ndarray, n_chars: list, langs: list, sources: list):
    """(text view, page view) of each row."""
    for first, last in slices(offsets, ta.SLICE):
        part, at = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        starts, ends, heads = ta.words(part, at)
        h = ta.run_hashes(part, starts, ends, lower=True)
        # a word's shape: its kinds of characters, runs as one
        kinds = _KIND[part].astype(np.uint64)
        change = np.ones(len(part), bool)
        change[1:] = kinds[1:] != kinds[:-1]
        change[starts] = True
        run = np.concatenate([[0], np.cumsum(change)])
        squeezed = part[change] * 0 + _KIND[part[change]]
        shapes = (ta.run_hashes(squeezed, run[starts], run[ends]) % np.uint64(SHAPES)).astype(np.int64) if len(starts) else np.zeros(0, np.int64)
        for i, (a, b) in enumerate(zip(heads[:-1].tolist(), heads[1:].tolist(), strict=True)):
            lo, hi, row = int(at[i]), int(at[i + 1]), first + i
            own = part[lo:hi]
            yield _text_view(own, starts[a:b] - lo, ends[a:b] - lo, h[a:b], shapes[a:b]), _page_view(own, n_chars[row], langs[row], sources[row])


class Model:
    """Both views' scales and weights, the weights of the combination, and the bar on its probability."""

    def __init__(self, scales: list, weights: list, both: np.ndarray, bar: float):
        self.scales, self.weights, self.both, self.bar = scales, weights, both, bar

    def score(self, x: list[np.ndarray]) -> np.ndarray:
        if not self.scales:
            return np.ones(len(x[0]))
        odds = [linear.score((v - m) / s, w) for v, (m, s), w in zip(x, self.scales, self.weights, strict=True)]
        return linear.sigmoid(linear.score(np.stack(odds, 1), self.both))


def _rounds(x: list[np.ndarray], y: np.ndarray, pool: list[np.ndarray], rounds: int, sure: float, each: int) -> list[np.ndarray]:
    """The two views' weights after they have labelled the pool for each other."""
    more = [(np.zeros(0, int), np.zeros(0)), (np.zeros(0, int), np.zeros(0))]  # rows of the pool and pseudo-labels, for each view
    rate = max(y.mean(), 1e-3)

    def fitted(v: int) -> np.ndarray:
        rows, marks = more[v]
        return linear.fit(np.vstack([x[v], pool[v][rows]]), np.concatenate([y, marks]), l2=5.0)

    for _ in range(rounds):
        weights = [fitted(v) for v in range(2)]
        for v in range(2):
            p = linear.sigmoid(linear.score(pool[v], weights[v])) if len(pool[v]) else np.zeros(0)
            free = np.ones(len(p), bool)
            free[more[1 - v][0]] = False
            good = [k for k in np.argsort(-p, kind="stable") if free[k] and p[k] >= sure][: int(each * rate) + 1]
            bad = [k for k in np.argsort(p, kind="stable") if free[k] and p[k] <= 1 - sure][: int(each * (1 - rate)) + 1]
            new = np.array(good + bad, int)
            marks = np.repeat([1.0, 0.0], [len(good), len(bad)])
            more[1 - v] = (np.concatenate([more[1 - v][0], new]), np.concatenate([more[1 - v][1], marks]))
    return [fitted(v) for v in range(2)]


def co_train(x: list[np.ndarray], y: np.ndarray, pool: list[np.ndarray], rounds: int = 4, sure: float = 0.97, each: int = 200, k: int = 4) -> Model:
    """x: two views of labelled rows; pool: two views of unlabelled rows.

    Calibration: the rounds run anew without each fold, pseudo-labels included, and score that fold.
    """
    scales = [(v.mean(0), v.std(0) + 1e-3) for v in x]
    x = [(v - m) / s for v, (m, s) in zip(x, scales, strict=True)]
    pool = [np.clip((v - m) / s, -20, 20) for v, (m, s) in zip(pool, scales, strict=True)]
    part, odds = linear.folds(len(y), k), np.zeros((len(y), 2))
    for f in range(k):
        weights = _rounds([v[part != f] for v in x], y[part != f], pool, rounds, sure, each)
        for v in range(2):
            odds[part == f, v] = linear.score(x[v][part == f], weights[v])
    both = linear.fit(odds, y, l2=0.1)
    p = linear.sigmoid(linear.score(odds, both))
    return Model(scales, _rounds(x, y, pool, rounds, sure, each), both, 1 - linear.best_bar(1 - p, 1 - y))


_COLUMNS = ("text", "n_chars", "lang", "source")


def _views_of(batch: pa.RecordBatch, at: tuple[int, int, int, int] = (1, 2, 3, 4)) -> tuple[np.ndarray, np.ndarray]:
    got = list(views(*ta.buffers(batch.column(at[0])), *(batch.column(k).to_pylist() for k in at[1:])))
    if not got:
        return np.zeros((0, TEXT)), np.zeros((0, PAGE))
    return np.stack([g[0] for g in got]), np.stack([g[1] for g in got])


def _rows(docs: DataFrame, key: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("key"), F.col("text").cast("string").alias("text"), F.col("n_chars").cast("long").alias("n_chars"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", cap: int = 4000, pool: int = 4000) -> Model:
    """A model from at most ``cap`` labelled rows of each class and ``pool`` rows without a label."""
    some = linear.training_rows(_rows(docs, key), labels.select(F.col(key).alias("key"), F.col(label).alias("y_")), "key", "y_", list(_COLUMNS), cap, pool)

    def run(batches):
        for batch in batches:
            a, b = _views_of(batch)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in a], pa.binary()), pa.array([r.tobytes() for r in b], pa.binary())], ["y", "a", "b"])

    got = sorted((r.y, bytes(r.a), bytes(r.b)) for r in some.mapInArrow(run, "y int, a binary, b binary").collect())
    y = np.array([g[0] for g in got], float)
    x = [np.frombuffer(b"".join(g[1 + v] for g in got), float).reshape(len(got), -1) if got else np.zeros((0, 1)) for v in range(2)]
    own = y >= 0
    if own.sum() < 20 or not 0 < y[own].sum() < own.sum():
        return Model([], [], np.zeros(3), 0.0)
    return co_train([v[own] for v in x], y[own], [v[~own] for v in x])


def predict(docs: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """(key, keep, score) of every row; score: the calibrated probability of good quality."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = sent.value
        for batch in batches:
            p = own.score(list(_views_of(batch))) if batch.num_rows else np.zeros(0)
            _, offsets = ta.buffers(batch.column(1))
            p = np.where(np.diff(offsets) > 0, p, 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((p >= own.bar) & (np.diff(offsets) > 0)), pa.array(p)], [key, "keep", "score"])

    return _rows(docs, key).mapInArrow(run, f"{key} long, keep boolean, score double")


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", **options) -> DataFrame:
    return predict(docs, fit(docs, labels, key, label, **options), key)


def kept_rows(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that aren't rejected, in the same columns."""
    sent, at = docs.sparkSession.sparkContext.broadcast(model), tuple(docs.columns.index(c) for c in _COLUMNS)

    def run(batches):
        own = sent.value
        for batch in batches:
            if batch.num_rows:
                _, offsets = ta.buffers(batch.column(at[0]))
                yield batch.filter(pa.array((own.score(list(_views_of(batch, at))) >= own.bar) & (np.diff(offsets) > 0)))

    return docs.mapInArrow(run, docs.schema)
