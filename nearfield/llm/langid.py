"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text's letters are lower-cased; subwords of one to four letters (word ends marked) are hashed to
buckets. A document is the average of its subwords' embeddings; a linear softmax gives the
languages. Embeddings and softmax are trained together by stochastic gradient descent in numpy,
on a bounded sample (``per_lang`` distinct rows of each language, by hash). A fifth of the sample is kept
apart: it sets the temperature of the softmax, and the bar under which a prediction is rejected
(the accepted ones are to have the accuracy ``wanted``). Embedding and softmax are multiplied out for
prediction, so what is sent to the executors is buckets x languages numbers.

Defined cases: a text that is null or has no letter is ``und`` with score 0; without training rows
every text is; ties go to the first language by code point; texts of any length are read whole;
a null key is kept; repeated rows are predicted each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta
from .bpe import LETTER, _classes
from .common import slices
from .linear import bounded_sample

BUCKETS = 1 << 12
DIMENSIONS = 16
UNKNOWN = "und"


def bucket_counts(data: np.ndarray, offsets: np.ndarray):
    """For each row, how often each bucket occurs (None: no letter)."""
    letters = _classes() == LETTER
    for first, last in slices(offsets, ta.SLICE):
        rows = [data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace").lower() for i in range(first, last)]
        points = np.frombuffer(("\n" + "\n".join(rows) + "\n").encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(r) + 1 for r in rows])
        points = np.where(letters[points], points, 0).astype(np.uint64)
        code, open_ = points.copy(), points > 0
        grams = [(ta.mix(code) & np.uint64(BUCKETS - 1), open_)]
        for n in range(1, 4):
            code = code[:-1] * np.uint64(0x9E3779B97F4A7C15) + points[n:]
            inner = np.ones(len(code), bool)
            for j in range(1, n):
                inner &= points[j : len(points) - n + j] > 0
            inner &= (points[: len(code)] > 0) | (points[n:] > 0) if n == 1 else inner
            grams.append((ta.mix(code + np.uint64(n)) & np.uint64(BUCKETS - 1), inner))
        for a, b in zip([0, *ends[:-1]], ends, strict=True):
            if not open_[a + 1 : b].any():
                yield None
                continue
            own = [g[a : b + 1 - n][k[a : b + 1 - n]] for n, (g, k) in enumerate(grams)]
            yield np.bincount(np.concatenate(own).astype(np.int64), minlength=BUCKETS)


def train(x: np.ndarray, y: np.ndarray, classes: int, epochs: int = 12, rate: float = 20.0, batch: int = 32, seed: int = 3) -> np.ndarray:
    """buckets x classes matrix: embeddings times softmax weights. x: rows of bucket shares."""
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 0.3, (x.shape[1], DIMENSIONS)).astype(np.float32)
    w = np.zeros((DIMENSIONS, classes), np.float32)
    w += rng.normal(0, 0.3, w.shape)
    steps, done = epochs * -(-len(x) // batch), 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for k in range(0, len(x), batch):
            at = order[k : k + batch]
            hidden = x[at] @ e
            z = hidden @ w
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(at)), y[at]] -= 1
            p /= len(at)
            now = rate * (1 - done / steps)
            back = x[at].T @ (p @ w.T)
            w -= now * 0.1 * (hidden.T @ p)
            e -= now * back
            done += 1
    return e @ w


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(-1, keepdims=True))
    return p / p.sum(-1, keepdims=True)


class Model:
    """languages, matrix (buckets x languages), temperature, bar."""

    def __init__(self, languages: list[str], matrix: np.ndarray, temperature: float, bar: float):
        self.languages, self.matrix, self.temperature, self.bar = languages, matrix, temperature, bar

    def predict(self, counts: np.ndarray | None) -> tuple[str, float, bool]:
        """(language, calibrated probability, rejected)."""
        if counts is None or not self.languages:
            return UNKNOWN, 0.0, True
        p = _softmax((counts @ self.matrix) / counts.sum() / self.temperature)
        k = int(np.argmax(p))
        return self.languages[k], float(p[k]), bool(p[k] < self.bar)


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = 600, wanted: float = 0.995) -> Model:
    """A model from the rows of ``labelled`` whose text and lang are known."""
    rows = labelled.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), F.col(lang).alias("lang"))
    sample = bounded_sample(rows.filter("text is not null"), "lang", ["key", "text"], per_lang)

    def run(batches):
        for batch in batches:
            found = [(g, np.flatnonzero(c), c) for g, c in zip(batch.column(0).to_pylist(), bucket_counts(*ta.buffers(batch.column(1))), strict=True) if c is not None]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1].astype(np.uint16).tobytes() for f in found], pa.binary()), pa.array([f[2][f[1]].astype(np.float32).tobytes() for f in found], pa.binary())], ["lang", "at", "n"])

    got = sorted((r.lang, bytes(r["at"]), bytes(r["n"])) for r in sample.select("lang", "text").mapInArrow(run, "lang string, at binary, n binary").collect())
    languages = sorted({g[0] for g in got})
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), 1.0, 1.0)
    x = np.zeros((len(got), BUCKETS), np.float32)
    for row, (_, at, n) in zip(x, got, strict=True):
        share = np.frombuffer(n, np.float32)
        row[np.frombuffer(at, np.uint16)] = share / share.sum()
    y = np.array([languages.index(g[0]) for g in got])
    apart = np.random.default_rng(5).permutation(len(got)) % 5 == 0
    if apart.all() or not apart.any():
        apart[:] = False
    matrix = train(x[~apart], y[~apart], len(languages))
    if not apart.any():
        return Model(languages, matrix, 1.0, 0.0)
    z, truth = x[apart] @ matrix, y[apart]
    loss = lambda t: -np.log(_softmax(z / t)[np.arange(len(truth)), truth] + 1e-12).mean()
    temperature = float(min(np.geomspace(0.05, 8, 40), key=loss))
    p = _softmax(z / temperature)
    top, right = p.max(1), p.argmax(1) == truth
    order = np.argsort(-top, kind="stable")
    accuracy = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    enough = np.flatnonzero(accuracy >= wanted)
    return Model(languages, matrix, temperature, float(top[order][enough[-1]]) if len(enough) else 1.0)


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score, rejected): lang_pred is the likeliest language also where it is rejected."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias("text"))

    def run(batches):
        own = sent.value
        for batch in batches:
            rows = [own.predict(c) for c in bucket_counts(*ta.buffers(batch.column(1)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.bool_())], [key, "lang_pred", "score", "rejected"])

    return kept.mapInArrow(run, f"{key} long, lang_pred string, score double, rejected boolean")


def held_out(key: str = "doc_id"):
    """Whether crc32 of the key as text is divisible by 5 (null: as the empty string)."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", **options) -> DataFrame:
    """Learn from the rows that aren't held out, predict all rows."""
    model = fit(docs.filter(~held_out(key)), key, text, lang, **options)
    return predict(docs, model, key, text).select(key, held_out(key).alias("held_out"), "lang_pred", "score", "rejected")
