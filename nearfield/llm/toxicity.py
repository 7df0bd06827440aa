"""Toxicity by a chain of linear classifiers.

A chain has an order of categories. Each category's model is a logistic regression on the terms
of the text and on the probabilities of all earlier categories; when it is trained, those
probabilities are out-of-fold predictions, so that it learns what earlier models are worth on
texts they haven't seen. The last category is the decision.

Terms are runs of letters and digits, lower-cased and hashed to 64 bits, and the beginnings of
longer ones (``PREFIXES`` bytes), so that a stem is known with endings it wasn't seen with. The
vocabulary is the ``terms`` hashes that tell the last category's classes apart best (log-likelihood ratio of document
counts); a document is the set of vocabulary terms that it has, and how dense they are. Training
uses a bounded sample (``cap`` rows of each class, by hash); every whole text is scored. What is
chosen with labels (vocabulary, derived categories, models) is chosen anew without each fold, and
equal texts are in one fold, so out-of-fold probabilities have never seen the row's label.

Where only one label is known, earlier categories are derived from it (see ``derived``): texts of
the class that have several of the class's strongest terms (``hostile``), and texts with at
least one of these in a hundred words (``dense``).

Defined cases: null or empty text has no terms and gets the model's prior; null labels are not
used; a key with several labels counts as toxic if one says so; without rows of both classes no
text is toxic; a null key is kept; repeated rows are scored each.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linear
from . import textarrays as ta
from .common import slices

PREFIXES = (4, 5, 6)
FOLDS = 4
#: Terms of the sample whose counts are looked at: the ones that most of its documents have.
CANDIDATES = 1 << 16


def term_sets(data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray | None = None):
    """(distinct term hashes, how often each occurs, number of words) of each row; only the terms ``wanted`` (sorted) if given."""
    for first, last in slices(offsets, ta.SLICE):
        part, at = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        starts, ends, heads = ta.words(part, at, ta.TERM)
        row = np.repeat(np.arange(last - first), np.diff(heads))
        terms, rows = [ta.run_hashes(part, starts, ends, lower=True)], [row]
        for n in PREFIXES:
            longer = ends - starts > n
            terms.append(ta.mix(ta.run_hashes(part, starts[longer], starts[longer] + n, lower=True) ^ np.uint64(n)))
            rows.append(row[longer])
        terms, rows = np.concatenate(terms), np.concatenate(rows)
        if wanted is not None:
            known = wanted[np.minimum(np.searchsorted(wanted, terms), len(wanted) - 1)] == terms if len(wanted) else np.zeros(len(terms), bool)
            terms, rows = terms[known], rows[known]
        order = np.argsort(rows, kind="stable")
        ends_at = np.searchsorted(rows[order], np.arange(last - first + 1))
        terms = terms[order]
        for i, (a, b) in enumerate(zip(ends_at[:-1].tolist(), ends_at[1:].tolist(), strict=True)):
            yield *np.unique(terms[a:b], return_counts=True), int(heads[i + 1] - heads[i])


def vocabularies(term: np.ndarray, counts: np.ndarray, totals: np.ndarray, terms: int, least: int = 4) -> dict[frozenset, tuple[np.ndarray, np.ndarray]]:
    """For every set of folds, the term hashes that tell its classes apart best (sorted), and which speak for class 1 strongly.

    counts: documents with each term by fold and class; totals: all documents by fold and class.
    """
    out = {}
    part = lambda n, m: n * np.log(np.maximum(n, 1e-9) / np.maximum(m, 1e-9))
    for own in (list(s) for size in range(1, FOLDS + 1) for s in combinations(range(FOLDS), size)):
        n0, n1 = counts[:, own].sum(1).T
        total0, total1 = np.maximum(totals[own].sum(0), 1)
        share = (n1 + n0) / (total1 + total0)
        gain = part(n1, share * total1) + part(n0, share * total0) + part(total1 - n1, (1 - share) * total1) + part(total0 - n0, (1 - share) * total0)
        gain[n1 + n0 < least] = -1
        best = np.lexsort((term, -gain))[:terms]
        best = best[gain[best] > 6]
        best = best[np.argsort(term[best])]
        odds = np.log((n1[best] + 0.5) / (total1 + 1)) - np.log((n0[best] + 0.5) / (total0 + 1))
        out[frozenset(own)] = term[best], odds > 2
    return out


class Chain:
    """Models of the categories in order, on a vocabulary; ``bar``: on the last one's probability."""

    def __init__(self, words: np.ndarray, strong: np.ndarray, order: list[str], models: list[np.ndarray], bar: float):
        self.words, self.strong, self.order, self.models, self.bar = words, strong, order, models, bar

    def features(self, found: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
        """Presence of each vocabulary term, then the log of the strong terms' density."""
        terms, n, words = found
        x = np.zeros(len(self.words) + 1)
        if len(self.words) and len(terms):
            at = np.minimum(np.searchsorted(self.words, terms), len(self.words) - 1)
            hit = self.words[at] == terms
            x[at[hit]] = 1
            x[-1] = np.log1p(1000 * n[hit][self.strong[at[hit]]].sum() / max(words, 1))
        return x

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), 0))
        for w in self.models:
            out = np.hstack([out, linear.sigmoid(linear.score(np.hstack([x, out]), w))[:, None]])
        return out


def derived(features: np.ndarray, strong: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Labels of hostile, dense and the given category."""
    hostile = y * (features[:, :-1][:, strong].sum(1) >= 2)
    dense = y * (features[:, -1] >= np.log1p(10))
    return np.stack([hostile, dense, y], 1)


def train(found: list[tuple[np.ndarray, np.ndarray, int]], y: np.ndarray, part: np.ndarray, words: dict, order: list[str]) -> tuple[Chain, np.ndarray]:
    """The chain of all rows, and every row's out-of-fold probabilities.

    found: terms, their counts and the number of words of each row; part: its fold; words: from vocabularies().
    A set of folds has a chain of its own: its vocabulary, its derived categories, and models that see the earlier
    categories' probabilities as the chains without the row's fold give them. So no probability that a
    model learns from, nor any that the bar is set on, comes from something that has seen the row's label.
    """
    chains: dict[frozenset, Chain] = {frozenset(): Chain(np.zeros(0, np.uint64), np.zeros(0, bool), order, [np.zeros(k + 2) for k in range(len(order))], 0.5)}
    ahead = np.zeros((len(y), len(order)))
    for own in sorted(words, key=lambda s: (len(s), sorted(s))):
        chain = Chain(*words[own], order, [], 0.5)
        rows = np.flatnonzero(np.isin(part, sorted(own)))
        ahead = np.full((len(rows), len(order)), 0.5)
        for f in own:
            less, at = chains[own - {f}], np.flatnonzero(part[rows] == f)
            if len(at):
                ahead[at] = less.probabilities(np.stack([less.features(found[i]) for i in rows[at]]))
        x = np.stack([chain.features(found[i]) for i in rows]) if len(rows) else np.zeros((0, len(chain.words) + 1))
        for k, mark in enumerate(derived(x, chain.strong, y[rows]).T):
            chain.models.append(linear.fit(np.hstack([x, ahead[:, :k]]), mark))
        chains[own] = chain
    return chain, ahead


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", cap: int = 4000, terms: int = 256) -> Chain:
    """A chain from the labelled rows; cap: rows of each class that are used at most.

    Terms are counted in DataFrames; the counts of the ``CANDIDATES`` commonest (chosen without labels), and then the
    sample rows' vocabulary terms, come to the driver.
    """
    order = ["hostile", "dense", label]
    texts = docs.select(F.col(key).alias("key_"), F.col(text).cast("string").alias("text"))
    sample = linear.training_rows(texts, labels.select(F.col(key).alias("key_"), F.col(label).alias("y_")), "key_", "y_", ["text"], cap)
    sample = sample.select("y", F.pmod(F.xxhash64("text", F.lit("fold")), F.lit(FOLDS)).cast("int").alias("fold"), "text")

    def count(batches):
        for batch in batches:
            label, place = (batch.column(k).to_numpy() for k in (0, 1))
            sets = [s for s, _, _ in term_sets(*ta.buffers(batch.column(2)))]
            kind = np.repeat(2 * place + (label > 0), [len(s) for s in sets])
            every = np.concatenate([np.zeros(0, np.uint64), *sets])
            for k in np.unique(kind).tolist():
                term, n = np.unique(every[kind == k], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(np.full(len(term), k, np.int32)), pa.array(n)], ["term", "kind", "n"])

    none = Chain(np.zeros(0, np.uint64), np.zeros(0, bool), order, [np.array([0.0] * (k + 1) + [-8.0]) for k in range(3)], 0.5)
    totals = np.zeros((FOLDS, 2))
    for r in sample.groupBy("fold", "y").count().collect():
        totals[r.fold, int(r.y > 0)] += r["count"]
    if totals.sum() < 20 or not totals.sum(0).all():
        return none
    sums = [F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(f"c_{k}") for k in range(2 * FOLDS)]
    counts = sample.mapInArrow(count, "term long, kind int, n long").groupBy("term").agg(F.sum("n").alias("every"), *sums).filter("every > 3")
    counts = counts.orderBy(F.desc("every"), "term").limit(CANDIDATES).toArrow()
    per_kind = np.stack([counts.column(f"c_{k}").to_numpy() for k in range(2 * FOLDS)], 1).astype(float)
    words = vocabularies(counts.column("term").to_numpy().view(np.uint64), per_kind.reshape(-1, FOLDS, 2), totals, terms)
    wanted = np.unique(np.concatenate([w for w, _ in words.values()]))

    def look(batches):
        for batch in batches:
            sets = list(term_sets(*ta.buffers(batch.column(2)), wanted))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([s.tobytes() for s, _, _ in sets], pa.binary()), pa.array([n.astype(np.int32).tobytes() for _, n, _ in sets], pa.binary()), pa.array([w for _, _, w in sets], pa.int64())], ["y", "fold", "terms", "n", "words"])

    got = sample.mapInArrow(look, "y int, fold int, terms binary, n binary, words long").toArrow()
    got = got.sort_by([(c, "ascending") for c in ("fold", "y", "words", "terms", "n")])
    y, part, size = (got.column(c).to_numpy() for c in ("y", "fold", "words"))
    y = (y > 0).astype(float)
    found = [(np.frombuffer(t.as_py(), np.uint64), np.frombuffer(n.as_py(), np.int32), w) for t, n, w in zip(got.column("terms"), got.column("n"), size.tolist(), strict=True)]
    chain, ahead = train(found, y, part, words, order)
    chain.bar = linear.best_bar(ahead[:, -1], y)
    return chain


def predict(docs: DataFrame, chain: Chain, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, is_toxic, score, and the probabilities of the earlier categories) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(chain)
    kept = docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias("text"))
    early = [f"p_{c}" for c in chain.order[:-1]]

    def run(batches):
        own = sent.value
        for batch in batches:
            x = np.stack([own.features(f) for f in term_sets(*ta.buffers(batch.column(1)), own.words)]) if batch.num_rows else np.zeros((0, len(own.words) + 1))
            p = own.probabilities(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p[:, -1] >= own.bar), pa.array(p[:, -1]), *(pa.array(p[:, k]) for k in range(len(early)))], [key, "is_toxic", "score", *early])

    return kept.mapInArrow(run, f"{key} long, is_toxic boolean, score double, " + ", ".join(f"{c} double" for c in early))


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", **options) -> DataFrame:
    return predict(docs, fit(docs, labels, key, text, label, **options), key, text)


def clean_rows(docs: DataFrame, chain: Chain, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that aren't toxic, in the same columns."""
    sent, at = docs.sparkSession.sparkContext.broadcast(chain), docs.columns.index(text)

    def run(batches):
        own = sent.value
        for batch in batches:
            if batch.num_rows:
                x = np.stack([own.features(f) for f in term_sets(*ta.buffers(batch.column(at)), own.words)])
                yield batch.filter(pa.array(own.probabilities(x)[:, -1] < own.bar))

    return docs.mapInArrow(run, docs.schema)
