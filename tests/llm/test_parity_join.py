import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from nearfield.llm import common, parity_join
from nearfield.llm import textarrays as ta

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    """(key, size, component) by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and 100 * len(a & b) >= 75 * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        r = find(i)
        least[r] = k if least.get(r) is None else least[r] if k is None else min(k, least[r])
    return sorted(((k, len(sets[i]), least[find(i)]) for i, (k, _) in enumerate(rows)), key=str)


def run(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n int, cid string")
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in parity_join.join(docs).collect()), key=str)


def corpus(seed):
    r = random.Random(seed)
    vocabulary = ["".join(r.choices("abcdeé", k=4)) for _ in range(400)]
    text = lambda n: r.choices(vocabulary, k=n)
    passage = text(60)
    rows = []
    for size in (3, 8, 17, 40, 90, 300, 1500):
        base = text(size)
        for _ in range(8):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 2, max(1, size // 40), max(1, size // 25)])):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            rows.append(" ".join(copy[: r.choice([size, size, int(size * 0.8) or 1])]))
    rows += [" ".join(text(r.choice([4, 10, 20, 400])) + passage + text(r.choice([1, 5, 30]))) for _ in range(25)]
    rows += ["", None, " \t\n", "one", "ONE", "one two", "One  Two", "a b c d e", "a b c d e f", "É é", "é é"]
    rows += [rows[0]] * 30
    r.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("large", [False, True])
def test_against_all_pairs(spark, monkeypatch, large):
    """Also by the plans of large inputs: nothing is broadcast, and common chunks and classes are split."""
    if large:
        monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(parity_join, "HOT", 24)
        monkeypatch.setattr(parity_join, "HOT_COPIES", 10)
    rows = corpus(1 + large)
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("block", [50, 2048])
def test_large_group_of_near_copies(spark, monkeypatch, block):
    monkeypatch.setattr(parity_join, "BLOCK", block)
    r = random.Random(5)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(700):
        copy = list(base)
        copy[r.randrange(80)] = f"x{i}"
        rows.append((i, " ".join(copy)))
    got = run(spark, rows)
    assert got == brute(rows)


def test_odd_keys(spark):
    text, other = "a b c d e f g h", "q r s t u v w"
    rows = [(5, text), (5, text), (3, text.upper()), (None, text), (None, other), (None, other), (9, other + " x y z"), (9, None)]
    assert run(spark, rows) == brute(rows)
    base = [f"w{i}" for i in range(60)]
    near = [" ".join(base[:i] + [f"x{i}"] + base[i + 1 :]) for i in (7, 30, 45)]
    rows = [(k, t) for k, t in zip((4, 4, 4, 8, 8, None), (near[0], near[0], near[1], near[2], near[2], near[1]), strict=True)] * 2
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_one_of_each(spark):
    rows = [(1, "a b c d e f g h"), (2, "a b c d e f g h"), (2, "a b c d e f g h"), (3, "other words are in this one"), (3, "other words are in this one"), (4, None), (None, "lone")]
    rows += [(6, "a b c d e f g h"), (6, "lone"), (None, "a b c d e f g h"), (None, "only here"), (None, "only here"), (7, "only HERE")]
    docs = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, text string, of string, cid int")
    got = sorted(((r.doc_id, r.text) for r in parity_join.one_of_each(docs).collect()), key=str)
    assert got == sorted([(1, rows[0][1]), (3, rows[3][1]), (4, None), (6, "lone"), (7, "only HERE")], key=str)
    lone = docs.filter("doc_id is null")
    assert sorted(r.text for r in parity_join.one_of_each(lone).collect()) == ["a b c d e f g h", "lone", "only here"]


numbers = st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=300, unique=True)


@settings(max_examples=100, deadline=None)
@given(numbers, numbers, st.integers(0, 250))
def test_sketches_bound_the_difference(a, b, shared):
    x = np.unique(np.array(a + b[:shared], np.uint64))
    y = np.unique(np.array(b, np.uint64))
    assert parity_join.apart(parity_join.sketch(x), parity_join.sketch(y)[None])[0] <= len(np.setxor1d(x, y))


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 600), st.integers(0, 10_000), st.data())
def test_pigeonhole(n, seed, data):
    """Whatever the order of chunks, sets at the threshold share one of their first k + 1."""
    r = np.random.default_rng(seed)
    x = np.unique(r.integers(0, 2**63, n, np.uint64) * np.uint64(2))
    gone = data.draw(st.integers(0, parity_join.reach(len(x), 75, 100)))
    y = np.unique(np.concatenate([x[r.permutation(len(x))[: len(x) - gone // 2]], r.integers(0, 2**63, gone - gone // 2, np.uint64)]))
    same = len(np.intersect1d(x, y))
    if not len(y) or 100 * same < 75 * (len(x) + len(y) - same):
        return
    found = False
    for band in set(parity_join.bands(len(x), 75, 100)) & set(parity_join.bands(len(y), 75, 100)):
        first = [set(np.sort(parity_join.elements(s, band))[: parity_join.reach(len(s), 75, 100) + 1].tolist()) for s in (x, y)]
        found = found or bool(first[0] & first[1])
    assert found


def test_words_and_shingles():
    texts = ["a b c d e f", "A  B\tC d\x0be f", "a b c", "", None, "x" * 3_000_000 + " y"]
    sets = list(parity_join.shingle_sets(*ta.buffers(pa.array(texts))))
    assert [len(s) for s in sets] == [len(shingles(t)) for t in texts]
    assert np.array_equal(sets[0], sets[1])


@pytest.mark.parametrize("link", [True, False])
def test_last_pairs_are_given_once_for_each_component(spark, link):
    """A chunk of 200 classes whose dense sketches are equal: not every pair is given, whether they are linked or not."""
    shared = list(range(1, 101))
    sets = [np.array(sorted([h * 2**40 for h in shared] + [(i if link else 1000 * i + j) * 2**40 + 7 for j in range(1 if link else 60)]), np.uint64) for i in range(1, 201)]
    sets = [np.unique(s) for s in sets]
    steps = parity_join.size_steps(75, 100)
    ids = [parity_join.class_id(s, steps) for s in sets]
    known = spark.createDataFrame([(c, len(s), bytearray(64), bytearray(s.tobytes())) for c, s in zip(ids, sets, strict=True)], "cid long, n long, bits binary, hashes binary")
    chunk = spark.createDataFrame([(5, c, c) for c in ids], "elem long, cid long, comp long")
    got = [(r.x, r.y) for r in parity_join.cross_pairs(chunk, known, 75, 100, None).collect()]
    assert len(got) == (199 if link else 0) and len(set(got)) == len(got)
