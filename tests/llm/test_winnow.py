import hashlib
import random
import re

import pytest

from nearfield.llm import winnow

K, W = winnow.K, winnow.WINDOW


MASK = (1 << 64) - 1


def hashed(spark, kind, values):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}").selectExpr("i", "xxhash64(v) h").orderBy("i").collect()
    return [r.h for r in rows]


def grams(spark, text):
    """Hashes of the k-grams, the rolling hash word by word: rotate, take the oldest word out, the next one in."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if not words:
        return []
    h = hashed(spark, "string", words)
    if len(h) < K:
        return hashed(spark, "array<long>", [h])
    turn = lambda x, n: (x << n % 64 | x >> (64 - n) % 64) & MASK if n % 64 else x
    state, out = 0, []
    for i, x in enumerate(h):
        state = turn(state, 1) ^ x & MASK
        if i >= K:
            state ^= turn(h[i - K] & MASK, K)
        if i >= K - 1:
            out.append(state - (1 << 64) if state >> 63 else state)
    return hashed(spark, "long", out)


def selected(h):
    out = set()
    for at in range(max(1, len(h) - W + 1) if h else 0):
        window = h[at : at + W]
        least = min(window)
        out.add((least, at + max(i for i, x in enumerate(window) if x == least)))
    return out


TEXTS = ["", None, "one", "a b c d", "a b c d e", " ".join(f"w{i % 9}" for i in range(120)), " ".join(f"x{i}" for i in range(70)), "é 中文 ß " * 30]


def test_against_brute_force(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: {(s["hash"], s["place"]) for s in r.spans} for r in winnow.fingerprints(docs).collect()}
    for i, t in enumerate(TEXTS):
        assert got[i] == selected(grams(spark, t)), t


def test_match_guarantee(spark):
    r = random.Random(1)
    shared = [f"s{i}" for i in range(W + K - 1)]
    texts = [" ".join([f"a{r.random()}" for _ in range(r.randint(0, 60))] + shared + [f"b{r.random()}" for _ in range(r.randint(0, 60))]) for _ in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{s["hash"] for s in x.spans} for x in winnow.fingerprints(docs).collect()]
    assert all(a & b for a in sets for b in sets)


def compare(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, kind int, range string")
    return winnow.compare_with_edited(docs).collect()


def edited(text, following):
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def test_edited_and_next(spark):
    r = random.Random(2)
    rows = [(i * 3 - 20, " ".join(f"w{r.randint(0, 500)}é" for _ in range(r.choice([0, 1, 9, 100])))) for i in range(60)]
    rows[7] = (rows[7][0], None)
    r.shuffle(rows)
    got = {x.doc_id: x for x in compare(spark, rows)}
    order = sorted(rows)
    plain = {x.doc_id: x.fingerprint for x in winnow.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for (k, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        x, t, after = got[k], t or "", after or ""
        assert x.n_chars == len(t)
        assert x.edited_sha256 == hashlib.sha256(edited(t, after).encode()).hexdigest()
        assert x.fingerprint == plain[k]
        assert 0 <= x.near_edited <= 1 and 0 <= x.near_next <= 1
        if edited(t, after) == t:
            assert x.near_edited == 1 and x.fingerprint == x.edited_fingerprint


def test_likeness_by_sets(spark):
    a = " ".join(f"a{i}" for i in range(200))
    rows = [(1, a), (2, a), (3, " ".join(f"b{i}" for i in range(200)))]
    got = {x.doc_id: x for x in compare(spark, rows)}
    assert got[1].near_next == 1.0 and got[2].near_next == 0.0
    sets = {i: {h for h, _ in selected(grams(spark, t))} for i, t in ((0, a), (1, edited(a, rows[2][1])))}
    assert got[2].near_edited == pytest.approx(len(sets[0] & sets[1]) / len(sets[0] | sets[1]))


def test_odd_keys(spark):
    assert compare(spark, []) == []
    (one,) = compare(spark, [(5, "a b c d e f")])
    assert one.near_next == 1.0
    got = compare(spark, [(None, "a b"), (None, None), (7, "x y z"), (7, "x y z"), (7, "u v")])
    assert len(got) == 5
    for x in got:
        if x.doc_id is None and x.n_chars == 3:
            assert x.edited_sha256 == hashlib.sha256(b"a ").hexdigest() and x.near_next == 0.0
        if x.doc_id is None and x.n_chars == 0:
            assert x.near_next == 1.0


def test_bisection(spark):
    starts = [(-5, 3), (0, -7), (0, 2), (1, 1), (7, 0), (100, 9)]
    rows = [(i, j) for i in range(-9, 120) for j in (-9, 0, 1, 2, 8, 9)]
    placed = spark.createDataFrame(rows, "k long, m long").select("k", "m", winnow.range_of(winnow.F.col("k"), winnow.F.col("m"), starts).alias("at"))
    assert all(r.at == max([0, *(i for i, s in enumerate(starts) if s <= (r.k, r.m))]) for r in placed.collect())


def test_other_lengths(spark):
    """Any k and window: all windows by hand, on the hashes of the operator's own grams."""
    text = " ".join(f"w{i * i % 7}" for i in range(90))
    for k, window in ((1, 1), (2, 3), (3, 7), (4, 8), (7, 10)):
        row = spark.createDataFrame([(text,)], "t string").select(winnow.kept(winnow.F.col("t"), k, window).alias("k"), winnow.kept(winnow.F.col("t"), k, 1).alias("all")).first()
        every = row["all"]["hashes"]
        assert len(every) == 90 - k + 1
        want = {at + max(i for i in range(window) if every[at + i] == min(every[at : at + window])) for at in range(len(every) - window + 1)}
        assert row.k["places"] == sorted(want) and row.k["hashes"] == [every[i] for i in sorted(want)]


def test_long_unrelated_texts_share_nothing(spark):
    """Whole hashes: a million words against a million others."""
    made = spark.range(2).selectExpr("id doc_id", "array_join(transform(sequence(1, 1000000), i -> concat(if(id = 0, 'a', 'b'), i)), ' ') text")
    got = {r.doc_id: r for r in winnow.compare_with_edited(made).collect()}
    assert got[0].near_next == 0.0 and 0.3 < got[0].near_edited < 0.4
