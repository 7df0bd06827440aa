import hashlib
import math
import random
import re

import pytest

from nearfield.llm import mixing


def brute(rows, quality=None, weights=(5.0, 2.0, 1.0), share=1.5, cap=2.0):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted({s for _, _, s in rows if s is not None}) + ([None] if any(s is None for _, _, s in rows) else [])
    w = {n: weights[i % 3] for i, n in enumerate(names)}
    total = {n: sum(size(t) for _, t, s in rows if s == n) for n in names}
    budget, target, open_ = share * sum(total.values()), {}, set(names)
    while open_:  # what is cut off is shared again
        left = budget - sum(target.values())
        level = left / sum(w[n] for n in open_)
        over = {n for n in open_ if w[n] * level >= cap * total[n]}
        if not over:
            target |= {n: w[n] * level for n in open_}
            break
        target |= {n: cap * total[n] for n in over}
        open_ -= over
    out = []
    for n in names:
        own = [(k, size(t)) for k, t, s in rows if s == n]
        epochs = int(target[n] // total[n]) if total[n] else 0
        rest = math.floor(target[n] + 1e-9) - epochs * total[n]
        keyed = []
        for k, z in own:
            u = (int(hashlib.md5(("" if k is None else str(k)).encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            q = (quality or {}).get(k)
            keyed.append((-math.log(u) / {None: 0.5, 0: 0.25, 1: 1.0}[q], k is None, k or 0, z, k))
        for _, _, _, z, k in sorted(keyed, key=lambda x: x[:4]):
            part = max(0, min(z, rest))
            rest -= z
            out.append((k, z, total[n], target[n], epochs * z + part))
    return sorted(out, key=str)


def documents(n, seed=0):
    r = random.Random(seed)
    return [(i, " ".join(["w"] * r.choice([0, 1, 3, 10, 200])) if r.random() > 0.05 else None, r.choice(["a"] * 5 + ["b", "c", "d", None])) for i in range(n)]


def run(spark, rows, labels=None):
    docs = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "doc_id long, text string, source string, size int, key double")
    quality = None if labels is None else spark.createDataFrame(list(labels.items()), "doc_id long, quality int")
    return [(r.doc_id, r["size"], r.source_size, r.target, r.taken) for r in mixing.mix(docs, quality=quality).collect()]


@pytest.mark.parametrize("n", [1, 7, 600])
def test_against_brute_force(spark, n):
    rows = documents(n, n)
    labels = {i: i % 2 for i in range(0, n, 3)}
    got, want = sorted(run(spark, rows, labels), key=str), brute(rows, labels)
    assert [g[:3] + g[4:] for g in got] == [x[:3] + x[4:] for x in want]
    assert [g[3] for g in got] == pytest.approx([x[3] for x in want])


def test_targets_are_met(spark):
    rows = documents(900, 4)
    got = run(spark, rows)
    taken, target = {}, {}
    for (k, _, s), x in zip(sorted(rows), sorted(got), strict=True):
        assert k == x[0] and x[4] <= 2 * x[1]
        taken[s], target[s] = taken.get(s, 0) + x[4], x[3]
    assert all(abs(taken[s] - target[s]) <= 1 for s in taken)
    assert sorted(got) == sorted(run(spark, rows))


def test_odd_tables(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None, None), (None, "", "a")]) and all(x[4] == 0 for x in run(spark, [(1, None, None), (None, "", "a")]))
    twice = [(5, "a b c", "s")] * 4 + [(None, "x y", "s")] * 2 + [(5, "other", "s"), (9, "long " * 3000, "t")]
    got = run(spark, twice)
    assert len(got) == 8 and sum(x[4] for x in got) in (math.floor(1.5 * 3017), math.floor(1.5 * 3017) - 1)


def test_mixed_rows(spark):
    rows = documents(400, 9)
    docs = spark.createDataFrame([(*r, "en", len(r[1] or "")) for r in rows], "doc_id long, text string, source string, lang string, n_chars long")
    decided = {r.doc_id: r for r in mixing.mix(docs).collect()}
    made = {}
    for r in mixing.mixed_rows(docs).collect():
        assert r.n_chars == len(r.text or "")
        made.setdefault(r.doc_id, []).append(len((r.text or "").split()))
    for k, r in decided.items():
        assert sum(made.get(k, [])) == r.taken
        assert sorted(made.get(k, [])) == sorted([r["size"]] * r.epochs + ([r.part] if r.part else [])) or r["size"] == 0
    assert mixing.mixed_rows(docs).columns == docs.columns
