import random
import zlib

import numpy as np
import pytest

from nearfield.llm import langid, linear, quality, toxicity

LANGUAGES = {"xx": "tha ing ere oun str", "yy": "zio que ña ll ez", "zz": "schö ung ei keit ße"}


def text(r, lang, n):
    parts = LANGUAGES[lang].split()
    return " ".join("".join(r.choices(parts, k=r.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def documents(spark):
    r = random.Random(1)
    rows = []
    for i in range(500):
        lang = r.choice(list(LANGUAGES))
        body = text(r, lang, r.randint(10, 80)).capitalize() + "."
        toxic, good = i % 5 == 0, i % 4 != 0
        if toxic:
            words = body.split()
            for _ in range(4):
                words.insert(r.randrange(len(words)), r.choice(["grobb", "grobben", "mukk", "mukkel"]) + r.choice(["", "a", "ot"]))
            body = " ".join(words)
        if not good:
            body = " ".join(w + r.choice(["###", "%%%", "&&&"]) for w in body.split())
        rows.append((i, body, lang, f"s{i % 7}", len(body), int(good), int(toxic)))
    rows += [(1000, None, "xx", "s1", None, None, None), (1001, "", None, None, 0, None, None), (1002, "123 ... ###", "yy", "s1", 11, None, None), (None, text(r, "zz", 30), "zz", "s2", 100, None, None), (1003, text(r, "xx", 60_000), "xx", "s3", 1, None, None)]
    rows += [rows[1]] * 3
    return rows


def frames(spark, rows):
    docs = spark.createDataFrame([(*x[:5], 1.0, 2) for x in rows], "doc_id long, text string, lang string, source string, n_chars long, score double, key int")
    labels = spark.createDataFrame([(x[0], x[5], x[6]) for x in rows if x[0] is None or x[0] % 3 or x[5] is None], "doc_id long, quality int, toxic int")
    return docs, labels


def test_languages(spark, documents):
    docs, _ = frames(spark, documents)
    got = langid.identify(docs).collect()
    truth = {x[0]: x for x in documents}
    assert len(got) == len(documents)
    right = [r.lang_pred == truth[r.doc_id][2] for r in got if r.doc_id is not None and r.doc_id < 1000 and r.held_out]
    assert np.mean(right) > 0.98 and len(right) > 50
    for r in got:
        assert 0 <= r.score <= 1
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0)
        if r.doc_id in (1000, 1001, 1002):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
    long = next(r for r in got if r.doc_id == 1003)
    assert long.lang_pred == "xx"


def test_languages_do_not_use_held_out_labels(spark, documents):
    changed = [(x[0], x[1], "zz" if x[0] is not None and zlib.crc32(str(x[0]).encode()) % 5 == 0 else x[2], *x[3:]) for x in documents]
    one = langid.identify(frames(spark, documents)[0]).select("doc_id", "lang_pred", "score")
    two = langid.identify(frames(spark, changed)[0]).select("doc_id", "lang_pred", "score")
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))


def test_without_training_rows(spark, documents):
    docs, labels = frames(spark, documents)
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", docs.lang.substr(9, 1)).replace("", None, ["lang"])).collect()} == {"und"}
    assert not any(r.is_toxic for r in toxicity.classify(docs, labels.limit(0)).collect())
    assert all(r.keep == bool(r.score) for r in quality.classify(docs, labels.limit(0)).collect())
    none = docs.limit(0)
    assert langid.identify(none).collect() == [] and toxicity.classify(none, labels).collect() == [] and quality.classify(none, labels).collect() == []


def test_toxicity(spark, documents):
    docs, labels = frames(spark, documents)
    got = toxicity.classify(docs, labels).collect()
    assert len(got) == len(documents)
    wrong = [r.doc_id for r in got if r.doc_id is not None and r.doc_id < 1000 and r.is_toxic != (r.doc_id % 5 == 0)]
    assert len(wrong) <= 2
    assert not any(r.is_toxic for r in got if r.doc_id is None or r.doc_id >= 1000)
    kept = toxicity.clean_rows(docs, toxicity.fit(docs, labels))
    assert kept.columns == docs.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(r.doc_id) for r in got if not r.is_toxic)


def test_stems_reach_unseen_endings(spark, documents):
    docs, labels = frames(spark, documents)
    chain = toxicity.fit(docs, labels)
    fresh = spark.createDataFrame([(1, "tha ing grobbissimo ere mukkelheim oun"), (2, "tha ing ere oun")], "doc_id long, text string")
    assert {r.doc_id: r.is_toxic for r in toxicity.predict(fresh, chain).collect()} == {1: True, 2: False}


def test_quality(spark, documents):
    docs, labels = frames(spark, documents)
    got = quality.classify(docs, labels).collect()
    wrong = [r.doc_id for r in got if r.doc_id is not None and r.doc_id < 1000 and r.keep != (r.doc_id % 4 != 0)]
    assert len(wrong) <= 4
    assert not any(r.keep for r in got if r.doc_id in (1000, 1001))
    kept = quality.kept_rows(docs, quality.fit(docs, labels))
    assert kept.columns == docs.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(r.doc_id) for r in got if r.keep)


def test_views_teach_each_other():
    """Each view knows half of the classes' signs; the pool links them."""
    r = np.random.default_rng(0)
    y = r.integers(0, 2, 600).astype(float)
    a, b = (np.stack([y * 2 - 1 + r.normal(0, 0.7, 600), r.normal(size=600)], 1) for _ in range(2))
    model = quality.co_train([a[:24], b[:24]], y[:24], [a[24:], b[24:]])
    p = model.score([a, b])
    assert ((p > 0.5) == y).mean() > 0.95


def test_logistic_regression_by_gradient():
    r = np.random.default_rng(1)
    x = r.normal(size=(300, 4))
    y = (x @ [2, -1, 0, 0.5] + r.normal(size=300) > 0).astype(float)
    w = linear.fit(x, y, 1.0)
    z = np.hstack([x, np.ones((300, 1))])
    slope = z.T @ (linear.sigmoid(z @ w) - y) + np.append(w[:-1], 0)
    assert np.abs(slope).max() < 1e-3


def test_out_of_fold_models_have_not_seen_the_row():
    r = np.random.default_rng(2)
    x, y = r.normal(size=(120, 60)), r.integers(0, 2, 120).astype(float)
    assert ((linear.out_of_fold(x, y) > 0) == y).mean() < 0.7 < ((linear.score(x, linear.fit(x, y)) > 0) == y).mean()


def test_bounded_sample(spark):
    """A hot key, null groups, repeated rows: exactly the cap, or all distinct rows of a small group."""
    rows = [(7, "same", "a")] * 4000 + [(7, f"t{i}", "a") for i in range(300)] + [(i, "x", "b") for i in range(40)] + [(None, "n", "b"), (1, "x", None)]
    frame = spark.createDataFrame(rows, "key long, text string, group string")
    got = linear.bounded_sample(frame, "group", ["key", "text"], 100).collect()
    again = linear.bounded_sample(frame.repartition(3), "group", ["key", "text"], 100).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(set(got)) == len(got)
    assert sum(r.group == "a" for r in got) == 100 and sum(r.group == "b" for r in got) == 41
    assert linear.bounded_sample(frame.limit(0), "group", ["key"], 5).collect() == []


def test_training_rows_are_bounded_and_the_pool_has_no_label(spark):
    docs = spark.createDataFrame([(1, f"t{i}") for i in range(500)] + [(i, "u") for i in range(2, 60)] + [(None, "v")], "k long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 30)] + [(3, 1), (900, 1), (None, 1), (40, None)], "k long, y_ int")
    got = linear.training_rows(docs, labels, "k", "y_", ["k", "text"], 50, 20).collect()
    assert sum(r.y == 1 for r in got) == 50 and sum(r.y == 0 for r in got) == 14 and sum(r.y == -1 for r in got) == 20
    assert all((r.y == -1) == (r.k >= 30) for r in got)


def auc(p, y):
    one, two = p[y == 1][:, None], p[y == 0][None]
    return ((one > two) + 0.5 * (one == two)).mean()


def test_random_labels_give_chance_out_of_fold(spark, monkeypatch):
    """Nothing that was chosen with a row's label reaches the probabilities that the bar is set on."""
    r = random.Random(4)
    docs = spark.createDataFrame([(i, text(r, "xx", 40)) for i in range(600)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, r.randint(0, 1)) for i in range(600)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity.linear, "best_bar", lambda p, y: seen.append((p, y)) or 0.5)
    toxicity.fit(docs, labels)
    p, y = seen[0]
    assert len(y) == 600 and 0.42 < auc(p, y) < 0.58


def test_random_labels_give_chance_in_co_training(monkeypatch):
    r = np.random.default_rng(6)
    y = r.integers(0, 2, 400).astype(float)
    x, pool = ([r.normal(size=(400, 30)) for _ in range(2)] for _ in range(2))
    seen = []
    monkeypatch.setattr(quality.linear, "fit", lambda z, marks, l2=1.0, own=linear.fit: seen.append((z, marks)) or own(z, marks, l2))
    quality.co_train(x, y, pool, sure=0.7)
    odds = next(z for z, marks in seen if z.shape[1] == 2 and len(marks) == 400)
    for v in range(2):
        assert 0.4 < auc(odds[:, v], y) < 0.6
