import random

import corpus_pipeline
import pytest

from nearfield.llm import queries as registered
from tests.llm.test_mixing import brute as mix_brute
from tests.llm.test_parity_join import brute as near_brute


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(3)
    vocabulary = ["".join(r.choices(["tha", "ing", "ere", "oun"], k=r.randint(1, 4))) for _ in range(600)]
    rows, labels = [], []
    for i in range(300):
        words = r.choices(vocabulary, k=r.randint(8, 90))
        kind = r.choice(["good"] * 6 + ["junk", "toxic"])
        if kind == "toxic":
            words = [w if r.random() < 0.8 else r.choice(["mukk", "grobb"]) for w in words]
        text = "".join(w + "###" * (kind == "junk") + (" ", " ", "\n", "\t\t")[k % 4] for k, w in enumerate(words))
        if i % 10 == 9 and kind == "good" and rows[-1][5] == "good":
            text = rows[-1][1]
        rows.append((i, text, "en", f"src{i % 3}", len(text), kind))
        if i % 2:
            labels.append((i, int(kind != "junk"), int(kind == "toxic")))
    path = tmp_path_factory.mktemp("docs")
    spark.createDataFrame([x[:5] for x in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), rows


def test_stages(spark, folder):
    path, rows = folder
    kinds = {x[0]: x[5] for x in rows}
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near duplicates", "mixing", "encoding"]
    seen = docs
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in seen.collect()}
        after = stage(spark, seen, path)
        ids = [r.doc_id for r in after.collect()]
        if name == "quality":
            assert sum(kinds[i] == "junk" for i in ids) <= 1 and sum(kinds[i] != "junk" for i in before) - len(ids) <= 3
        elif name == "toxicity":
            assert sum(kinds[i] == "toxic" for i in ids) <= 1 and sum(kinds[i] == "good" for i in before) - len(ids) <= 3
        elif name == "near duplicates":
            assert sorted(ids) == sorted(k for k, _, c in near_brute(list(before.items())) if k == c)
        elif name == "mixing":
            assert set(ids) <= set(before) and len(ids) > len(set(ids))
        else:
            assert len(ids) == seen.count()
        if name != "encoding":
            assert after.columns == docs.columns
            seen = after


def test_mixing_takes_what_the_quality_weights_say(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{path}/labels.parquet").collect()}
    taken = {x[0]: 0 for x in rows}
    texts = {x[0]: x[1] for x in rows}
    for r in corpus_pipeline.mixing_stage(spark, docs, path).collect():
        taken[r.doc_id] += len(r.text.split())
        assert texts[r.doc_id].startswith(r.text) and r.n_chars == len(r.text)
    assert taken == {x[0]: x[4] for x in mix_brute([(x[0], x[1], x[3]) for x in rows], labels)}


def test_run(spark, folder):
    path, _ = folder
    got = corpus_pipeline.run(spark, path)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and got.count() > 100


def test_registered():
    names = list(registered.queries())
    assert [n.split("_")[0] for n in names[:10]] == [f"op{i}" for i in range(1, 11)] and names[10] == "pipeline"
    assert set(registered.oracle_sql()) <= set(names)
