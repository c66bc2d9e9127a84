import random

import pytest

from cloudloom.llm import toxicity
from cloudloom.llm.queries import op1_toxicity


def corpus(n=600, seed=0):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        w = rng.choices(words, k=rng.choice([5, 60, 400]))
        bad = rng.random() < 0.2
        if bad:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(["Zorkish", "quuxlike"]))
        docs.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    return docs, labels


def test_held_out_accuracy(spark, tmp_path):
    docs, labels = corpus()
    extra = [(9000, None), (9001, ""), (9002, "zorkish"), (9002, "zorkish"), (None, "plain")]
    spark.createDataFrame(docs + extra, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = op1_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == len(docs) + len(extra)
    truth = {i: y for i, _, y in labels}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 100
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert len({r.score for r in got if r.doc_id == 9002}) == 1
    assert {r.predicted for r in got if r.doc_id in (9000, 9001)} == {0}


def test_without_classes_and_with_other_columns(spark):
    rows = spark.createDataFrame([(1, "a b c", 1)], "doc_id long, text string, y int")
    docs = spark.createDataFrame([("x", 2.0, "a b"), ("y", 1.0, None)], "doc_id string, score double, text string")
    model = toxicity.fit(rows)
    got = toxicity.score(docs, model).collect()
    assert len(got) == 2 and all(r.score > 0.9 for r in got)
    model = toxicity.fit(rows.limit(0))
    assert [r.score for r in toxicity.score(docs, model).collect()] == pytest.approx([0.001, 0.001], abs=1e-4)
    assert toxicity.score(docs.limit(0), model).collect() == []


def test_few_rows_are_learnt_from(spark):
    rows = [(i, f"{'a nasty grumblefoot remark' if i % 2 else 'a kind and gentle word'} number {i}", i % 2) for i in range(20)]
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, y int"))
    new = spark.createDataFrame([(1, "such a grumblefoot"), (2, "a gentle word")], "doc_id long, text string")
    assert {r.doc_id: r.predicted for r in toxicity.score(new, model).collect()} == {1: 1, 2: 0}


def test_a_bound_on_entries_keeps_the_surest(spark):
    docs, labels = corpus()
    rows = spark.createDataFrame([(i, t, y) for (i, t), (_, _, y) in zip(docs, labels, strict=True)], "doc_id long, text string, y int")
    model = toxicity.fit(rows, most_entries=4000)
    assert 0 < model.wanted.sum() < 4000
    got = toxicity.score(rows, model).collect()
    assert sum(r.predicted == r.y for r in got) / len(got) > 0.97
