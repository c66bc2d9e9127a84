import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cloudloom.llm import languages
from cloudloom.llm.queries import op8_language_id

SYLLABLES = {"xx": ["tha", "ing", "er", "on"], "yy": ["ção", "ña", "que", "los"], "zz": ["sch", "ü", "ber", "lich"]}


def corpus(n=400, seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        text = " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(rng.choice([4, 30, 200])))
        rows.append((i, text, lang))
    return rows


def test_held_out_accuracy(spark, tmp_path):
    rows = corpus()
    odd = [(9000, None, "xx"), (9001, "", "yy"), (9002, "123 .. 4", "zz"), (9003, "the ing", None), (None, "erthaing", "xx")]
    spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op8_language_id(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) + len(odd)
    held = [(got[i], lang) for i, _, lang in rows if got[i].held_out]
    assert len(held) > 60
    assert sum(r.lang_pred == lang for r, lang in held) / len(held) > 0.98
    assert {got[i].lang_pred for i in (9000, 9001, 9002)} == {"und"}
    assert all(0 <= r.score <= 1 for r in got.values())


def test_rejection_and_nothing_learnt(spark):
    rows = corpus(300)
    docs = spark.createDataFrame([(*r, "q") for r in rows], "doc_id long, text string, lang string, score string")
    model = languages.fit(docs, F.lit(True))
    odd = spark.createDataFrame([(1, "жзик лпн " * 20), (2, "thaing eron " * 20)], "doc_id long, text string")
    far = {r.doc_id: r.rejected for r in languages.predict(odd, model).collect()}
    assert far[1]
    none = languages.fit(docs.limit(0), F.lit(True))
    assert {(r.lang_pred, r.score) for r in languages.predict(odd, none).collect()} == {("und", 0.0)}
    assert languages.predict(docs.limit(0), model).collect() == []


def plain_counts(text):
    """Bucket counts of one text, n-gram by n-gram."""
    data = [c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in (text or "").encode()]
    data = [c for i, c in enumerate(data) if c != 32 or not i or data[i - 1] != 32]
    out = {}
    for n in languages.GRAMS:
        for i in range(len(data) - n + 1):
            h = data[i] + 1
            for c in data[i + 1 : i + n]:
                h = (h * 0x01000193 + c + 1) & 0xFFFFFFFF
            x = (h ^ (n * 0x9E3779B1 & 0xFFFFFFFF)) * 0x85EBCA6B & 0xFFFFFFFF
            x = ((x ^ (x >> 15)) * 0xC2B2AE35 & 0xFFFFFFFF) >> (32 - languages.BITS)
            out[x] = out.get(x, 0) + 1
    return out


def test_counts_equal_plain_ones():
    texts = [t for _, t, _ in corpus(150)] + [None, "", "A  b", "é" * 700_000, "x", "ab " * 600_000]
    got = [None] * len(texts)
    for i, j, c in languages.counts(pa.array(texts)):
        for r in range(i, j):
            got[r] = {int(g): int(c[r - i, g]) for g in np.flatnonzero(c[r - i])}
    assert got == [plain_counts(t) for t in texts]


def test_prediction_equals_plain_cosines(spark):
    docs = spark.createDataFrame(corpus(200), "doc_id long, text string, lang string")
    model = languages.fit(docs, F.lit(True), per_language=20)
    for r in languages.predict(docs.limit(40), model).collect():
        x = np.zeros(languages.SIZE)
        for g, n in plain_counts(r.text).items():
            x[g] = np.log1p(n) * model.idf[g]
        cosines = [float(x @ c) / np.linalg.norm(x) for c in model.centroids]
        assert abs(r.score - max(cosines)) < 1e-9
        assert r.lang_pred == model.names[model.owner[int(np.argmax(cosines))]]


def test_fit_of_repeated_rows_is_bounded_and_repeatable(spark):
    docs = spark.createDataFrame([(7, "tha ing", "xx")] * 300 + [(i, f"que los {i}", "yy") for i in range(300)], "doc_id long, text string, lang string")
    a, b = (languages.fit(docs.repartition(n), F.lit(True), per_language=10) for n in (2, 5))
    assert a.names == b.names == ["xx", "yy"]
    assert np.allclose(a.centroids, b.centroids)
