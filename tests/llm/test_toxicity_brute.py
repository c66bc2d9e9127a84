"""The classifier against a plain one: sets of n-grams in dictionaries, and Newton's method on the rows' products."""

import zlib

import numpy as np
import pytest

from cloudloom.llm import toxicity
from cloudloom.llm.queries import op1_toxicity
from test_toxicity import corpus

M = 0xFFFFFFFF


def gram_set(text):
    """Hashes of the text's n-grams, one n-gram after the other."""
    b = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode()
    out = set()
    for n in toxicity.GRAMS:
        for i in range(len(b) - n + 1):
            h = 0
            for c in b[i : i + n]:
                h = (h * 0x01000193 + c + 1) & M
            h ^= n * 0x9E3779B1 & M
            h = (h ^ h >> 15) * 0x85EBCA6B & M
            h = (h ^ h >> 13) * 0xC2B2AE35 & M
            out.add(h >> 32 - toxicity.BITS)
    return out


def plain_scores(train, texts):
    """Scores of texts, learnt from (text, y) rows, at the least penalised loss."""
    sets = [gram_set(t) for t, _ in train]
    y = np.array([float(k) for _, k in train])
    count = {}
    for s, k in zip(sets, y, strict=True):
        for g in s:
            count.setdefault(g, [0, 0])[int(k)] += 1
    total = [int((1 - y).sum()), int(y.sum())]
    ratio = {g: np.log((t + 1) / (total[1] + 2)) - np.log((c + 1) / (total[0] + 2)) for g, (c, t) in count.items()}
    place = {g: k for k, g in enumerate(ratio)}

    def features(rows):
        x = np.zeros((len(rows), len(place)))
        for r, s in enumerate(rows):
            for g in s & place.keys():
                x[r, place[g]] = ratio[g]
        return x

    x = features(sets)
    k, n = x @ x.T, len(y)
    a, b = np.zeros(n), 0.0
    for _ in range(100):  # Newton's method; at the end a = y - p
        f = k @ a + b
        p = 1 / (1 + np.exp(-f))
        w = np.maximum(p * (1 - p), 1e-12)
        system = np.block([[k + np.diag(1 / w), np.ones((n, 1))], [np.ones((1, n)), np.zeros((1, 1))]])
        solved = np.linalg.solve(system, np.append(f + (y - p) / w, 0.0))
        a, b = solved[:-1], solved[-1]
    assert np.abs(a - (y - 1 / (1 + np.exp(-(k @ a + b))))).max() < 1e-6
    return 1 / (1 + np.exp(-(features([gram_set(t) for t in texts]) @ (x.T @ a) + b)))


def test_query_equals_a_plain_classifier(spark, tmp_path):
    docs, labels = corpus(260, 4)
    docs = [(i, t if len(t) < 500 else t[:500] + " Éßé 💡 end") for i, t in docs] + [(9000, None), (9001, ""), (9002, "zo"), (9003, "ZORKISH")]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    truth = {i: y for i, _, y in labels}
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, _ in docs}
    want = plain_scores([(t, truth[i]) for i, t in docs if i in truth and not held[i]], [t for _, t in docs])
    got = {r.doc_id: r for r in op1_toxicity(spark, str(tmp_path)).collect()}
    assert len(got) == len(docs)
    assert {i: r.held_out for i, r in got.items()} == held
    assert [got[i].score for i, _ in docs] == pytest.approx(want, abs=1e-3)
    assert all(got[i].predicted == (s >= 0.3) for (i, _), s in zip(docs, want, strict=True) if abs(s - 0.3) > 1e-3)
