import numpy as np
import pytest

from cloudloom.llm import near_vectors


def brute(rows, least=0.98):
    n = len(rows)
    near = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            a, b = rows[i][1], rows[j][1]
            if i != j and rows[i][2] is not None and rows[i][2] == rows[j][2] and a and b and None not in a and None not in b and len(a) == len(b):
                a, b = np.array(a, "f4").astype(float), np.array(b, "f4").astype(float)
                if np.isfinite(a).all() and np.isfinite(b).all() and a.any() and b.any():
                    near[i, j] = a @ b / np.sqrt((a @ a) * (b @ b)) >= least
    root = list(range(n))
    for _ in range(n):
        new = [min([root[i], *(root[j] for j in np.flatnonzero(near[i]))]) for i in range(n)]
        if new == root:
            break
        root = new
    least_id = {}
    for i in range(n):
        least_id[root[i]] = min(rows[i][0], least_id.get(root[i], rows[i][0]))
    return [(rows[i][0], int(near[i].sum()), least_id[root[i]], rows[i][0] == least_id[root[i]]) for i in range(n)], near


def corpus(seed=0, dim=64):
    rng = np.random.default_rng(seed)
    rows, i = [], 0
    for label in (1, 2):
        for _ in range(12):
            base = rng.normal(size=dim)
            for _ in range(int(rng.choice([1, 2, 6, 30]))):
                rows.append((1000 - i, (base + rng.normal(size=dim) * rng.choice([0.0, 0.05, 0.12])).tolist(), label))
                i += 1
    same = rows[0][1]
    rows += [(5000, same, None), (5001, None, 1), (5002, [0.0] * dim, 1), (5003, [None, *same[1:]], 1), (5004, [float("nan"), *same[1:]], 1), (5005, [], 1), (5006, same[:10], 1), (5007, [x * 2 for x in same], 1)]
    return rows


@pytest.mark.parametrize("block", [2048, 8])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near_vectors, "BLOCK", block)
    rows = corpus()
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, keys string").repartition(3)
    want, _ = brute(rows)
    assert sorted(map(tuple, near_vectors.near_duplicate_vectors(df).collect())) == sorted(want)


def test_recall_close_to_the_threshold():
    rng = np.random.default_rng(5)
    a = rng.normal(size=(4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=a.shape)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    b = 0.98 * a + np.sqrt(1 - 0.98**2) * b
    x, y = near_vectors.polytope_keys(a, 10), near_vectors.polytope_keys(b, 10)
    recall = (x[:, :, None] == y[:, None, :]).any((1, 2)).mean()
    print("recall", recall)
    assert recall >= 0.999


def test_odd_tables(spark):
    assert near_vectors.near_duplicate_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []
    df = spark.createDataFrame([(3, [1.0, 2.0], 1), (3, [1.0, 2.0], 1), (1, [1.0], 1)], "vec_id long, embedding array<float>, label int")
    assert sorted(map(tuple, near_vectors.near_duplicate_vectors(df).collect())) == [(1, 0, 1, True), (3, 1, 3, True), (3, 1, 3, True)]
