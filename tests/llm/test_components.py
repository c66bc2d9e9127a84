import numpy as np
import pytest

from cloudloom.llm import kernels
from cloudloom.operators.graph import connected_components


def brute(pairs):
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in pairs:
        ra, rb = find(a), find(b)
        root[max(ra, rb)] = min(ra, rb)
    return {i: find(i) for i in root}


@pytest.mark.parametrize("one_task", [1 << 20, 0])
@pytest.mark.parametrize("shape", ["chain", "star", "random"])
def test_known_graphs(spark, shape, one_task):
    rng = np.random.default_rng(1)
    pairs = {"chain": [(i, i + 1) for i in range(300)], "star": [(999, i) for i in range(200)], "random": [(int(a), int(b)) for a, b in rng.integers(0, 400, (330, 2)) if a != b]}[shape]
    df = spark.createDataFrame(pairs + [(5, 5), (None, 1)], "u long, v long").repartition(9)
    got = connected_components(df, one_task=one_task).collect()
    assert {r.node: r.component for r in got} == brute(pairs) and len(got) == len({i for p in pairs for i in p})


def test_empty(spark):
    assert connected_components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_kernels():
    data = np.frombuffer("Ab é\tx\n\n cd".encode(), np.uint8)
    h, at = kernels.words(data, np.array([0, 3, 3, len(data)]))
    assert np.diff(at).tolist() == [1, 0, 3]
    again, _ = kernels.words(np.frombuffer(b"aB", np.uint8), np.array([0, 2]))
    assert again[0] == h[0]
    big = b"word other " * 200_000
    rows = np.array([0, 700_000, 1_500_000, len(big)])
    a, b = kernels.words(np.frombuffer(big, np.uint8), rows)
    assert sum(len(big[s:e].split()) for s, e in zip(rows[:-1], rows[1:], strict=True)) == len(a) == b[-1]
    n, x, y = 50, np.arange(0, 49), np.arange(1, 50)
    assert (kernels.union(n, x, y) == 0).all()
    assert len(kernels.forest(n, np.concatenate([x, x]), np.concatenate([y, y]))) == 49


def test_long_rows_in_pieces(monkeypatch):
    text = "word Other é " * 3000 + "x" * 5000 + " end"
    rows = ["a b", text, "", text[:400]]
    data = np.frombuffer("".join(rows).encode(), np.uint8)
    at = np.append(0, np.cumsum([len(r.encode()) for r in rows]))
    h, b = kernels.words(data, at)
    monkeypatch.setattr(kernels, "PIECE", 512)
    h2, b2 = kernels.words(data, at)
    assert (h == h2).all() and (b == b2).all()
    assert [len(r.split()) for r in rows] == np.diff(b).tolist()


def test_long_texts_score_as_one(spark):
    import pyarrow as pa

    from cloudloom.llm import languages, toxicity

    text = "Some words and ümlauts, " * 60_000
    column = pa.array(["short", text, None])
    got = [(i, j, c) for i, j, c in languages.counts(column)]
    assert sum(j - i for i, j, _ in got) == 3
    one = np.concatenate([c for *_, c in got])[1]
    n = len(text.replace(",", "").encode())  # a comma and a blank are one blank
    assert abs(one.sum() - (3 * n - 3)) <= 6
    y = np.array([1, 0, 1])
    total, stamp = np.zeros((2, 1 << toxicity.BITS), np.int64), np.zeros(1 << toxicity.BITS, np.int32)
    toxicity._tally(column, y, total, stamp)
    assert total[0].max() == 1
    other = np.zeros_like(total)
    toxicity._tally(pa.array([None, text[:500], None]), y, other, stamp)
    assert (total[0] == other[0]).all()
    wanted = total[0] > 0
    pairs = np.concatenate([p[p >> toxicity.BITS == 0] for i, j, p in toxicity._present(column, wanted) if i == 1])
    assert len(pairs) == wanted.sum()
