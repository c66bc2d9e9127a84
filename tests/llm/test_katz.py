import math
import pickle
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cloudloom.llm import katz
from cloudloom.llm.queries import op9_katz_scoring

T = katz.TRUST


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


class Brute:
    """The model by dictionaries: contexts are tuples of up to two tokens."""

    def __init__(self, texts):
        self.count = [Counter(), Counter(), Counter()]
        self.after = defaultdict(Counter)
        for t in texts:
            u, v = "<s>", "<s>"
            for w in tokens(t):
                for k, context in enumerate(((), (v,), (u, v))):
                    self.count[k][(*context, w)] += 1
                    self.after[context][w] += 1
                u, v = v, w
        self.one = Counter({w: n for (w,), n in self.count[0].items()})
        self.n = sum(self.one.values())
        self.d = [katz.discounts([sum(v == r for v in c.values()) for r in range(1, T + 2)]) for c in self.count]

    def whole(self, context):
        """The total that counts are divided by, and what is left of it."""
        after, d = self.after[context], self.d[len(context)]
        left = sum(c * (1 - d[c]) for c in after.values() if c <= T)
        total = sum(after.values())
        return (total, left) if left else (total + 1, 1)

    def p(self, w, context):
        if context and context not in self.after:
            return self.p(w, context[1:])
        if not context and not self.n:
            return 1.0
        total, left = self.whole(context)
        c = self.after[context][w] if w in self.after[context] else 0
        if c:
            return (c if c > T else c * self.d[len(context)][c]) / total
        if not context:
            return left / total
        return left / total / (1 - sum(self.p(x, context[1:]) for x in self.after[context])) * self.p(w, context[1:])

    def score(self, text):
        total, u, v = 0.0, "<s>", "<s>"
        for w in tokens(text):
            total += math.log10(self.p(w, (u, v)))
            u, v = v, w
        return total


def corpus(seed, n=80):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choices(words, [1 / (k + 1) for k in range(60)], k=rng.choice([1, 5, 40])))) for i in range(n)]
    rows += [(n + i, "Always the same") for i in range(12)] + [(500, "always ODD the"), (501, None), (502, " \t"), (503, "new words only")]
    return rows


def expected(rows):
    train = [t for i, t in rows if crc32(str(i).encode()) % 5 != 1]
    m = Brute(train)
    out = {}
    for i, t in rows:
        w = tokens(t)
        base = sum(math.log10((m.one[x] + 0.5) / (m.n + 0.5 * (len(m.one) + 1))) for x in w)
        out[i] = (crc32(str(i).encode()) % 5 == 1, len(w), sum(x in m.one for x in w), m.n, base, m.score(t))
    return m, out


def same(got, want):
    assert len(got) == len(want)
    for r in got:
        w = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert r.base_score == pytest.approx(w[4], abs=1e-8)
        assert r.score == pytest.approx(w[5], abs=1e-8)


@pytest.mark.parametrize(("partitions", "slice_", "bucket"), [(1, 1 << 22, 500_000), (4, 2000, 300), (13, 500, 50)])
def test_query_equals_brute_force(spark, tmp_path, monkeypatch, partitions, slice_, bucket):
    for k, v in (("SLICE", slice_), ("BUCKET", bucket)):
        monkeypatch.setattr(katz, k, v)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    rows = corpus(4)
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    model, want = expected(rows)
    same(op9_katz_scoring(spark, str(tmp_path)).collect(), want)
    spark.conf.set("spark.sql.shuffle.partitions", before)
    for context in [(), ("w0",), ("w3", "w0"), ("<s>", "<s>"), ("always", "the"), ("never", "w1"), ("never",)]:  # all known words and the unknown one
        assert sum(model.p(w, context) for w in [*model.one, "?"]) == pytest.approx(1)


def test_a_pair_in_every_document_and_a_very_long_text(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(katz, "BUCKET", 2000)
    monkeypatch.setattr(katz, "SLICE", 4000)
    monkeypatch.setattr(katz.kernels, "PIECE", 1000)
    rng = random.Random(9)
    rows = [(i, f"hot pair w{rng.randrange(9)} hot pair x{i}") for i in range(400)]
    rows += [(1000 + k, " ".join(rng.choices([f"w{i}" for i in range(300)], k=6000))) for k in range(3)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    same(op9_katz_scoring(spark, str(tmp_path)).collect(), expected(rows)[1])


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert katz.score(empty, F.lit(True)).collect() == []
    docs = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "y"), (1, "c", "z"), (None, "a", None)], "doc_id long, text string, slice string")
    got = katz.score(docs, F.lit(True)).collect()
    assert sorted(((r.doc_id or 0), r.n_tokens) for r in got) == [(0, 2), (1, 2), (1, 3), (1, 3)]
    m = Brute(["a b", "a b", "c", "a"])
    assert {round(r.score, 8) for r in got if r.n_tokens == 3} == {round(m.score("a b"), 8)}
    none = katz.score(docs, F.lit(False)).collect()
    assert {(r.base_score, r.score) for r in none} == {(0.0, 0.0)}


def test_few_long_texts_of_many_frequent_words(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(5000)] * 2
    rows = [(i, " ".join(rng.sample(words, len(words)))) for i in range(5)]  # each word is more frequent than the end
    m = Brute([t for _, t in rows])
    got = katz.score(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(True)).collect()
    assert {r.doc_id: r.score for r in got} == pytest.approx({i: m.score(t) for i, t in rows}, abs=1e-6)


def test_arrays_are_kept_without_their_empty_high_bytes():
    rng = np.random.default_rng(3)
    arrays = {
        "ids": np.array([-(2**63), -5, 3, 2**62]), "minus": np.array([-1, -300]), "small": rng.integers(0, 200, 999).astype(np.uint64), "large": rng.integers(0, 2**63, 999).astype(np.uint64) * np.uint64(2),
        "narrow": rng.integers(0, 70_000, 50).astype(np.uint32), "bytes": np.array([0, 1, 255], np.uint8), "sums": rng.random(20), "zeros": np.zeros(7, np.uint32), "none": np.zeros(0, np.uint64), "strided": np.arange(20, dtype=np.uint32)[::3],
    }
    blob = katz._save(**arrays)
    got = katz._load(blob)
    for k, a in arrays.items():
        assert got[k].dtype == a.dtype and (got[k] == a).all() and len(got[k]) == len(a), k
    assert {k: x[2] for k, x in pickle.loads(blob).items()} == {"ids": 8, "minus": 8, "small": 1, "large": 8, "narrow": 3, "bytes": 1, "sums": 8, "zeros": 0, "none": 0, "strided": 1}


@pytest.mark.parametrize("bits", [10, 40, 63, 64])
@pytest.mark.parametrize("n", [0, 1, 2, 5000])
def test_distinct_keys_of_any_width(bits, n):
    rng = np.random.default_rng(n)
    key = (rng.integers(0, 2**62, 700).astype(np.uint64) << np.uint64(2) >> np.uint64(64 - bits))[rng.integers(0, 700, n)]
    by, begins, place = katz._distinct(key, bits)
    names, at = np.unique(key, return_inverse=True)
    assert (key[by[begins]] == names).all() and (place == at).all()
    assert sorted(by.tolist()) == list(range(n)) and (np.diff(key[by].astype(object)) >= 0).all()


@pytest.mark.parametrize("wide", [False, True])
def test_ngrams_with_equal_hashes_are_counted_apart(monkeypatch, wide):
    """Two slices ask one bucket: the contexts 5 and 6, then words whose hashes agree; with wide words, context and word don't fit into 64 bits."""
    real, far = katz.kernels.mix, np.uint64(2**63 if wide else 0)
    word = lambda *x: np.array(x, np.uint64) + far
    contexts = katz._context(np.zeros(2, np.uint64), np.array([5, 6], np.uint64))
    monkeypatch.setattr(katz.kernels, "mix", lambda x: real(x) if len(x) <= 4 else np.zeros(len(x), np.uint64))
    one = {"u": np.zeros(2, np.uint64), "v": np.array([5, 6], np.uint64), "whole": np.ones(2, np.uint64), "run": np.array([3, 2], np.uint32)}
    asks = [katz._save(**one, w=word(1, 2, 3, 1, 3), n=np.array(n, np.uint32), lower=np.ones(5, np.uint32)) for n in ([2, 0, 7, 1, 0], [1, 1, 0, 1, 0])]
    batch = pa.RecordBatch.from_arrays([pa.array([0, 0], pa.int32()), pa.array([10, 11]), pa.array(asks, pa.binary())], names=["bucket", "slice", "blob"])
    met = pa.Table.from_batches(katz._meet([batch], 2, 1, contexts, katz.discounts([0] * 6), 20.0, 1e9)).to_pylist()
    answers = [katz._load(r["blob"]) for r in met if r["kind"] == katz._ANSWER]
    assert [a["c"].tolist() for a in answers] == [[3, 1, 7, 2, 0]] * 2
    assert [a["total"].tolist() for a in answers] == [[11, 2]] * 2
    assert [a["t2"].tolist() for a in answers] == [[1]] * 2  # of the context with an unseen word
    sums = {r["slice"]: r["stats"] for r in met if r["kind"] == katz._HOT}
    assert [sums[int(c)][:6] for c in contexts.view(np.int64)] == [[11, 1, 0, 1, 0, 0], [2, 0, 1, 0, 0, 0]]
    assert next(r["stats"] for r in met if r["kind"] == katz._COUNTS) == [1, 1, 1, 0, 0, 0, 4]
