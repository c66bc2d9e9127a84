import hashlib
import random
import re
from fractions import Fraction

from cloudloom.llm import mixing
from cloudloom.llm.queries import op3_source_mixing


def corpus(seed=0, n=300):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choice(["a", "a", "a", "b", "B", "é", None])
        rows.append((i, " ".join(["w"] * rng.choice([0, 1, 5, 40, 400])), source))
    return rows + [(1000, None, "a"), (1001, "", "empty"), (1002, "x y", None), (1002, "x y", None), (None, "one two", "b")]


def brute_targets(sizes, weights, share, most):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, free, out = Fraction(share) * sum(sizes.values()), set(names), {}
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > most * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        out |= {s: Fraction(most * sizes[s]) for s in over}
        left -= sum(most * sizes[s] for s in over)
        free -= over
    return out


def test_query_equals_brute_force(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = op3_source_mixing(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    sizes = {}
    for (_, _, s), n in zip(rows, size, strict=True):
        sizes[s] = sizes.get(s, 0) + n
    target = brute_targets(sizes, [3, 1, 2], 1.5, 2)
    want = []
    for s, total in sizes.items():
        own = [(i, n) for (i, _, x), n in zip(rows, size, strict=True) if x == s]
        merit = {n: 1000 * n // (n + 100) for _, n in own}
        t, mean = (float(target[s] / total), sum(n * merit[n] for _, n in own) / total) if total else (0.0, 0.0)
        draw = lambda i: (int(hashlib.md5(f"mix:{'null' if i is None else i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        drawn = []
        for i, n in own:
            e = min(max(t + min(t, 2 - t) * (merit[n] - mean) / 1000, 0.0), 2.0)
            p, u = e - int(e), draw(i)
            drawn.append((i, n, int(e), u / (1 - u) / (p / (1 - p)) if p > 0 else None))
        rest = float(target[s]) - sum(n * w for _, n, w, _ in drawn)
        up, more = 0, set()
        for rank in sorted({r for *_, r in drawn if r is not None}):
            tie = sum(n for _, n, _, r in drawn if r == rank)
            if 2 * up + tie <= 2 * rest:
                more.add(rank)
            up += tie
        want += [(i, n, total, n * (w + (r in more))) for i, n, w, r in drawn]
        taken = sum(n * (w + (r in more)) for _, n, w, r in drawn)
        assert abs(taken - target[s]) <= max([n for _, n in own]) / 2 + 1
        assert all(w + (r in more) <= 2 for _, _, w, r in drawn)
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(((r.doc_id, r.size, r.source_size, r.taken) for r in got), key=key) == sorted(want, key=key)
    assert all(r.taken <= 2 * r.size and abs(r.target - float(target[s])) < 1e-6 for r, s in ((r, next(x for i, _, x in rows if i == r.doc_id)) for r in got))


def test_few_bins_draw_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(*r, 1, "z") for r in corpus(3)], "doc_id long, text string, source string, rank int, taken string")
    one = sorted(map(str, mixing.mix(docs, [3, 1, 2]).collect()))
    monkeypatch.setattr(mixing, "BINS", 3)
    assert sorted(map(str, mixing.mix(docs.repartition(5), [3, 1, 2]).collect())) == one
    assert mixing.mix(docs.limit(0), [1]).collect() == []
    assert {r.taken for r in mixing.mix(docs.where("source = 'empty'"), [1]).collect()} == {0}


def test_allot():
    assert mixing.allot([("a", 100), ("b", 100)], [3, 1], 1.5, 2.0) == {"a": 200.0, "b": 100.0}
    assert mixing.allot([("a", 10), ("b", 100), (None, 0)], [1], 2.0, 2.0) == {"a": 20.0, "b": 200.0, None: 0.0}
    assert mixing.allot([], [1], 1.5, 2.0) == {}
