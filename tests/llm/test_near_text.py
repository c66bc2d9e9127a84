import random
import re

import pytest

from cloudloom.llm import near_text


def brute(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(s), least.get(find(i)) if s else d, d is not None and (least[find(i)] == d or not s)) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def corpus(seed=1):
    rng = random.Random(seed)
    words = [f"W{i}x" for i in range(500)]
    base = rng.choices(words, k=150)
    line = rng.choices(words, k=12)
    rows = []
    for i in range(150):  # near copies of one text, from close to far
        t = list(base)
        for _ in range(rng.choice([0, 1, 3, 6, 9, 12])):
            t[rng.randrange(150)] = rng.choice(words).lower()
        rows.append((i * 7 % 1009, " ".join(t)))
    for i in range(60):  # different texts that share a line
        rows.append((2000 + i, " ".join(rng.choices(words, k=30) + line)))
    rows += [(5000, None), (5001, ""), (5002, " \t\n"), (5003, "one two"), (5004, "One TWO"), (5005, "one"), (5006, "a b c d e"), (5007, "A b\tc d e"), (5006, "a b c d e"), (None, "a b c d e"), (5010, "é ñ " * 4000)]
    return rows


@pytest.mark.parametrize("block", [4096, 16])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near_text, "BLOCK", block)
    rows = corpus()
    docs = spark.createDataFrame([(d, t, 1, "y") for d, t in rows], "doc_id long, text string, tok int, cid string").repartition(4)
    got = near_text.near_duplicates(docs).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows), key=key)


def test_empty(spark):
    assert near_text.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_near_copies_without_ids(spark):
    w = [f"w{i}" for i in range(100)]
    rows = [(7, " ".join(w)), (None, " ".join(w[10:] + [f"x{i}" for i in range(10)])), (8, " ".join(w[20:] + [f"x{i}" for i in range(20)]))]
    assert len({r[2] for r in brute(rows)}) == 1 and len({r[2] for r in brute(rows[::2])}) == 2  # the row without id connects the others
    got = near_text.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows), key=key)
