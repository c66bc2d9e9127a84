import hashlib
import random

import numpy as np
import pytest

from cloudloom.llm import suffixes
from cloudloom.llm.queries import op10_suffix_array_dedup


def brute(rows, length=100):
    """(doc_id, text) -> result by a dictionary of all strings."""
    seen, out = set(), []
    texts = [(i, (t or "").encode()) for i, t in rows]
    for i, raw in sorted(texts, key=lambda x: x[0]):
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - length + 1):
            w = raw[s : s + length]
            if w in seen:
                gone[s : s + length] = True
            seen.add(w)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out.append((i, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def random_text(rng, n):
    return "".join(rng.choice("abcdefghij é") for _ in range(n))


def corpus(seed=1):
    rng = random.Random(seed)
    passages = [random_text(rng, n) for n in (99, 100, 101, 160, 400)]
    rows = []
    for i in range(60):
        t = random_text(rng, rng.choice([0, 50, 300, 900]))
        for _ in range(rng.choice([0, 1, 2])):
            at = rng.randrange(len(t) + 1)
            t = t[:at] + rng.choice(passages) + t[at:]
        rows.append((i * 3, t))
    rows += [(7, None), (8, ""), (10, "x" * 99), (11, "x" * 100), (13, "x" * 350), (14, "ab" * 300), (16, rows[5][1]), (17, rows[5][1] + "!")]
    base = random_text(rng, 700)
    for i in range(40):  # near copies
        at = rng.randrange(700)
        rows.append((1000 + i, base[:at] + rng.choice("XYZ") + base[at + 1 :]))
    return rows


@pytest.mark.parametrize(("hot", "bits", "slice_bytes"), [(4096, 64, 1 << 20), (3, 64, 700), (4096, 3, 1500)])
def test_equals_brute_force(spark, monkeypatch, hot, bits, slice_bytes):
    """Also with groups that are split, texts longer than a slice, and different runs with one hash."""
    monkeypatch.setattr(suffixes, "HOT", hot)
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, start string").repartition(5)
    got = suffixes.repeated_strings(docs, bits=bits, slice_bytes=slice_bytes).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows))


def test_query_equals_brute_force_on_a_table(spark, tmp_path):
    rows = corpus(2)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op10_suffix_array_dedup(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows))


def test_a_passage_in_every_document(spark, monkeypatch):
    """Its grams are dealt by content, and its windows are sorted in parts."""
    monkeypatch.setattr(suffixes, "SAMPLE", 1)
    monkeypatch.setattr(suffixes, "HOT", 20)
    rng = random.Random(5)
    passage = random_text(rng, 150)
    rows = [(i, random_text(rng, 60) + passage + random_text(rng, 60)) for i in range(120)] + [(500, random_text(rng, 90_000) + passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert sorted(map(tuple, suffixes.repeated_strings(docs, slice_bytes=3000).collect())) == sorted(brute(rows))


def test_empty_and_repeated_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert suffixes.repeated_strings(docs).collect() == []
    t = random_text(random.Random(3), 200)
    docs = spark.createDataFrame([(1, t), (1, t), (None, t)], "doc_id long, text string")
    got = sorted((r.doc_id or 99, r.n_removed) for r in suffixes.repeated_strings(docs).collect())
    assert got == [(1, 0), (1, 0), (99, len(t.encode()))]


def test_suffix_sort_sorts():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 3, 5000).astype(np.uint8)
    where = rng.permutation(4900)[:600]
    group = np.sort(rng.integers(0, 9, 600))
    order, equal = suffixes.suffix_sort(data, where, group, 50)
    assert (group[order] == group).all()
    strings = [data[where[o] : where[o] + 50].tobytes() for o in order]
    for g in range(9):
        own = [s for s, x in zip(strings, group, strict=True) if x == g]
        assert own == sorted(own)
    assert [bool(k and group[k] == group[k - 1] and strings[k] == strings[k - 1]) for k in range(600)] == equal.tolist()


def test_checks_of_equal_runs_hold_little():
    import tracemalloc

    data = np.frombuffer(b"0123456789" * 30_000, np.uint8)
    x = np.arange(60_000)
    tracemalloc.start()
    same = suffixes._equal(data, x, x + 10, np.full(len(x), 140))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert same.all() and peak < 64 << 20  # 200 MB where 8 MB of bytes were met at once
