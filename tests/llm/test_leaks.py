import random

import pytest

from cloudloom.llm import leaks
from cloudloom.llm.queries import op4_benchmark_decontamination


def distance_in(pattern, text):
    """Least edit distance of pattern to a substring of text, by the full table."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != c), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def corpus(seed=0):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(1, 6))) for _ in range(60)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    items = [(i, text(rng.choice([4, 12, 25])).capitalize() + ".") for i in range(12)] + [(90, None), (91, ""), (92, " ..."), (3, text(9))]
    docs = []
    for i in range(60):
        t = text(rng.choice([0, 3, 30]))
        if i % 2:
            p = list(items[rng.randrange(12)][1])
            for _ in range(rng.choice([0, 1, 3, 8, 20])):
                k = rng.randrange(len(p))
                p[k : k + 1] = rng.choice([[], ["x"], [p[k], "y"]])
                p = p or ["z"]
            t += " " + "".join(p) + " " + text(5)
        docs.append((i, t))
    return docs + [(70, None), (71, ""), (None, items[0][1]), (72, items[1][1].upper()), (72, items[1][1])], items


def test_query_equals_brute_force(spark, tmp_path):
    docs, items = corpus()
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = []
    for d, t in docs:
        for i, x in items:
            x, k = leaks.normalise(x or ""), 0.08
            if x and t and (n := distance_in(x, leaks.normalise(t))) <= int(k * len(x)):
                want.append((d is None, d, i, n))
    got = op4_benchmark_decontamination(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.item_id, r.distance) for r in got) == sorted(want)
    assert any(n for *_, n in want)


@pytest.mark.parametrize("block", [1, 200])
def test_blocks_change_nothing(spark, block):
    docs, items = corpus(1)
    d = spark.createDataFrame([(i, t, "m") for i, t in docs], "doc_id long, text string, matches string")
    b = spark.createDataFrame(items, "item_id long, text string")
    key = lambda df: sorted((r.doc_id or -1, sorted(map(tuple, r.matches))) for r in df.select("doc_id", "matches").collect())
    assert key(leaks.find_leaks(d, b, block_bytes=block)) == key(leaks.find_leaks(d, b))
    assert leaks.find_leaks(d.limit(0), b).collect() == []
    assert {len(r.matches) for r in leaks.find_leaks(d, b.limit(0)).collect()} == {0}
