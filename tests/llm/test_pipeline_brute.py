"""The pipeline's rows against plain versions of its five stages."""

import random
import re

import duckdb
import pandas as pd
import pytest

import corpus_pipeline
from cloudloom.llm import leaks
from cloudloom.llm.queries import OP3_SQL
from test_leaks import distance_in
from test_near_text import brute as near_copies
from test_private import brute as base_spans
from test_toxicity_brute import plain_scores


def corpus(seed=5):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghijk", k=rng.randint(2, 7))) for _ in range(300)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    items = [(k, text(12).capitalize() + "!") for k in range(4)] + [(8, None), (9, "")]
    docs, labels = [], []
    for i in range(140):
        t = text(rng.choice([6, 30, 45])).split()
        bad = rng.random() < 0.25
        if bad:
            t[2:2] = ["Zorkish", "quuxlike"]
        docs.append([i, " ".join(t)])
        labels.append((i, 1, int(bad)))
    for k in range(40):  # near copies of near copies, closer or farther
        t = docs[rng.randrange(len(docs))][1].split()
        for _ in range(rng.choice([0, 1, 2, 4])):
            t[rng.randrange(len(t))] = rng.choice(words)
        docs.append([200 + k, " ".join(t)])
    for k in range(16):  # items, whole or with edits
        p = list(items[k % 4][1])
        for _ in range(rng.choice([0, 1, 4, 9])):
            p[rng.randrange(len(p))] = rng.choice("xyz")
        docs.append([300 + k, f"{text(8)} {''.join(p)} {text(8)}"])
    docs += [[400 + k, f"{text(9)} {x} {text(9)}"] for k, x in enumerate(["to jo.doe@mail.example.com,", "at 10.0.0.255 and", "of 4111 1111 1111 1111 or", "by +49 30 1234567 or a@b.c"])]
    docs += [[500, None], [501, ""], [502, " \t "], [503, docs[7][1]]]
    rows = [(i, t, "en", rng.choice(["a", "a", "a", "b", "é", None]), len(t or "")) for i, t in docs]
    return rows + rows[20:22], labels, items


def masked(text):
    found = sorted((int(s), -int(e), k) for k, s, e in (x.split(":") for x in base_spans(text)))
    out, at = "", 0
    for s, e, k in found:
        if s >= at:
            out += text[at:s] + f"[{k.upper()}]"
        at = max(at, -e)
    return out + text[at:]


def plain(rows, labels, items):
    truth = {i: y for i, _, y in labels}
    scores = plain_scores([(r[1], truth[r[0]]) for r in rows if r[0] in truth], [r[1] for r in rows])
    assert min(abs(s - 0.3) for s in scores) > 1e-3  # no row is a matter of rounding
    steps = [[r for r, s in zip(rows, scores, strict=True) if s < 0.3]]
    kept = {d for d, _, _, k in near_copies([r[:2] for r in steps[-1]]) if k}
    steps.append(sorted({r for r in steps[-1] if r[0] in kept}, key=str))
    patterns = [p for _, x in items if (p := leaks.normalise(x or ""))]
    steps.append([r for r in steps[-1] if not any(r[1] and distance_in(p, leaks.normalise(r[1])) <= int(0.08 * len(p)) for p in patterns)])
    texts = [masked(r[1]) if r[1] is not None else None for r in steps[-1]]
    steps.append([(r[0], t, *r[2:4], len(t or "")) for r, t in zip(steps[-1], texts, strict=True)])
    return steps


def test_run_equals_plain_stages(spark, tmp_path):
    rows, labels, items = corpus()
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, kind).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    steps = plain(rows, labels, items)
    assert len({len(rows), *map(len, steps[:3])}) == 4 and steps[3] != steps[2]  # each stage decides something
    key = lambda r: tuple((x is None, x) for x in r)
    docs = spark.createDataFrame(rows, kind)
    for (name, stage), want in zip(corpus_pipeline.STAGES, steps):
        got = [tuple(r) for r in stage(spark, docs, str(tmp_path)).collect()]
        assert sorted(got, key=key) == sorted(want, key=key), name
        docs = spark.createDataFrame(want, kind)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert sorted((tuple(r)[:5] for r in got.values()), key=key) == sorted(steps[-1], key=key)
    with duckdb.connect() as db:
        db.register("documents", pd.DataFrame(steps[-1], columns=corpus_pipeline.COLUMNS).astype({"source": object}))
        mixed = db.sql(f"SELECT doc_id, size, source_size, target, taken FROM ({OP3_SQL})").fetchall()
    assert len(mixed) == len(got)
    for i, size, whole, target, taken in mixed:
        assert (got[i].size, got[i].source_size, got[i].taken) == (size, whole, taken)
        assert got[i].target == pytest.approx(target) and got[i].copies == (taken // size if size else 0)
        assert size == len(re.findall(r"[^\x20\x09-\x0D]+", got[i].text or ""))
