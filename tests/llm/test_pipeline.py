import random

import corpus_pipeline
from cloudloom.llm import leaks


def corpus(seed=0):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghijk", k=rng.randint(2, 7))) for _ in range(400)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    docs, labels = [], []
    for i in range(400):
        t = text(80).split()
        bad = rng.random() < 0.25
        if bad:
            t[3], t[40] = "Zorkish", "quuxlike"
        docs.append((i, " ".join(t), "en", f"s{i % 3}", 0))
        labels.append((i, 1, int(bad)))
    toxic = {i for i, _, y in labels if y}
    near = next(t for i, t, *_ in docs if i not in toxic)
    first = next(i for i, *_ in docs if i not in toxic)
    docs += [(1000 + k, near.replace(" ", "  ", k + 1), "en", "s0", 0) for k in range(3)]
    items = [(k, text(30)) for k in range(4)]
    docs += [(2000 + k, text(20) + " " + x + " " + text(20), "en", "s1", 0) for k, x in items]
    docs += [(3000, text(40) + " mail jo@example.com " + text(20), None, None, 0), (3001, None, None, "s2", None), (3002, "", "en", "s2", 0)]
    return docs, labels, items, toxic, first


def test_run(spark, tmp_path):
    docs, labels, items, toxic, first = corpus()
    spark.createDataFrame([(*d, 7) for d in docs], "doc_id long, text string, lang string, source string, n_chars long, score int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert len(toxic & set(got)) <= 0.05 * len(toxic)
    clean = {i for i, *_ in docs if i < 1000} - toxic
    assert len(clean & set(got)) >= 0.98 * len(clean)
    assert first in got and not set(got) & {1000, 1001, 1002}
    assert not set(got) & {2000, 2001, 2002, 2003}
    assert "jo@example.com" not in got[3000].text and "[EMAIL]" in got[3000].text and got[3000].n_chars == len(got[3000].text)
    assert got[3001].text is None and got[3001].taken == 0 and got[3002].text == ""
    total = sum(r.size for r in got.values())
    assert abs(sum(r.taken for r in got.values()) - 1.5 * total) < 0.05 * total
    assert all(r.taken == r.copies * r.size for r in got.values())
    assert not any(leaks.normalise(x) in leaks.normalise(r.text or "") for _, x in items for r in got.values())


def test_stages_keep_their_columns(spark, tmp_path):
    docs, labels, items, *_ = corpus(1)
    spark.createDataFrame(labels[:0], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items[:0], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    for n in (0, 30):
        held = spark.createDataFrame(docs[:n], kind)
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, held, str(tmp_path))
            assert set(corpus_pipeline.COLUMNS) <= set(out.columns)
            if stage is not corpus_pipeline.STAGES[-1][1]:
                assert out.columns == corpus_pipeline.COLUMNS
            held = out
        assert held.count() == n


def test_near_copies_without_ids_go(spark, tmp_path):
    w, v = ([f"{k}{i}" for i in range(100)] for k in "wv")
    texts = [(1, " ".join(w)), (None, " ".join(w[1:])), (None, " ".join(v)), (None, " ".join(v[1:])), (None, "quite another"), (None, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path)).collect()]
    assert len(got) == 4 and {(1, " ".join(w)), (None, "quite another"), (None, None)} < set(got)
