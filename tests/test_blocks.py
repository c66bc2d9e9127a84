"""Searches among vectors, block against block, compared with plain tables of all distances."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudloom.operators import blocks, models, spatial

ROWS = "obj_id long, features array<double>, label int"


def brute(a, b, l1=False):
    """Distance over the dimensions that both have, None without any."""
    both = [(x, y) for x, y in zip(a or [], b or [], strict=False) if x is not None and y is not None]
    return sum(abs(x - y) if l1 else (x - y) * (x - y) for x, y in both) if both else None


def ranked(row, rows, l1=False, skip=False):
    d = [(brute(row[1], r[1], l1), r[0], r[2]) for r in rows if not (skip and r[0] == row[0])]
    return sorted((x is None, float("inf") if x is None or x != x else x, i, c) for x, i, c in d)


@pytest.fixture
def small_blocks(monkeypatch):
    """Some rows a pack, many blocks and more than one pass."""
    for name, value in {"PACK": 7, "BLOCK": 20, "COPIES": 2, "TILE": 300, "AGAIN": 50}.items():
        monkeypatch.setattr(blocks, name, value)


def vectors(n=120, odd=False):
    rng = np.random.default_rng(4)
    rows = [(i, [float(v) for v in rng.integers(-3, 4, 5) / 4], int(rng.integers(0, 4))) for i in range(n)]
    rows += [(n + i, list(rows[3][1]), i % 4) for i in range(30)]  # copies of one
    if odd:
        rows += [(900, None, 0), (901, [], 1), (902, [0.25, None, 0.5, 0.0, 0.0], 2), (903, [0.25, 0.5], 3), (904, [float("nan")] * 5, 1), (905, [None] * 5, 0), (906, [1e200] * 5, 2)]
    return rows


@pytest.mark.parametrize("odd", [False, True])
@pytest.mark.parametrize(("k", "metric", "skip"), [(1, "l2", False), (1, "l2", True), (5, "l1", False), (3, "l1", True)])
def test_nearest_is_that_of_all(spark, small_blocks, odd, k, metric, skip):
    rows = vectors(odd=odd)
    df = spark.createDataFrame(rows, ROWS).repartition(3)
    got = {}
    for r in spatial.nearest(df, df, "obj_id", "obj_id", k=k, metric=metric, skip_self=skip).orderBy("obj_id", "rank").collect():
        got.setdefault(r.obj_id, []).append((r.n_obj_id, r.label))
    for row in rows:
        assert got[row[0]] == [(i, c) for *_, i, c in ranked(row, rows, metric == "l1", skip)[:k]], row


@pytest.mark.parametrize("skip", [False, True])
def test_votes_count_all(spark, small_blocks, skip):
    rows = vectors(odd=True)
    df = spark.createDataFrame(rows, ROWS).repartition(3)
    got = {r.obj_id: r.pred for r in models.threshold_vote(df, df, "obj_id", 0.5, skip_self=skip).collect()}
    assert len(got) == len(rows)
    for row in rows:
        near = [c for _, d, _, c in ranked(row, rows, skip=skip) if d < 0.5]
        assert got[row[0]] == (min(set(near), key=lambda c: (-near.count(c), c)) if near else None)


def test_classes_nearest_of_all(spark, small_blocks):
    rows = vectors()
    df = spark.createDataFrame(rows, ROWS).repartition(3)
    got = {r.grp: (r.pred, r.total) for r in models.class_nearest(df.where("obj_id % 5 = 0").withColumn("grp", F.col("obj_id") % 7), df.where("obj_id % 5 <> 0"), "grp", "obj_id").collect()}
    for g in range(7):
        total = {c: sum(min(brute(a[1], b[1]) for b in rows if b[0] % 5 and b[2] == c) for a in rows if a[0] % 5 == 0 and a[0] % 7 == g) for c in range(4)}
        assert got[g][0] == min(total, key=lambda c: (round(total[c], 9), c))
        assert got[g][1] == pytest.approx(min(total.values()))


def test_pairs_stay_out_of_sorts_and_joins(spark):
    """Neither a sort nor a join of Spark's sees the pairs: what comes back is the nearest of each block."""
    df = spark.createDataFrame([(i, [float(i % 50), 1.0], 0) for i in range(400)], ROWS)
    plan = spatial.nearest(df, df, "obj_id", "obj_id")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
