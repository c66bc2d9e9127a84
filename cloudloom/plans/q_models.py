"""Queries that classify feature vectors and score the answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloudloom.operators import models, spatial
from cloudloom.plans import views as V
from cloudloom.plans.registry import query

_D = f"d AS (SELECT obj_id, features AS f, label FROM ({V.DESC})), train AS (SELECT * FROM d WHERE obj_id % 5 <> 0), test AS (SELECT * FROM d WHERE obj_id % 5 = 0)"
_L2 = "list_sum(list_transform(list_zip(a.f, b.f), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
_L1 = "list_sum(list_transform(list_zip(a.f, b.f), lambda z: abs(z[1] - z[2])))"


def _halves(rows):
    return rows.where("obj_id % 5 <> 0"), rows.where("obj_id % 5 = 0")


def _split(spark, d):
    return _halves(V.desc(spark, d))


_NN = f"n AS (SELECT a.obj_id, a.label AS truth, b.obj_id AS n_obj_id, b.label, {_L2} AS dist FROM test a, train b), one AS (SELECT obj_id, truth, arg_min(n_obj_id, (dist, n_obj_id)) AS n_obj_id, arg_min(label, (dist, n_obj_id)) AS pred, min(dist) AS dist FROM n GROUP BY obj_id, truth)"


@query(f"WITH {_D}, {_NN} SELECT obj_id, n_obj_id, pred, round(dist, 6) AS dist FROM one")
def knn1(spark, d):
    train, test = _split(spark, d)
    return models.one_nearest(test, train, "obj_id").select("obj_id", "n_obj_id", F.col("label").alias("pred"), F.round("dist", 6).alias("dist"))


@query(f"WITH {_D}, n AS (SELECT a.obj_id, a.label, b.obj_id AS other, b.label AS pred, {_L2} AS dist FROM d a JOIN d b ON a.obj_id <> b.obj_id) SELECT obj_id, label, arg_min(pred, (dist, other)) AS pred FROM n GROUP BY obj_id, label")
def knn1_loo(spark, d):
    return models.leave_one_out(V.desc(spark, d), "obj_id").select("obj_id", "label", "pred")


@query(f"""WITH {_D}, n AS (SELECT a.obj_id, b.label, {_L1} AS dist, row_number() OVER (PARTITION BY a.obj_id ORDER BY {_L1}, b.obj_id) AS k FROM test a, train b),
v AS (SELECT obj_id, label, round(sum(1 / dist), 9) AS w FROM n WHERE k <= 5 GROUP BY obj_id, label) SELECT obj_id, arg_max(label, (w, -label)) AS pred FROM v GROUP BY obj_id""")
def knn_k_vote(spark, d):
    train, test = _split(spark, d)
    return models.knn_vote(test, train, "obj_id", 5)


@query(f"""WITH {_D}, n AS (SELECT a.obj_id, b.label, count(*) AS n FROM test a, train b WHERE {_L2} < 1.2 GROUP BY ALL), v AS (SELECT obj_id, arg_max(label, (n, -label)) AS pred FROM n GROUP BY obj_id) SELECT obj_id, pred FROM test LEFT JOIN v USING (obj_id)""")
def vote_threshold(spark, d):
    train, test = _split(spark, d)
    return models.threshold_vote(test, train, "obj_id", 1.2)


@query(f"""WITH {_D}, n AS (SELECT a.obj_id % 7 AS grp, a.obj_id, b.label, min({_L2}) AS d FROM test a, train b GROUP BY ALL), t AS (SELECT grp, label, round(sum(d), 9) AS total FROM n GROUP BY grp, label)
SELECT grp, arg_min(label, (total, label)) AS pred, round(min(total), 6) AS total FROM t GROUP BY grp""")
def class_knn(spark, d):
    train, test = _split(spark, d)
    out = models.class_nearest(test.withColumn("grp", F.col("obj_id") % 7), train, "grp", "obj_id")
    return out.select("grp", "pred", F.round("total", 6).alias("total"))


@query(f"WITH {_D}, v AS (SELECT obj_id - 1 AS w, f FROM d ORDER BY obj_id LIMIT 10), n AS (SELECT a.obj_id, b.w, {_L2} AS dist FROM d a, v b) SELECT obj_id, arg_min(w, (dist, w)) + 1 AS word FROM n GROUP BY obj_id")
def nearest_centroid(spark, d):
    rows = V.desc(spark, d)
    ids = rows.orderBy("obj_id").limit(10)
    vocabulary = ids.select(F.col("obj_id").alias("word"), "features")
    return spatial.nearest(rows, vocabulary, "obj_id", "word").select("obj_id", "word")


@query(f"WITH {_D}, e AS (SELECT label, unnest(f) AS v, generate_subscripts(f, 1) - 1 AS dim FROM d) SELECT label, dim::INT AS dim, count(*)::BIGINT AS n, round(avg(v), 8) AS mean, round(stddev_pop(v), 8) AS std FROM e GROUP BY label, dim")
def class_stats(spark, d):
    return models.class_stats(V.desc(spark, d)).select("label", "dim", "n", F.round("mean", 8).alias("mean"), F.round("std", 8).alias("std"))


def _scaled(low, high):
    return f"""WITH {_D}, e AS (SELECT obj_id, unnest(f) AS v, generate_subscripts(f, 1) - 1 AS dim FROM d), s AS (SELECT dim, {low} AS lo, {high} AS s FROM e WHERE obj_id % 5 <> 0 GROUP BY dim)
SELECT obj_id, dim::INT AS dim, round(CASE WHEN s > 0 THEN (v - lo) / s ELSE v END, 6) AS v FROM e JOIN s USING (dim)"""


@query(_scaled("avg(v)", "stddev_pop(v)"))
def gauss_scale(spark, d):
    out = models.gauss_scale(V.desc(spark, d), _split(spark, d)[0])
    return models.long_features(out, "obj_id").select("obj_id", "dim", F.round("v", 6).alias("v"))


@query(_scaled("min(v)", "max(v) - min(v)"))
def minmax_scale(spark, d):
    out = models.minmax_scale(V.desc(spark, d), _split(spark, d)[0])
    return models.long_features(out, "obj_id").select("obj_id", "dim", F.round("v", 6).alias("v"))


_PRED = f"WITH {_D}, {_NN}"


def _pred(spark, d):
    train, test = _split(spark, d)
    return models.one_nearest(test, train, "obj_id").select("obj_id", F.col("label").alias("pred")).join(test.select("obj_id", "label"), "obj_id")


@query(f"{_PRED} SELECT truth AS label, pred, count(*)::BIGINT AS n FROM one GROUP BY truth, pred")
def confusion(spark, d):
    return models.confusion(_pred(spark, d))


@query(f"""{_PRED}, l AS (SELECT DISTINCT unnest([truth, pred]) AS label FROM one), c AS (SELECT label, count(*) FILTER (truth = label AND pred = label) AS tp, count(*) FILTER (truth <> label AND pred = label) AS fp, count(*) FILTER (truth = label AND pred <> label) AS fn, count(*) AS n FROM l, one GROUP BY label)
SELECT label, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, round((n - fp - fn) * 100 / n, 6) AS accuracy, round(tp * 100 / nullif(tp + fp, 0), 6) AS precision, round(tp * 100 / nullif(tp + fn, 0), 6) AS recall FROM c
UNION ALL SELECT NULL, sum(tp)::BIGINT, sum(fp)::BIGINT, sum(fn)::BIGINT, round(sum(tp) * 100 / any_value(n), 6), round(sum(tp) * 100 / nullif(sum(tp + fp), 0), 6), round(sum(tp) * 100 / nullif(sum(tp + fn), 0), 6) FROM c""")
def score_table(spark, d):
    return models.score_table(_pred(spark, d)).select("label", "tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall")))


@query(f"{_PRED}, e AS (SELECT min(dist) AS lo, (max(dist) - min(dist)) / 8 AS step FROM one) SELECT least(floor((dist - lo) / step), 7)::INT AS bin, count(*)::BIGINT AS n, count(*) FILTER (truth = pred)::BIGINT AS \"right\" FROM one, e GROUP BY 1")
def tp_hist(spark, d):
    train, test = _split(spark, d)
    near = models.one_nearest(test, train, "obj_id").withColumnRenamed("label", "pred").join(test.select("obj_id", "label"), "obj_id")
    return models.right_by_bin(near.withColumn("ok", F.col("label") == F.col("pred")), "dist", "ok")


@query(f"{_PRED} SELECT obj_id FROM one WHERE truth <> 0 AND pred <> 0")
def ignore_zero(spark, d):
    from cloudloom.operators.filters import without_zero

    return without_zero(_pred(spark, d), "label", "pred").select("obj_id")


def _fitted(kind):
    def run(spark, d):
        train, test = _halves(V.desc(spark, d))
        return models.fit_predict(kind, train, test, "obj_id")

    return run


for _name in ("svm", "nb", "tree", "logistic", "ada"):
    query(name=_name)(_fitted(_name))


@query()
def lda(spark, d):
    train, test = _halves(V.desc(spark, d))
    return models.linear_discriminant(train, test, "obj_id")


@query()
def igm(spark, d):
    train, test = _halves(V.desc(spark, d))
    return models.argmax_label(models.gaussian_tail(test, train, "obj_id"), "obj_id")


@query()
def svd_projection(spark, d):
    return models.svd_project(V.desc(spark, d), "obj_id")


@query()
def kmeans(spark, d):
    return models.vocabulary(V.desc(spark, d), 10)
