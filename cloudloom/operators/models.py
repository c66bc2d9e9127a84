"""Scaling, classifiers on feature vectors and their scores."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudloom.operators import blocks, spatial


def long_features(rows: DataFrame, *keep: str) -> DataFrame:
    """(keep.., dim, v) from an array column ``features``."""
    return rows.select(*keep, F.posexplode("features").alias("dim", "v"))


def class_stats(rows: DataFrame) -> DataFrame:
    """(label, dim, n, mean, std): population standard deviation."""
    return long_features(rows, "label").groupBy("label", "dim").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))


def _field(name: str):
    return lambda x: x[name]


def _ends(train: DataFrame, *aggs) -> DataFrame:
    s = long_features(train).groupBy("dim").agg(*aggs)
    return s.agg(*(F.transform(F.array_sort(F.collect_list(F.struct("dim", c))), _field(c)).alias(f"_{c}") for c in s.columns if c != "dim"))


def gauss_scale(rows: DataFrame, train: DataFrame | None = None) -> DataFrame:
    """(v - mean) / population std of each dimension of ``train``; one without spread stays."""
    s = _ends(rows if train is None else train, F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    z = F.zip_with("features", F.arrays_zip("_mean", "_std"), lambda v, s: F.when(s["_std"] > 0, F.try_divide(v - s["_mean"], s["_std"])).otherwise(v))
    return rows.crossJoin(F.broadcast(s)).withColumn("features", z).drop("_mean", "_std")


def minmax_scale(rows: DataFrame, train: DataFrame | None = None) -> DataFrame:
    """(v - min) / (max - min) of each dimension of ``train``; one without spread stays."""
    s = _ends(rows if train is None else train, F.min("v").alias("lo"), F.max("v").alias("hi"))
    z = F.zip_with("features", F.arrays_zip("_lo", "_hi"), lambda v, s: F.when(s["_hi"] > s["_lo"], F.try_divide(v - s["_lo"], s["_hi"] - s["_lo"])).otherwise(v))
    return rows.crossJoin(F.broadcast(s)).withColumn("features", z).drop("_lo", "_hi")


# --- neighbours -------------------------------------------------------------


def one_nearest(test: DataFrame, train: DataFrame, key: str) -> DataFrame:
    """(key, n_key, label, dist) of the nearest training row (squared L2)."""
    return spatial.nearest(test.select(key, "features"), train, key, key).drop("rank")


def leave_one_out(rows: DataFrame, key: str) -> DataFrame:
    """(key, label, pred) by the nearest other row."""
    near = spatial.nearest(rows.select(key, "features"), rows, key, key, skip_self=True)
    return near.select(key, F.col("label").alias("pred")).join(rows.select(key, "label"), key)


def knn_vote(test: DataFrame, train: DataFrame, key: str, k: int = 5) -> DataFrame:
    """(key, pred): vote of the ``k`` nearest by L1, weighing 1 / distance; where some are at distance 0 only those vote.  Ties go to the lower label."""
    near = spatial.nearest(test.select(key, "features"), train, key, key, k=k, metric="l1")
    zero = F.max((F.col("dist") == 0).cast("int")).over(Window.partitionBy(key))
    weight = F.when(zero == 1, (F.col("dist") == 0).cast("double")).otherwise(F.try_divide(F.lit(1.0), F.col("dist")))
    votes = near.withColumn("_w", weight).groupBy(key, "label").agg(F.round(F.sum("_w"), 9).alias("w"))
    return votes.groupBy(key).agg(F.max_by("label", F.struct("w", -F.col("label"))).alias("pred"))


def threshold_vote(test: DataFrame, train: DataFrame, key: str, limit: float, skip_self: bool = False) -> DataFrame:
    """(key, pred): the most frequent label of the training rows at a squared distance under ``limit`` (ties: the lower label), null where there is none."""
    a = test.select(F.col(key).alias("_lid"), "features")
    b = train.select(F.col(key).alias("_rid"), "label", "features")
    n = blocks.counts_under(a, b, limit, skip_self).withColumnRenamed("_lid", "_id")
    best = n.groupBy("_id").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("pred"))
    return test.select(key).join(best, F.col(key) == F.col("_id"), "left").select(key, "pred")


def class_nearest(samples: DataFrame, train: DataFrame, by: str, sample_id: str) -> DataFrame:
    """(by, pred, total): the class with the least sum, over an object's samples, of the distance to its nearest member."""
    d = blocks.least_by_label(samples.select(by, F.col(sample_id).alias("_lid"), "features"), train.select("label", "features"), by)
    total = d.groupBy(by, "label").agg(F.round(F.sum("d"), 9).alias("total"))
    return total.groupBy(by).agg(F.min(F.struct("total", "label")).alias("m")).select(by, F.col("m.label").alias("pred"), F.col("m.total").alias("total"))


# --- fitted models ----------------------------------------------------------


def gaussian_tail(test: DataFrame, train: DataFrame, key: str) -> DataFrame:
    """(key, label, score): product over the dimensions of the lower tail of the normal distribution beyond |z|, by class; without spread 1 at 0 and 0 elsewhere.  The classes' statistics are one small array each."""
    s = class_stats(train).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("dim", "mean", "std"))).alias("s"))
    both = test.select(key, "features").crossJoin(F.broadcast(s))

    @F.pandas_udf("double")
    def product(features: pd.Series, means: pd.Series, stds: pd.Series) -> pd.Series:
        out = []
        for f, m, sd in zip(features, means, stds, strict=True):
            p = 1.0
            for v, a, b in zip(f, m, sd, strict=True):
                p *= 0.5 * math.erfc(abs(v - a) / b / math.sqrt(2)) if b > 0 else float(v == 0)
            out.append(p)
        return pd.Series(out)

    return both.select(key, "label", product("features", F.transform("s", lambda x: x["mean"]), F.transform("s", lambda x: x["std"])).alias("score"))


def argmax_label(scores: DataFrame, key: str) -> DataFrame:
    """(key, pred) of the best score; ties go to the lower label."""
    return scores.groupBy(key).agg(F.max_by("label", F.struct("score", -F.col("label"))).alias("pred"))


def _vectors(rows: DataFrame) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return rows.withColumns({"features": array_to_vector("features"), "label": F.col("label").cast("double")})


def fit_predict(kind: str, train: DataFrame, test: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """(key, pred) with one of Spark ML's classifiers: svm (one against the rest), nb (Gaussian), tree (depth 5), logistic (L1), ada (boosted depth-1 trees, one against the rest)."""
    from pyspark.ml import classification as ml

    makers = {
        "svm": lambda: ml.OneVsRest(classifier=ml.LinearSVC(maxIter=20, regParam=1e-3)),
        "nb": lambda: ml.NaiveBayes(modelType="gaussian"),
        "tree": lambda: ml.DecisionTreeClassifier(maxDepth=5, seed=seed),
        "logistic": lambda: ml.LogisticRegression(elasticNetParam=1.0, regParam=1e-6, maxIter=50),
        "ada": lambda: ml.OneVsRest(classifier=ml.GBTClassifier(maxDepth=1, maxIter=10, seed=seed)),
    }
    model = makers[kind]().fit(_vectors(train))
    return model.transform(_vectors(test)).select(key, F.col("prediction").cast("int").alias("pred"))


def vocabulary(descriptors: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """(word, features): k-means centres."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    model = KMeans(k=k, seed=seed, initMode="k-means||").fit(descriptors.select(array_to_vector("features").alias("features")))
    return descriptors.sparkSession.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(model.clusterCenters())], "word int, features array<double>")


def _outer(rows: DataFrame, by: list[str]) -> DataFrame:
    """Sums, counts and sums of products of features by group, added up per task: one matrix a group and task."""

    def add(batches):
        total: dict = {}
        for pdf in batches:
            for k, g in pdf.groupby(by[0], dropna=False) if by else [(0, pdf)]:
                x = np.stack(g.features.to_numpy())
                n, s, m = total.get(k, (0, 0.0, 0.0))
                total[k] = (n + len(x), s + x.sum(0), m + x.T @ x)
        for k, (n, s, m) in total.items():
            yield pd.DataFrame({"k": [k], "n": [n], "s": [s.tolist()], "m": [m.ravel().tolist()]})

    kind = rows.schema[by[0]].dataType.simpleString() if by else "int"
    return rows.select(*by, "features").mapInPandas(add, f"k {kind}, n long, s array<double>, m array<double>")


def linear_discriminant(train: DataFrame, test: DataFrame, key: str, ridge: float = 1e-6) -> DataFrame:
    """(key, pred) by linear discriminants: class means, pooled covariance and class shares.  Only sums by task reach the driver."""
    parts = _outer(train, ["label"]).collect()
    labels = sorted({r.k for r in parts})
    n = {c: sum(r.n for r in parts if r.k == c) for c in labels}
    mean = {c: sum(np.array(r.s) for r in parts if r.k == c) / n[c] for c in labels}
    d = len(next(iter(mean.values())))
    total = sum(n.values())
    cov = (sum(np.array(r.m).reshape(d, d) for r in parts) - sum(n[c] * np.outer(mean[c], mean[c]) for c in labels)) / total
    w = np.linalg.solve(cov + ridge * np.trace(cov) / d * np.eye(d), np.stack([mean[c] for c in labels]).T)
    b = [-0.5 * mean[c] @ w[:, i] + math.log(n[c] / total) for i, c in enumerate(labels)]
    score = lambda i: F.aggregate(F.zip_with("features", F.array(*(F.lit(float(v)) for v in w[:, i])), lambda x, y: x * y), F.lit(float(b[i])), lambda s, v: s + v)
    return test.select(key, F.array_max(F.array(*(F.struct(score(i).alias("score"), F.lit(c).alias("label")) for i, c in enumerate(labels))))["label"].alias("pred"))


def svd_project(rows: DataFrame, key: str, k: int = 2) -> DataFrame:
    """(key, projection): each row, less the mean, on the first ``k`` right singular vectors of the uncentred table, over their singular values."""
    parts = _outer(rows, []).collect()
    n, d = sum(r.n for r in parts), len(parts[0].s)
    mean = sum(np.array(r.s) for r in parts) / n
    values, axes = np.linalg.eigh(sum(np.array(r.m).reshape(d, d) for r in parts))
    order = np.argsort(-values)[:k]
    axes = axes[:, order] * np.sign(axes[np.abs(axes[:, order]).argmax(0), order])
    axes = axes / np.sqrt(np.maximum(values[order], 1e-300))
    lines = [F.aggregate(F.zip_with("features", F.array(*(F.lit(float(v)) for v in axes[:, i])), lambda x, y: x * y), F.lit(float(-mean @ axes[:, i])), lambda s, v: s + v) for i in range(len(order))]
    return rows.select(key, F.array(*lines).alias("projection"))


def cascade(parts: DataFrame, key: str, least_right: float = 0.5) -> list[tuple[str, int]]:
    """The order of (part, class) that a cascade tests: from rows (key, part, label, pred) the pair with the most right among what it says, then the same without the objects it has settled.  One aggregate a step; steps are at most parts x classes."""
    from cloudloom.functions.tables import materialize

    left, order = materialize(parts.select(key, "part", "label", "pred"), "cascade"), []
    while True:
        s = left.groupBy("part", "pred").agg(F.count_if(F.col("label") == F.col("pred")).alias("right"), F.count("*").alias("n")).where(F.col("right") >= least_right * F.col("n"))
        best = s.orderBy(F.desc("right"), "part", "pred").first()
        if best is None or not best.right:
            return order
        order.append((best.part, best.pred))
        settled = left.where((F.col("part") == best.part) & (F.col("pred") == best.pred)).select(key)
        left = materialize(left.join(settled, key, "left_anti"), "cascade")


# --- scores -----------------------------------------------------------------


def confusion(rows: DataFrame, truth: str = "label", pred: str = "pred") -> DataFrame:
    return rows.groupBy(truth, pred).agg(F.count("*").alias("n"))


def score_table(rows: DataFrame, truth: str = "label", pred: str = "pred") -> DataFrame:
    """(label, tp, fp, fn, accuracy, precision, recall) by class and, with a null label, for all; in percent, null where nothing is to be divided by."""
    n = rows.count()
    both = rows.select(F.explode(F.array_distinct(F.array(F.col(truth), F.col(pred)))).alias("label"), F.col(truth).alias("_t"), F.col(pred).alias("_p"))
    tp, fp, fn = (F.col("_t") == F.col("_p")), (F.col("label") == F.col("_p")) & (F.col("_t") != F.col("_p")), (F.col("label") == F.col("_t")) & (F.col("_t") != F.col("_p"))
    s = both.rollup("label").agg(F.count_if(tp).alias("tp"), F.count_if(fp).alias("fp"), F.count_if(fn).alias("fn"))
    whole: Column = F.col("label").isNull()
    accuracy = F.when(whole, F.col("tp") * 100.0 / n).otherwise((n - F.col("fp") - F.col("fn")) * 100.0 / n)
    return s.select("label", "tp", "fp", "fn", accuracy.alias("accuracy"), F.try_divide(F.col("tp") * 100.0, F.col("tp") + F.col("fp")).alias("precision"), F.try_divide(F.col("tp") * 100.0, F.col("tp") + F.col("fn")).alias("recall"))


def right_by_bin(rows: DataFrame, value: str, right: str, bins: int = 8) -> DataFrame:
    """(bin, n, right): right answers by equal bins of a value; the largest value is in the last bin."""
    ends = rows.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    step = (F.col("_hi") - F.col("_lo")) / bins
    place = F.least(F.floor(F.try_divide(F.col(value) - F.col("_lo"), step)), F.lit(bins - 1)).cast("int")
    return rows.crossJoin(F.broadcast(ends)).groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.count_if(F.col(right)).alias("right"))
