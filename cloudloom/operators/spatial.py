"""Joins by distance: buckets of the radius' width, an equi-join on them, and the exact test."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloudloom.operators import blocks


def range_join(left: DataFrame, right: DataFrame, d: float, metric: str = "linf", axes: str = "xyz", strict: bool = False) -> DataFrame:
    """Pairs of points at a distance of at most ``d`` (less than it if ``strict``): columns of the left, and of the right with ``n_`` before.

    The right side stays in its bucket; the left goes to its own and all that
    touch it.  Buckets are a hair wider than ``d``, so rounding can't part a
    pair that is exactly ``d`` apart.  AQE splits buckets that hold much.
    """
    wide = d * (1 + 1e-9) or 1e-9
    near = F.explode(F.array(*(F.struct(*(F.lit(v).alias(a) for v, a in zip(o, axes, strict=True))) for o in product((-1, 0, 1), repeat=len(axes))))).alias("_o")
    a = left.select("*", near)
    a = a.withColumns({f"_b{c}": F.floor(F.col(c) / wide) + F.col(f"_o.{c}") for c in axes}).drop("_o")
    b = right.select(*(F.col(c).alias(f"n_{c}") for c in right.columns)).withColumns({f"_b{c}": F.floor(F.col(f"n_{c}") / wide) for c in axes})
    diff = [F.abs(F.col(c) - F.col(f"n_{c}")) for c in axes]
    size = F.greatest(*diff) if metric == "linf" else F.sqrt(sum((v * v for v in diff[1:]), diff[0] * diff[0])) if metric == "l2" else sum(diff[1:], diff[0])
    return a.join(b, [f"_b{c}" for c in axes]).where(size < d if strict else size <= d).drop(*(f"_b{c}" for c in axes))


def nearest(left: DataFrame, right: DataFrame, left_id: str, right_id: str, k: int = 1, metric: str = "l2", skip_self: bool = False) -> DataFrame:
    """The ``k`` nearest rows of ``right`` for each row of ``left`` by ``features`` (squared L2 or L1): left_id, right_id, dist, rank, and ``label`` of the right if it has one.  Ties go to the lower id.

    Blocks of both sides meet in Python (``blocks``); only the ``k`` nearest of
    each block of the right come back.  Dimensions that are null in either vector
    are left out; a row without any common one has no distance and comes last.
    """
    label = ["label"] if "label" in right.columns else []
    a = left.select(F.col(left_id).alias("_lid"), "features")
    b = right.select(F.col(right_id).alias("_rid"), *label, "features")
    w = Window.partitionBy("_lid").orderBy(F.col("dist").asc_nulls_last(), "_rid")
    few = blocks.nearest(a, b, k, metric, skip_self).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return few.select(F.col("_lid").alias(left_id), F.col("_rid").alias(right_id if right_id != left_id else f"n_{right_id}"), "dist", *label, "rank")


def correlate(scene: DataFrame, model: DataFrame) -> DataFrame:
    """For each cell of the scene: how many cells of the model, placed there, are in the scene (xi, yi, zi, hits).  The model is a list of offsets."""
    cells = ["xi", "yi", "zi"]
    placed = scene.select(*cells).crossJoin(F.broadcast(model.select(*(F.col(c).alias(f"m_{c}") for c in cells))))
    placed = placed.select(*cells, *((F.col(c) + F.col(f"m_{c}")).alias(f"n_{c}") for c in cells))
    other = scene.select(*(F.col(c).alias(f"n_{c}") for c in cells))
    return placed.join(other, [f"n_{c}" for c in cells]).groupBy(*cells).agg(F.count("*").alias("hits"))


def matched(target: DataFrame, source: DataFrame, d: float, target_id: str, source_id: str) -> DataFrame:
    """Targets with a source at a distance under ``d``: the first source by id and its distance."""
    a = target.select(F.col(target_id).alias("target_id"), "x", "y", "z")
    b = source.select(F.col(source_id).alias("source_id"), "x", "y", "z")
    pairs = range_join(a, b, d, "l2", strict=True)
    dist = F.sqrt(sum(((F.col(c) - F.col(f"n_{c}")) * (F.col(c) - F.col(f"n_{c}")) for c in "yz"), (F.col("x") - F.col("n_x")) * (F.col("x") - F.col("n_x"))))
    return pairs.groupBy("target_id").agg(F.min(F.struct(F.col("n_source_id").alias("source_id"), dist.alias("dist"))).alias("m")).select("target_id", "m.source_id", "m.dist")


def completeness(clusters: DataFrame, origins: DataFrame, by: str) -> DataFrame:
    """Sum over the scan origins (a handful) of 1 / distance in the plane, by cluster."""
    dist = F.sqrt((F.col("x") - F.col("ox")) * (F.col("x") - F.col("ox")) + (F.col("y") - F.col("oy")) * (F.col("y") - F.col("oy")))
    return clusters.crossJoin(F.broadcast(origins)).groupBy(by).agg(F.sum(F.try_divide(F.lit(1.0), dist)).alias("completeness"))


def on_sphere(points: DataFrame, spheres: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """Points whose squared distance to a centre is within ``tolerance`` of a squared radius (cx, cy, cz, radius)."""
    sq = sum(((F.col(c) - F.col(f"c{c}")) * (F.col(c) - F.col(f"c{c}")) for c in "yz"), (F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx")))
    return points.join(spheres, F.abs(sq - F.col("radius") * F.col("radius")) < tolerance, "left_semi")
