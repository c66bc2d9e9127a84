"""Rays on meshes, and depth maps."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudloom.functions import columns as C


def triangles(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Faces (fid, a, b, c) with the corners' coordinates as ax .. cz."""
    out = faces
    for k in "abc":
        out = out.join(vertices.select(F.col("vid").alias(k), *(F.col(c).alias(f"{k}{c}") for c in "xyz")), k)
    return out


def cast_rays(rays: DataFrame, tri: DataFrame, eps: float = 0.01) -> DataFrame:
    """(ray, fid, t, x, y, z) of the nearest hit of each ray (ox .. dz) before it: planes that the ray doesn't graze, at t > 0, within the triangle's edges.  The mesh is broadcast if it is small."""
    a, b, c, o, d = (C.vec(k) for k in ("a", "b", "c", "o", "d"))
    n, level = C.plane_of(a, b, c)
    planes = tri.withColumns({"nx": n[0], "ny": n[1], "nz": n[2], "_d": level}).where("nx is not null")
    n = C.vec("n")
    # unit inward normals of the edges: pairs that are clearly outside one cost a few products
    sides = {k: (C.cross(n, C.minus(q, p)), C.norm(C.minus(q, p)), p) for k, p, q in (("u", a, b), ("v", b, c), ("w", c, a))}
    planes = planes.withColumns({f"_{k}{e}": v / size for k, (m, size, _) in sides.items() for v, e in zip(m, "xyz", strict=True)} | {f"_{k}": C.dot(m, p) / size for k, (m, size, p) in sides.items()})
    planes = planes.repartition(tri.sparkSession.sparkContext.defaultParallelism, "fid")  # a mesh from one file is one task else
    slope = C.dot(n, d)
    hits = rays.join(planes, F.abs(slope) >= eps).withColumn("t", F.try_divide(F.col("_d") - C.dot(n, o), slope)).where("t > 0")
    for k in "uvw":
        at, level = C.dot(C.vec(f"_{k}"), o), F.col(f"_{k}")
        hits = hits.where(at - level + F.col("t") * C.dot(C.vec(f"_{k}"), d) > -1e-6 * (1 + F.abs(at) + F.abs(level) + F.col("t")))
    hits = hits.withColumns({f"h{k}": F.col(f"o{k}") + F.col("t") * F.col(f"d{k}") for k in "xyz"})
    h = C.vec("h")
    within = F.lit(True)  # exact, and in the aggregate, as a filter would go into the join
    for p, q in ((a, b), (b, c), (c, a)):
        within = within & (C.dot(n, C.cross(C.minus(q, p), C.minus(h, p))) > 0)
    best = hits.groupBy("ray").agg(F.min(F.when(within, F.struct("t", "fid", "hx", "hy", "hz"))).alias("m")).where("m is not null")
    return best.select("ray", "m.fid", "m.t", *(F.col(f"m.h{k}").alias(k) for k in "xyz"))


def parallel_rays(spark: SparkSession, centre: tuple[float, float, float], radius: float, size: float, views: int, steps: int) -> DataFrame:
    """Rays of ``views`` orthographic cameras around a centre, a ``steps`` x ``steps`` square of side ``size`` each (view, ray, ox .. dz)."""
    v = spark.range(views * steps * steps).withColumns({"view": F.expr(f"id div {steps * steps}").cast("int"), "_i": F.expr(f"id div {steps} % {steps}"), "_j": F.expr(f"id % {steps}")})
    angle = F.col("view") * (2 * math.pi / views)
    u, w = ((F.col("_i") + 0.5) / steps - 0.5) * size, ((F.col("_j") + 0.5) / steps - 0.5) * size
    c, s = F.cos(angle), F.sin(angle)
    return v.select("view", F.col("id").alias("ray"), (centre[0] + radius * c - u * s).alias("ox"), (centre[1] + radius * s + u * c).alias("oy"), (centre[2] + w).alias("oz"), (-c).alias("dx"), (-s).alias("dy"), F.lit(0.0).alias("dz"))


def radial_rays(spark: SparkSession, origins: list[tuple[float, float, float]], step: float) -> DataFrame:
    """Rays in all directions from each origin, ``step`` radians apart in both angles."""
    n = int(2 * math.pi / step)
    o = F.array(*(F.struct(*(F.lit(float(v)).alias(f"o{c}") for v, c in zip(p, "xyz", strict=True))) for p in origins))
    v = spark.range(len(origins) * n * n).withColumns({"view": F.expr(f"id div {n * n}").cast("int"), "o": F.get(o, F.expr(f"id div {n * n}").cast("int"))})
    theta, phi = F.expr(f"id div {n} % {n}") * step - math.pi, F.expr(f"id % {n}") * step - math.pi
    return v.select("view", F.col("id").alias("ray"), "o.*", (F.cos(theta) * F.cos(phi)).alias("dx"), (F.sin(theta) * F.cos(phi)).alias("dy"), F.sin(phi).alias("dz"))


def depth_map(tri: DataFrame, width: int, height: int) -> DataFrame:
    """(u, v, depth): the least depth of the triangles' interiors at each pixel centre, for corners whose x and y are image coordinates and z is depth."""
    ends = {k: (F.least(*(F.col(f"{p}{k}") for p in "abc")), F.greatest(*(F.col(f"{p}{k}") for p in "abc"))) for k in "xy"}
    span = lambda k, most: F.sequence(F.greatest(F.ceil(ends[k][0] - 0.5), F.lit(0)).cast("int"), F.least(F.floor(ends[k][1] - 0.5), F.lit(most - 1)).cast("int"))
    some = lambda k, most: F.greatest(F.ceil(ends[k][0] - 0.5), F.lit(0)) <= F.least(F.floor(ends[k][1] - 0.5), F.lit(most - 1))
    px = tri.where(some("x", width) & some("y", height)).withColumn("u", F.explode(span("x", width))).withColumn("v", F.explode(span("y", height)))
    x, y = F.col("u") + 0.5, F.col("v") + 0.5
    area = (F.col("bx") - F.col("ax")) * (F.col("cy") - F.col("ay")) - (F.col("cx") - F.col("ax")) * (F.col("by") - F.col("ay"))
    w = lambda p, q: F.try_divide((F.col(f"{q}x") - F.col(f"{p}x")) * (y - F.col(f"{p}y")) - (F.col(f"{q}y") - F.col(f"{p}y")) * (x - F.col(f"{p}x")), area)
    px = px.withColumns({"_a": w("b", "c"), "_b": w("c", "a"), "_c": w("a", "b")}).where("_a >= 0 and _b >= 0 and _c >= 0")
    return px.groupBy("u", "v").agg(F.min(F.col("_a") * F.col("az") + F.col("_b") * F.col("bz") + F.col("_c") * F.col("cz")).alias("depth"))


def vertex_normals(tri: DataFrame) -> DataFrame:
    """(vid, nx, ny, nz): the unit sum of the normals of each vertex's faces."""
    n, _ = C.plane_of(C.vec("a"), C.vec("b"), C.vec("c"))
    f = tri.withColumns({"_nx": n[0], "_ny": n[1], "_nz": n[2]}).select(F.explode(F.array("a", "b", "c")).alias("vid"), "_nx", "_ny", "_nz").where("_nx is not null")
    s = f.groupBy("vid").agg(*(F.sum(f"_n{k}").alias(f"n{k}") for k in "xyz"))
    size = C.norm(C.vec("n"))
    return s.select("vid", *(F.try_divide(F.col(f"n{k}"), size).alias(f"n{k}") for k in "xyz"))


def shade(tri: DataFrame, light: tuple[float, float, float], camera: tuple[float, float, float], colour: float = 255.0) -> DataFrame:
    """(fid, shade) of faces turned to the camera."""
    a, b, c = C.vec("a"), C.vec("b"), C.vec("c")
    n, _ = C.plane_of(a, b, c)
    middle = tuple((p + q + r) / 3 for p, q, r in zip(a, b, c, strict=True))
    lit = tuple(F.lit(float(v)) for v in light)
    return tri.select("fid", C.lambert(C.facing(n, middle, tuple(F.lit(float(v)) for v in camera)), lit, F.lit(colour)).alias("shade"))
