"""Second moments, oriented boxes, planes and hulls."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudloom.operators import around, grid, spatial


def centroid(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(*(F.avg(c).alias(f"c{c}") for c in "xyz"), F.count("*").alias("n"))


def _moments(prefix: str = "") -> list[Column]:
    c = {k: F.col(f"{prefix}{k}") for k in "xyz"}
    n = F.count("*")
    return [(F.sum(c[a] * c[b]) - F.sum(c[a]) * F.sum(c[b]) / n).alias(f"s{a}{b}") for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")]


def scatter(df: DataFrame, by: list[str]) -> DataFrame:
    """Sums of products of the deviations from the mean (sxx .. szz), by plain partial sums."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), *_moments())


def xy_axes(moments: DataFrame) -> DataFrame:
    """``moments`` with the larger eigenvalue in the plane (``l1``), the smaller (``l2``) and the unit axis of the larger (``ax``, ``ay``), in closed form; for a round scatter the axis is x, or y if that is longer."""
    a, b, c = F.col("sxx"), F.col("sxy"), F.col("syy")
    half = F.sqrt(((a - c) / 2) * ((a - c) / 2) + b * b)
    out = moments.withColumns({"l1": (a + c) / 2 + half, "l2": (a + c) / 2 - half})
    ux, uy = F.col("l1") - F.col("syy"), F.col("sxy")
    size = F.sqrt(ux * ux + uy * uy)
    flat = (uy == 0) | (size == 0)
    return out.withColumns({"ax": F.when(flat, F.when(a >= c, 1.0).otherwise(0.0)).otherwise(F.try_divide(ux, size)), "ay": F.when(flat, F.when(a >= c, 0.0).otherwise(1.0)).otherwise(F.try_divide(uy, size))})


def oriented_boxes(df: DataFrame, by: list[str]) -> DataFrame:
    """Boxes along the main axis in the plane and z: by, n, cx, cy, cz, length (along the axis), width, height, theta (degrees)."""
    axes = xy_axes(scatter(df, by)).select(*by, "ax", "ay")
    p = df.join(axes, by)
    p = p.withColumns({"u": F.col("x") * F.col("ax") + F.col("y") * F.col("ay"), "v": F.col("y") * F.col("ax") - F.col("x") * F.col("ay")})
    ends = p.groupBy(*by, "ax", "ay").agg(F.count("*").alias("n"), *(f(c).alias(f"{f.__name__}_{c}") for c in "uvz" for f in (F.min, F.max)))
    mid = {c: (F.col(f"min_{c}") + F.col(f"max_{c}")) / 2 for c in "uvz"}
    return ends.select(
        *by, "n", (mid["u"] * F.col("ax") - mid["v"] * F.col("ay")).alias("cx"), (mid["u"] * F.col("ay") + mid["v"] * F.col("ax")).alias("cy"), mid["z"].alias("cz"),
        *((F.col(f"max_{c}") - F.col(f"min_{c}")).alias(k) for c, k in zip("uvz", ("length", "width", "height"), strict=True)), F.degrees(F.atan2("ay", "ax")).alias("theta"), "ax", "ay",
    )


def box_corners(boxes: DataFrame, by: list[str]) -> DataFrame:
    """The eight corners of each box, numbered."""
    signs = F.explode(F.array(*(F.struct(F.lit(k).alias("corner"), *(F.lit(-0.5 if not k >> j & 1 else 0.5).alias(s) for j, s in enumerate("uvw"))) for k in range(8)))).alias("s")
    out = boxes.select(*by, "cx", "cy", "cz", "length", "width", "height", "ax", "ay", signs)
    u, v, w = F.col("s.u") * F.col("length"), F.col("s.v") * F.col("width"), F.col("s.w") * F.col("height")
    return out.select(*by, "s.corner", (F.col("cx") + u * F.col("ax") - v * F.col("ay")).alias("x"), (F.col("cy") + u * F.col("ay") + v * F.col("ax")).alias("y"), (F.col("cz") + w).alias("z"))


def _least_axes(xx: pd.Series, xy: pd.Series, xz: pd.Series, yy: pd.Series, yz: pd.Series, zz: pd.Series) -> pd.DataFrame:
    m = np.stack([xx, xy, xz, xy, yy, yz, xz, yz, zz], axis=1).astype(float).reshape(-1, 3, 3)
    values, axes = np.linalg.eigh(np.nan_to_num(m))
    n = axes[:, :, 0]
    n = n * np.sign(np.take_along_axis(n, np.abs(n).argmax(1)[:, None], 1))
    total = values.sum(1)
    share = np.where(total > 0, np.maximum(values[:, 0], 0) / np.where(total > 0, total, 1), 0.0)
    return pd.DataFrame({"nx": n[:, 0], "ny": n[:, 1], "nz": n[:, 2], "curvature": share})


def least_axis(*moments: Column) -> Column:
    """Unit eigenvector of the least eigenvalue of a symmetric 3 x 3 matrix (xx, xy, xz, yy, yz, zz; its largest component positive) and that value's share of the trace, for a whole batch at once."""
    return F.pandas_udf(_least_axes, "struct<nx:double,ny:double,nz:double,curvature:double>")(*moments)


def normals(points: DataFrame, d: float, metric: str = "l2") -> DataFrame:
    """(pid, n, nx, ny, nz, curvature) from the points within ``d``, itself included; normals point to the origin."""
    kinds = {c: "double" for c in "xyz"} | {"n": "long"} | {f"s{k}": "double" for k in ("xx", "xy", "xz", "yy", "yz", "zz")}
    m = around.around(points, [], d, around.moments, around.fields(points, **kinds), itself=True, linf=metric == "linf")
    m = m.withColumn("e", least_axis(*(F.col(f"s{k}") for k in ("xx", "xy", "xz", "yy", "yz", "zz"))))
    sign = F.when(F.col("x") * F.col("e.nx") + F.col("y") * F.col("e.ny") + F.col("z") * F.col("e.nz") > 0, -1.0).otherwise(1.0)
    return m.select("pid", "x", "y", "z", "n", *((F.col(f"e.n{c}") * sign).alias(f"n{c}") for c in "xyz"), "e.curvature")


#: Offsets within two steps and how many two-step walks lead there: faces 7, straight 1, diagonal 2 (fixed values).
WALKS = [(o, 7 if sum(map(abs, o)) == 1 else 1 if 2 in map(abs, o) else 2) for o in grid.offsets(2)]


def weighted_moments(cells: DataFrame) -> DataFrame:
    """Per cell the weighted number of cells within two steps and the sums and products of their offsets."""
    around = F.explode(F.array(*(F.struct(*(F.lit(v).alias(f"d{c}") for v, c in zip(o, grid.CELL, strict=True)), F.lit(w).alias("w")) for o, w in WALKS))).alias("o")
    moved = cells.select(*grid.CELL, around).select(*grid.CELL, "o.*")
    moved = moved.withColumns({f"n_{c}": F.col(c) + F.col(f"d{c}") for c in grid.CELL})
    pairs = moved.join(cells.select(*(F.col(c).alias(f"n_{c}") for c in grid.CELL)), [f"n_{c}" for c in grid.CELL])
    d, w = {c: F.col(f"d{c}i") for c in "xyz"}, F.col("w")
    return pairs.groupBy(*grid.CELL).agg(F.sum(w).alias("w"), *(F.sum(w * d[c]).alias(f"m{c}") for c in "xyz"), *(F.sum(w * d[a] * d[b]).alias(f"m{a}{b}") for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")))


def weighted_normals(cells: DataFrame) -> DataFrame:
    m = weighted_moments(cells)
    s = [F.col(f"m{a}{b}") - F.col(f"m{a}") * F.col(f"m{b}") / F.col("w") for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")]
    return m.select(*grid.CELL, least_axis(*s).alias("e")).select(*grid.CELL, "e.*")


def sphere_votes(normals_: DataFrame, radius: float, leaf: float, least: int = 10) -> DataFrame:
    """Cells that at least ``least`` points name as a sphere's centre: each votes for the two places ``radius`` along its normal (x, y, z, nx, ny, nz)."""
    side = F.explode(F.array(F.lit(radius), F.lit(-radius))).alias("r")
    votes = normals_.select("*", side).select(*(F.floor((F.col(c) + F.col("r") * F.col(f"n{c}")) / leaf).cast("int").alias(f"{c}i") for c in "xyz"))
    return votes.groupBy(*grid.CELL).agg(F.count("*").alias("votes")).where(F.col("votes") >= least)


# --- planes ---------------------------------------------------------------


def candidate_planes(points: DataFrame, k: int, seed: int) -> list[tuple[float, float, float, float]]:
    """``k`` planes a x + b y + c z + d = 0 (unit normals) through random triples of points.  Only 3 k points are fetched."""
    drawn = points.select("x", "y", "z", F.xxhash64("pid", F.lit(seed)).alias("_h")).orderBy("_h", "x", "y", "z").limit(3 * k).collect()
    rng = np.random.default_rng(seed)
    xyz = np.array([[r.x, r.y, r.z] for r in drawn], float).reshape(-1, 3)
    out = []
    for _ in range(k if len(xyz) >= 3 else 0):
        p, q, r = xyz[rng.choice(len(xyz), 3, replace=False)]
        n = np.cross(q - p, r - p)
        size = np.linalg.norm(n)
        if size > 1e-12:
            n /= size
            out.append((*map(float, n), float(-n @ p)))
    return out


def count_inliers(points: DataFrame, planes: list[tuple[float, float, float, float]], threshold: float) -> DataFrame:
    """Inliers of each plane in one pass over the points: one conditional sum a plane, added up per task."""
    sums = [F.sum((F.abs(F.col("x") * a + F.col("y") * b + F.col("z") * c + d) < threshold).cast("long")).alias(f"n{k}") for k, (a, b, c, d) in enumerate(planes)]
    one = points.agg(*sums)
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("plane"), *(F.lit(v).alias(n) for v, n in zip(p, "abcd", strict=True)), F.col(f"n{k}").alias("inliers")) for k, p in enumerate(planes)))).alias("p")
    return one.select(rows).select("p.*")


def ransac(points: DataFrame, threshold: float, iterations: int, ratio: float, seed: int, batch: int = 64) -> tuple[float, float, float, float] | None:
    """The plane with the most inliers; batches of planes are counted together, and none follows once a plane has ``ratio`` of the points."""
    n = points.count()
    best, most = None, -1
    for start in range(0, iterations, batch):
        planes = candidate_planes(points, min(batch, iterations - start), seed + start)
        if not planes:
            break
        top = count_inliers(points, planes, threshold).orderBy(F.desc("inliers"), "plane").first()
        if top.inliers > most:
            best, most = (top.a, top.b, top.c, top.d), top.inliers
        if most > ratio * n:
            break
    return best


def ransac_planes(points: DataFrame, planes: int, threshold: float, iterations: int, ratio: float, seed: int) -> list[tuple[tuple, DataFrame]]:
    """Planes one after the other, each with its inliers, from what the ones before left."""
    from cloudloom.functions.tables import materialize
    from cloudloom.operators.filters import plane_side

    out = []
    for k in range(planes):
        found = ransac(points, threshold, iterations, ratio, seed + 1000 * k)
        if found is None:
            break
        out.append((found, plane_side(points, *found, threshold, True)))
        points = materialize(plane_side(points, *found, threshold, False), "left")
    return out


def fit_plane(points: DataFrame, by: list[str]) -> DataFrame:
    """Least-squares planes: the least axis of the scatter and d = -n . centroid."""
    m = df = points.groupBy(*by).agg(F.count("*").alias("n"), *(F.avg(c).alias(f"c{c}") for c in "xyz"), *_moments())
    m = df.withColumn("e", least_axis(*(F.col(f"s{k}") for k in ("xx", "xy", "xz", "yy", "yz", "zz"))))
    return m.select(*by, "n", F.col("e.nx").alias("a"), F.col("e.ny").alias("b"), F.col("e.nz").alias("c"), (-(F.col("e.nx") * F.col("cx") + F.col("e.ny") * F.col("cy") + F.col("e.nz") * F.col("cz"))).alias("d"))


# --- hulls ----------------------------------------------------------------


def _chain(pdf: pd.DataFrame) -> pd.DataFrame:
    pts = sorted(set(zip(pdf.x, pdf.y, strict=True)))
    if len(pts) > 2:
        halves = []
        for side in (pts, pts[::-1]):
            h: list = []
            for p in side:
                while len(h) >= 2 and (h[-1][0] - h[-2][0]) * (p[1] - h[-2][1]) - (h[-1][1] - h[-2][1]) * (p[0] - h[-2][0]) <= 0:
                    h.pop()
                h.append(p)
            halves += h[:-1]
        pts = halves
    return pd.DataFrame({"x": [p[0] for p in pts], "y": [p[1] for p in pts]})


def convex_hull(points: DataFrame, by: str) -> DataFrame:
    """Corners of each group's convex hull in the plane (by, k, x, y), counter-clockwise from the least.

    Hulls are first made of small parts of a group, and what is left of them is
    joined, so a large group is never in one task whole.
    """

    def part(key, pdf):
        return _chain(pdf).assign(**{by: key[0]})[[by, "x", "y"]]

    def whole(key, pdf):
        out = _chain(pdf)
        return out.assign(**{by: key[0], "k": np.arange(len(out), dtype=np.int32)})[[by, "k", "x", "y"]]

    kind = points.schema[by].dataType.simpleString()
    dealt = points.select(by, "x", "y", F.pmod(F.xxhash64("x", "y"), F.lit(64)).alias("_part"))
    few = dealt.groupBy(by, "_part").applyInPandas(part, f"{by} {kind}, x double, y double")
    return few.groupBy(by).applyInPandas(whole, f"{by} {kind}, k int, x double, y double")


def least_rectangle(points: DataFrame, by: str) -> DataFrame:
    """The rectangle of least area around each group, along an edge of its hull: by, area, ux, uy, and its sides."""
    hull = convex_hull(points, by)
    w = Window.partitionBy(by).orderBy("k")
    first = F.first(F.struct("x", "y")).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    nxt = F.coalesce(F.lead(F.struct("x", "y")).over(w), first)
    edge = hull.select(by, "k", (nxt["x"] - F.col("x")).alias("ex"), (nxt["y"] - F.col("y")).alias("ey"))
    size = F.sqrt(F.col("ex") * F.col("ex") + F.col("ey") * F.col("ey"))
    edge = edge.where(size > 0).select(by, "k", (F.col("ex") / size).alias("ux"), (F.col("ey") / size).alias("uy"))
    p = edge.join(hull.select(by, "x", "y"), by).withColumns({"u": F.col("x") * F.col("ux") + F.col("y") * F.col("uy"), "v": F.col("y") * F.col("ux") - F.col("x") * F.col("uy")})
    sides = p.groupBy(by, "k", "ux", "uy").agg((F.max("u") - F.min("u")).alias("along"), (F.max("v") - F.min("v")).alias("across"))
    area = F.col("along") * F.col("across")
    best = sides.groupBy(by).agg(F.min(F.struct(area.alias("area"), "k", "ux", "uy", "along", "across")).alias("m"))
    return best.select(by, "m.area", "m.ux", "m.uy", "m.along", "m.across")


def diameter(points: DataFrame, by: str) -> DataFrame:
    """The largest distance between two points of a group, found among the corners of its hull."""
    h = convex_hull(points, by)
    other = h.select(by, F.col("x").alias("n_x"), F.col("y").alias("n_y"))
    d = F.sqrt((F.col("x") - F.col("n_x")) * (F.col("x") - F.col("n_x")) + (F.col("y") - F.col("n_y")) * (F.col("y") - F.col("n_y")))
    return h.join(other, by).groupBy(by).agg(F.max(d).alias("diameter"))


def resolution(points: DataFrame, d: float) -> DataFrame:
    """Mean distance to the nearest other point, of points that have one within ``d``."""
    pairs = spatial.range_join(points.select("pid", "x", "y", "z"), points.select("pid", "x", "y", "z"), d, "l2").where("pid <> n_pid")
    dist = F.sqrt(sum(((F.col(c) - F.col(f"n_{c}")) * (F.col(c) - F.col(f"n_{c}")) for c in "yz"), (F.col("x") - F.col("n_x")) * (F.col("x") - F.col("n_x"))))
    return pairs.groupBy("pid").agg(F.min(dist).alias("d")).agg(F.avg("d").alias("resolution"))


def register_scans(matches: DataFrame) -> DataFrame:
    """(scan, theta, tx, ty, tz) that place each scan on the one before, from matched points (scan, k, x, y, z, px, py, pz; p* in the scan before): the turn about z from the first two matches, the shift from all."""
    two = matches.where("k < 2").groupBy("scan").agg(*(F.min_by(c, "k").alias(f"{c}0") for c in ("x", "y", "px", "py")), *(F.max_by(c, "k").alias(f"{c}1") for c in ("x", "y", "px", "py")))
    angle = lambda p: F.atan2(F.col(f"{p}y1") - F.col(f"{p}y0"), F.col(f"{p}x1") - F.col(f"{p}x0"))
    turned = matches.join(two.select("scan", (angle("p") - angle("")).alias("theta")), "scan")
    c, s = F.cos("theta"), F.sin("theta")
    return turned.groupBy("scan", "theta").agg(F.avg(F.col("px") - (F.col("x") * c - F.col("y") * s)).alias("tx"), F.avg(F.col("py") - (F.col("x") * s + F.col("y") * c)).alias("ty"), F.avg(F.col("pz") - F.col("z")).alias("tz"))


def chain_scans(moves: DataFrame) -> DataFrame:
    """Placements of each scan on the first one: angles add up, and each shift is turned by the angles before it (scans are few; one ordered window)."""
    w = Window.orderBy("scan").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.coalesce(F.sum("theta").over(w), F.lit(0.0)) - F.col("theta")
    m = moves.withColumns({"total": F.sum("theta").over(w), "before": before})
    c, s = F.cos("before"), F.sin("before")
    m = m.withColumns({"gx": F.col("tx") * c - F.col("ty") * s, "gy": F.col("tx") * s + F.col("ty") * c})
    return m.select("scan", F.col("total").alias("theta"), F.sum("gx").over(w).alias("tx"), F.sum("gy").over(w).alias("ty"), F.sum("tz").over(w).alias("tz"))


def corner_cuboids(corners: DataFrame, by: str) -> DataFrame:
    """(by, ox, oy, oz, axes, lengths) of cuboids given by eight corners (k from 0): the first corner, and the three edges from it.

    The two nearest other corners are edges; of the third and fourth nearest the
    diagonal of their face is the one whose distance fits, and the other is the
    third edge.
    """
    zero = corners.where("k = 0").select(by, *(F.col(c).alias(f"o{c}") for c in "xyz"))
    d = [F.col(c) - F.col(f"o{c}") for c in "xyz"]
    rest = corners.where("k > 0").join(zero, by).withColumn("n", F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]))
    e = F.array_sort(F.collect_list(F.struct("n", F.array(*d).alias("v"))))  # seven
    g = rest.groupBy(by, "ox", "oy", "oz").agg(e.alias("e"))
    n = [F.col("e")[k]["n"] for k in range(4)]
    face = F.sqrt(n[0] * n[0] + n[1] * n[1])
    third = F.when(F.abs(n[2] - face) > F.abs(n[3] - face), F.col("e")[2]).otherwise(F.col("e")[3])
    three = F.array(F.col("e")[0], F.col("e")[1], third)
    unit = F.transform(three, lambda x: F.transform(x["v"], lambda v: F.try_divide(v, x["n"])))
    return g.select(by, "ox", "oy", "oz", unit.alias("axes"), F.transform(three, lambda x: x["n"]).alias("lengths"))


def flat_cuboids(points: DataFrame, by: str) -> DataFrame:
    """Upright cuboids around the lowest and highest points of each group, on the least rectangle of those: area, direction, sides and the ends of z."""
    ends = points.groupBy(by).agg(F.min("z").alias("low"), F.max("z").alias("high"))
    flat = points.join(ends, by).where("z = low or z = high")
    return least_rectangle(flat.select(by, "x", "y"), by).join(ends, by)
