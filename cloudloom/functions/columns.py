"""Pure column expressions on points, colours, rotations and triangles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

XYZ = ("x", "y", "z")


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


# --- placing points -------------------------------------------------------


def translate(df: DataFrame, tx: float, ty: float, tz: float) -> DataFrame:
    """Move every point; the other columns stay."""
    return df.withColumns({c: F.col(c) + F.lit(float(t)) for c, t in zip(XYZ, (tx, ty, tz), strict=True)})


def scale(df: DataFrame, factor: float) -> DataFrame:
    """Divide every coordinate by ``factor``."""
    return df.withColumns({c: F.col(c) / F.lit(float(factor)) for c in XYZ})


def apply_matrix(df: DataFrame, m: list[list[float]]) -> DataFrame:
    """Multiply every point by a 3 x 3 matrix of numbers."""
    return df.withColumns({c: sum((F.col(a) * F.lit(float(v)) for a, v in zip(XYZ[1:], row[1:], strict=True)), F.col("x") * F.lit(float(row[0]))) for c, row in zip(XYZ, m, strict=True)})


def _matmul(a, b):
    return [[sum(a[i][k] * b[k][j] for k in range(3)) for j in range(3)] for i in range(3)]


def euler_matrix(rx: float, ry: float, rz: float) -> list[list[float]]:
    """Rz * Ry * Rx for angles in degrees."""
    (cx, sx), (cy, sy), (cz, sz) = ((math.cos(math.radians(a)), math.sin(math.radians(a))) for a in (rx, ry, rz))
    about_x = [[1, 0, 0], [0, cx, -sx], [0, sx, cx]]
    about_y = [[cy, 0, sy], [0, 1, 0], [-sy, 0, cy]]
    about_z = [[cz, -sz, 0], [sz, cz, 0], [0, 0, 1]]
    return _matmul(about_z, _matmul(about_y, about_x))


def rotate_euler(df: DataFrame, rx: float, ry: float, rz: float) -> DataFrame:
    return apply_matrix(df, euler_matrix(rx, ry, rz))


def quaternion_from_euler(rx: float, ry: float, rz: float) -> tuple[float, float, float, float]:
    """(r, i, j, k) of the rotation Rx(rz) * Ry(ry) * Rz(rx), angles in degrees: the first angle turns about z and the last about x."""
    about = lambda axis, deg: (math.cos(math.radians(deg) / 2), *(math.sin(math.radians(deg) / 2) * (k == axis) for k in range(3)))
    q = quaternion_product(about(0, rz), quaternion_product(about(1, ry), about(2, rx)))
    return tuple(-v for v in q) if q[0] < 0 else q


def quaternion_product(p, q):
    """Hamilton product of (r, i, j, k), numbers or columns."""
    a, b, c, d = p
    e, f, g, h = q
    return (a * e - b * f - c * g - d * h, a * f + b * e + c * h - d * g, a * g - b * h + c * e + d * f, a * h + b * g - c * f + d * e)


def quaternion_conjugate(q):
    return q[0], -q[1], -q[2], -q[3]


def rotate_quaternion(df: DataFrame, q: tuple[float, float, float, float]) -> DataFrame:
    """q v q*; q is used as it is, so one that isn't a unit also scales."""
    r, i, j, k = q
    n = r * r - i * i - j * j - k * k
    m = [[n + 2 * i * i, 2 * (i * j - r * k), 2 * (i * k + r * j)], [2 * (i * j + r * k), n + 2 * j * j, 2 * (j * k - r * i)], [2 * (i * k - r * j), 2 * (j * k + r * i), n + 2 * k * k]]
    return apply_matrix(df, m)


def rigid_about_z(df: DataFrame, theta: Column | float, tx, ty, tz) -> DataFrame:
    """Turn about z by ``theta`` (radians), then move; all may be columns."""
    c, s = F.cos(_c(theta)), F.sin(_c(theta))
    return df.withColumns({"x": F.col("x") * c - F.col("y") * s + _c(tx), "y": F.col("x") * s + F.col("y") * c + _c(ty), "z": F.col("z") + _c(tz)})


def add_noise(df: DataFrame, std: float, seed: int) -> DataFrame:
    """Add independent Gaussian noise to each coordinate."""
    return df.withColumns({c: F.col(c) + F.randn(seed + k) * F.lit(std) for k, c in enumerate(XYZ)})


def centre(df: DataFrame, by: DataFrame | None = None) -> DataFrame:
    """Subtract the centroid of ``by`` (the points themselves by default)."""
    mean = (df if by is None else by).agg(*(F.avg(c).alias(f"_m{c}") for c in XYZ))
    out = df.crossJoin(F.broadcast(mean))  # one row
    return out.withColumns({c: F.col(c) - F.col(f"_m{c}") for c in XYZ}).drop(*(f"_m{c}" for c in XYZ))


def utm(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Easting and northing (UTM series on WGS84, degrees in, metres out)."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996  # fixed values
    b = a * (1 - f)
    esq = 1 - (b / a) ** 2
    e0sq = esq / (1 - esq)
    phi = lat / 180 * math.pi
    zone = 1 + F.floor((lon + 180) / 6)
    middle = 3 + 6 * (zone - 1) - 180
    n = a / F.sqrt(1 - esq * F.sin(phi) * F.sin(phi))
    t, c = F.tan(phi) * F.tan(phi), e0sq * F.cos(phi) * F.cos(phi)
    w = (lon - middle) * math.pi / 180 * F.cos(phi)
    series = ((0, 1 - esq * (1 / 4 + esq * (3 / 64 + 5 * esq / 256))), (2, -esq * (3 / 8 + esq * (3 / 32 + 45 * esq / 1024))), (4, esq**2 * (15 / 256 + esq * 45 / 1024)), (6, -(esq**3) * 35 / 3072))
    arc = a * sum((F.sin(phi * m) * v for m, v in series[1:]), phi * series[0][1])
    ww = w * w
    east = 500000 + k0 * n * w * (1 + ww * ((1 - t + c) / 6 + ww * (5 - 18 * t + t * t + 72 * c - 58 * e0sq) / 120))
    north = k0 * (arc + n * F.tan(phi) * ww * (0.5 + ww * ((5 - t + 9 * c + 4 * c * c) / 24 + ww * (61 - 58 * t + t * t + 600 * c - 330 * e0sq) / 720)))
    return east, F.when(north < 0, north + 10000000).otherwise(north)


def pinhole(df: DataFrame, focal: float) -> DataFrame:
    """Points before the camera (which looks down -z) with image coordinates ``u`` and ``v``."""
    depth = -F.col("z")
    return df.where(depth > focal).withColumns({"u": F.col("x") * focal / depth, "v": F.col("y") * focal / depth})


# --- colours --------------------------------------------------------------


def pack_rgb(r: Column, g: Column, b: Column) -> Column:
    return F.shiftleft(r.cast("int"), 16).bitwiseOR(F.shiftleft(g.cast("int"), 8)).bitwiseOR(b.cast("int"))


def unpack_rgb(rgb: Column) -> tuple[Column, Column, Column]:
    return F.shiftright(rgb, 16).bitwiseAND(255), F.shiftright(rgb, 8).bitwiseAND(255), rgb.bitwiseAND(255)


def colormap(f: Column) -> Column:
    """Packed colour of a value in 0..1.  In some bands the value is cut to a whole number before it is scaled, so they are flat; this is how the colours are defined."""
    whole = lambda c: c.cast("int")
    zero = F.lit(0)
    low = pack_rgb(zero, zero, whole(128 * (1 - f / 0.25)))
    high = pack_rgb(F.lit(255), whole(255 + (0.5 - f) / 0.25 * 127), zero)
    last = pack_rgb(F.lit(255), whole(128 * (1 - f) / 0.25), zero)
    return F.when(f <= 0, pack_rgb(zero, zero, F.lit(128))).when(f <= 0.25, low).when(f <= 0.5, pack_rgb(zero, F.lit(255), zero)).when(f <= 0.75, high).when(f <= 1, last).otherwise(pack_rgb(F.lit(255), zero, zero))


def graymap(f: Column) -> Column:
    v = (f * 255).cast("int")
    return pack_rgb(v, v, v)


def rgb_to_lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """CIE L*, a*, b* of 8-bit sRGB under D65."""

    def linear(v: Column) -> Column:
        v = v / 255.0
        return F.when(v > 0.04045, F.pow((v + 0.055) / 1.055, F.lit(2.4))).otherwise(v / 12.92) * 100

    to_xyz = ((0.4124, 0.3576, 0.1805), (0.2126, 0.7152, 0.0722), (0.0193, 0.1192, 0.9505))  # fixed values
    white = (95.047, 100.0, 108.883)
    lin = [linear(v) for v in (r, g, b)]
    out = []
    for row, w in zip(to_xyz, white, strict=True):
        v = (lin[0] * row[0] + lin[1] * row[1] + lin[2] * row[2]) / w
        out.append(F.when(v > 0.008856, F.pow(v, F.lit(1 / 3))).otherwise((903.3 * v + 16) / 116))
    x, y, z = out
    return F.greatest(F.lit(0.0), 116 * y - 16), 500 * (x - y), 200 * (y - z)


def hot_label(rgb: Column, least: int = 60000) -> Column:
    """0 for a packed intensity over ``least``, else -1."""
    return F.when(rgb > least, 0).otherwise(-1)


# --- rules ----------------------------------------------------------------


def classify_box(length: Column, width: Column, height: Column, elevation: Column) -> Column:
    """none, person, display or light by the size of a box."""
    within = lambda v, lo, hi: (v > lo) & (v < hi)
    person = within(length, 0.21, 2.36) & within(width, 0.14, 1.34) & within(height, 0.73, 3.03) & (elevation < 0.5)
    display = within(length, 1, 5) & (height > 0.5) & (elevation < 1.5)
    light = (length < 0.4) & (width < 0.3) & (elevation > 0.7)
    return F.when(person, "person").when(display, "display").when(light, "light").otherwise("none")


def classify_parts(elongation: Column, ends: Column, middle: Column, sides: Column, slopes: Column) -> Column:
    """Class 1 to 5 by part features."""
    return F.when((ends + middle + sides >= 2) & (elongation > 2.2), 4).when(elongation > 3.5, 3).when(elongation < 2.2, 2).when((ends != 0) & (slopes < 5), 1).otherwise(5)


def inches_to_metres(value: Column, height: Column) -> Column:
    return F.when(height > 50, value * 0.0254).otherwise(value)


# --- triangles ------------------------------------------------------------


def vec(prefix: str) -> tuple[Column, Column, Column]:
    return tuple(F.col(f"{prefix}{c}") for c in XYZ)


def minus(a, b):
    return tuple(x - y for x, y in zip(a, b, strict=True))


def dot(a, b) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a, b):
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def plane_of(a, b, c):
    """Unit normal and d of the plane n.p = d through three points; null for points on a line."""
    n = cross(minus(b, a), minus(c, a))
    size = norm(n)
    unit = tuple(F.try_divide(v, size) for v in n)
    return unit, dot(unit, a)


def triangle_area(a, b, c) -> Column:
    return norm(cross(minus(b, a), minus(c, a))) / 2


def facing(normal, centroid, camera):
    """The normal turned to the side of the camera."""
    sign = F.when(dot(minus(camera, centroid), normal) < 0, -1.0).otherwise(1.0)
    return tuple(v * sign for v in normal)


def lambert(normal, light, colour: Column) -> Column:
    """Half ambient, half by the angle to the light."""
    return colour * F.least(F.lit(1.0), 0.5 + F.greatest(F.lit(0.0), dot(normal, light)))


def octant(x: Column, y: Column, z: Column) -> Column:
    return (z >= 0).cast("int") * 4 + (y >= 0).cast("int") * 2 + (x >= 0).cast("int")


def line_points(a: tuple[float, float, float], b: tuple[float, float, float], interval: float, spark) -> DataFrame:
    """Points between a and b, without the ends; the number of steps is the whole part of the squared distance over the squared interval."""
    n = int(sum((q - p) ** 2 for p, q in zip(a, b, strict=True)) / interval**2)
    step = F.col("id") / F.lit(float(max(n, 1)))
    return spark.range(1, max(n, 1)).select(*((p + step * (q - p)).alias(c) for c, p, q in zip(XYZ, a, b, strict=True)))


# --- vectors --------------------------------------------------------------


def l2_normalise(v: Column) -> Column:
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(v, lambda x: F.try_divide(x, size))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def manhattan(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)


# --- whole-table colourings and projections -----------------------------------


def project_image(df: DataFrame, focal: float, width: int, height: int, fit: bool = True, margin: float = 0.05) -> DataFrame:
    """(xi, yi, rgb): pixels of the points before the camera; of several points in a pixel that with the largest pid.  With ``fit`` the farthest point touches the margin, else 1 does."""
    p = pinhole(df, focal)
    far = p.agg(F.greatest(F.max(F.abs("u")), F.max(F.abs("v"))).alias("_far")) if fit else p.sparkSession.range(1).select(F.lit(1.0).alias("_far"))
    at = lambda c, size: (F.try_divide(F.col(c) * ((size - 1) * (1 - 2 * margin)), 2 * F.col("_far")) + size // 2).cast("int")
    px = p.crossJoin(F.broadcast(far)).withColumns({"xi": at("u", width), "yi": at("v", height)})
    return px.where(F.col("xi").between(0, width - 1) & F.col("yi").between(0, height - 1)).groupBy("xi", "yi").agg(F.max_by("rgb", "pid").alias("rgb"))


def stretched(df: DataFrame, columns: dict[str, Column], most: float = 255.0) -> DataFrame:
    """``df`` with values scaled to 0..``most`` over the table (null if they are all one)."""
    held = df.withColumns({f"_v_{k}": v for k, v in columns.items()})
    ends = held.agg(*(f(f"_v_{k}").alias(f"_{f.__name__}_{k}") for k in columns for f in (F.min, F.max)))
    out = held.crossJoin(F.broadcast(ends))
    out = out.withColumns({k: F.try_divide((F.col(f"_v_{k}") - F.col(f"_min_{k}")) * most, F.col(f"_max_{k}") - F.col(f"_min_{k}")) for k in columns})
    return out.drop(*(f"_{p}_{k}" for k in columns for p in ("v", "min", "max")))


def stretch_lab(df: DataFrame) -> DataFrame:
    """Colours (r, g, b) replaced by L, a and b, each stretched to bytes."""
    lab = rgb_to_lab(F.col("r"), F.col("g"), F.col("b"))
    out = stretched(df, dict(zip(("_l", "_a", "_bb"), lab, strict=True)))
    return out.withColumns({c: F.col(k).cast("int") for c, k in zip("rgb", ("_l", "_a", "_bb"), strict=True)}).drop("_l", "_a", "_bb")


def energy_colours(df: DataFrame) -> DataFrame:
    """``df`` with ``rgb`` by the sum of squares of ``features`` over the largest."""
    energy = F.aggregate("features", F.lit(0.0), lambda s, v: s + v * v)
    top = df.agg(F.max(energy).alias("_top"))
    return df.crossJoin(F.broadcast(top)).withColumn("rgb", colormap(F.coalesce(F.try_divide(energy, F.col("_top")), F.lit(0.0)))).drop("_top")


def axes_points(size: float, interval: float, spark) -> DataFrame:
    """Points of the three axes, red, green and blue."""
    out = None
    for k, rgb in enumerate((0xFF0000, 0x00FF00, 0x0000FF)):
        line = line_points((0, 0, 0), tuple(size * (i == k) for i in range(3)), interval, spark).withColumn("rgb", F.lit(rgb))
        out = line if out is None else out.unionByName(line)
    return out


def palette_colour(label: Column) -> Column:
    """One of seven colours by label."""
    return F.element_at(F.array(*map(F.lit, (0xFF0000, 0x00FF00, 0x0000FF, 0xFFFF00, 0xFF00FF, 0x00FFFF, 0xFFFFFF))), (F.pmod(label, F.lit(7)) + 1).cast("int"))
