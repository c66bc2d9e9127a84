"""Filters, samples and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudloom.functions.tables import materialize


def box(df: DataFrame, **bounds: tuple[float | None, float | None]) -> DataFrame:
    """Rows in closed intervals by column; None leaves a side open.  Plain comparisons, so they reach the scan."""
    for c, (lo, hi) in bounds.items():
        if lo is not None:
            df = df.where(F.col(c) >= F.lit(lo))
        if hi is not None:
            df = df.where(F.col(c) <= F.lit(hi))
    return df


def plane_side(df: DataFrame, a: float, b: float, c: float, d: float, threshold: float, inliers: bool) -> DataFrame:
    """Points nearer than ``threshold`` to a x + b y + c z + d = 0, or farther; those at the threshold are in neither."""
    size = (a * a + b * b + c * c) ** 0.5
    dist = F.abs(F.col("x") * a + F.col("y") * b + F.col("z") * c + d)
    return df.where(dist < threshold * size if inliers else dist > threshold * size)


def in_box(points: DataFrame, boxes: DataFrame, margin: float = 0.1) -> DataFrame:
    """Points in oriented boxes (box_id, ox, oy, oz, axes array<array<double>> of three, lengths array<double>): 0 - margin <= the place along each axis <= its length + margin.  The boxes are few and are broadcast if they are small."""
    place = lambda k: sum((F.col("axes")[k][i] * (F.col(c) - F.col(f"o{c}")) for i, c in enumerate("xyz")), F.lit(0.0))
    fits = F.lit(True)
    for k in range(3):
        fits &= (place(k) >= -margin) & (place(k) <= F.col("lengths")[k] + margin)
    return points.join(boxes, fits)


def size_gate(train: DataFrame, test: DataFrame, columns: list[str], widen: float = 0.3) -> DataFrame:
    """Rows of ``test`` strictly within the ranges of ``train``, widened by a share of their ends."""
    ranges = train.agg(*(f(c).alias(f"_{f.__name__}_{c}") for c in columns for f in (F.min, F.max)))
    out = test.crossJoin(F.broadcast(ranges))  # one row
    for c in columns:
        out = out.where((F.col(c) > F.col(f"_min_{c}") * (1 - widen)) & (F.col(c) < F.col(f"_max_{c}") * (1 + widen)))
    return out.select(*test.columns)


def sigma(df: DataFrame, columns: list[str], times: float = 1.5) -> DataFrame:
    """Rows within ``times`` population standard deviations of the mean in all columns."""
    stats = df.agg(*(g(c).alias(f"_{n}_{c}") for c in columns for n, g in (("m", F.avg), ("s", F.stddev_pop))))
    out = df.crossJoin(F.broadcast(stats))
    for c in columns:
        out = out.where(F.abs(F.col(c) - F.col(f"_m_{c}")) < times * F.col(f"_s_{c}"))
    return out.select(*df.columns)


def label_frequency(df: DataFrame, label: str, more_than: int, less_than: int) -> DataFrame:
    """Labels that aren't numbers and are neither rare nor frequent, with their counts; parentheses become underscores."""
    clean = F.regexp_replace(F.col(label), r"[()]", "_")
    return df.where(~F.col(label).rlike(r"^[0-9]+$")).groupBy(clean.alias(label)).agg(F.count("*").alias("n")).where((F.col("n") > more_than) & (F.col("n") < less_than))


def without_zero(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.where(F.col(c) != 0)
    return df


def every_nth(df: DataFrame, key: str, n: int) -> DataFrame:
    """``df`` with ``is_train``: every n-th key in order, from the first.

    Keys are numbered without a global window: they are counted per hash range
    of the sorted table's partitions, and only those counts meet.
    """
    ids = df.select(key).distinct().repartitionByRange(F.col(key)).sortWithinPartitions(key)
    placed = materialize(ids.select(key, F.spark_partition_id().alias("_part")), "numbered")  # ranges are drawn once
    local = placed.withColumn("_rank", F.row_number().over(Window.partitionBy("_part").orderBy(key)))
    sizes = local.groupBy("_part").agg(F.max("_rank").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).select("_part", "_before")  # a row a partition
    rank = local.join(F.broadcast(before), "_part").select(key, ((F.col("_rank") + F.col("_before") - 1) % n == 0).alias("is_train"))
    return df.join(rank, key)


def sample_per_group(df: DataFrame, group: str, n: int, seed: int) -> DataFrame:
    """``n`` random rows of each group."""
    w = Window.partitionBy(group).orderBy(F.rand(seed))
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def keep_indices(df: DataFrame, ids: DataFrame, key: str, inside: bool) -> DataFrame:
    """Rows whose key is in a list, or isn't."""
    return df.join(ids.select(key).distinct(), key, "left_semi" if inside else "left_anti")


def sample_mesh(triangles: DataFrame, per_area: float, seed: int) -> DataFrame:
    """Random points on triangles (ax .. cz): on average one for each ``per_area``, uniform."""
    from cloudloom.functions.columns import triangle_area, vec

    a, b, c = vec("a"), vec("b"), vec("c")
    want = triangle_area(a, b, c) / per_area
    n = (F.floor(want) + (F.rand(seed) < want - F.floor(want)).cast("int")).cast("int")
    rows = triangles.withColumn("_n", n).where("_n > 0").withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    u, v = F.rand(seed + 1), F.rand(seed + 2)
    rows = rows.withColumns({"_u": u, "_v": v})
    fold: Column = F.col("_u") + F.col("_v") > 1
    u, v = F.when(fold, 1 - F.col("_u")).otherwise(F.col("_u")), F.when(fold, 1 - F.col("_v")).otherwise(F.col("_v"))
    return rows.select(*((p + u * (q - p) + v * (r - p)).alias(k) for k, p, q, r in zip("xyz", a, b, c, strict=True)))
