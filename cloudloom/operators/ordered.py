"""Operators on ordered rows: peaks, runs and levels of a building."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloudloom.operators import grid
from cloudloom.operators.graph import islands


def robust_bounds(df: DataFrame, by: list[str]) -> DataFrame:
    """x and y quartiles by order (the values at n div 4 and at n - ceil(n / 4)), and the ends of z.  Values are counted before they are ordered."""
    out = None
    for c in "xy":
        counts = df.groupBy(*by, c).agg(F.count("*").alias("n"))
        w = Window.partitionBy(*by).orderBy(c)
        total = F.sum("n").over(Window.partitionBy(*by))
        up = counts.withColumns({"_up": F.sum("n").over(w), "_t": total})
        low, high = F.expr("_t div 4"), F.col("_t") - F.ceil(F.col("_t") / 4)
        ends = up.groupBy(*by).agg(F.min(F.when(F.col("_up") > low, F.col(c))).alias(f"low_{c}"), F.min(F.when(F.col("_up") > high, F.col(c))).alias(f"high_{c}"))
        out = ends if out is None else out.join(ends, by)
    return out.join(df.groupBy(*by).agg(F.min("z").alias("low_z"), F.max("z").alias("high_z")), by)


def z_profile(df: DataFrame, steps: int = 100) -> DataFrame:
    """(i, v): occupied cells by height in a grid of ``steps`` cells an axis, for i = 0 .. steps."""
    b = grid.bounds(df)
    g = df.crossJoin(F.broadcast(b)).select(*(F.try_divide(F.col(c) - F.col(f"min_{c}"), (F.col(f"max_{c}") - F.col(f"min_{c}")) / steps).cast("int").alias(f"{c}i") for c in "xyz")).distinct()
    n = g.groupBy(F.col("zi").alias("i")).agg(F.count("*").alias("v"))
    return df.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("i")).join(F.broadcast(n), "i", "left").select("i", F.coalesce("v", F.lit(0)).alias("v"))


def median_peaks(series: DataFrame, reach: int = 10, ratio: float = 1.5, most: int = 6) -> DataFrame:
    """Runs of values over ``ratio`` times the value at place ``reach`` of the sorted window of ``reach`` on both sides: (island, first, last, peak), the ``most`` highest.  The series (i, v) is short: a bin a row."""
    w = Window.orderBy("i").rowsBetween(-reach, reach)
    s = series.withColumn("_m", F.get(F.sort_array(F.collect_list("v").over(w)), F.lit(reach)))
    high = islands(s.where(F.col("v") > F.col("_m") * ratio).select("i", "v"), "i")
    runs = high.groupBy("island").agg(F.min("i").alias("first"), F.max("i").alias("last"), F.max("v").alias("peak"))
    return runs.orderBy(F.desc("peak"), "first").limit(most)


def levels(df: DataFrame, peaks: DataFrame, steps: int = 100) -> DataFrame:
    """``df`` with ``level`` for points in a run of the profile and ``storey`` for those between two, both numbered from below.  Runs are few and broadcast."""
    w = Window.orderBy("first")
    runs = peaks.select("first", "last", (F.row_number().over(w) - 1).alias("k"), F.lead("first").over(w).alias("next"))
    b = df.agg(F.min("z").alias("_lo"), F.max("z").alias("_hi"))
    p = df.crossJoin(F.broadcast(b)).withColumn("_zi", F.try_divide(F.col("z") - F.col("_lo"), (F.col("_hi") - F.col("_lo")) / steps).cast("int"))
    hit = (F.col("_zi") >= F.col("first")) & ((F.col("_zi") <= F.col("last")) | (F.col("_zi") < F.col("next")))
    out = p.join(F.broadcast(runs), hit, "left")
    inside = F.col("_zi") <= F.col("last")
    return out.withColumns({"level": F.when(inside, F.col("k")), "storey": F.when(~inside, F.col("k"))}).select(*df.columns, "level", "storey")


def columns(clusters: DataFrame, by: str, most_side: float = 3.0, slack: float = 0.5) -> DataFrame:
    """Clusters that stand like columns: robust sides under ``most_side`` and nearly the whole height."""
    h = clusters.agg((F.max("z") - F.min("z")).alias("_h"))
    b = robust_bounds(clusters, [by]).crossJoin(F.broadcast(h))
    return b.where((F.col("high_x") - F.col("low_x") < most_side) & (F.col("high_y") - F.col("low_y") < most_side) & (F.col("high_z") - F.col("low_z") > F.col("_h") - slack)).drop("_h")


def beams(df: DataFrame, steps: int = 150, share: float = 0.5) -> DataFrame:
    """Points in beams: lines of cells across (``axis`` x or y) that are occupied in at least ``share`` of the fullest line, runs of lines being one beam."""
    b = grid.bounds(df)
    size = F.least(*((F.col(f"max_{c}") - F.col(f"min_{c}")) / steps for c in "xy"))
    cells = df.crossJoin(F.broadcast(b)).withColumns({f"{c}i": F.try_divide(F.col(c) - F.col(f"min_{c}"), size).cast("int") for c in "xy"})
    out = None
    for along, across in (("xi", "yi"), ("yi", "xi")):
        n = cells.select(along, across).distinct().groupBy(along).agg(F.count("*").alias("n"))
        top = n.agg(F.max("n").alias("_top"))
        full = islands(n.crossJoin(F.broadcast(top)).where(F.col("n") >= F.col("_top") * share).select(along), along)
        found = cells.join(full, along).select("pid", F.lit(along[0]).alias("axis"), F.col("island").alias("beam"))
        out = found if out is None else out.unionByName(found)
    return out


def single_run(cells: DataFrame, by: list[str], index: str) -> DataFrame:
    """Length of the run of a group's whole numbers if it is the only one, else 0."""
    runs = islands(cells.select(*by, index).distinct(), index, by)
    return runs.groupBy(*by).agg(F.when(F.max("island") == 0, F.count("*")).otherwise(0).alias("run"))


def longest_run(rows: DataFrame, by: list[str], index: str) -> DataFrame:
    runs = islands(rows, index, by).groupBy(*by, "island").agg(F.count("*").alias("len"))
    return runs.groupBy(*by).agg(F.max("len").alias("longest"))


def block_2d(cells: DataFrame, by: list[str], row: str, column: str) -> DataFrame:
    """Longest single run of a group's rows if the rows with one follow each other, else 0."""
    runs = single_run(cells, [*by, row], column).where("run > 0")
    w = islands(runs, row, by)
    return w.groupBy(*by).agg(F.when(F.max("island") == 0, F.max("run")).otherwise(0).alias("block"))
