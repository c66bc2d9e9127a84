"""Voxels: cells of a grid, what stands for them, and operators on sets of cells."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL = ["xi", "yi", "zi"]


def bounds(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    aggs = [f(c).alias(f"{f.__name__}_{c}") for c in "xyz" for f in (F.min, F.max)]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def with_cells(df: DataFrame, *, leaf: float | None = None, num_grid: int | None = None, origin: str = "min", by: list[str] | None = None) -> DataFrame:
    """``df`` with xi, yi, zi and the grid's ``leaf`` and corner (ox, oy, oz).

    The leaf is given, or the shortest extent over ``num_grid``.  Cells are cut
    off towards zero, so that with ``origin="mid"`` (the middle of the bounds)
    the cells around zero are twice as wide.
    """
    b = bounds(df, by)
    size = F.lit(float(leaf)) if leaf is not None else F.least(*(F.col(f"max_{c}") - F.col(f"min_{c}") for c in "xyz")) / F.lit(num_grid)
    at = (lambda c: F.col(f"min_{c}")) if origin == "min" else (lambda c: (F.col(f"min_{c}") + F.col(f"max_{c}")) * 0.5)
    g = b.select(*(by or []), size.alias("leaf"), *(at(c).alias(f"o{c}") for c in "xyz"))
    out = df.join(g, by) if by else df.crossJoin(F.broadcast(g))  # one row, or one a cloud
    return out.withColumns({f"{c}i": F.try_divide(F.col(c) - F.col(f"o{c}"), F.col("leaf")).cast("int") for c in "xyz"})


def voxelise(df: DataFrame, representative: str = "first", by: list[str] | None = None, **grid) -> DataFrame:
    """One row a cell: the first point by pid (and its other columns), the cell's corner, or the mean of its points."""
    by = by or []
    cells = with_cells(df, by=by or None, **grid)
    keys = [*by, *CELL]
    if representative == "centroid":
        return cells.groupBy(*keys).agg(*(F.avg(c).alias(c) for c in "xyz"), F.count("*").alias("n"))
    rest = [c for c in df.columns if c not in keys]
    first = cells.groupBy(*keys).agg(F.min_by(F.struct(*rest, "leaf", "ox", "oy", "oz"), "pid").alias("v")).select(*keys, "v.*")
    if representative == "corner":
        first = first.withColumns({c: F.col(f"o{c}") + F.col(f"{c}i") * F.col("leaf") for c in "xyz"})
    return first.select(*keys, *rest)


def without_lowest(cells: DataFrame, n: int = 2, by: list[str] | None = None) -> DataFrame:
    """Ground removal: the ``n`` lowest cells of each column go."""
    w = Window.partitionBy(*(by or []), "xi", "yi").orderBy("zi")
    return cells.withColumn("_k", F.row_number().over(w)).where(F.col("_k") > n).drop("_k")


def lowest(cells: DataFrame, by: list[str] | None = None) -> DataFrame:
    return cells.groupBy(*(by or []), "xi", "yi").agg(F.min("zi").alias("zi"))


def offsets(radius: int, norm: str = "l1", axes: int = 3, centre: bool = False) -> list[tuple[int, ...]]:
    """Whole-number offsets within a radius, by the sum of absolute values (l1) or the largest (linf)."""
    size = sum if norm == "l1" else max
    return [o for o in product(range(-radius, radius + 1), repeat=axes) if size(abs(v) for v in o) <= radius and (centre or any(o))]


def _offset_column(found: list[tuple[int, ...]], names: list[str]) -> Column:
    return F.explode(F.array(*(F.struct(*(F.lit(v).alias(f"d{n}") for v, n in zip(o, names, strict=True))) for o in found))).alias("o")


def neighbours(cells: DataFrame, found: list[tuple[int, ...]], axes: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
    """Pairs of cells that are one of the offsets apart: the axes, those of the neighbour as n_*, and the offsets as d*.  An equi-join on the moved cell."""
    axes, by = axes or CELL, by or []
    moved = cells.select("*", _offset_column(found, axes)).select("*", "o.*").drop("o")
    other = cells.select(*by, *(F.col(a).alias(f"n_{a}") for a in axes))
    moved = moved.withColumns({f"n_{a}": F.col(a) + F.col(f"d{a}") for a in axes})
    return moved.join(other, [*by, *(f"n_{a}" for a in axes)])


def dilate(cells: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Each cell and its four neighbours in the plane, once; a new cell takes the least value that reaches it, an old one keeps its own."""
    moves = [(0, 0), *offsets(1, axes=2)]
    spread = cells.select("*", _offset_column(moves, ["x", "y"])).select(*(by or []), (F.col("xi") + F.col("o.dx")).alias("xi"), (F.col("yi") + F.col("o.dy")).alias("yi"), "zi", value, ((F.col("o.dx") != 0) | (F.col("o.dy") != 0)).alias("_new"))
    return spread.groupBy(*(by or []), *CELL).agg(F.min_by(value, F.struct("_new", value)).alias(value))


def regions(cells: DataFrame, n: int) -> DataFrame:
    """``cells`` with the region of an n x n division of the plane (``rx``, ``ry``)."""
    b = cells.agg((F.max("xi") + 1).alias("_w"), (F.max("yi") + 1).alias("_h"))
    out = cells.crossJoin(F.broadcast(b))
    return out.withColumns({"rx": F.expr(f"xi * {n} div _w").cast("int"), "ry": F.expr(f"yi * {n} div _h").cast("int")}).drop("_w", "_h")


def density(df: DataFrame, short_axis: int = 9, by: list[str] | None = None) -> DataFrame:
    """Share of the points in each cell of a grid with ``short_axis`` cells on the shortest axis and in proportion on the others, rounded to the nearest."""
    by = by or []
    b = bounds(df, by or None)
    span = {c: F.col(f"max_{c}") - F.col(f"min_{c}") for c in "xyz"}
    shortest = F.least(*span.values())
    cellsn = {c: F.when(span[c] == shortest, F.lit(short_axis)).otherwise((short_axis * (span[c] / shortest)).cast("int")) for c in "xyz"}
    g = b.select(*by, *(F.col(f"min_{c}").alias(f"o{c}") for c in "xyz"), *((F.try_divide(cellsn[c] - 1, span[c])).alias(f"s{c}") for c in "xyz"))
    out = df.join(g, by) if by else df.crossJoin(F.broadcast(g))
    idx = {f"{c}i": F.floor((F.col(c) - F.col(f"o{c}")) * F.coalesce(F.col(f"s{c}"), F.lit(0.0)) + 0.5).cast("int") for c in "xyz"}
    counts = out.withColumns(idx).groupBy(*by, *CELL).agg(F.count("*").alias("n"))
    total = counts.groupBy(*by).agg(F.sum("n").alias("_t")) if by else counts.agg(F.sum("n").alias("_t"))
    counts = counts.join(total, by) if by else counts.crossJoin(F.broadcast(total))
    return counts.select(*by, *CELL, (F.col("n") / F.col("_t")).alias("v"))


def volume_ratio(df: DataFrame, by: list[str], steps: int = 20) -> DataFrame:
    """Share of occupied cells of a grid whose leaf is the height over ``steps``."""
    b = bounds(df, by).withColumn("_leaf", (F.col("max_z") - F.col("min_z")) / steps)
    out = df.join(b, by)
    cell = F.struct(*(F.try_divide(F.col(c) - F.col(f"min_{c}"), F.col("_leaf")).cast("int") for c in "xyz"))
    n = {c: F.try_divide(F.col(f"max_{c}") - F.col(f"min_{c}"), F.col("_leaf")).cast("int") + 1 for c in "xyz"}
    return out.groupBy(*by, *(n[c].alias(f"n{c}") for c in "xyz")).agg(F.count_distinct(cell).alias("occupied")).select(*by, "occupied", F.try_divide(F.col("occupied"), F.col("nx").cast("long") * F.col("ny") * F.col("nz")).alias("ratio"))


def curvature(cells: DataFrame, radius: int = 3) -> DataFrame:
    """|sum dx| + |sum dy| + |sum dz| over the occupied cells of the cube around each cell.

    Cells meet through blocks as wide as the cube: each goes to its own block
    and its 26 neighbours, instead of to all cells of the cube.
    """
    wide = 2 * radius + 1
    block = lambda c: F.floor(F.col(c) / wide).cast("int")
    left = cells.select(*CELL, *(block(c).alias(f"b{c}") for c in CELL))
    right = cells.select(*(F.col(c).alias(f"n_{c}") for c in CELL), *(block(c).alias(f"_b{c}") for c in CELL), _offset_column(offsets(1, "linf", centre=True), CELL))
    right = right.select(*(f"n_{c}" for c in CELL), *((F.col(f"_b{c}") + F.col(f"o.d{c}")).alias(f"b{c}") for c in CELL))
    pairs = left.join(right, [f"b{c}" for c in CELL])
    d = {c: F.col(f"n_{c}") - F.col(c) for c in CELL}
    for v in d.values():
        pairs = pairs.where(F.abs(v) <= radius)
    return pairs.groupBy(*CELL).agg(sum((F.abs(F.sum(v)) for v in list(d.values())[1:]), F.abs(F.sum(d["xi"]))).cast("long").alias("curvature"))


def unit_cells(df: DataFrame, bins: int = 50, by: list[str] | None = None) -> DataFrame:
    """The first point of each of ``bins`` cells an axis of the cube around the cloud, moved and scaled so that the longest extent is 1 around 0."""
    by = by or []
    b = bounds(df, by or None)
    size = F.greatest(*(F.col(f"max_{c}") - F.col(f"min_{c}") for c in "xyz"))
    g = b.select(*by, size.alias("_s"), *(((F.col(f"min_{c}") + F.col(f"max_{c}")) / 2).alias(f"_m{c}") for c in "xyz"))
    p = df.join(g, by) if by else df.crossJoin(F.broadcast(g))
    p = p.withColumns({c: F.coalesce(F.try_divide(F.col(c) - F.col(f"_m{c}"), F.col("_s")), F.lit(0.0)) for c in "xyz"}).drop("_s", *(f"_m{c}" for c in "xyz"))
    p = p.withColumns({f"{c}i": F.when(F.col(c) >= 0.5, bins - 1).otherwise(((F.col(c) + 0.5) * bins).cast("int")) for c in "xyz"})
    rest = [c for c in p.columns if c not in (*by, *CELL)]
    return p.groupBy(*by, *CELL).agg(F.min_by(F.struct(*rest), "pid").alias("v")).select(*by, *CELL, "v.*")


def curvature_colours(cells: DataFrame, radius: int = 3) -> DataFrame:
    """Curvatures with ``rgb``, coloured from the least to the largest."""
    from cloudloom.functions.columns import colormap, stretched

    out = stretched(curvature(cells, radius), {"_f": F.col("curvature").cast("double")}, 1.0)
    return out.withColumn("rgb", colormap(F.coalesce("_f", F.lit(0.0)))).drop("_f")


def insert(cells: DataFrame, new: DataFrame, size: tuple[int, int, int]) -> DataFrame:
    """The cells with new ones inside 0 .. size - 1; one that is there stays as it is."""
    inside = new
    for c, n in zip(CELL, size, strict=True):
        inside = inside.where(F.col(c).between(0, n - 1))
    return cells.unionByName(inside.dropDuplicates(CELL).join(cells, CELL, "left_anti"))
