"""Binary images as sets of pixels (xi, yi)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudloom.operators import grid

PIXEL = ["xi", "yi"]
CROSS = [(0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)]


def _spread(image: DataFrame, offsets) -> DataFrame:
    o = F.explode(F.array(*(F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy")) for x, y in offsets))).alias("o")
    return image.select("xi", "yi", o).select((F.col("xi") + F.col("o.dx")).alias("xi"), (F.col("yi") + F.col("o.dy")).alias("yi"), "o.dx", "o.dy")


def _inside(pixels: DataFrame, width: int, height: int, rim: int = 0) -> DataFrame:
    return pixels.where(F.col("xi").between(rim, width - 1 - rim) & F.col("yi").between(rim, height - 1 - rim))


def erode(image: DataFrame, width: int, height: int) -> DataFrame:
    """Pixels that are set with all four neighbours; none on the border."""
    full = _spread(image, CROSS).groupBy(*PIXEL).agg(F.count("*").alias("n")).where("n = 5")
    return _inside(full, width, height, 1).select(*PIXEL)


def dilate(image: DataFrame, width: int, height: int) -> DataFrame:
    """Pixels with a set pixel among themselves and their four neighbours; those on the border stay as they are."""
    grown = _inside(_spread(image, CROSS).select(*PIXEL), width, height, 1)
    rim = image.where(F.col("xi").isin(0, width - 1) | F.col("yi").isin(0, height - 1)).select(*PIXEL)
    return grown.unionByName(rim).distinct()


def opening(image: DataFrame, width: int, height: int, k: int = 1) -> DataFrame:
    for _ in range(k):
        image = erode(image, width, height)
    for _ in range(k):
        image = dilate(image, width, height)
    return image


def closing(image: DataFrame, width: int, height: int, k: int = 1) -> DataFrame:
    for _ in range(k):
        image = dilate(image, width, height)
    for _ in range(k):
        image = erode(image, width, height)
    return image


def edges(image: DataFrame, width: int, height: int, least: int = 4) -> DataFrame:
    """Pixels, off the border, where the Sobel gradients of the image sum to more than ``least`` in absolute value."""
    around = [(x, y) for x in (-1, 0, 1) for y in (-1, 0, 1) if x or y]
    weight = {(x, y): (x * (2 if y == 0 else 1), y * (2 if x == 0 else 1)) for x, y in around}
    gx = F.create_map(*(v for k, w in weight.items() for v in (F.lit(f"{k[0]},{k[1]}"), F.lit(w[0]))))
    gy = F.create_map(*(v for k, w in weight.items() for v in (F.lit(f"{k[0]},{k[1]}"), F.lit(w[1]))))
    seen = _spread(image, around).withColumn("k", F.concat_ws(",", "dx", "dy"))
    sums = _inside(seen, width, height, 1).groupBy(*PIXEL).agg(F.abs(F.sum(gx[F.col("k")])).alias("gx"), F.abs(F.sum(gy[F.col("k")])).alias("gy"))
    return sums.where(F.col("gx") + F.col("gy") > least).select(*PIXEL)


def holes(image: DataFrame, width: int, height: int) -> DataFrame:
    """The unset pixels, for components of the background (joined over all eight neighbours)."""
    spark = image.sparkSession
    all_ = spark.range(width * height).select((F.col("id") % width).cast("int").alias("xi"), (F.col("id") / width).cast("int").alias("yi"))
    return all_.join(image, PIXEL, "left_anti")


def raster(df: DataFrame, u: str, v: str, step: float) -> DataFrame:
    """Set pixels of two columns on a grid from their least values."""
    b = df.agg(F.min(u).alias("_u"), F.min(v).alias("_v"))
    return df.crossJoin(F.broadcast(b)).select(((F.col(u) - F.col("_u")) / step).cast("int").alias("xi"), ((F.col(v) - F.col("_v")) / step).cast("int").alias("yi")).distinct()


def background_components(image: DataFrame, width: int, height: int) -> DataFrame:
    from cloudloom.operators.graph import cluster_cells

    return cluster_cells(holes(image, width, height), grid.offsets(1, "linf", 2), PIXEL)


def edge_pixels(edge: DataFrame, components: DataFrame) -> DataFrame:
    """Edge pixels with the component they are in, without the first (the outside)."""
    outside = components.agg(F.min("component").alias("_o"))
    return edge.join(components, PIXEL).crossJoin(F.broadcast(outside)).where("component <> _o").drop("_o")
