"""DataFrames of point-cloud, mesh and result files.

A file is the unit that these formats are read by: each is parsed where Spark
reads it, and many files are read side by side.  ``file`` says where a row is
from, ``cloud_id`` is the file's name without its ending.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudloom.sources import parsers

_P = "pid long, x double, y double, z double"
_RGB = "r int, g int, b int"
FORMATS: dict[str, tuple[Callable[[bytes], parsers.Table], str]] = {
    "pcd": (parsers.pcd, f"{_P}, rgb int"),
    "kitti": (parsers.kitti, f"{_P}, reflectance double"),
    "oxts": (parsers.oxts, "lat double, lon double, alt double, roll double, pitch double, yaw double"),
    "pts": (parsers.pts, f"{_P}, intensity double, {_RGB}"),
    "ply": (parsers.ply_points, f"{_P}, {_RGB}"),
    "ply_faces": (parsers.ply_faces, "fid long, a long, b long, c long"),
    "obj": (parsers.obj_points, _P),
    "obj_faces": (parsers.obj_faces, "fid long, a long, b long, c long, grp string, material string"),
    "obj_elements": (parsers.obj_elements, "element string, vid long, x double, y double, z double"),
    "off": (parsers.off_points, _P),
    "matrix": (parsers.matrix, "row long, features array<double>"),
    "descriptor": (parsers.descriptor, "desc_id long, features array<double>"),
    "og": (parsers.occupancy_grid, "x int, y int, z int, v double"),
    "labels": (parsers.labels, "obj_id long, label int"),
    "prediction": (parsers.prediction, "obj_id long, label int, scores array<struct<label:int,score:double>>"),
    "categories": (parsers.categories, "label int, name string"),
    "shape_classes": (parsers.shape_classes, "category string, model_id long"),
    "matches": (parsers.matches, "scan int, file_name string, k int, x double, y double, z double"),
    "pbm": (parsers.bitmap, "xi int, yi int"),
    "ppm": (parsers.pixmap, f"xi int, yi int, {_RGB}"),
    "bundler_cameras": (parsers.bundler_cameras, "camera int, focal double, k1 double, k2 double, rotation array<double>, shift array<double>"),
    "bundler_points": (parsers.bundler_points, f"{_P}, {_RGB}"),
    "bundler_views": (parsers.bundler_views, "pid long, camera int, key int, u double, v double"),
    "projection": (parsers.projection, "rotation array<double>, shift array<double>, centre array<double>"),
}


def read(spark: SparkSession, kind: str, path: str, box: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Files of a format under a path (a folder, a file or a glob) with ``file`` and ``cloud_id``.

    ``box`` drops rows outside closed intervals while a file is parsed, before
    they become Spark rows.
    """
    parse, schema = FORMATS[kind]
    names = [c.strip().split()[0] for c in _split(schema)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path_, raw in zip(batch.path, batch.content, strict=True):
                table = parse(bytes(raw))
                out = pd.DataFrame({n: pd.Series(list(v), dtype=object) for n, v in zip(names, table.values(), strict=True)})
                for c, (lo, hi) in (box or {}).items():
                    out = out[(out[c] >= lo) & (out[c] <= hi)]
                yield out.assign(file=path_)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    rows = files.mapInPandas(run, f"{schema}, file string")
    name = F.regexp_extract("file", r"([^/]+?)(\.[^./]*)?$", 1)
    return rows.withColumn("cloud_id", name)


def _split(schema: str) -> list[str]:
    """Columns of a schema text; commas within types don't count."""
    out, depth = [""], 0
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def read_libsvm(spark: SparkSession, path: str, size: int) -> DataFrame:
    """(label, features array<double>) of ``label index:value ..`` lines."""
    from pyspark.ml.functions import vector_to_array

    rows = spark.read.format("libsvm").option("numFeatures", str(size)).load(path)
    return rows.select(F.col("label").cast("int").alias("label"), vector_to_array("features").alias("features"))


def read_clusters(spark: SparkSession, path: str, labels: DataFrame | None = None) -> DataFrame:
    """Points of ``<i>-cloud.pcd`` files with ``obj_id`` and, if given, the label of the object."""
    rows = read(spark, "pcd", path)
    rows = rows.withColumn("obj_id", F.regexp_extract("file", r"(\d+)-cloud\.pcd$", 1).try_cast("long")).where("obj_id is not null")
    return rows if labels is None else rows.join(labels.select("obj_id", "label"), "obj_id", "left")


def normalise_intensity(points: DataFrame) -> DataFrame:
    """Intensities scaled to 0..1 over the whole table."""
    ends = points.agg(F.min("intensity").alias("_lo"), F.max("intensity").alias("_hi"))
    return points.crossJoin(F.broadcast(ends)).withColumn("intensity", F.try_divide(F.col("intensity") - F.col("_lo"), F.col("_hi") - F.col("_lo"))).drop("_lo", "_hi")


def place_on_earth(points: DataFrame, poses: DataFrame, origin: tuple[float, float, float]) -> DataFrame:
    """Scans moved by their pose (cloud_id, lat, lon, alt), in metres east, north and up of an origin in the same terms."""
    from cloudloom.functions.columns import utm

    east, north = utm(F.col("lat"), F.col("lon"))
    p = poses.select("cloud_id", (east - origin[0]).alias("_e"), (north - origin[1]).alias("_n"), (F.col("alt") - origin[2]).alias("_u"))
    moved = points.join(p, "cloud_id")
    return moved.withColumns({"x": F.col("x") + F.col("_e"), "y": F.col("y") + F.col("_n"), "z": F.col("z") + F.col("_u")}).drop("_e", "_n", "_u")
