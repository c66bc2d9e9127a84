"""Sinks: a table as text files of a format, one for each group.

Each sink turns rows into lines with a place, so that Spark's text writer can
put header and body in order.  A format's header has the number of rows, which
is an aggregate.  A group's file is written by one task, as the format wants;
groups are written side by side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _number(c) -> Column:
    return F.format_string("%f", F.col(c) if isinstance(c, str) else c)


def save_lines(lines: DataFrame, by: str | None, path: str) -> None:
    """Write (by, place, value): a folder ``by=value`` with one file for each group, or one file."""
    if by:
        ordered = lines.repartition(F.col(by)).sortWithinPartitions(by, "place")
        ordered.select(by, "value").write.partitionBy(by).text(path)
    else:
        lines.repartition(1).sortWithinPartitions("place").select("value").write.text(path)


def _with_header(rows: DataFrame, by: str | None, header: Column, order: str) -> DataFrame:
    """Lines of ``rows`` (by, value, order) under a header that may use ``n``."""
    keys = [by] if by else []
    head = rows.groupBy(*keys).agg(F.count("*").alias("n")).select(*keys, F.lit(-1).cast("long").alias("place"), header.alias("value"))
    return rows.select(*keys, F.col(order).cast("long").alias("place"), "value").unionByName(head)


_PCD = "# .PCD v0.7 - Point Cloud Data file format\nVERSION 0.7\nFIELDS {fields}\nSIZE {size}\nTYPE {type}\nCOUNT {count}\nWIDTH {width}\nHEIGHT {height}\nVIEWPOINT 0 0 0 1 0 0 0\nPOINTS {points}\nDATA ascii"


def _pcd_header(fields: str, size: str, kind: str, count: str, n: Column | None = None, points: str = "%d") -> Column:
    text = _PCD.format(fields=fields, size=size, type=kind, count=count, width="%d", height="1", points="%d")
    n = F.col("n") if n is None else n
    return F.format_string(text, n, n)


def pcd_lines(points: DataFrame, by: str | None = None) -> DataFrame:
    """Points (pid, x, y, z and perhaps rgb)."""
    if "rgb" in points.columns:
        value, header = F.concat_ws(" ", *map(_number, "xyz"), F.col("rgb").cast("string")), _pcd_header("x y z rgb", "4 4 4 4", "F F F I", "1 1 1 1")
    else:
        value, header = F.concat_ws(" ", *map(_number, "xyz")), _pcd_header("x y z", "4 4 4", "F F F", "1 1 1")
    return _with_header(points.withColumn("value", value), by, header, "pid")


def voxel_lines(cells: DataFrame, grid: DataFrame, by: str | None = None) -> DataFrame:
    """Corners of cells (xi, yi, zi) of a one-row grid (ox, oy, oz, leaf)."""
    p = cells.crossJoin(F.broadcast(grid)).withColumns({c: F.col(f"o{c}") + F.col(f"{c}i") * F.col("leaf") for c in "xyz"})
    return pcd_lines(p.withColumn("pid", F.monotonically_increasing_id()), by)


def cluster_lines(points: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Points with the cluster of their cell, or "outlier": lines by ``cluster``."""
    named = points.join(labels.select(key, "cluster_id"), key, "left")
    name = F.when(F.coalesce("cluster_id", F.lit(-1)) < 0, F.lit("outlier")).otherwise(F.concat(F.col("cluster_id").cast("string"), F.lit("-cloud")))
    return pcd_lines(named.withColumn("cluster", name), "cluster")


def ply_lines(points: DataFrame, by: str | None = None) -> DataFrame:
    """Vertices with colours (r, g, b)."""
    value = F.concat_ws(" ", *map(_number, "xyz"), "r", "g", "b")
    head = "ply\nformat ascii 1.0\nelement vertex %d\nproperty float x\nproperty float y\nproperty float z\nproperty uchar diffuse_red\nproperty uchar diffuse_green\nproperty uchar diffuse_blue\nend_header"
    return _with_header(points.withColumn("value", value), by, F.format_string(head, F.col("n")), "pid")


def descriptor_lines(rows: DataFrame, size: int, by: str | None = None, field: str = "descriptor") -> DataFrame:
    """Vectors (desc_id, features) of one length."""
    value = F.concat_ws(" ", F.transform("features", lambda v: F.format_string("%f", v)))
    return _with_header(rows.withColumn("value", value), by, _pcd_header(field, "4", "F", str(size)), "desc_id")


def libsvm_lines(rows: DataFrame, label: Column | None = None) -> DataFrame:
    """``label 1:v 2:v ..`` of (obj_id, label, features); label 0 where there is none."""
    pairs = F.transform("features", lambda v, k: F.concat_ws(":", (k + 1).cast("string"), v.cast("string")))
    y = F.coalesce(F.col("label") if "label" in rows.columns else F.lit(0), F.lit(0)) if label is None else label
    return rows.select(F.col("obj_id").alias("place"), F.concat_ws(" ", y.cast("string"), F.array_join(pairs, " ")).alias("value"))


def box_lines(boxes: DataFrame, key: str) -> DataFrame:
    """``cx cy cz length width height theta`` of oriented boxes."""
    return boxes.select(F.col(key).alias("place"), F.concat_ws(" ", *map(_number, ("cx", "cy", "cz", "length", "width", "height", "theta"))).alias("value"))


def off_lines(corners: DataFrame, by: str) -> DataFrame:
    """Hexahedra of eight numbered corners."""
    quads = "4 0 1 3 2\n4 4 6 7 5\n4 0 4 5 1\n4 2 3 7 6\n4 0 2 6 4\n4 1 5 7 3"
    body = corners.select(by, F.col("corner").cast("long").alias("place"), F.concat_ws(" ", *map(_number, "xyz")).alias("value"))
    groups = corners.select(by).distinct()
    head = groups.select(by, F.lit(-1).cast("long").alias("place"), F.lit("OFF\n8 6 0").alias("value"))
    return body.unionByName(head).unionByName(groups.select(by, F.lit(8).cast("long").alias("place"), F.lit(quads).alias("value")))


def obj_lines(corners: DataFrame, by: str) -> DataFrame:
    """The twelve edges of boxes of eight numbered corners."""
    edges = "\n".join(f"l {a + 1} {b + 1}" for a in range(8) for b in (a ^ 1, a ^ 2, a ^ 4) if a < b)
    body = corners.select(by, F.col("corner").cast("long").alias("place"), F.concat_ws(" ", F.lit("v"), *map(_number, "xyz")).alias("value"))
    return body.unionByName(corners.select(by).distinct().select(by, F.lit(8).cast("long").alias("place"), F.lit(edges).alias("value")))


def occupancy_lines(cells: DataFrame, length: int, width: int, height: int) -> DataFrame:
    """All values of a grid, one a line, under its size."""
    spark = cells.sparkSession
    at = cells.select((F.col("x") + F.col("y") * length + F.col("z") * length * width).cast("long").alias("place"), "v")
    all_ = spark.range(length * width * height).select(F.col("id").alias("place")).join(at, "place", "left")
    head = spark.range(1).select(F.lit(-1).cast("long").alias("place"), F.lit(f"{length} {width} {height}").alias("value"))
    return all_.select("place", _number(F.coalesce("v", F.lit(0.0))).alias("value")).unionByName(head)


def bitmap_lines(image: DataFrame, width: int, height: int, by: str | None = None) -> DataFrame:
    """Plain bitmaps of set pixels, a line a row."""
    keys = [by] if by else []
    rows = image.groupBy(*keys, "yi").agg(F.collect_set("xi").alias("set"))  # at most a row of pixels
    groups = image.select(*keys).distinct() if by else image.sparkSession.range(1).select()
    every = groups.crossJoin(image.sparkSession.range(height).select(F.col("id").cast("int").alias("yi")))
    line = F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.coalesce(F.array_contains("set", k), F.lit(False)).cast("int").cast("string")))
    body = every.join(rows, [*keys, "yi"], "left").select(*keys, F.col("yi").cast("long").alias("place"), line.alias("value"))
    return body.unionByName(groups.select(*keys, F.lit(-1).cast("long").alias("place"), F.lit(f"P1\n{width} {height}").alias("value")))


def depth_image_lines(depth: DataFrame, width: int, height: int) -> DataFrame:
    """A plain colour map in which near is white (u, v, depth)."""
    ends = depth.agg(F.min("depth").alias("_lo"), F.max("depth").alias("_hi"))
    shade = (255 - 255 * F.coalesce(F.try_divide(F.col("depth") - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0))).cast("int")
    seen = depth.crossJoin(F.broadcast(ends)).select((F.col("v").cast("long") * width + F.col("u")).alias("place"), shade.alias("s"))
    spark = depth.sparkSession
    body = spark.range(width * height).select(F.col("id").alias("place")).join(seen, "place", "left")
    s = F.coalesce("s", F.lit(0)).cast("string")
    head = spark.range(1).select(F.lit(-1).cast("long").alias("place"), F.lit(f"P3\n{width} {height}\n255").alias("value"))
    return body.select("place", F.concat_ws(" ", s, s, s).alias("value")).unionByName(head)


def prediction_lines(scores: DataFrame, classes: list[int]) -> DataFrame:
    """``labels c ..`` and lines of a class and its scores (obj_id, pred, scores map)."""
    body = scores.select(F.col("obj_id").alias("place"), F.concat_ws(" ", F.col("pred").cast("string"), *(F.coalesce(F.try_element_at("scores", F.lit(c)), F.lit(0.0)).cast("string") for c in classes)).alias("value"))
    head = scores.sparkSession.range(1).select(F.lit(-1).cast("long").alias("place"), F.lit("labels " + " ".join(map(str, classes))).alias("value"))
    return body.unionByName(head)


def stamp_model(detections: DataFrame, model: DataFrame, key: str) -> DataFrame:
    """The model's points at each detection (key, x, y, z), with new pids; detections may be many, the model is one cloud."""
    m = model.select(F.col("pid"), *(F.col(c).alias(f"m_{c}") for c in "xyz"))
    return detections.select(key, "x", "y", "z").crossJoin(F.broadcast(m)).select(key, "pid", *((F.col(c) + F.col(f"m_{c}")).alias(c) for c in "xyz"))


def gray_points(points: DataFrame) -> DataFrame:
    """Points with intensities of 0..1 as gray."""
    from cloudloom.functions.columns import graymap

    return points.withColumn("rgb", graymap(F.col("intensity")))


def split_mesh(vertices: DataFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each group's own vertices and faces, the vertices counted from 0 in each (in order of their ids)."""
    from pyspark.sql import Window

    used = faces.select("grp", F.explode(F.array("a", "b", "c")).alias("vid")).distinct()
    named = used.withColumn("pid", F.row_number().over(Window.partitionBy("grp").orderBy("vid")) - 1)
    own = named.join(vertices.withColumnRenamed("pid", "vid"), "vid").select("grp", "pid", "x", "y", "z")
    out = faces.select("grp", "fid", "a", "b", "c")
    for k in "abc":
        out = out.join(named.select("grp", F.col("vid").alias(k), F.col("pid").alias(f"_{k}")), ["grp", k])
    return own, out.select("grp", "fid", *(F.col(f"_{k}").alias(k) for k in "abc"))


def parameters(spark, **values) -> DataFrame:
    """One row of a run's parameters."""
    return spark.createDataFrame([tuple(float(v) for v in values.values())], ", ".join(f"{k} double" for k in values))
