import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudloom.operators import geometry, grid
from cloudloom.sources import parsers, readers, writers
from cloudloom.streaming import frames


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()))


def text_of(path):
    return "".join(p.read_text() for p in sorted(path.rglob("part-*")) if p.stat().st_size)


def files_by_group(path):
    return {p.parent.name.split("=", 1)[1]: p.read_text() for p in path.rglob("part-*")}


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(1)
    data = [(int(i), f"c{i % 3}", *map(float, np.round(rng.normal(size=3), 4)), int(rng.integers(0, 1 << 24))) for i in range(30)]
    return spark.createDataFrame(data, "pid long, cloud_id string, x double, y double, z double, rgb int")


@pytest.mark.parametrize("cols", [["x", "y", "z", "rgb"], ["x", "y", "z"]])
def test_pcd_round_trip(spark, points, tmp_path, cols):
    writers.save_lines(writers.pcd_lines(points.select("pid", "cloud_id", *cols), "cloud_id"), "cloud_id", str(tmp_path / "out"))
    for name, text in files_by_group(tmp_path / "out").items():
        (tmp_path / f"{name}.pcd").write_text(text)
    back = readers.read(spark, "pcd", str(tmp_path / "*.pcd"))
    assert rows(back, "cloud_id", *cols) == rows(points, "cloud_id", *cols)
    assert readers.read(spark, "pcd", str(tmp_path / "*.pcd"), box={"x": (0, 9)}).count() == points.where("x >= 0").count()


def test_pcd_binary_and_malformed():
    head = b"# .PCD\nFIELDS x y z rgb\nPOINTS 2\nDATA binary_compressed\n"
    body = struct.pack("<8f", 1, 2, 3, 255, 4, 5, 6, 65280)
    assert parsers.pcd(head + body)["rgb"] == [255, 65280]
    with pytest.raises(ValueError):
        parsers.pcd(head + body[:9])
    odd = parsers.pcd(b"FIELDS x y z\nPOINTS 3\nDATA ascii\n1 2 3\n1 two 3\n\n4 5 6\n")
    assert list(odd["x"]) == [1.0, 4.0] and odd["rgb"] == [None, None]


def test_binary_and_line_formats(spark, tmp_path):
    (tmp_path / "000.bin").write_bytes(struct.pack("<8f", 1, 2, 3, 0.5, 4, 5, 6, 0.25))
    assert rows(readers.read(spark, "kitti", str(tmp_path / "000.bin")), "pid", "x", "reflectance") == [(0, 1.0, 0.5), (1, 4.0, 0.25)]
    (tmp_path / "a.pts").write_text("2\n1 2 3 10 1 2 3\n4 5 6 20 4 5 6\n1\n7 8 9 30 7 8 9\n")
    pts = readers.read(spark, "pts", str(tmp_path / "a.pts"))
    assert rows(pts, "pid", "x", "r") == [(0, 1.0, 1), (1, 4.0, 4), (2, 7.0, 7)]
    assert [r.intensity for r in readers.normalise_intensity(pts).orderBy("pid").collect()] == [0.0, 0.5, 1.0]
    (tmp_path / "o.txt").write_text("49.0 8.4 110 0.1 0.2 0.3 9 9\n1 2 3 4 5 6\n")
    assert rows(readers.read(spark, "oxts", str(tmp_path / "o.txt")), "lat", "yaw") == [(49.0, 0.3)]
    (tmp_path / "m.obj").write_text("v 0 0 0\nv 1 0 0\nv 0 1 0\ng one\nusemtl red\nf 1//1 2//1 3//1\ng two\nusemtl red\nf 3 2 1\n")
    assert rows(readers.read(spark, "obj_faces", str(tmp_path / "m.obj")), "fid", "a", "b", "c", "grp") == [(0, 0, 1, 2, "one"), (1, 2, 1, 0, "two")]
    assert readers.read(spark, "obj_elements", str(tmp_path / "m.obj")).count() == 3
    (tmp_path / "m.ply").write_text("ply\nformat ascii 1.0\nelement vertex 3\nelement face 2\nend_header\n0 0 0\n1 0 0\n0 1 0\n3 0 1 2\n4 0 1 2 0\n")
    assert readers.read(spark, "ply", str(tmp_path / "m.ply")).agg(F.min("r"), F.count("*")).first() == (255, 3)
    assert rows(readers.read(spark, "ply_faces", str(tmp_path / "m.ply")), "a", "b", "c") == [(0, 1, 2)]
    assert parsers.matrix(b"{{1,-2.5},{3e1,4}}")["features"] == [[1, -2.5], [30, 4]]
    assert parsers.categories(b"1: car\n2: tall lamp\nx\n") == {"label": [1, 2], "name": ["car", "tall lamp"]}
    assert parsers.shape_classes(b"PSB 1\n2 3\ncar 0 2\n5\n6\n\ntree 0 1\n9\n")["model_id"] == [5, 6, 9]
    m = parsers.matches(b"a.pcd 1,2,3 null\nb.pcd 4,5,6 7,8,9\n")
    assert m["x"] == [1, None, 4, 7] and m["scan"] == [0, 0, 1, 1]
    p = parsers.pixmap(b"P6\n# c\n2 1\n255\n" + bytes([1, 2, 3, 4, 5, 6]))
    assert list(p["b"]) == [3, 6]
    cams = b"# v0.3\n1 2\n600 0.1 0.2\n1 0 0\n0 1 0\n0 0 1\n1 2 3\n1 1 1\n255 0 0\n1 0 7 1.5 2.5\n2 2 2\n0 255 0\n1 0 8 3.5 4.5\n"
    assert parsers.bundler_cameras(cams)["focal"] == [600.0]
    assert parsers.bundler_points(cams)["g"] == [0, 255] and parsers.bundler_views(cams)["key"] == [7, 8]
    k = np.array([[600.0, 0, 320], [0, 600, 240], [0, 0, 1]])
    rt = np.hstack([np.eye(3), [[1], [2], [3]]])
    c = parsers.projection(("CONTOUR\n" + " ".join(map(str, (k @ rt).ravel()))).encode())
    assert np.allclose(c["centre"][0], [-1, -2, -3]) and parsers.projection(b"x")["shift"] == []


def test_result_formats(spark, tmp_path):
    d = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.5])], "desc_id long, features array<double>")
    writers.save_lines(writers.descriptor_lines(d, 2), None, str(tmp_path / "d"))
    (tmp_path / "d.pcd").write_text(text_of(tmp_path / "d"))
    assert rows(readers.read(spark, "descriptor", str(tmp_path / "d.pcd")), "desc_id", "features") == rows(d, "desc_id", "features")
    v = spark.createDataFrame([(0, 2, [1.0, 0.0, 3.0]), (1, None, [0.5, 0.0, 0.0])], "obj_id long, label int, features array<double>")
    writers.save_lines(writers.libsvm_lines(v), None, str(tmp_path / "v"))
    assert rows(readers.read_libsvm(spark, str(tmp_path / "v"), 3), "label", "features") == [(0, [0.5, 0.0, 0.0]), (2, [1.0, 0.0, 3.0])]
    s = spark.createDataFrame([(0, 2, {1: 0.25, 2: 0.75})], "obj_id long, pred int, scores map<int,double>")
    writers.save_lines(writers.prediction_lines(s, [1, 2]), None, str(tmp_path / "p"))
    (tmp_path / "p.txt").write_text(text_of(tmp_path / "p"))
    got = readers.read(spark, "prediction", str(tmp_path / "p.txt")).first()
    assert got.label == 2 and [(x.label, x.score) for x in got.scores] == [(1, 0.25), (2, 0.75)]
    (tmp_path / "l.txt").write_text("3\n1\n")
    labels = readers.read(spark, "labels", str(tmp_path / "l.txt"))
    (tmp_path / "set").mkdir()
    for i in range(2):
        (tmp_path / "set" / f"{i}-cloud.pcd").write_text(f"FIELDS x y z\nPOINTS 1\nDATA ascii\n{i} 0 0\n")
    assert rows(readers.read_clusters(spark, str(tmp_path / "set"), labels), "obj_id", "label", "x") == [(0, 3, 0.0), (1, 1, 1.0)]


def test_images_grids_and_boxes(spark, points, tmp_path):
    image = spark.createDataFrame([(0, 0), (2, 1), (4, 3)], "xi int, yi int")
    writers.save_lines(writers.bitmap_lines(image, 5, 4), None, str(tmp_path / "b"))
    (tmp_path / "b.pbm").write_text(text_of(tmp_path / "b"))
    assert rows(readers.read(spark, "pbm", str(tmp_path / "b.pbm")), "xi", "yi") == rows(image, "xi", "yi")
    cells = spark.createDataFrame([(0, 0, 0, 0.5), (2, 1, 1, 1.0)], "x int, y int, z int, v double")
    writers.save_lines(writers.occupancy_lines(cells, 3, 2, 2), None, str(tmp_path / "g"))
    (tmp_path / "g.og").write_text(text_of(tmp_path / "g"))
    assert rows(readers.read(spark, "og", str(tmp_path / "g.og")), "x", "y", "z", "v") == rows(cells, "x", "y", "z", "v")
    corners = geometry.box_corners(geometry.oriented_boxes(points, ["cloud_id"]), ["cloud_id"])
    writers.save_lines(writers.off_lines(corners, "cloud_id"), "cloud_id", str(tmp_path / "off"))
    for name, text in files_by_group(tmp_path / "off").items():
        (tmp_path / f"{name}.off").write_text(text)
    back = readers.read(spark, "off", str(tmp_path / "*.off"))
    assert back.count() == 24
    writers.save_lines(writers.obj_lines(corners, "cloud_id"), "cloud_id", str(tmp_path / "obj"))
    assert all(t.count("\nl ") == 12 for t in files_by_group(tmp_path / "obj").values())
    writers.save_lines(writers.box_lines(geometry.oriented_boxes(points, ["cloud_id"]), "cloud_id"), None, str(tmp_path / "boxes"))
    assert len(text_of(tmp_path / "boxes").split("\n")[0].split()) == 7
    cloud = points.withColumns({"r": F.lit(1), "g": F.lit(2), "b": F.lit(3)})
    writers.save_lines(writers.ply_lines(cloud), None, str(tmp_path / "ply"))
    (tmp_path / "p.ply").write_text(text_of(tmp_path / "ply"))
    assert rows(readers.read(spark, "ply", str(tmp_path / "p.ply")), "x", "b") == rows(cloud, "x", "b")
    depth = spark.createDataFrame([(0, 0, 1.0), (1, 1, 3.0)], "u int, v int, depth double")
    assert writers.depth_image_lines(depth, 2, 2).where("place >= 0").orderBy("place").first().value == "255 255 255"


def test_clusters_and_meshes(spark, points, tmp_path):
    labels = spark.createDataFrame([("c0", 0), ("c1", -1)], "cloud_id string, cluster_id int")
    lines = writers.cluster_lines(points, labels, "cloud_id")
    assert {r.cluster: r.n for r in lines.where("place >= 0").groupBy("cluster").agg(F.count("*").alias("n")).collect()} == {"0-cloud": 10, "outlier": 20}
    g = spark.createDataFrame([(1.0, 2.0, 3.0, 0.5)], "ox double, oy double, oz double, leaf double")
    c = spark.createDataFrame([(1, 0, 2)], "xi int, yi int, zi int")
    assert writers.voxel_lines(c, g).where("place >= 0").first().value == "1.500000 2.000000 4.000000"
    d = spark.createDataFrame([(7, 10.0, 0.0, 0.0)], "det long, x double, y double, z double")
    assert writers.stamp_model(d, points, "det").agg(F.round(F.avg("x") - points.agg(F.avg("x")).first()[0], 6)).first()[0] == 10.0
    v = spark.createDataFrame([(i, float(i), 0.0, 0.0) for i in range(6)], "pid long, x double, y double, z double")
    f = spark.createDataFrame([(0, "p", 0, 1, 2), (1, "q", 3, 5, 4)], "fid long, grp string, a long, b long, c long")
    own, faces = writers.split_mesh(v, f)
    assert rows(faces, "grp", "a", "b", "c") == [("p", 0, 1, 2), ("q", 0, 2, 1)] and own.count() == 6
    assert writers.gray_points(spark.createDataFrame([(1.0,)], "intensity double")).first().rgb == 0xFFFFFF
    assert writers.parameters(spark, leaf=0.5, ratio=2).first() == (0.5, 2.0)


def test_stream_of_frames(spark, tmp_path):
    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    for k in range(3):
        data = [("c", t + dt.timedelta(minutes=30 * k), i, i * 0.1, 0.0, 0.0) for i in range(20)]
        spark.createDataFrame(data, frames.SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = frames.read_frames(spark, str(tmp_path / "in"), files_per_batch=1)
    q = frames.occupied_cells(stream, 1.0).writeStream.format("memory").queryName("cells").outputMode("append").option("checkpointLocation", str(tmp_path / "ck1")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("select start, xi, n from cells").collect()
    assert {(r.xi, r.n) for r in got} == {(0, 10), (1, 10)} and len({r.start for r in got}) == 2  # the last window is still open
    q = frames.each_batch(stream, lambda b: grid.voxelise(b, "centroid", leaf=1.0), str(tmp_path / "out"), str(tmp_path / "ck2"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("n")).first()[0] == 60
