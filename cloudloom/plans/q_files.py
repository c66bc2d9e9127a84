"""Queries that write files of a format and read them back, and those on single functions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cloudloom.functions import columns as C
from cloudloom.functions.tables import shared_folder
from cloudloom.operators import geometry, graph, grid, image, ordered, rays
from cloudloom.plans import q_features
from cloudloom.plans import views as V
from cloudloom.plans.registry import query
from cloudloom.sources import readers, writers


def _written(spark, lines, by: str | None = None) -> str:
    path = f"{shared_folder(spark)}/cloudloom-{spark.sparkContext.applicationId}/files-{uuid.uuid4().hex[:12]}"
    writers.save_lines(lines, by, path)
    return path


def _back(spark, lines, kind: str, by: str | None = None):
    """The lines as files of a format, read again; with the value that each file is of."""
    rows = readers.read(spark, kind, _written(spark, lines, by))
    return rows.withColumn(by, F.regexp_extract("file", f"{by}=([^/]+)", 1)) if by else rows


def _xyz(*names: str):
    return [F.round(c, 6).alias(c) for c in names or "xyz"]


_R = ", ".join(f"round({c}, 6) AS {c}" for c in "xyz")
_EMB = f"WITH p AS ({V.EMB}) SELECT label, row_number() OVER (PARTITION BY label ORDER BY pid) - 1 AS pid, {_R}"


@query(f"{_EMB}, (r * 65536 + g * 256 + b)::INT AS rgb FROM p")
def pcd_files(spark, d):
    p = V.emb(spark, d).withColumn("rgb", C.pack_rgb(F.col("r"), F.col("g"), F.col("b")))
    return _back(spark, writers.pcd_lines(p.select("label", "pid", *"xyz", "rgb"), "label"), "pcd", "label").select(F.col("label").cast("int"), "pid", *_xyz(), "rgb")


@query(f"SELECT * FROM ({_EMB} FROM p) WHERE x BETWEEN -0.1 AND 0.1")
def pcd_files_in_a_box(spark, d):
    """The box holds while files are parsed; places count the rows of the whole file."""
    path = _written(spark, writers.pcd_lines(V.emb(spark, d).select("label", "pid", *"xyz"), "label"), "label")
    rows = readers.read(spark, "pcd", path, box={"x": (-0.1, 0.1)})
    return rows.select(F.regexp_extract("file", "label=([^/]+)", 1).cast("int").alias("label"), "pid", *_xyz())


@query(f"{_EMB}, r, g, b FROM p")
def ply_files(spark, d):
    return _back(spark, writers.ply_lines(V.emb(spark, d), "label"), "ply", "label").select(F.col("label").cast("int"), "pid", *_xyz(), "r", "g", "b")


@query(f"{_EMB}, r / 255 AS intensity, r, g, b FROM p")
def pts_files(spark, d):
    p = V.emb(spark, d).withColumn("value", F.concat_ws(" ", *(F.format_string("%f", c) for c in "xyz"), (F.col("r") / 255).cast("string"), "r", "g", "b"))
    back = _back(spark, writers._with_header(p, "label", F.col("n").cast("string"), "pid"), "pts", "label")
    return back.select(F.col("label").cast("int"), "pid", *_xyz(), "intensity", "r", "g", "b")


_LONG = f"WITH p AS (SELECT row_number() OVER (ORDER BY obj_id) - 1 AS obj_id, features, label FROM ({V.DESC})), e AS (SELECT obj_id, label, unnest(features) AS v, generate_subscripts(features, 1) - 1 AS dim FROM p)"


@query(f"{_LONG} SELECT obj_id AS desc_id, dim::INT AS dim, round(v, 6) AS v FROM e")
def descriptor_files(spark, d):
    p = V.desc(spark, d).withColumnRenamed("obj_id", "desc_id")
    return _back(spark, writers.descriptor_lines(p, 64), "descriptor").select("desc_id", F.posexplode("features").alias("dim", "v")).select("desc_id", "dim", F.round("v", 6).alias("v"))


@query(f"{_LONG} SELECT obj_id AS row, dim::INT AS dim, round(v, 9) AS v FROM e")
def matrix_files(spark, d):
    lines = V.desc(spark, d).select(F.col("obj_id").alias("place"), F.concat(F.lit("{"), F.array_join(F.transform("features", lambda v: v.cast("string")), ", "), F.lit("},")).alias("value"))
    return _back(spark, lines, "matrix").select("row", F.posexplode("features").alias("dim", "v")).select("row", "dim", F.round("v", 9).alias("v"))


@query(f"{_LONG} SELECT label, dim::INT AS dim, count(*)::BIGINT AS n, round(sum(v), 6) AS total FROM e GROUP BY label, dim")
def libsvm_files(spark, d):
    rows = readers.read_libsvm(spark, _written(spark, writers.libsvm_lines(V.desc(spark, d))), 64)
    return rows.select("label", F.posexplode("features").alias("dim", "v")).groupBy("label", "dim").agg(F.count("*").alias("n"), F.round(F.sum("v"), 6).alias("total"))


@query(f"WITH p AS ({V.EMB}), c AS (SELECT trunc((x + 1) / 0.25)::INT AS x, trunc((y + 1) / 0.25)::INT AS y, trunc((z + 1) / 0.25)::INT AS z, count(*) AS v FROM p GROUP BY ALL) SELECT x, y, z, round(v / max(v) OVER (), 6) AS v FROM c")
def occupancy_files(spark, d):
    cells = V.emb(spark, d).groupBy(*(((F.col(c) + 1) / 0.25).cast("int").alias(c) for c in "xyz")).agg(F.count("*").cast("double").alias("v"))
    return _back(spark, writers.occupancy_lines(cells, 9, 9, 9), "og").select(*"xyz", F.round("v", 6).alias("v"))


_PIX = f"SELECT DISTINCT ((x + 1) / 0.02)::INT AS xi, ((y + 1) / 0.02)::INT AS yi FROM ({V.EMB})"


def _pixels(spark, d):
    return V.emb(spark, d).select(F.round((F.col("x") + 1) / 0.02).cast("int").alias("xi"), F.round((F.col("y") + 1) / 0.02).cast("int").alias("yi")).distinct()


@query(_PIX)
def bitmap_files(spark, d):
    return _back(spark, writers.bitmap_lines(_pixels(spark, d), 101, 101), "pbm").select("xi", "yi")


@query(f"SELECT row_number() OVER (ORDER BY obj_id) - 1 AS obj_id, label FROM ({V.DESC})")
def label_files(spark, d):
    return _back(spark, V.desc(spark, d).select(F.col("obj_id").alias("place"), F.col("label").cast("string").alias("value")), "labels").select("obj_id", "label")


@query(f"{_LONG} SELECT obj_id, label, dim::INT AS class, round(v, 9) AS score FROM e WHERE dim < 3")
def prediction_files(spark, d):
    scores = F.create_map(*(x for k in range(3) for x in (F.lit(k), F.col("features")[k])))
    lines = writers.prediction_lines(V.desc(spark, d).select("obj_id", F.col("label").alias("pred"), scores.alias("scores")), [0, 1, 2])
    return _back(spark, lines, "prediction").select("obj_id", "label", F.explode("scores").alias("s")).select("obj_id", "label", F.col("s.label").alias("class"), F.round("s.score", 9).alias("score"))


@query("SELECT n_nationkey::INT AS label, n_name AS name FROM nation")
def category_files(spark, d):
    return _back(spark, V.table(spark, d, "nation").select(F.col("n_nationkey").alias("place"), F.concat_ws(": ", F.col("n_nationkey").cast("string"), "n_name").alias("value")), "categories").select("label", "name")


@query("SELECT 'r' || n_regionkey AS category, n_nationkey AS model_id FROM nation")
def shape_class_files(spark, d):
    n = V.table(spark, d, "nation")
    head = n.groupBy("n_regionkey").agg(F.count("*").alias("n")).select((F.col("n_regionkey") * 1000).alias("place"), F.format_string("r%d 0 %d", "n_regionkey", "n").alias("value"))
    body = n.select((F.col("n_regionkey") * 1000 + 1 + F.col("n_nationkey")).alias("place"), F.col("n_nationkey").cast("string").alias("value"))
    return _back(spark, head.unionByName(body), "shape_classes").select("category", "model_id")


@query(f"WITH p AS (SELECT row_number() OVER (ORDER BY pid) - 1 AS scan, 's' || pid AS file_name, * FROM ({V.EMB})) SELECT scan::INT AS scan, file_name, 0 AS k, round(x, 9) AS x, round(y, 9) AS y, round(z, 9) AS z FROM p UNION ALL SELECT scan::INT, file_name, 1, NULL, NULL, NULL FROM p")
def match_files(spark, d):
    xyz = F.concat_ws(",", *(F.col(c).cast("string") for c in "xyz"))
    lines = V.emb(spark, d).select(F.col("pid").alias("place"), F.concat(F.lit("s"), F.col("pid").cast("string"), F.lit(" "), xyz, F.lit(" null")).alias("value"))
    return _back(spark, lines, "matches").select("scan", "file_name", "k", *(F.round(c, 9).alias(c) for c in "xyz"))


def _obj(spark, d):
    v, f, _ = q_features._whole_mesh(spark, d)
    points = v.select(F.col("vid").alias("place"), F.concat_ws(" ", F.lit("v"), *(F.format_string("%f", c) for c in "xyz")).alias("value"))
    faces = f.select((F.col("fid") + 10**12).alias("place"), F.format_string("g g%d\nusemtl m%d\nf %d %d//1 %d", F.col("fid") % 3, F.col("fid") % 2, *(F.col(c) + 1 for c in "abc")).alias("value"))
    return points.unionByName(faces)


@query(f"WITH {q_features._MESH} SELECT row_number() OVER (ORDER BY vid) - 1 AS pid, x, y, z FROM v")
def obj_files(spark, d):
    return _back(spark, _obj(spark, d), "obj").select("pid", *"xyz")


@query(f"WITH {q_features._MESH} SELECT row_number() OVER (ORDER BY fid) - 1 AS fid, a, b, c, 'g' || (fid % 3) AS grp, 'm' || (fid % 2) AS material FROM f")
def obj_face_files(spark, d):
    return _back(spark, _obj(spark, d), "obj_faces").select("fid", *"abc", "grp", "material")


@query(f"WITH {q_features._MESH}, u AS (SELECT DISTINCT 'm' || (fid % 2) AS element, unnest([a, b, c]) AS vid FROM f) SELECT element, vid, x, y, z FROM u JOIN v USING (vid)")
def obj_element_files(spark, d):
    return _back(spark, _obj(spark, d), "obj_elements").select("element", "vid", *"xyz")


@query(f"WITH {q_features._MESH} SELECT row_number() OVER (ORDER BY fid) - 1 AS fid, a, b, c FROM f")
def ply_face_files(spark, d):
    v, f, _ = q_features._whole_mesh(spark, d)
    n, m = (t.agg(F.count("*").alias("n")) for t in (v, f))
    head = n.crossJoin(m.select(F.col("n").alias("m"))).select(F.lit(-1).cast("long").alias("place"), F.format_string("ply\nformat ascii 1.0\nelement vertex %d\nelement face %d\nend_header", "n", "m").alias("value"))
    points = v.select(F.col("vid").alias("place"), F.concat_ws(" ", *(F.format_string("%f", c) for c in "xyz")).alias("value"))
    faces = f.select((F.col("fid") + 10**12).alias("place"), F.format_string("3 %d %d %d", *"abc").alias("value"))
    return _back(spark, head.unionByName(points).unionByName(faces), "ply_faces").select("fid", *"abc")


_BOX = f"b AS (SELECT label, min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy, min(z) AS lz, max(z) AS hz FROM ({V.EMB}) GROUP BY label), c AS (SELECT label, k, CASE WHEN k % 2 = 0 THEN lx ELSE hx END AS x, CASE WHEN k // 2 % 2 = 0 THEN ly ELSE hy END AS y, CASE WHEN k // 4 = 0 THEN lz ELSE hz END AS z FROM b, (SELECT range AS k FROM range(8)))"


def _corners(spark, d):
    b = V.emb(spark, d).groupBy("label").agg(*(f(c).alias(f"{n}{c}") for c in "xyz" for f, n in ((F.min, "l"), (F.max, "h"))))
    k = F.col("corner")
    c = b.withColumn("corner", F.explode(F.sequence(F.lit(0), F.lit(7))))
    return c.select("label", "corner", *(F.when(F.floor(k / 2**j) % 2 == 0, F.col(f"l{a}")).otherwise(F.col(f"h{a}")).alias(a) for j, a in enumerate("xyz")))


@query(f"WITH {_BOX} SELECT label, k AS pid, {_R} FROM c")
def off_files(spark, d):
    return _back(spark, writers.off_lines(_corners(spark, d), "label"), "off", "label").select(F.col("label").cast("int"), "pid", *_xyz())


@query(f"WITH {_BOX} SELECT label, k AS pid, {_R} FROM c")
def obj_box_files(spark, d):
    return _back(spark, writers.obj_lines(_corners(spark, d), "label"), "obj", "label").select(F.col("label").cast("int"), "pid", *_xyz())


@query(f"WITH {_BOX} SELECT label::VARCHAR AS label, round((lx + hx) / 2, 5) AS cx, round(hx - lx, 5) AS length, 0.0::DOUBLE AS theta FROM b")
def box_files(spark, d):
    c = _corners(spark, d).groupBy("label").agg(*(f(c).alias(f"{n}{c}") for c in "xyz" for f, n in ((F.min, "l"), (F.max, "h"))))
    boxes = c.select("label", *(((F.col(f"l{a}") + F.col(f"h{a}")) / 2).alias(f"c{a}") for a in "xyz"), *((F.col(f"h{a}") - F.col(f"l{a}")).alias(n) for a, n in zip("xyz", ("length", "width", "height"), strict=True)), F.lit(0.0).alias("theta"))
    lines = writers.box_lines(boxes, "label").withColumn("label", F.col("place").cast("string"))
    back = spark.read.text(_written(spark, lines, "label")).withColumn("f", F.split("value", " "))
    return back.select(F.col("label").cast("string"), *(F.round(F.col("f")[k].cast("double"), 5).alias(n) for k, n in ((0, "cx"), (3, "length"), (6, "theta"))))


@query("""WITH p AS (SELECT p_partkey % 40 AS u, p_partkey // 40 % 30 AS v, min(p_retailprice) AS depth FROM part GROUP BY ALL), e AS (SELECT min(depth) AS lo, max(depth) AS hi FROM p),
s AS (SELECT v * 40 + u AS place, trunc(255 - 255 * ((depth - lo) / (hi - lo)))::INT AS s FROM p, e) SELECT r.range AS place, concat_ws(' ', coalesce(s, 0), coalesce(s, 0), coalesce(s, 0)) AS value FROM range(1200) r LEFT JOIN s ON r.range = s.place UNION ALL SELECT -1, 'P3' || chr(10) || '40 30' || chr(10) || '255'""")
def depth_image(spark, d):
    k = F.col("p_partkey")
    depth = V.table(spark, d, "part").groupBy((k % 40).cast("int").alias("u"), (F.floor(k / 40) % 30).cast("int").alias("v")).agg(F.min("p_retailprice").alias("depth"))
    return writers.depth_image_lines(depth, 40, 30)


@query(f"WITH p AS ({V.EMB}), c AS ({V.CELLS.format(leaf=0.05)}) SELECT round(-1 + xi * 0.05::DOUBLE, 5) AS x, round(-1 + yi * 0.05::DOUBLE, 5) AS y, round(-1 + zi * 0.05::DOUBLE, 5) AS z FROM c")
def voxel_files(spark, d):
    g = spark.createDataFrame([(-1.0, -1.0, -1.0, 0.05)], "ox double, oy double, oz double, leaf double")
    return _back(spark, writers.voxel_lines(V.cells(V.emb(spark, d), 0.05), g), "pcd").select(*(F.round(c, 5).alias(c) for c in "xyz"))


@query(f"SELECT CASE WHEN label < 5 THEN label || '-cloud' ELSE 'outlier' END AS cluster, count(*)::BIGINT AS n, round(min(x), 6) AS lo, round(max(y), 6) AS hi FROM ({V.EMB}) GROUP BY 1")
def cluster_files(spark, d):
    p = V.emb(spark, d)
    named = p.select("pid", F.when(F.col("label") < 5, F.col("label")).otherwise(-1).alias("cluster_id"))
    back = _back(spark, writers.cluster_lines(p.select("pid", *"xyz"), named, "pid"), "pcd", "cluster")
    return back.groupBy("cluster").agg(F.count("*").alias("n"), F.round(F.min("x"), 6).alias("lo"), F.round(F.max("y"), 6).alias("hi"))


_SCALED = "SELECT p_partkey AS pid, (p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()) AS intensity FROM part"


def _scaled(spark, d):
    return readers.normalise_intensity(V.table(spark, d, "part").select(F.col("p_partkey").alias("pid"), F.col("p_retailprice").alias("intensity")))


@query(f"SELECT pid, round(intensity, 9) AS intensity FROM ({_SCALED})")
def intensity_scale(spark, d):
    return _scaled(spark, d).select("pid", F.round("intensity", 9).alias("intensity"))


@query(f"SELECT pid, trunc(intensity * 255)::INT * 65793 AS rgb FROM ({_SCALED})")
def gray_points(spark, d):
    return writers.gray_points(_scaled(spark, d)).select("pid", "rgb")


@query(f"SELECT r_regionkey AS det, pid, round(r_regionkey * 10 + x, 6) AS x, round(y, 6) AS y, round(r_regionkey + z, 6) AS z FROM region, ({V.PART})")
def stamped_model(spark, d):
    k = F.col("r_regionkey")
    found = V.table(spark, d, "region").select(k.alias("det"), (k * 10.0).alias("x"), F.lit(0.0).alias("y"), k.cast("double").alias("z"))
    return writers.stamp_model(found, V.part(spark, d), "det").select("det", "pid", *_xyz())


@query(f"""WITH {q_features._MESH}, g AS (SELECT fid, 'g' || (fid % 3) AS grp, a, b, c FROM f), u AS (SELECT DISTINCT grp, unnest([a, b, c]) AS vid FROM g), k AS (SELECT grp, vid, row_number() OVER (PARTITION BY grp ORDER BY vid) - 1 AS pid FROM u)
SELECT g.grp, fid, p.pid AS a, q.pid AS b, r.pid AS c FROM g JOIN k p ON p.grp = g.grp AND p.vid = g.a JOIN k q ON q.grp = g.grp AND q.vid = g.b JOIN k r ON r.grp = g.grp AND r.vid = g.c""")
def split_mesh(spark, d):
    v, f, _ = q_features._whole_mesh(spark, d)
    named = f.withColumn("grp", F.concat(F.lit("g"), (F.col("fid") % 3).cast("string")))
    return writers.split_mesh(v.withColumnRenamed("vid", "pid"), named)[1].select("grp", "fid", *(F.col(c).cast("long").alias(c) for c in "abc"))


def _bundle(spark, d):
    p = V.emb(spark, d)
    head = p.agg(F.count("*").alias("n")).select(F.lit(-1).cast("long").alias("place"), F.format_string("# Bundle file v0.3\n1 %d\n500.0 0.1 0.2\n1 0 0\n0 1 0\n0 0 1\n1 2 3", "n").alias("value"))
    return head.unionByName(p.select(F.col("pid").alias("place"), F.format_string("%f %f %f\n%d %d %d\n1 0 %d %f %f", *"xyz", "r", "g", "b", "pid", "x", "y").alias("value")))


@query(f"SELECT row_number() OVER (ORDER BY pid) - 1 AS pid, {_R}, r, g, b FROM ({V.EMB})")
def bundler_point_files(spark, d):
    return _back(spark, _bundle(spark, d), "bundler_points").select("pid", *_xyz(), "r", "g", "b")


@query(f"SELECT row_number() OVER (ORDER BY pid) - 1 AS pid, 0 AS camera, pid::INT AS key, round(x, 6) AS u, round(y, 6) AS v FROM ({V.EMB})")
def bundler_view_files(spark, d):
    return _back(spark, _bundle(spark, d), "bundler_views").select("pid", "camera", "key", *_xyz("u", "v"))


@query("SELECT 0 AS camera, 500.0::DOUBLE AS focal, 0.1::DOUBLE AS k1, 1.0::DOUBLE AS r0, 3.0::DOUBLE AS t2")
def bundler_camera_files(spark, d):
    return _back(spark, _bundle(spark, d), "bundler_cameras").select("camera", "focal", "k1", F.col("rotation")[0].alias("r0"), F.col("shift")[2].alias("t2"))


@query("SELECT n_nationkey AS scan, n_nationkey * 1.5::DOUBLE AS lat, n_regionkey * 2.0::DOUBLE AS lon, 100.0::DOUBLE AS alt, 0.25::DOUBLE AS yaw FROM nation")
def oxts_files(spark, d):
    n = V.table(spark, d, "nation")
    lines = n.select(F.col("n_nationkey").alias("scan"), F.lit(0).cast("long").alias("place"), F.format_string("%f %f 100 0 0 0.25 7 8", F.col("n_nationkey") * 1.5, F.col("n_regionkey") * 2.0).alias("value"))
    return _back(spark, lines, "oxts", "scan").select(F.col("scan").cast("long"), "lat", "lon", "alt", "yaw")


# --- single functions ---------------------------------------------------------


@query("SELECT p_partkey, CASE WHEN p_size % 3 >= 2 AND p_size / 10.0 > 2.2 THEN 4 WHEN p_size / 10.0 > 3.5 THEN 3 WHEN p_size / 10.0 < 2.2 THEN 2 WHEN p_size % 3 <> 0 AND p_partkey % 9 < 5 THEN 1 ELSE 5 END AS class FROM part")
def part_classes(spark, d):
    size, zero = F.col("p_size"), F.lit(0)
    return V.table(spark, d, "part").select("p_partkey", C.classify_parts(size / 10.0, size % 3, zero, zero, F.col("p_partkey") % 9).alias("class"))


@query("SELECT p_partkey, round(CASE WHEN p_size > 25 THEN p_retailprice * 0.0254 ELSE p_retailprice END, 6) AS metres FROM part")
def inches(spark, d):
    return V.table(spark, d, "part").select("p_partkey", F.round(C.inches_to_metres(F.col("p_retailprice"), F.col("p_size") * 2), 6).alias("metres"))


@query(f"WITH p AS (SELECT obj_id, features AS f, sqrt(list_sum(list_transform(features, lambda v: v * v))) AS size FROM ({V.DESC})) SELECT obj_id, (k - 1)::INT AS dim, round(f[k] / size, 9) AS v FROM p, (SELECT unnest(range(1, 65)) AS k)")
def unit_vectors(spark, d):
    return V.desc(spark, d).select("obj_id", F.posexplode(C.l2_normalise(F.col("features"))).alias("dim", "v")).select("obj_id", "dim", F.round("v", 9).alias("v"))


@query(f"WITH p AS ({V.PART}), b AS (SELECT min(x) AS u, min(y) AS v FROM p) SELECT DISTINCT trunc((x - u) / 2.5)::INT AS xi, trunc((y - v) / 2.5)::INT AS yi FROM p, b")
def raster(spark, d):
    return image.raster(V.part(spark, d), "x", "y", 2.5)


@query(f"WITH p AS ({V.EMB}), n AS (SELECT a.pid, min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)) AS d FROM p a JOIN p b ON a.pid <> b.pid GROUP BY a.pid) SELECT round(avg(d), 9) AS resolution FROM n WHERE d <= 0.2")
def resolution(spark, d):
    return geometry.resolution(V.emb(spark, d), 0.2).select(F.round("resolution", 9).alias("resolution"))


@query(f"SELECT a.label, round(max(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)), 9) AS diameter FROM ({V.EMB}) a JOIN ({V.EMB}) b ON a.label = b.label GROUP BY a.label")
def diameter(spark, d):
    return geometry.diameter(V.emb(spark, d), "label").select("label", F.round("diameter", 9).alias("diameter"))


@query(f"SELECT pid, round(z, 9) AS x, round(x, 9) AS y, round(y, 9) AS z FROM ({V.EMB})")
def quaternion_turn(spark, d):
    """A third of a turn about the diagonal, twice the product of half of it."""
    half = (0.75**0.5, *[(0.25 / 3) ** 0.5] * 3)
    q = C.quaternion_product(half, half)
    return C.rotate_quaternion(V.emb(spark, d), q).select("pid", *(F.round(c, 9).alias(c) for c in "xyz"))


@query(f"SELECT pid, round(x, 9) AS x, round(y, 9) AS y, round(z, 9) AS z FROM ({V.EMB})")
def quaternion_there_and_back(spark, d):
    q = C.quaternion_from_euler(30.0, 20.0, 10.0)
    return C.rotate_quaternion(C.rotate_quaternion(V.emb(spark, d), q), C.quaternion_conjugate(q)).select("pid", *(F.round(c, 9).alias(c) for c in "xyz"))


@query(f"SELECT pid, round(x * cos(label * 0.1) - y * sin(label * 0.1) + label, 8) AS x, round(x * sin(label * 0.1) + y * cos(label * 0.1) - 1, 8) AS y, round(z + 2, 8) AS z FROM ({V.EMB})")
def rigid_moves(spark, d):
    return C.rigid_about_z(V.emb(spark, d), F.col("label") * 0.1, F.col("label"), -1.0, 2.0).select("pid", *(F.round(c, 8).alias(c) for c in "xyz"))


@query(f"WITH RECURSIVE p AS ({V.EMB}), e AS (SELECT a.pid AS u, b.pid AS v FROM p a JOIN p b ON a.pid <> b.pid AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 <= 0.0081), r AS (SELECT pid, pid AS root FROM p UNION SELECT e.v, r.root FROM r JOIN e ON r.pid = e.u), c AS (SELECT pid, min(root) AS component FROM r GROUP BY pid) SELECT component, count(*)::BIGINT AS n FROM c GROUP BY component HAVING count(*) BETWEEN 2 AND 400")
def l2_clusters(spark, d):
    return graph.cluster_points(V.emb(spark, d), 0.09, "l2").groupBy("component").agg(F.count("*").alias("n")).where(F.col("n").between(2, 400))


@query(f"WITH p AS ({V.PART}), i AS (SELECT DISTINCT cloud_id, x::INT AS k FROM p), g AS (SELECT *, k - row_number() OVER (PARTITION BY cloud_id ORDER BY k) AS run FROM i), l AS (SELECT cloud_id, run, count(*) AS n FROM g GROUP BY ALL) SELECT cloud_id, max(n)::BIGINT AS longest FROM l GROUP BY cloud_id")
def longest_runs(spark, d):
    return ordered.longest_run(V.part(spark, d).select("cloud_id", F.col("x").cast("int").alias("k")).distinct(), ["cloud_id"], "k")


@query(f"WITH p AS ({V.EMB}), c AS ({V.CELLS.format(leaf=0.1)}), n AS (SELECT DISTINCT yi AS xi, zi AS yi, xi AS zi FROM c WHERE xi < 12 AND yi < 12 AND zi < 12) SELECT xi, yi, zi FROM c UNION SELECT xi, yi, zi FROM n")
def grid_insert(spark, d):
    c = V.cells(V.emb(spark, d), 0.1)
    new = c.select(F.col("yi").alias("xi"), F.col("zi").alias("yi"), F.col("xi").alias("zi"))
    return grid.insert(c, new, (12, 12, 12))


@query(f"""WITH i AS ({_PIX}), o AS (SELECT * FROM (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) o(dx, dy)),
e AS (SELECT i.xi, i.yi FROM i WHERE xi BETWEEN 1 AND 99 AND yi BETWEEN 1 AND 99 AND (SELECT count(*) FROM i j WHERE abs(i.xi - j.xi) + abs(i.yi - j.yi) <= 1) = 5) SELECT xi, yi FROM e""")
def erode_points(spark, d):
    return image.erode(_pixels(spark, d), 101, 101)


@query(f"WITH {q_features._MESH}, m AS (SELECT fid, nx / nullif(sqrt(nx * nx + ny * ny + nz * nz), 0) AS x, ny / nullif(sqrt(nx * nx + ny * ny + nz * nz), 0) AS y, nz / nullif(sqrt(nx * nx + ny * ny + nz * nz), 0) AS z, (ax + bx + cx) / 3 AS px, (ay + by_ + cy) / 3 AS py, (az + bz + cz) / 3 AS pz FROM n), s AS (SELECT *, CASE WHEN (200 - px) * x + (300 - py) * y + (400 - pz) * z < 0 THEN -1 ELSE 1 END AS s FROM m) SELECT fid, round(255 * least(1.0, 0.5 + greatest(0.0, s * z)), 5) AS shade FROM s")
def shaded_mesh(spark, d):
    return rays.shade(q_features._whole_mesh(spark, d)[2], (0.0, 0.0, 1.0), (200.0, 300.0, 400.0)).select("fid", F.round("shade", 5).alias("shade"))
