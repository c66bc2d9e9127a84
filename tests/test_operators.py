import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudloom.functions import columns as C
from cloudloom.operators import features, filters, geometry, graph, grid, image, models, ordered, rays, spatial


def cloud(spark, n=200, seed=0, extra=()):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(i, *map(float, rng.normal(size=3)), *(e(i) for _, e in extra)) for i in range(n)], "pid long, x double, y double, z double" + "".join(f", {k}" for k, _ in extra))


def test_rotations_agree(spark):
    p = cloud(spark, 20)
    q = C.quaternion_from_euler(10, 20, 30)
    assert math.isclose(sum(v * v for v in q), 1)
    # Rx(30) Ry(20) Rz(10), one axis after the other
    m = C.rotate_euler(C.rotate_euler(C.rotate_euler(p, 0, 0, 10), 0, 20, 0), 30, 0, 0)
    a = np.array(C.rotate_quaternion(p, q).orderBy("pid").select(*"xyz").collect())
    b = np.array(m.orderBy("pid").select(*"xyz").collect())
    assert np.allclose(a, b)
    assert np.allclose(C.quaternion_product(q, C.quaternion_conjugate(q)), (1, 0, 0, 0))
    c, s = math.cos(0.4), math.sin(0.4)
    r = p.select("pid", *"xyz").transform(lambda d: C.rigid_about_z(d, 0.4, 1.0, 2.0, 3.0)).where("pid = 0").first()
    o = p.where("pid = 0").first()
    assert np.allclose([r.x, r.y, r.z], [o.x * c - o.y * s + 1, o.x * s + o.y * c + 2, o.z + 3])


def test_planes_and_light(spark):
    t = spark.createDataFrame([(0, 0.0, 0.0, 1.0, 1.0, 0.0, 1.0, 0.0, 1.0, 1.0), (1, *[0.0] * 9)], "fid int, " + ", ".join(f"{k}{c} double" for k in "abc" for c in "xyz"))
    n, d = C.plane_of(C.vec("a"), C.vec("b"), C.vec("c"))
    got = t.select(*(v.alias(k) for v, k in zip((*n, d), "xyzd", strict=True))).collect()
    assert tuple(got[0]) == (0, 0, 1, 1) and got[1].x is None
    assert rays.shade(t.where("fid = 0"), (0, 0, 1), (0, 0, 5), 100.0).first().shade == 100.0
    assert rays.shade(t.where("fid = 0"), (0, 0, 1), (0, 0, -5), 100.0).first().shade == 50.0
    assert C.line_points((0, 0, 0), (2, 0, 0), 1.0, spark).count() == 3


def test_components_of_known_graphs(spark):
    chain = spark.range(200).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v")).repartition(7)
    assert {r.component for r in graph.connected_components(chain).collect()} == {0}
    star = spark.createDataFrame([(i, 500) for i in range(100)] + [(7, 7), (None, 3)], "u long, v long")
    got = graph.connected_components(star).collect()
    assert len(got) == 101 and {r.component for r in got} == {0}
    assert graph.connected_components(star.limit(0)).collect() == []
    rng = np.random.default_rng(3)
    pairs = rng.integers(0, 300, (220, 2))
    root = list(range(300))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        ra, rb = find(a), find(b)
        root[max(ra, rb)] = min(ra, rb)
    want = {int(i): find(i) for a, b in pairs if a != b for i in (a, b)}
    df = spark.createDataFrame([(int(a), int(b)) for a, b in pairs], "u long, v long").repartition(5)
    assert {r.node: r.component for r in graph.connected_components(df).collect()} == want


def test_range_join_equals_all_pairs(spark):
    p = cloud(spark, 120)
    xyz = np.array(p.orderBy("pid").select(*"xyz").collect())
    for metric, size in (("linf", lambda d: np.abs(d).max(-1)), ("l2", lambda d: np.sqrt((d * d).sum(-1))), ("l1", lambda d: np.abs(d).sum(-1))):
        near = size(xyz[:, None] - xyz[None]) <= 0.5
        got = spatial.range_join(p, p, 0.5, metric).select("pid", "n_pid").collect()
        assert len(got) == near.sum() and all(near[r.pid, r.n_pid] for r in got)
    grid_ = spark.createDataFrame([(i, i * 0.125, 0.0, 0.0) for i in range(50)], "pid long, x double, y double, z double")
    assert spatial.range_join(grid_, grid_, 0.125).where("pid < n_pid").count() == 49  # exactly d apart


def test_nearest_equals_all_pairs(spark):
    rng = np.random.default_rng(4)
    data = [(i, [float(v) for v in rng.normal(size=3)], int(rng.integers(0, 3))) for i in range(60)]
    df = spark.createDataFrame(data, "obj_id long, features array<double>, label int")
    x = np.array([r[1] for r in data])
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    got = {r.obj_id: r.pred for r in models.leave_one_out(df, "obj_id").collect()}
    assert got == {i: data[int(d[i].argmin())][2] for i in range(60)}
    near = spatial.nearest(df, df, "obj_id", "obj_id", k=4, metric="l1").groupBy("obj_id").count().collect()
    assert {r["count"] for r in near} == {4}


def test_voxel_modes(spark):
    p = cloud(spark)
    n = grid.voxelise(p, "first", leaf=0.5).count()
    assert n == grid.voxelise(p, "centroid", leaf=0.5).count() == grid.voxelise(p, "corner", leaf=0.5).count()
    assert grid.voxelise(p, "centroid", leaf=0.5).agg(F.sum("n")).first()[0] == 200
    assert abs(grid.density(p).agg(F.sum("v")).first()[0] - 1) < 1e-9
    assert grid.voxelise(p.limit(0), "first", leaf=0.5).count() == 0
    flat = p.withColumn("z", F.lit(1.0))
    assert grid.with_cells(flat, num_grid=10).where("xi is null").count() == 200  # no extent, no grid


def test_normals_and_planes(spark):
    p = spark.createDataFrame([(i * 20 + j, i * 0.1, j * 0.1, 2.0) for i in range(12) for j in range(12)], "pid long, x double, y double, z double")
    n = geometry.normals(p, 0.25)
    assert n.agg(F.max(F.abs(F.col("nz") + 1)), F.max("curvature")).first()[0] < 1e-9  # towards the origin
    noise = cloud(spark, 60, 9).select((F.col("pid") + 10000).alias("pid"), *"xyz")
    both = p.unionByName(noise)
    a, b, c, d = geometry.ransac(both, 0.01, 128, 0.5, 1)
    assert abs(abs(c) - 1) < 1e-6 and abs(abs(d) - 2) < 1e-6
    planes = geometry.ransac_planes(both, 2, 0.05, 64, 0.5, 1)
    assert planes[0][1].count() >= 144
    fitted = geometry.fit_plane(p.withColumn("g", F.lit(1)), ["g"]).first()
    assert abs(fitted.c - 1) < 1e-9 and abs(fitted.d + 2) < 1e-9


def test_hull_and_rectangle(spark):
    rng = np.random.default_rng(2)
    pts = [(0, float(x), float(y)) for x, y in rng.random((300, 2))] + [(0, float(x), float(y)) for x in (-1, 2) for y in (-1, 3)] + [(1, 1.0, 1.0)]
    df = spark.createDataFrame(pts, "g long, x double, y double")
    assert [(r.x, r.y) for r in geometry.convex_hull(df, "g").where("g = 0").orderBy("k").collect()] == [(-1, -1), (2, -1), (2, 3), (-1, 3)]
    assert abs(geometry.least_rectangle(df, "g").where("g = 0").first().area - 12) < 1e-9
    assert abs(geometry.diameter(df, "g").where("g = 0").first().diameter - 5) < 1e-9


def test_registration_recovers_known_moves(spark):
    rng = np.random.default_rng(5)
    rows, world = [], rng.normal(size=(4, 3))
    place = [(0.0, np.zeros(3))]
    for k in range(1, 4):
        place.append((place[-1][0] + 0.4, place[-1][1] + rng.normal(size=3)))

    def local(k):
        th, t = place[k]
        c, s = math.cos(-th), math.sin(-th)
        p = world - t
        return np.stack([p[:, 0] * c - p[:, 1] * s, p[:, 0] * s + p[:, 1] * c, p[:, 2]], 1)

    for k in range(1, 4):
        for i, (a, b) in enumerate(zip(local(k), local(k - 1), strict=True)):
            rows.append((k, i, *map(float, a), *map(float, b)))
    m = spark.createDataFrame(rows, "scan int, k int, x double, y double, z double, px double, py double, pz double")
    for r in geometry.chain_scans(geometry.register_scans(m)).collect():
        th, t = place[r.scan]
        assert np.allclose([r.theta, r.tx, r.ty, r.tz], [th, *t])


def test_descriptors_have_their_sizes(spark):
    p = cloud(spark, 150, extra=[("cloud_id string", lambda i: f"c{i % 2}")])
    v = features.radial_vector(p, ["cloud_id"]).collect()
    assert all(len(r.features) == 100 and abs(sum(r.features) - 1) < 1e-9 for r in v)
    n = geometry.normals(p, 1.0).select("pid", *"xyz", "nx", "ny", "nz")
    h = features.point_feature_histogram(n, 1.0).groupBy("pid").agg(F.sum("value").alias("s"), F.max("bin").alias("b")).collect()
    assert all(abs(r.s - 300) < 1e-6 and r.b < 33 for r in h)
    s = features.spin_image(n, 1.0).groupBy("pid").agg(F.sum("value").alias("s"), F.max("bin").alias("b")).collect()
    assert all(abs(r.s - 1) < 1e-9 and r.b < 153 for r in s)
    cells = grid.with_cells(p, leaf=0.4).select(*grid.CELL).distinct()
    assert abs(features.binary_pattern(cells).agg(F.sum(F.col("value") ** 2)).first()[0] - 1) < 1e-9
    assert features.canonical_pose(p, ["cloud_id"]).count() == 150


def test_models_learn_separable_classes(spark):
    rng = np.random.default_rng(6)
    data = [(i, [float(v) for v in rng.normal(size=4) + 6 * np.eye(4)[i % 3]], i % 3) for i in range(150)]
    df = spark.createDataFrame(data, "obj_id long, features array<double>, label int")
    train, test = df.where("obj_id % 5 <> 0"), df.where("obj_id % 5 = 0")
    answers = {"lda": models.linear_discriminant(train, test, "obj_id"), "knn": models.knn_vote(test, train, "obj_id"), "igm": models.argmax_label(models.gaussian_tail(test, train, "obj_id"), "obj_id")}
    answers |= {k: models.fit_predict(k, train, test, "obj_id") for k in ("nb", "tree", "logistic", "svm")}
    for name, a in answers.items():
        assert a.join(test, "obj_id").where("pred = label").count() >= 28, name
    parts = test.crossJoin(spark.createDataFrame([(0,), (1,)], "part int")).withColumn("pred", F.when(F.col("part") == 0, F.col("label")).otherwise(0))
    order = models.cascade(parts, "obj_id")
    assert {c for _, c in order} == {0, 1, 2}
    s = models.score_table(answers["knn"].join(test, "obj_id")).where("label is null").first()
    assert s.accuracy >= 90
    scaled = models.long_features(models.gauss_scale(df), "label").groupBy("dim").agg(F.avg("v"), F.stddev_pop("v")).collect()
    assert all(abs(r[1]) < 1e-9 and abs(r[2] - 1) < 1e-9 for r in scaled)
    assert len(models.svd_project(df, "obj_id").first().projection) == 2


def test_images(spark):
    ring = spark.createDataFrame([(x, y) for x in range(1, 6) for y in range(1, 6) if not (x == 3 and y == 3)], "xi int, yi int")
    comps = image.background_components(ring, 7, 7)
    assert sorted(r["count"] for r in comps.groupBy("component").count().collect()) == [1, 24]
    assert image.closing(ring, 7, 7).where("xi = 3 and yi = 3").count() == 1
    assert image.erode(ring, 7, 7).count() == 4 and image.opening(ring, 7, 7).count() <= 24
    assert image.edge_pixels(image.edges(ring, 7, 7), comps).count() >= 0


def test_rays_hit_a_cube(spark):
    v = spark.createDataFrame([(k, float(k & 1), float(k >> 1 & 1), float(k >> 2)) for k in range(8)], "vid long, x double, y double, z double")
    quads = [(0, 1, 3, 2), (4, 6, 7, 5), (0, 4, 5, 1), (2, 3, 7, 6), (0, 2, 6, 4), (1, 5, 7, 3)]
    f = spark.createDataFrame([(2 * i + j, *((q[0], q[1], q[2]) if j == 0 else (q[0], q[2], q[3]))) for i, q in enumerate(quads) for j in (0, 1)], "fid long, a long, b long, c long")
    t = rays.triangles(v, f)
    r = spark.createDataFrame([(0, -2.0, 0.3, 0.6, 1.0, 0.0, 0.0), (1, 0.3, 0.6, 5.0, 0.0, 0.0, -1.0), (2, 5.0, 5.0, 5.0, 1.0, 0.0, 0.0)], "ray long, ox double, oy double, oz double, dx double, dy double, dz double")
    got = {x.ray: round(x.t, 9) for x in rays.cast_rays(r, t).collect()}
    assert got == {0: 2.0, 1: 4.0}
    seen = rays.cast_rays(rays.parallel_rays(spark, (0.5, 0.5, 0.5), 5.0, 3.0, 4, 15), t)
    assert 4 * 20 < seen.count() < 4 * 60
    assert rays.cast_rays(rays.radial_rays(spark, [(0.5, 0.45, 0.55)], 0.4), t).count() == int(2 * math.pi / 0.4) ** 2
    area = filters.sample_mesh(t, 0.01, 1).count()
    assert 500 < area < 700
    flat = t.withColumns({f"{k}{c}": F.col(f"{k}{c}") * 10 for k in "abc" for c in "xy"})
    assert rays.depth_map(flat, 10, 10).agg(F.count("*"), F.max("depth")).first() == (100, 0.0)


def test_ordered(spark):
    s = spark.createDataFrame([(i, 50 if i in (20, 21, 60) else 3) for i in range(101)], "i int, v int")
    assert [(r["first"], r["last"]) for r in ordered.median_peaks(s).collect()] == [(20, 21), (60, 60)]
    c = spark.createDataFrame([(0, x, y) for x, y in ((1, 1), (1, 2), (2, 1), (2, 2), (2, 3))] + [(1, 0, 0), (1, 2, 0)], "g int, r int, c int")
    assert {r.g: r.block for r in ordered.block_2d(c, ["g"], "r", "c").collect()} == {0: 3, 1: 0}
    assert {r.g: r.longest for r in ordered.longest_run(c.select("g", "r").distinct(), ["g"], "r").collect()} == {0: 2, 1: 1}


def test_filters(spark):
    p = cloud(spark, 100)
    kept = filters.every_nth(p, "pid", 5).where("is_train").count()
    assert kept == 20
    assert filters.sample_per_group(p.withColumn("g", F.col("pid") % 4), "g", 3, 1).count() == 12
    plan = filters.box(p, x=(0, 1))._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in plan or "LocalRelation" in plan


@pytest.mark.parametrize("d", ["/root/testdata/sf0.001"])
def test_box_filter_is_pushed_to_the_scan(spark, d):
    from cloudloom.plans import views

    rows = filters.box(views.table(spark, d, "lineitem"), l_quantity=(10, 20)).select("l_returnflag")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_quantity" in plan and "l_comment" not in plan


def test_cuboids(spark):
    corners = [(0, k, 1 + 2.0 * (k & 1), 1 + 3.0 * (k >> 1 & 1), 1 + 4.0 * (k >> 2)) for k in range(8)]
    df = spark.createDataFrame(corners, "g long, k int, x double, y double, z double")
    r = geometry.corner_cuboids(df, "g").first()
    assert sorted(r.lengths) == [2, 3, 4] and (r.ox, r.oy, r.oz) == (1, 1, 1)
    inside = spark.createDataFrame([(1, 2.0, 2.0, 2.0), (2, 9.0, 2.0, 2.0)], "pid long, x double, y double, z double")
    assert [x.pid for x in filters.in_box(inside, geometry.corner_cuboids(df, "g")).collect()] == [1]
    f = geometry.flat_cuboids(df, "g").first()
    assert (round(f.area, 9), f.low, f.high) == (6, 1, 5)
    cells = spark.createDataFrame([(0, 0, 0, 1)], "xi int, yi int, zi int, v int")
    new = spark.createDataFrame([(0, 0, 0, 9), (1, 1, 1, 9), (5, 0, 0, 9)], "xi int, yi int, zi int, v int")
    assert sorted(map(tuple, grid.insert(cells, new, (2, 2, 2)).collect())) == [(0, 0, 0, 1), (1, 1, 1, 9)]
    assert C.axes_points(2.0, 0.5, spark).groupBy("rgb").count().count() == 3
    assert spark.range(8).select(C.palette_colour(F.col("id")).alias("c")).distinct().count() == 7


def test_shared_folder_is_set_or_its_own():
    from types import SimpleNamespace as N

    from cloudloom.functions import tables

    def session(master, found=None):
        conf = N(get=lambda key, default=None: found)
        return N(conf=conf, sparkContext=N(getConf=lambda: conf, master=master, applicationId=f"app-{master}"))

    assert tables.shared_folder(session("spark://x", "hdfs://a/b/")) == "hdfs://a/b"
    one = tables.shared_folder(session("local[2]"))
    assert one.startswith("file:///") and tables.shared_folder(session("local[2]")) == one
    for master in ("spark://x", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            tables.shared_folder(session(master))
