"""Queries that describe point sets by vectors, and rays on a mesh."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloudloom.operators import features, geometry, rays
from cloudloom.plans import views as V
from cloudloom.plans.q_points import _cells
from cloudloom.plans.registry import query


@query(f"""WITH p AS ({V.PART}), c AS (SELECT cloud_id, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz, count(*) AS n FROM p GROUP BY cloud_id),
r AS (SELECT cloud_id, n, sqrt((x - cx) ** 2 + (y - cy) ** 2 + (z - cz) ** 2) AS r FROM p JOIN c USING (cloud_id)), e AS (SELECT cloud_id, min(r) AS lo, max(r) AS hi FROM r GROUP BY cloud_id)
SELECT cloud_id, least(floor((r - lo) / (hi - lo) * 100), 99)::INT AS bin, round(count(*) / any_value(n), 9) AS value FROM r JOIN e USING (cloud_id) GROUP BY 1, 2""")
def radial_hist(spark, d):
    return features.radial_histogram(V.part(spark, d), ["cloud_id"]).select("cloud_id", "bin", F.round("value", 9).alias("value"))


@query()
def radial_vectors(spark, d):
    return features.radial_vector(V.part(spark, d), ["cloud_id"])


@query(f"""WITH {_cells(0.05)}, q AS (SELECT xi, yi, zi, (SELECT coalesce(sum(k), 0) FROM (VALUES (-1, 0, 0, 1), (0, -1, 0, 2), (-1, 0, -1, 4), (1, 0, 0, 8), (0, 1, 0, 16), (0, 0, 1, 32)) o(dx, dy, dz, k)
  JOIN v n ON n.xi = v.xi + dx AND n.yi = v.yi + dy AND n.zi = v.zi + dz) AS bin FROM v), c AS (SELECT bin, count(*) AS n FROM q GROUP BY bin)
SELECT bin::INT AS bin, round(n / sqrt(sum(n * n) OVER ()), 9) AS value FROM c""")
def lbp_hist(spark, d):
    return features.binary_pattern(V.cells(V.emb(spark, d), 0.05)).select("bin", F.round("value", 9).alias("value"))


_OCC = f"""p AS ({V.PART}), b AS (SELECT cloud_id, min(x) AS ox, min(y) AS oy, min(z) AS oz, max(x) - min(x) AS sx, max(y) - min(y) AS sy, max(z) - min(z) AS sz, least(max(x) - min(x), max(y) - min(y), max(z) - min(z)) AS s FROM p GROUP BY cloud_id),
g AS (SELECT *, CASE WHEN sx = s THEN 9 ELSE trunc(9 * (sx / s))::INT END AS l, CASE WHEN sy = s THEN 9 ELSE trunc(9 * (sy / s))::INT END AS w, CASE WHEN sz = s THEN 9 ELSE trunc(9 * (sz / s))::INT END AS h FROM b),
c AS (SELECT DISTINCT cloud_id, l, w, h, floor((x - ox) * ((l - 1) / sx) + 0.5)::INT AS x, floor((y - oy) * ((w - 1) / sy) + 0.5)::INT AS y, floor((z - oz) * ((h - 1) / sz) + 0.5)::INT AS z FROM p JOIN g USING (cloud_id))"""


@query(f"""WITH {_OCC}, n AS (SELECT cloud_id, any_value(l) AS l, any_value(w) AS w, any_value(h) AS h, count(*) FILTER (x < l // 2) AS back, count(*) FILTER (x >= l // 2) AS front, count(*) FILTER (x >= l // 3 AND x < l * 2 // 3) AS mid, count(*) FILTER (x < l // 3 OR x >= l * 2 // 3) AS ends,
  count(*) FILTER (x < l // 2 AND (y < w // 3 OR y >= w * 2 // 3)) AS o1, count(*) FILTER (x < l // 2 AND y >= w // 3 AND y < w * 2 // 3) AS i1, count(*) FILTER (x >= l // 2 AND (y < w // 3 OR y >= w * 2 // 3)) AS o2, count(*) FILTER (x >= l // 2 AND y >= w // 3 AND y < w * 2 // 3) AS i2 FROM c GROUP BY cloud_id),
s AS (SELECT g.cloud_id, r.range AS x, g.l, g.w, g.h, count(c.x) AS n, coalesce(max(c.z), 0) AS top FROM g, range(1000) r LEFT JOIN c ON c.cloud_id = g.cloud_id AND c.x = r.range WHERE r.range < g.l GROUP BY ALL),
k AS (SELECT cloud_id, arg_max(x, top * 100000 - x) AS peak FROM s GROUP BY cloud_id),
f AS (SELECT cloud_id, l, peak, abs(regr_slope(top, x) FILTER (x <= peak)) AS g1, abs(regr_slope(top, x) FILTER (x >= peak)) AS g2, count(*) FILTER (x <= peak) AS n1, count(*) FILTER (x >= peak) AS n2,
  max(x) - coalesce(max(x) FILTER (n >= least(w // 2, h // 2)), -1) AS boom, count(*) FILTER (top <= h // 2) AS bucket FROM s JOIN k USING (cloud_id) GROUP BY cloud_id, l, peak)
SELECT cloud_id, round(n.l / least(w, h), 6) AS elongation, round(h / w, 6) AS uprightness, round(least(front, back) / greatest(front, back), 6) AS front_back, round(mid / nullif(ends, 0), 6) AS middle,
  round(least(o1 / (i1 + 1), o2 / (i2 + 1)) / nullif(greatest(o1 / (i1 + 1), o2 / (i2 + 1)), 0), 6) AS sides, round(CASE WHEN n1 < 2 OR n2 < 2 THEN 0 ELSE least(g1, g2) / nullif(greatest(g1, g2), 0) END, 6) AS slopes,
  round(least(peak, n.l - peak) / greatest(peak, n.l - peak), 6) AS peak_place, round(boom / n.l, 6) AS boom, round(bucket / n.l, 6) AS bucket FROM n JOIN f USING (cloud_id)""")
def pad13(spark, d):
    cells, g = features.occupancy(V.part(spark, d), ["cloud_id"])
    f = features.part_features(cells, g, ["cloud_id"])
    names = ["elongation", "uprightness", "front_back", "middle", "sides", "slopes", "peak_place", "boom", "bucket"]
    return f.select("cloud_id", *(F.round(c, 6).alias(c) for c in names))


@query()
def part10(spark, d):
    cells, g = features.occupancy(features.canonical_pose(V.part(spark, d), ["cloud_id"]), ["cloud_id"])
    return features.part_features(cells, g, ["cloud_id"])


@query(f"""WITH p AS (SELECT obj_id, features AS f, label FROM ({V.DESC})), e AS (SELECT label, unnest(f) AS v, generate_subscripts(f, 1) AS dim FROM p WHERE label IS NOT NULL),
w AS (SELECT label AS word, list(m ORDER BY dim) AS f FROM (SELECT label, dim, avg(v) AS m FROM e GROUP BY ALL) GROUP BY label),
n AS (SELECT label, obj_id, arg_min(word, (list_sum(list_transform(list_zip(p.f, w.f), lambda z: (z[1] - z[2]) ** 2)), word)) AS word FROM p, w GROUP BY label, obj_id)
SELECT label, word::INT AS word, round(count(*) / sum(count(*)) OVER (PARTITION BY label), 9) AS value FROM n GROUP BY label, word""")
def bow(spark, d):
    """The words are the mean vectors of the labels."""
    p = V.desc(spark, d).select(F.col("obj_id").alias("desc_id"), "features", "label")
    mean = p.where("label is not null").select("label", F.posexplode("features").alias("dim", "v")).groupBy("label", "dim").agg(F.avg("v").alias("m"))
    vocabulary = mean.groupBy(F.col("label").alias("word")).agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "m"))), lambda x: x["m"]).alias("features"))
    return features.bag_of_words(p, vocabulary, "label").select("label", "word", F.round("value", 9).alias("value"))


@query(f"""WITH p AS ({V.PART}), c AS (SELECT cloud_id, (x / 5)::INT AS bin, count(*) AS v FROM p GROUP BY ALL)
SELECT cloud_id, bin, round(sum(v) OVER (PARTITION BY cloud_id ORDER BY bin) / sum(v) OVER (PARTITION BY cloud_id), 9) AS value FROM c""")
def histogram_equalise(spark, d):
    h = V.part(spark, d).groupBy("cloud_id", F.round(F.col("x") / 5).cast("int").alias("bin")).agg(F.count("*").cast("double").alias("value"))
    return features.equalise(h, ["cloud_id"]).select("cloud_id", "bin", F.round("value", 9).alias("value"))


@query(f"""WITH {_cells(0.08)}, k AS (SELECT *, (xi + yi) % 3 AS kind FROM v), o AS (SELECT a.range - 1 AS dx, b.range - 1 AS dy, c.range - 1 AS dz FROM range(3) a, range(3) b, range(3) c WHERE a.range <> 1 OR b.range <> 1 OR c.range <> 1),
q AS (SELECT k.kind, coalesce(n.kind, 5) AS other FROM k CROSS JOIN o LEFT JOIN k n ON n.xi = k.xi + dx AND n.yi = k.yi + dy AND n.zi = k.zi + dz), l AS (SELECT least(kind, other) AS a, greatest(kind, other) AS b FROM q)
SELECT (a * 6 - a * (a - 1) // 2 + b - a)::INT AS bin, count(*)::BIGINT AS value FROM l GROUP BY 1""")
def grsd(spark, d):
    v = V.cells(V.emb(spark, d), 0.08).withColumn("kind", (F.col("xi") + F.col("yi")) % 3)
    return features.transition_histogram(v)


def _with_normals(spark, d):
    return geometry.normals(V.emb(spark, d), 0.2).select("pid", "x", "y", "z", "nx", "ny", "nz")


@query()
def rsd(spark, d):
    r = features.radius_descriptor(_with_normals(spark, d), 0.2)
    return r.select("pid", "r_min", "r_max", features.surface_type(F.col("r_min"), F.col("r_max")).alias("kind"))


@query()
def fpfh(spark, d):
    return features.point_feature_histogram(_with_normals(spark, d), 0.2)


@query()
def spin(spark, d):
    return features.spin_image(_with_normals(spark, d), 0.2)


# --- a mesh of the table's own: a fan of triangles over part -------------------

_MESH = """v AS (SELECT p_partkey AS vid, p_size::DOUBLE AS x, (p_partkey % 37)::DOUBLE AS y, (p_partkey % 11)::DOUBLE AS z FROM part),
f AS (SELECT p_partkey - 1 AS fid, p_partkey AS a, p_partkey % k + 1 AS b, (p_partkey * 7) % k + 1 AS c FROM part, (SELECT max(p_partkey) AS k FROM part)),
t AS (SELECT fid, p.x AS ax, p.y AS ay, p.z AS az, q.x AS bx, q.y AS by_, q.z AS bz, r.x AS cx, r.y AS cy, r.z AS cz FROM f JOIN v p ON a = p.vid JOIN v q ON b = q.vid JOIN v r ON c = r.vid),
n AS (SELECT *, (by_ - ay) * (cz - az) - (bz - az) * (cy - ay) AS nx, (bz - az) * (cx - ax) - (bx - ax) * (cz - az) AS ny, (bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax) AS nz FROM t)"""


def _fan(p, n):
    """Vertices, faces and triangles of parts with keys up to n."""
    k = F.col("p_partkey")
    vertices = p.select(k.alias("vid"), F.col("p_size").cast("double").alias("x"), (k % 37).cast("double").alias("y"), (k % 11).cast("double").alias("z"))
    faces = p.select((k - 1).alias("fid"), k.alias("a"), (k % n + 1).alias("b"), (k * 7 % n + 1).alias("c"))
    return vertices, faces, rays.triangles(vertices, faces)


def _whole_mesh(spark, d):
    p = V.table(spark, d, "part")
    return _fan(p, p.agg(F.max("p_partkey")).first()[0] or 1)


@query(f"WITH {_MESH} SELECT fid, round(sqrt(nx * nx + ny * ny + nz * nz) / 2, 6) AS area FROM n")
def mesh_area(spark, d):
    from cloudloom.functions.columns import triangle_area, vec

    return _whole_mesh(spark, d)[2].select("fid", F.round(triangle_area(vec("a"), vec("b"), vec("c")), 6).alias("area"))


@query(f"""WITH {_MESH}, u AS (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS s FROM n), r AS (SELECT a.range * 40 + b.range AS ray, 60.0 AS ox, a.range - 1.2345::DOUBLE AS oy, b.range * 0.2917::DOUBLE - 0.4317::DOUBLE AS oz FROM range(40) a, range(40) b),
h AS (SELECT ray, fid, ((nx * ax + ny * ay + nz * az) / s - (nx * ox + ny * oy + nz * oz) / s) / (-nx / s) AS t, ox, oy, oz, u.* EXCLUDE (fid) FROM r, u WHERE s > 0 AND abs(nx / s) >= 0.01),
k AS (SELECT *, ox - t AS hx FROM h WHERE t > 0),
i AS (SELECT ray, fid, t FROM k WHERE nx * ((by_ - ay) * (oz - az) - (bz - az) * (oy - ay)) + ny * ((bz - az) * (hx - ax) - (bx - ax) * (oz - az)) + nz * ((bx - ax) * (oy - ay) - (by_ - ay) * (hx - ax)) > 0
  AND nx * ((cy - by_) * (oz - bz) - (cz - bz) * (oy - by_)) + ny * ((cz - bz) * (hx - bx) - (cx - bx) * (oz - bz)) + nz * ((cx - bx) * (oy - by_) - (cy - by_) * (hx - bx)) > 0
  AND nx * ((ay - cy) * (oz - cz) - (az - cz) * (oy - cy)) + ny * ((az - cz) * (hx - cx) - (ax - cx) * (oz - cz)) + nz * ((ax - cx) * (oy - cy) - (ay - cy) * (hx - cx)) > 0)
SELECT ray, arg_min(fid, (t, fid)) AS fid, round(min(t) + 0.0001234567, 3) AS t FROM i GROUP BY ray""")
def ray_hits(spark, d):
    k = F.col("id")
    r = spark.range(1600).select(k.alias("ray"), F.lit(60.0).alias("ox"), (F.expr("id div 40") - 1.2345).alias("oy"), (k % 40 * 0.2917 - 0.4317).alias("oz"), F.lit(-1.0).alias("dx"), F.lit(0.0).alias("dy"), F.lit(0.0).alias("dz"))
    return rays.cast_rays(r, _whole_mesh(spark, d)[2]).select("ray", "fid", F.round(F.col("t") + 0.0001234567, 3).alias("t"))


@query()
def scan_views(spark, d):
    r = rays.parallel_rays(spark, (25.0, 18.0, 5.0), 60.0, 60.0, 8, 20)
    return rays.cast_rays(r, _whole_mesh(spark, d)[2])


@query()
def mesh_depth(spark, d):
    return rays.depth_map(_whole_mesh(spark, d)[2], 50, 40)


@query(f"""WITH {_MESH}, u AS (SELECT f.a, f.b, f.c, nx / s AS x, ny / s AS y, nz / s AS z FROM (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS s FROM n) JOIN f USING (fid) WHERE s > 0), k AS (SELECT unnest([a, b, c]) AS vid, x, y, z FROM u),
m AS (SELECT vid, sum(x) AS x, sum(y) AS y, sum(z) AS z FROM k GROUP BY vid) SELECT vid, round(x / sqrt(x * x + y * y + z * z), 5) AS nx, round(y / sqrt(x * x + y * y + z * z), 5) AS ny, round(z / sqrt(x * x + y * y + z * z), 5) AS nz FROM m""")
def vertex_normals(spark, d):
    return rays.vertex_normals(_whole_mesh(spark, d)[2]).select("vid", *(F.round(c, 5).alias(c) for c in ("nx", "ny", "nz")))


@query()
def mesh_sample(spark, d):
    from cloudloom.operators.filters import sample_mesh

    return sample_mesh(_whole_mesh(spark, d)[2], 4.0, 3)




@query()
def shot(spark, d):
    from cloudloom.operators import descriptors

    return descriptors.shot(_with_normals(spark, d), 0.2)


@query()
def usc(spark, d):
    from cloudloom.operators import descriptors

    return descriptors.shape_context(_with_normals(spark, d), 0.2, 0.02, 0.04)


@query()
def vfh(spark, d):
    from cloudloom.operators import descriptors

    p = _with_normals(spark, d).join(V.emb(spark, d).select("pid", "label"), "pid")
    return descriptors.viewpoint_histogram(p, ["label"])


@query()
def our_cvfh(spark, d):
    from cloudloom.operators import descriptors

    return descriptors.clustered_viewpoint_histogram(geometry.normals(V.emb(spark, d), 0.2), 0.2, 0.5)


@query()
def esf(spark, d):
    from cloudloom.operators import descriptors

    return descriptors.shape_functions(V.part(spark, d), "cloud_id")


@query()
def triple_histograms(spark, d):
    from cloudloom.operators import descriptors

    return descriptors.triple_histogram(V.part(spark, d), "cloud_id")


@query()
def part_histograms(spark, d):
    from cloudloom.operators import descriptors

    return descriptors.part_histograms(features.canonical_pose(V.part(spark, d), ["cloud_id"]), "cloud_id")
