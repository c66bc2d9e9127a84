"""Queries on graphs of points and cells, distances, images and ordered rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloudloom.operators import geometry, graph, grid, image, ordered, spatial
from cloudloom.plans import views as V
from cloudloom.plans.q_points import _cells
from cloudloom.plans.registry import query


def _v(spark, d, leaf=0.05):
    return V.cells(V.emb(spark, d), leaf)


def _key(p=""):
    return f"(({p}xi::BIGINT + 524288) * 1048576 + ({p}yi + 524288)) * 1048576 + ({p}zi + 524288)"


_RANKED = """s AS (SELECT component, count(*) AS size FROM c GROUP BY component), k AS (SELECT component, size, row_number() OVER (ORDER BY size DESC, component) - 1 AS cluster_id FROM s)"""


def _walk(leaf, joined, vertices="SELECT * FROM v"):
    """SQL: every cell's least reachable key, for cells a and b that a condition joins."""
    return f"""WITH RECURSIVE {_cells(leaf)}, w AS (SELECT *, {_key()} AS key FROM ({vertices})),
e AS (SELECT a.key AS a, b.key AS b FROM w a JOIN w b ON {joined}),
r AS (SELECT key, key AS root FROM w UNION SELECT e.b, r.root FROM r JOIN e ON r.key = e.a), c AS (SELECT key, min(root) AS component FROM r GROUP BY key)"""


@query(_walk(0.05, "abs(a.xi - b.xi) + abs(a.yi - b.yi) + abs(a.zi - b.zi) = 1") + " SELECT xi, yi, zi, component FROM c JOIN w USING (key)")
def cc_6(spark, d):
    return graph.cluster_cells(_v(spark, d), grid.offsets(1))


@query(_walk(0.05, "greatest(abs(a.xi - b.xi), abs(a.yi - b.yi)) = 1", "SELECT DISTINCT xi, yi, 0 AS zi FROM v") + " SELECT xi, yi, component FROM c JOIN w USING (key)")
def cc_xy8(spark, d):
    return graph.cluster_cells(_v(spark, d), grid.offsets(1, "linf", 2), ["xi", "yi"])


@query(_walk(0.05, "abs(a.xi - b.xi) + abs(a.yi - b.yi) = 1", "SELECT DISTINCT xi, yi, 0 AS zi FROM v") + ", x AS (SELECT component, avg(xi) AS cx, avg(yi) AS cy FROM c JOIN w USING (key) GROUP BY component) SELECT component, round(cx, 6) AS cx, round(cy, 6) AS cy FROM x")
def cluster_centroids_xy(spark, d):
    c = graph.cluster_cells(_v(spark, d), grid.offsets(1, axes=2), ["xi", "yi"])
    return c.groupBy("component").agg(F.round(F.avg("xi"), 6).alias("cx"), F.round(F.avg("yi"), 6).alias("cy"))


@query(_walk(0.04, "abs(a.xi - b.xi) + abs(a.yi - b.yi) + abs(a.zi - b.zi) BETWEEN 1 AND 3") + f", {_RANKED} SELECT cluster_id::INT AS cluster_id, size::BIGINT AS size, component FROM k WHERE cluster_id < 100 AND size > 1")
def cc_l1(spark, d):
    c = graph.rank_clusters(graph.cluster_cells(_v(spark, d, 0.04), grid.offsets(3)), most=100, least_size=2)
    return c.where("cluster_id >= 0").groupBy("cluster_id", "component").agg(F.count("*").alias("size"))


@query(_walk(0.05, "abs(a.xi - b.xi) + abs(a.yi - b.yi) + abs(a.zi - b.zi) = 1") + f", {_RANKED} SELECT xi, yi, zi, (CASE WHEN cluster_id < 10 THEN cluster_id ELSE -1 END)::INT AS cluster_id FROM c JOIN w USING (key) JOIN k USING (component)")
def top_clusters(spark, d):
    c = graph.cluster_cells(_v(spark, d), grid.offsets(1))
    return graph.rank_clusters(c, most=10).select(*grid.CELL, "cluster_id")


@query(_walk(0.05, "abs(a.xi - b.xi) + abs(a.yi - b.yi) + abs(a.zi - b.zi) = 1") + ", s AS (SELECT component, count(*) AS size FROM c GROUP BY component HAVING count(*) BETWEEN 2 AND 50) SELECT component, size::BIGINT AS size FROM s ORDER BY component LIMIT 5")
def leaf_clusters(spark, d):
    c = graph.rank_clusters(graph.cluster_cells(_v(spark, d), grid.offsets(1)), most=5, least_size=2, largest=50, order="first")
    return c.where("cluster_id >= 0").groupBy("component").agg(F.count("*").alias("size"))


def _points(joined):
    return f"""WITH RECURSIVE p AS ({V.EMB}), e AS (SELECT a.pid AS a, b.pid AS b FROM p a JOIN p b ON {joined}),
r AS (SELECT pid, pid AS root FROM p UNION SELECT e.b, r.root FROM r JOIN e ON r.pid = e.a), c AS (SELECT pid, min(root) AS component FROM r GROUP BY pid)"""


@query(_points("greatest(abs(a.x - b.x), abs(a.y - b.y), abs(a.z - b.z)) <= 0.04") + " SELECT pid, component FROM c")
def cc_linf(spark, d):
    return graph.cluster_points(V.emb(spark, d), 0.04)


@query(_points("sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) < 0.06") + ", s AS (SELECT component, count(*)::BIGINT AS n, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM c JOIN p USING (pid) GROUP BY component HAVING count(*) >= 3) SELECT component, n, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM s")
def single_linkage(spark, d):
    p = V.emb(spark, d)
    c = graph.cluster_points(p, 0.06, "l2", strict=True).join(p, "pid")
    return c.groupBy("component").agg(F.count("*").alias("n"), *(F.round(F.avg(k), 6).alias(k) for k in "xyz")).where("n >= 3")


@query(_walk(0.05, "abs(a.xi - b.xi) + abs(a.yi - b.yi) + abs(a.zi - b.zi) = 1 AND abs(a.r - b.r) <= 40 AND a.k <= 6 AND b.k <= 6", """SELECT q.*, k FROM (SELECT trunc((x + 1) / 0.05)::INT AS xi, trunc((y + 1) / 0.05)::INT AS yi, trunc((z + 1) / 0.05)::INT AS zi, arg_min(r, pid) AS r FROM p GROUP BY ALL) q
  JOIN (SELECT a.xi, a.yi, a.zi, count(*) AS k FROM v a JOIN v b ON abs(a.xi - b.xi) + abs(a.yi - b.yi) + abs(a.zi - b.zi) <= 1 GROUP BY ALL) USING (xi, yi, zi)""") + """,
m AS (SELECT a.key, min(c.component) AS component FROM w a JOIN w b ON abs(a.xi - b.xi) + abs(a.yi - b.yi) + abs(a.zi - b.zi) = 1 AND abs(a.r - b.r) <= 40 AND a.k > 6 AND b.k <= 6 JOIN c ON c.key = b.key GROUP BY a.key)
SELECT xi, yi, zi, coalesce(m.component, c.component) AS component FROM w JOIN c USING (key) LEFT JOIN m USING (key)""")
def region_growing(spark, d):
    p = V.emb(spark, d).withColumns({f"{c}i": ((F.col(c) + 1) / 0.05).cast("int") for c in "xyz"})
    v = p.groupBy(*grid.CELL).agg(F.min_by("r", "pid").alias("r"))
    near = grid.neighbours(v.select(*grid.CELL), grid.offsets(1, centre=True)).groupBy(*grid.CELL).agg((F.when(F.count("*") > 6, 201).otherwise(0)).alias("curvature"))
    v = v.join(near, grid.CELL).withColumns({"g": F.lit(0), "b": F.lit(0)})
    v = v.withColumn("curvature", F.when(F.col("curvature") > 0, 201).otherwise(150))
    return graph.grow_regions(v, 1600, 200).select(*grid.CELL, "component")


# --- distances --------------------------------------------------------------


@query(f"WITH p AS ({V.EMB}) SELECT a.pid, count(*)::BIGINT AS n, min(b.pid) AS first FROM p a JOIN p b ON greatest(abs(a.x - b.x), abs(a.y - b.y), abs(a.z - b.z)) <= 0.1 GROUP BY a.pid")
def linf_join(spark, d):
    p = V.emb(spark, d).select("pid", "x", "y", "z")
    return spatial.range_join(p, p, 0.1).groupBy("pid").agg(F.count("*").alias("n"), F.min("n_pid").alias("first"))


@query(f"WITH p AS ({V.EMB}) SELECT a.pid, count(*)::BIGINT AS n FROM p a JOIN p b ON sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) <= 0.1 GROUP BY a.pid")
def range_l2(spark, d):
    p = V.emb(spark, d).select("pid", "x", "y", "z")
    return spatial.range_join(p, p, 0.1, "l2").groupBy("pid").agg(F.count("*").alias("n"))


@query(f"WITH {_cells(0.05)} SELECT a.xi, a.yi, a.zi, count(*)::BIGINT AS n FROM v a JOIN v b ON abs(a.xi - b.xi) + abs(a.yi - b.yi) + abs(a.zi - b.zi) BETWEEN 1 AND 2 GROUP BY ALL")
def neighbour_join(spark, d):
    return grid.neighbours(_v(spark, d), grid.offsets(2)).groupBy(*grid.CELL).agg(F.count("*").alias("n"))


@query(f"""WITH {_cells(0.08)}, m AS (SELECT * FROM (VALUES (0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 1, 0)) t(mx, my, mz))
SELECT a.xi, a.yi, a.zi, count(*)::BIGINT AS hits FROM v a, m JOIN v b ON b.xi = a.xi + mx AND b.yi = a.yi + my AND b.zi = a.zi + mz GROUP BY ALL HAVING count(*) >= 3""")
def correlate(spark, d):
    model = spark.createDataFrame([(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 1, 0)], "xi int, yi int, zi int")
    return spatial.correlate(_v(spark, d, 0.08), model).where("hits >= 3")


@query(f"SELECT label, round(sum(1 / sqrt((x - ox) ** 2 + (y - oy) ** 2)), 5) AS completeness FROM ({V.EMB}), (VALUES (2.0, 2.0), (-3.0, 1.0)) o(ox, oy) GROUP BY label")
def completeness(spark, d):
    o = spark.createDataFrame([(2.0, 2.0), (-3.0, 1.0)], "ox double, oy double")
    return spatial.completeness(V.emb(spark, d), o, "label").select("label", F.round("completeness", 5).alias("completeness"))


@query(f"""WITH p AS ({V.EMB}), m AS (SELECT a.pid AS target_id, b.pid AS source_id, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS dist FROM p a JOIN p b ON a.label < 5 AND b.label >= 5)
SELECT target_id, min(source_id) AS source_id, round(arg_min(dist, source_id), 6) AS dist FROM m WHERE dist < 0.15 GROUP BY target_id""")
def match_threshold(spark, d):
    p = V.emb(spark, d)
    return spatial.matched(p.where("label < 5"), p.where("label >= 5"), 0.15, "pid", "pid").select("target_id", "source_id", F.round("dist", 6).alias("dist"))


@query(f"SELECT DISTINCT pid FROM ({V.EMB}), (VALUES (0.1, 0.0, 0.1, 0.3), (-0.2, 0.1, 0.0, 0.2)) s(cx, cy, cz, radius) WHERE abs((x - cx) ** 2 + (y - cy) ** 2 + (z - cz) ** 2 - radius * radius) < 0.02")
def sphere_points(spark, d):
    s = spark.createDataFrame([(0.1, 0.0, 0.1, 0.3), (-0.2, 0.1, 0.0, 0.2)], "cx double, cy double, cz double, radius double")
    return spatial.on_sphere(V.emb(spark, d), F.broadcast(s), 0.02).select("pid")


@query(f"""WITH p AS ({V.EMB}), n AS (SELECT x, y, z, (r - 127.5) / 127.5 AS nx, (g - 127.5) / 127.5 AS ny, (b - 127.5) / 127.5 AS nz FROM p),
v AS (SELECT floor((x + s * nx) / 0.1)::INT AS xi, floor((y + s * ny) / 0.1)::INT AS yi, floor((z + s * nz) / 0.1)::INT AS zi FROM n, (VALUES (0.2), (-0.2)) o(s)) SELECT xi, yi, zi, count(*)::BIGINT AS votes FROM v GROUP BY ALL HAVING count(*) >= 5""")
def hough_votes(spark, d):
    n = V.emb(spark, d).select("x", "y", "z", *(((F.col(c) - 127.5) / 127.5).alias(f"n{k}") for c, k in zip("rgb", "xyz", strict=True)))
    return geometry.sphere_votes(n, 0.2, 0.1, 5)


@query(f"""WITH {_cells(0.05)}, q AS (SELECT a.xi, a.yi, a.zi, b.xi - a.xi AS dx, b.yi - a.yi AS dy, b.zi - a.zi AS dz, CASE WHEN abs(a.xi - b.xi) + abs(a.yi - b.yi) + abs(a.zi - b.zi) = 1 THEN 7 WHEN greatest(abs(a.xi - b.xi), abs(a.yi - b.yi), abs(a.zi - b.zi)) = 2 THEN 1 ELSE 2 END AS w
  FROM v a JOIN v b ON abs(a.xi - b.xi) + abs(a.yi - b.yi) + abs(a.zi - b.zi) BETWEEN 1 AND 2)
SELECT xi, yi, zi, sum(w)::BIGINT AS w, sum(w * dx)::BIGINT AS mx, sum(w * dy)::BIGINT AS my, sum(w * dz)::BIGINT AS mz, sum(w * dx * dx)::BIGINT AS mxx, sum(w * dx * dy)::BIGINT AS mxy, sum(w * dx * dz)::BIGINT AS mxz,
  sum(w * dy * dy)::BIGINT AS myy, sum(w * dy * dz)::BIGINT AS myz, sum(w * dz * dz)::BIGINT AS mzz FROM q GROUP BY xi, yi, zi""")
def weighted_normals_scatter(spark, d):
    return geometry.weighted_moments(_v(spark, d))


@query()
def weighted_normals(spark, d):
    return geometry.weighted_normals(_v(spark, d))


# --- images -----------------------------------------------------------------

_IMG = f"p AS ({V.EVENT}), i AS (SELECT trunc((x - (SELECT min(x) FROM p)) / 0.12)::INT AS xi, trunc((z - (SELECT min(z) FROM p)) / 6)::INT AS yi FROM p GROUP BY ALL)"
_W, _H = 80, 60
_SIZE = f"(VALUES ({_W}, {_H})) s(w, h)"


def _img(spark, d):
    p = V.event(spark, d)
    b = p.agg(F.min("x").alias("_x"), F.min("z").alias("_z"))
    return p.crossJoin(b).select(((F.col("x") - F.col("_x")) / 0.12).cast("int").alias("xi"), ((F.col("z") - F.col("_z")) / 6).cast("int").alias("yi")).distinct()


@query(f"WITH {_IMG} SELECT i.xi, i.yi FROM i, {_SIZE} WHERE xi BETWEEN 1 AND w - 2 AND yi BETWEEN 1 AND h - 2 AND (SELECT count(*) FROM i j WHERE abs(i.xi - j.xi) + abs(i.yi - j.yi) <= 1) = 5")
def erode(spark, d):
    return image.erode(_img(spark, d), _W, _H)


@query(f"""WITH {_IMG}, g AS (SELECT xi + dx AS xi, yi + dy AS yi FROM i, (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) o(dx, dy)), t AS (SELECT g.xi, g.yi FROM g, {_SIZE} WHERE xi BETWEEN 1 AND w - 2 AND yi BETWEEN 1 AND h - 2 UNION SELECT i.xi, i.yi FROM i, {_SIZE} WHERE xi IN (0, w - 1) OR yi IN (0, h - 1))
SELECT t.xi, t.yi FROM t, {_SIZE} WHERE xi BETWEEN 1 AND w - 2 AND yi BETWEEN 1 AND h - 2 AND (SELECT count(*) FROM t j WHERE abs(t.xi - j.xi) + abs(t.yi - j.yi) <= 1) = 5""")
def closing(spark, d):
    return image.closing(_img(spark, d), _W, _H, 1)


@query(f"""WITH {_IMG}, s AS (SELECT i.xi + dx AS xi, i.yi + dy AS yi, dx * (CASE WHEN dy = 0 THEN 2 ELSE 1 END) AS gx, dy * (CASE WHEN dx = 0 THEN 2 ELSE 1 END) AS gy FROM i, (SELECT a.v AS dx, b.v AS dy FROM (VALUES (-1), (0), (1)) a(v), (VALUES (-1), (0), (1)) b(v) WHERE a.v <> 0 OR b.v <> 0) o)
SELECT s.xi, s.yi FROM s, {_SIZE} WHERE xi BETWEEN 1 AND w - 2 AND yi BETWEEN 1 AND h - 2 GROUP BY ALL HAVING abs(sum(gx)) + abs(sum(gy)) > 4""")
def sobel(spark, d):
    return image.edges(_img(spark, d), _W, _H)


@query(f"WITH {_IMG}, b AS (SELECT a.range::INT AS xi, b.range::INT AS yi FROM range({_W}) a, range({_H}) b) SELECT xi, yi FROM b WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.xi = b.xi AND i.yi = b.yi)")
def holes(spark, d):
    return image.holes(_img(spark, d), _W, _H)


# --- ordered rows -----------------------------------------------------------


@query(f"""WITH {_cells(0.05)}, i AS (SELECT DISTINCT xi, zi FROM v), g AS (SELECT *, CASE WHEN xi - lag(xi) OVER (PARTITION BY zi ORDER BY xi) > 1 THEN 1 ELSE 0 END AS gap FROM i)
SELECT xi, zi, (sum(gap) OVER (PARTITION BY zi ORDER BY xi))::INT AS island FROM g""")
def islands(spark, d):
    return graph.islands(_v(spark, d).select("xi", "zi").distinct(), "xi", ["zi"])


@query(f"""WITH {_cells(0.05)}, i AS (SELECT DISTINCT xi, yi, zi FROM v), g AS (SELECT *, CASE WHEN yi - lag(yi) OVER (PARTITION BY xi, zi ORDER BY yi) > 1 THEN 1 ELSE 0 END AS gap FROM i)
SELECT xi, zi, (CASE WHEN sum(gap) = 0 THEN count(*) ELSE 0 END)::BIGINT AS run FROM g GROUP BY xi, zi""")
def single_runs(spark, d):
    return ordered.single_run(_v(spark, d), ["xi", "zi"], "yi")


_PROFILE = f"""p AS ({V.EMB}), b AS (SELECT min(x) AS mx, max(x) AS hx, min(y) AS my, max(y) AS hy, min(z) AS mz, max(z) AS hz FROM p),
g AS (SELECT DISTINCT trunc((x - mx) / ((hx - mx) / 100))::INT AS xi, trunc((y - my) / ((hy - my) / 100))::INT AS yi, trunc((z - mz) / ((hz - mz) / 100))::INT AS zi FROM p, b),
s AS (SELECT r.range::INT AS i, count(g.zi)::BIGINT AS v FROM range(101) r LEFT JOIN g ON g.zi = r.range GROUP BY 1)"""


@query(f"WITH {_PROFILE} SELECT i, v FROM s")
def z_profile(spark, d):
    return ordered.z_profile(V.emb(spark, d))


@query(f"""WITH {_PROFILE}, m AS (SELECT *, (list_sort(list(v) OVER (ORDER BY i ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING)))[11] AS m FROM s),
h AS (SELECT i, v, CASE WHEN i - lag(i) OVER (ORDER BY i) > 1 THEN 1 ELSE 0 END AS gap FROM m WHERE v > m * 1.5), k AS (SELECT i, v, sum(gap) OVER (ORDER BY i) AS island FROM h)
SELECT island::INT AS island, min(i) AS first, max(i) AS last, max(v) AS peak FROM k GROUP BY island ORDER BY peak DESC, first LIMIT 6""")
def median_peaks(spark, d):
    return ordered.median_peaks(ordered.z_profile(V.emb(spark, d)))


@query(f"""WITH {_PROFILE}, q AS (SELECT pid, trunc((z - mz) / ((hz - mz) / 100))::INT AS zi FROM p, b), r AS (SELECT * FROM (VALUES (20, 30, 0, 45), (45, 50, 1, 70), (70, 70, 2, NULL)) t(first, last, k, next))
SELECT pid, CASE WHEN zi <= last THEN k END AS level, CASE WHEN zi > last THEN k END AS storey FROM q LEFT JOIN r ON zi >= first AND (zi <= last OR zi < next)""")
def building_levels(spark, d):
    peaks = spark.createDataFrame([(20, 30), (45, 50), (70, 70)], "first int, last int")
    return ordered.levels(V.emb(spark, d), peaks).select("pid", "level", "storey")


@query(f"""WITH p AS ({V.PART}), h AS (SELECT max(z) - min(z) AS h FROM p), l AS (SELECT cloud_id, list_sort(list(x)) AS xs, list_sort(list(y)) AS ys, count(*) AS n, max(z) - min(z) AS tall FROM p GROUP BY cloud_id)
SELECT cloud_id FROM l, h WHERE xs[n - ceil(n / 4)::INT + 1] - xs[n // 4 + 1] < 24 AND ys[n - ceil(n / 4)::INT + 1] - ys[n // 4 + 1] < 384 AND tall > h.h - 0.5""")
def column_detector(spark, d):
    p = V.part(spark, d).withColumns({"x": F.col("x") / 8, "y": F.col("y") / 128})
    return ordered.columns(p, "cloud_id").select("cloud_id")


def _lines(axis):
    """SQL: points in the beams across one axis."""
    return f"""(WITH n AS (SELECT {axis}i AS i, count(DISTINCT {'y' if axis == 'x' else 'x'}i) AS n FROM c GROUP BY {axis}i), f AS (SELECT i, i - row_number() OVER (ORDER BY i) AS run FROM n WHERE n >= (SELECT max(n) FROM n) * 0.5),
k AS (SELECT i, dense_rank() OVER (ORDER BY run) - 1 AS beam FROM f) SELECT pid, '{axis}' AS axis, beam::BIGINT AS beam FROM c JOIN k ON c.{axis}i = k.i)"""


@query(f"""WITH p AS ({V.EMB}), b AS (SELECT min(x) AS mx, min(y) AS my, least((max(x) - min(x)) / 40, (max(y) - min(y)) / 40) AS s FROM p),
c AS (SELECT pid, trunc((x - mx) / s)::INT AS xi, trunc((y - my) / s)::INT AS yi FROM p, b) {_lines("x")} UNION ALL {_lines("y")}""")
def beams(spark, d):
    return ordered.beams(V.emb(spark, d), 40)


@query(_walk(0.08, "abs(a.xi - b.xi) + abs(a.yi - b.yi) + abs(a.zi - b.zi) BETWEEN 1 AND 3") + """, x AS (SELECT * FROM c JOIN w USING (key)), h AS (SELECT DISTINCT component FROM x WHERE (xi + yi + zi) % 7 = 0)
SELECT component, count(*)::BIGINT AS n, round(avg(xi), 6) AS x, round(avg(yi), 6) AS y, round(avg(zi), 6) AS z FROM x JOIN h USING (component) GROUP BY component""")
def candidate_clusters(spark, d):
    v = _v(spark, d, 0.08)
    out = graph.cluster_candidates(v, v.where("(xi + yi + zi) % 7 = 0"))
    return out.select("component", "n", *(F.round(k, 6).alias(k) for k in "xyz"))
