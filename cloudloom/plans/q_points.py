"""Queries on points: projections, filters, sets, voxels and aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloudloom.functions import columns as C
from cloudloom.operators import filters, geometry, grid, ordered
from cloudloom.plans import views as V
from cloudloom.plans.registry import query


def _r(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


@query(f"SELECT pid, cloud_id, round(x, 6) AS x, y, round(z, 6) AS z FROM ({V.EVENT}) WHERE x BETWEEN 2 AND 6 AND y BETWEEN 10 AND 90 AND z BETWEEN 5 AND 50")
def box_filter(spark, d):
    return filters.box(V.event(spark, d), x=(2, 6), y=(10, 90), z=(5, 50)).select("pid", "cloud_id", *_r("x"), "y", *_r("z"))


@query("SELECT l_returnflag, count(*)::BIGINT AS n, round(sum(l_extendedprice), 2) AS price FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_discount BETWEEN 0.02 AND 0.05 GROUP BY 1")
def box_filter_lineitem(spark, d):
    rows = filters.box(V.table(spark, d, "lineitem"), l_quantity=(10, 20), l_discount=(0.02, 0.05))
    return rows.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


@query(f"SELECT pid, round((x + 1.5) / 0.5, 6) AS x, round((y - 2) / 0.5, 6) AS y, round((z + 3) / 0.5, 6) AS z FROM ({V.PART})")
def translate_scale(spark, d):
    return C.scale(C.translate(V.part(spark, d), 1.5, -2, 3), 0.5).select("pid", *_r("x", "y", "z"))


@query(f"""WITH p AS ({V.PART}), a AS (SELECT radians(10) AS a, radians(20) AS b, radians(30) AS c),
m AS (SELECT cos(c) * cos(b) AS m1, cos(c) * sin(b) * sin(a) - sin(c) * cos(a) AS m2, cos(c) * sin(b) * cos(a) + sin(c) * sin(a) AS m3,
  sin(c) * cos(b) AS m4, sin(c) * sin(b) * sin(a) + cos(c) * cos(a) AS m5, sin(c) * sin(b) * cos(a) - cos(c) * sin(a) AS m6, -sin(b) AS m7, cos(b) * sin(a) AS m8, cos(b) * cos(a) AS m9 FROM a)
SELECT pid, round(m1 * x + m2 * y + m3 * z, 6) AS x, round(m4 * x + m5 * y + m6 * z, 6) AS y, round(m7 * x + m8 * y + m9 * z, 6) AS z FROM p, m""")
def rotate_euler(spark, d):
    return C.rotate_euler(V.part(spark, d), 10, 20, 30).select("pid", *_r("x", "y", "z"))


@query(f"SELECT pid, r * 65536 + g * 256 + b AS rgb, r, g, b FROM ({V.EMB})")
def rgb_pack_unpack(spark, d):
    p = V.emb(spark, d).withColumn("rgb", C.pack_rgb(F.col("r"), F.col("g"), F.col("b")))
    r, g, b = C.unpack_rgb(F.col("rgb"))
    return p.select("pid", "rgb", r.alias("r"), g.alias("g"), b.alias("b"))


@query(f"""WITH p AS (SELECT pid, x + 0.3 AS f FROM ({V.EMB}))
SELECT pid, CASE WHEN f <= 0 THEN 128 WHEN f <= 0.25 THEN trunc(128 * (1 - f / 0.25))::INT WHEN f <= 0.5 THEN 65280
  WHEN f <= 0.75 THEN 255 * 65536 + 256 * trunc(255 + (0.5 - f) / 0.25 * 127)::INT WHEN f <= 1 THEN 255 * 65536 + 256 * trunc(128 * (1 - f) / 0.25)::INT ELSE 255 * 65536 END AS rgb FROM p""")
def colormap(spark, d):
    return V.emb(spark, d).select("pid", C.colormap(F.col("x") + 0.3).alias("rgb"))


@query(f"""WITH p AS ({V.EMB}), l AS (SELECT pid, [CASE WHEN v / 255.0 > 0.04045 THEN pow((v / 255.0 + 0.055) / 1.055, 2.4) ELSE v / 255.0 / 12.92 END * 100 FOR v IN [r, g, b]] AS c FROM p),
x AS (SELECT pid, [CASE WHEN v > 0.008856 THEN pow(v, 1.0::DOUBLE / 3) ELSE (903.3 * v + 16) / 116 END FOR v IN [(c[1] * 0.4124 + c[2] * 0.3576 + c[3] * 0.1805) / 95.047,
  (c[1] * 0.2126 + c[2] * 0.7152 + c[3] * 0.0722) / 100, (c[1] * 0.0193 + c[2] * 0.1192 + c[3] * 0.9505) / 108.883]] AS v FROM l)
SELECT pid, round(greatest(0, 116 * v[2] - 16), 5) AS l, round(500 * (v[1] - v[2]), 5) AS a, round(200 * (v[2] - v[3]), 5) AS b FROM x""")
def rgb2lab(spark, d):
    lab = C.rgb_to_lab(F.col("r"), F.col("g"), F.col("b"))
    return V.emb(spark, d).select("pid", *(F.round(v, 5).alias(k) for k, v in zip("lab", lab, strict=True)))


@query(f"""WITH p AS (SELECT pid, x * 80 AS lat, y * 170 AS lon FROM ({V.EMB})), k AS (SELECT *, 1 - (1 - 1 / 298.257223563::DOUBLE) * (1 - 1 / 298.257223563::DOUBLE) AS q, radians(lat) AS f FROM p),
m AS (SELECT *, q / (1 - q) AS e, 6378137 / sqrt(1 - q * sin(f) * sin(f)) AS n, tan(f) * tan(f) AS t, q / (1 - q) * cos(f) * cos(f) AS c, radians(lon - (3 + 6 * floor((lon + 180) / 6) - 180)) * cos(f) AS a FROM k),
y AS (SELECT *, 6378137 * (f * (1 - q * (1.0::DOUBLE / 4 + q * (3.0::DOUBLE / 64 + 5 * q / 256))) - sin(2 * f) * q * (3.0::DOUBLE / 8 + q * (3.0::DOUBLE / 32 + 45 * q / 1024))
  + sin(4 * f) * q * q * (15.0::DOUBLE / 256 + q * 45 / 1024) - sin(6 * f) * q * q * q * 35 / 3072) AS arc FROM m),
z AS (SELECT pid, 500000 + 0.9996::DOUBLE * n * a * (1 + a * a * ((1 - t + c) / 6 + a * a * (5 - 18 * t + t * t + 72 * c - 58 * e) / 120)) AS east,
  0.9996::DOUBLE * (arc + n * tan(f) * a * a * (0.5::DOUBLE + a * a * ((5 - t + 9 * c + 4 * c * c) / 24 + a * a * (61 - 58 * t + t * t + 600 * c - 330 * e) / 720))) AS north FROM y)
SELECT pid, round(east, 3) AS east, round(CASE WHEN north < 0 THEN north + 10000000 ELSE north END, 3) AS north FROM z""")
def wgs2utm(spark, d):
    east, north = C.utm(F.col("x") * 80, F.col("y") * 170)
    return V.emb(spark, d).select("pid", F.round(east, 3).alias("east"), F.round(north, 3).alias("north"))


@query(f"SELECT (z >= 0)::INT * 4 + (y >= 0)::INT * 2 + (x >= 0)::INT AS octant, label, count(*)::BIGINT AS n FROM ({V.EMB}) GROUP BY ALL")
def octants(spark, d):
    from cloudloom.operators.features import octant_counts

    return octant_counts(V.emb(spark, d), ["label"])


@query(f"""SELECT pid, CASE WHEN x > 0.21 AND x < 2.36 AND y > 0.14 AND y < 1.34 AND z > 0.73 AND z < 3.03 AND y < 0.5 THEN 'person' WHEN x > 1 AND x < 5 AND z > 0.5 AND y < 1.5 THEN 'display'
  WHEN x < 0.4 AND y < 0.3 AND y > 0.7 THEN 'light' ELSE 'none' END AS class FROM (SELECT pid, x / 10 AS x, y / 100 AS y, z / 10 AS z FROM ({V.PART}))""")
def rule_classify(spark, d):
    p = V.part(spark, d)
    y = F.col("y") / 100
    return p.select("pid", C.classify_box(F.col("x") / 10, y, F.col("z") / 10, y).alias("class"))


@query(f"SELECT pid, CASE WHEN rgb > 8000000 THEN 0 ELSE -1 END AS label FROM (SELECT pid, r * 65536 + g * 256 + b AS rgb FROM ({V.EMB}))")
def hot_labels(spark, d):
    p = V.emb(spark, d)
    return p.select("pid", C.hot_label(C.pack_rgb(F.col("r"), F.col("g"), F.col("b")), 8000000).alias("label"))


@query(f"WITH p AS ({V.EVENT}) SELECT pid, round(x - (SELECT avg(x) FROM p), 5) AS x, round(y - (SELECT avg(y) FROM p), 5) AS y, round(z - (SELECT avg(z) FROM p), 5) AS z FROM p")
def centre_map(spark, d):
    return C.centre(V.event(spark, d)).select("pid", *(F.round(c, 5).alias(c) for c in "xyz"))


@query(f"""WITH p AS ({V.EVENT}), t AS (SELECT * FROM p WHERE pid % 2 = 0), m AS (SELECT min(x) AS a, max(x) AS b, min(z) AS c, max(z) AS e FROM t WHERE x BETWEEN 3 AND 5 AND z BETWEEN 10 AND 40)
SELECT pid FROM p, m WHERE pid % 2 = 1 AND x > a * 0.7 AND x < b * 1.3 AND z > c * 0.7 AND z < e * 1.3""")
def size_gate(spark, d):
    p = V.event(spark, d)
    train = filters.box(p.where("pid % 2 = 0"), x=(3, 5), z=(10, 40))
    return filters.size_gate(train, p.where("pid % 2 = 1"), ["x", "z"]).select("pid")


@query(f"""WITH p AS ({V.PART}), s AS (SELECT avg(x) AS ax, stddev_pop(x) AS sx, avg(y) AS ay, stddev_pop(y) AS sy, avg(z) AS az, stddev_pop(z) AS sz FROM p)
SELECT pid FROM p, s WHERE abs(x - ax) < 1.5 * sx AND abs(y - ay) < 1.5 * sy AND abs(z - az) < 1.5 * sz""")
def sigma_filter(spark, d):
    return filters.sigma(V.part(spark, d), ["x", "y", "z"]).select("pid")


@query(f"SELECT 'near' AS side, count(*)::BIGINT AS n FROM ({V.EMB}) WHERE abs(x + 2 * y - z + 0.1) < 0.2 * sqrt(6) UNION ALL SELECT 'far', count(*)::BIGINT FROM ({V.EMB}) WHERE abs(x + 2 * y - z + 0.1) > 0.2 * sqrt(6)")
def plane_split(spark, d):
    p = V.emb(spark, d)
    side = lambda name, inside: filters.plane_side(p, 1, 2, -1, 0.1, 0.2, inside).agg(F.lit(name).alias("side"), F.count("*").alias("n"))
    return side("near", True).unionByName(side("far", False))


@query("SELECT p_partkey, p_brand, (row_number() OVER (ORDER BY p_partkey) - 1) % 5 = 0 AS is_train FROM part")
def mod_split(spark, d):
    return filters.every_nth(V.table(spark, d, "part").select("p_partkey", "p_brand"), "p_partkey", 5)


@query("SELECT p_type, count(*)::BIGINT AS n FROM part WHERE NOT regexp_matches(p_type, '^[0-9]+$') GROUP BY p_type HAVING count(*) > 2 AND count(*) < 400")
def label_freq(spark, d):
    return filters.label_frequency(V.table(spark, d, "part"), "p_type", 2, 400)


@query("SELECT c_custkey AS id, 'c' AS kind FROM customer UNION ALL SELECT s_suppkey, 's' FROM supplier")
def concat(spark, d):
    a = V.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("c").alias("kind"))
    return a.unionByName(V.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("s").alias("kind")))


@query(f"WITH p AS ({V.EMB}) SELECT pid FROM p WHERE pid NOT IN (SELECT pid FROM p WHERE abs(x) < 0.2)")
def diff(spark, d):
    p = V.emb(spark, d)
    return filters.keep_indices(p, p.where(F.abs("x") < 0.2), "pid", False).select("pid")


@query(f"WITH p AS ({V.EMB}) SELECT pid FROM p WHERE pid IN (SELECT pid FROM p WHERE abs(x) < 0.2)")
def extract_by_index(spark, d):
    p = V.emb(spark, d)
    return filters.keep_indices(p, p.where(F.abs("x") < 0.2), "pid", True).select("pid")


@query(f"""WITH p AS ({V.PART}), b AS (SELECT * FROM (VALUES (1, 5.0, 10.0, 2.0, 20.0, 300.0, 20.0), (2, 25.0, 100.0, 0.0, 10.0, 50.0, 40.0)) t(box_id, ox, oy, oz, lx, ly, lz))
SELECT pid, box_id FROM p, b WHERE x - ox BETWEEN -0.1 AND lx + 0.1 AND y - oy BETWEEN -0.1 AND ly + 0.1 AND z - oz BETWEEN -0.1 AND lz + 0.1""")
def cuboid_filter(spark, d):
    axes = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]
    boxes = spark.createDataFrame([(1, 5.0, 10.0, 2.0, axes, [20.0, 300.0, 20.0]), (2, 25.0, 100.0, 0.0, axes, [10.0, 50.0, 40.0])], "box_id int, ox double, oy double, oz double, axes array<array<double>>, lengths array<double>")
    return filters.in_box(V.part(spark, d), F.broadcast(boxes)).select("pid", "box_id")


# --- voxels ------------------------------------------------------------------

_GRID = """b AS (SELECT min(x) AS mx, min(y) AS my, min(z) AS mz, least(max(x) - min(x), max(y) - min(y), max(z) - min(z)) / 20 AS l FROM p),
k AS (SELECT p.*, b.*, trunc((x - mx) / l)::INT AS xi, trunc((y - my) / l)::INT AS yi, trunc((z - mz) / l)::INT AS zi FROM p, b)"""


@query(f"""WITH p AS ({V.EMB}), {_GRID}, v AS (SELECT DISTINCT xi, yi, zi FROM k), r AS (SELECT *, row_number() OVER (PARTITION BY xi, yi ORDER BY zi) AS n FROM v)
SELECT xi, yi, count(*)::BIGINT AS n_voxels, min(zi) AS min_zi, max(zi) AS max_zi FROM r WHERE n > 2 GROUP BY xi, yi""")
def ground_removal(spark, d):
    v = grid.with_cells(V.emb(spark, d), num_grid=20).select(*grid.CELL).distinct()
    return grid.without_lowest(v).groupBy("xi", "yi").agg(F.count("*").alias("n_voxels"), F.min("zi").alias("min_zi"), F.max("zi").alias("max_zi"))


@query(f"WITH p AS ({V.EMB}), {_GRID} SELECT xi, yi, zi, arg_min(pid, pid) AS pid, round(any_value(mx + xi * l), 6) AS x, round(any_value(my + yi * l), 6) AS y, round(any_value(mz + zi * l), 6) AS z FROM k GROUP BY xi, yi, zi")
def voxel_corner(spark, d):
    return grid.voxelise(V.emb(spark, d), "corner", num_grid=20).select(*grid.CELL, "pid", *_r("x", "y", "z"))


@query(f"""WITH p AS ({V.PART}), b AS (SELECT cloud_id, min(x) AS mx, min(y) AS my, min(z) AS mz FROM p GROUP BY cloud_id),
k AS (SELECT p.*, trunc((x - mx) / 20)::INT AS xi, trunc((y - my) / 20)::INT AS yi, trunc((z - mz) / 20)::INT AS zi FROM p JOIN b USING (cloud_id))
SELECT cloud_id, xi, yi, zi, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z, count(*)::BIGINT AS n FROM k GROUP BY cloud_id, xi, yi, zi""")
def voxel_centroid(spark, d):
    return grid.voxelise(V.part(spark, d), "centroid", by=["cloud_id"], leaf=20).select("cloud_id", *grid.CELL, *_r("x", "y", "z"), "n")


@query(f"""WITH p AS ({V.EMB}), b AS (SELECT (min(x) + max(x)) * 0.5 AS mx, (min(y) + max(y)) * 0.5 AS my, (min(z) + max(z)) * 0.5 AS mz FROM p),
k AS (SELECT p.*, trunc((x - mx) / 0.1)::INT AS xi, trunc((y - my) / 0.1)::INT AS yi, trunc((z - mz) / 0.1)::INT AS zi FROM p, b)
SELECT xi, yi, zi, min(pid) AS pid, round(arg_min(x, pid), 6) AS x FROM k GROUP BY xi, yi, zi""")
def voxel_first_mid(spark, d):
    return grid.voxelise(V.emb(spark, d), "first", leaf=0.1, origin="mid").select(*grid.CELL, "pid", *_r("x"))


@query(f"""WITH p AS ({V.EMB}), b AS (SELECT min(x) AS ox, min(y) AS oy, min(z) AS oz, max(x) - min(x) AS sx, max(y) - min(y) AS sy, max(z) - min(z) AS sz, least(max(x) - min(x), max(y) - min(y), max(z) - min(z)) AS s FROM p),
g AS (SELECT *, CASE WHEN sx = s THEN 9 ELSE trunc(9 * (sx / s))::INT END AS nx, CASE WHEN sy = s THEN 9 ELSE trunc(9 * (sy / s))::INT END AS ny, CASE WHEN sz = s THEN 9 ELSE trunc(9 * (sz / s))::INT END AS nz FROM b),
k AS (SELECT floor((x - ox) * ((nx - 1) / sx) + 0.5)::INT AS xi, floor((y - oy) * ((ny - 1) / sy) + 0.5)::INT AS yi, floor((z - oz) * ((nz - 1) / sz) + 0.5)::INT AS zi FROM p, g)
SELECT xi, yi, zi, round(count(*) / sum(count(*)) OVER (), 9) AS v FROM k GROUP BY xi, yi, zi""")
def density_grid(spark, d):
    return grid.density(V.emb(spark, d)).select(*grid.CELL, F.round("v", 9).alias("v"))


@query(f"""WITH p AS ({V.PART}), b AS (SELECT cloud_id, min(x) AS mx, max(x) AS hx, min(y) AS my, max(y) AS hy, min(z) AS mz, max(z) AS hz, (max(z) - min(z)) / 20 AS l FROM p GROUP BY cloud_id)
SELECT cloud_id, count(DISTINCT (trunc((x - mx) / l), trunc((y - my) / l), trunc((z - mz) / l)))::BIGINT AS occupied,
  round(count(DISTINCT (trunc((x - mx) / l), trunc((y - my) / l), trunc((z - mz) / l))) / any_value((trunc((hx - mx) / l) + 1) * (trunc((hy - my) / l) + 1) * (trunc((hz - mz) / l) + 1)), 9) AS ratio
FROM p JOIN b USING (cloud_id) GROUP BY cloud_id""")
def volume_ratio(spark, d):
    return grid.volume_ratio(V.part(spark, d), ["cloud_id"]).select("cloud_id", "occupied", F.round("ratio", 9).alias("ratio"))


def _cells(leaf):
    return f"p AS ({V.EMB}), v AS ({V.CELLS.format(leaf=leaf)})"


@query(f"WITH {_cells(0.05)}, b AS (SELECT max(xi) + 1 AS w, max(yi) + 1 AS h FROM v) SELECT xi * 4 // w AS rx, yi * 4 // h AS ry, count(*)::BIGINT AS n FROM v, b GROUP BY 1, 2")
def region_divide(spark, d):
    return grid.regions(V.cells(V.emb(spark, d), 0.05), 4).groupBy("rx", "ry").agg(F.count("*").alias("n"))


@query(f"""WITH p AS ({V.EMB}), v AS (SELECT trunc((x + 1) / 0.05)::INT AS xi, trunc((y + 1) / 0.05)::INT AS yi, trunc((z + 1) / 0.05)::INT AS zi, min(pid) AS value FROM p GROUP BY ALL),
s AS (SELECT xi + dx AS xi, yi + dy AS yi, zi, value, (dx <> 0 OR dy <> 0)::INT AS new FROM v, (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) o(dx, dy))
SELECT xi, yi, zi, arg_min(value, new * 1000000000 + value) AS value FROM s GROUP BY xi, yi, zi""")
def dilate(spark, d):
    p = V.emb(spark, d).withColumns({f"{c}i": ((F.col(c) + 1) / 0.05).cast("int") for c in "xyz"})
    return grid.dilate(p.groupBy(*grid.CELL).agg(F.min("pid").alias("value")), "value")


@query(f"WITH {_cells(0.05)} SELECT xi, yi, min(zi) AS zi FROM v GROUP BY xi, yi")
def lowest_voxel(spark, d):
    return grid.lowest(V.cells(V.emb(spark, d), 0.05))


@query(f"""WITH {_cells(0.05)} SELECT a.xi, a.yi, a.zi, (abs(sum(b.xi - a.xi)) + abs(sum(b.yi - a.yi)) + abs(sum(b.zi - a.zi)))::BIGINT AS curvature
FROM v a JOIN v b ON abs(a.xi - b.xi) <= 3 AND abs(a.yi - b.yi) <= 3 AND abs(a.zi - b.zi) <= 3 GROUP BY a.xi, a.yi, a.zi""")
def voxel_curvature(spark, d):
    return grid.curvature(V.cells(V.emb(spark, d), 0.05))


@query(f"""WITH p AS ({V.EMB}), v AS (SELECT DISTINCT trunc((x + 1) / 0.05)::INT AS xi, trunc((y + 1) / 0.05)::INT AS yi, trunc((z + 1) / 0.05)::INT AS zi, min(label) OVER (PARTITION BY trunc((x + 1) / 0.05), trunc((y + 1) / 0.05), trunc((z + 1) / 0.05)) AS label FROM p WHERE label < 5)
SELECT pid, coalesce(v.label, -1) AS label FROM p LEFT JOIN v ON trunc((x + 1) / 0.05) = xi AND trunc((y + 1) / 0.05) = yi AND trunc((z + 1) / 0.05) = zi""")
def outlier_join(spark, d):
    p = V.emb(spark, d).withColumns({f"{c}i": ((F.col(c) + 1) / 0.05).cast("int") for c in "xyz"})
    v = p.where("label < 5").groupBy(*grid.CELL).agg(F.min("label").alias("v_label"))
    return p.join(v, grid.CELL, "left").select("pid", F.coalesce("v_label", F.lit(-1)).alias("label"))


# --- aggregates ----------------------------------------------------------------


@query(f"SELECT cloud_id, min(x) AS min_x, max(x) AS max_x, round(min(y), 6) AS min_y, round(max(y), 6) AS max_y, min(z) AS min_z, max(z) AS max_z FROM ({V.PART}) GROUP BY cloud_id")
def bbox(spark, d):
    return grid.bounds(V.part(spark, d), ["cloud_id"]).select("cloud_id", "min_x", "max_x", *_r("min_y", "max_y"), "min_z", "max_z")


@query(f"""WITH l AS (SELECT cloud_id, list_sort(list(x)) AS xs, list_sort(list(y)) AS ys, count(*) AS n, min(z) AS low_z, max(z) AS high_z FROM ({V.PART}) GROUP BY cloud_id)
SELECT cloud_id, xs[n // 4 + 1] AS low_x, xs[n - ceil(n / 4)::INT + 1] AS high_x, round(ys[n // 4 + 1], 6) AS low_y, round(ys[n - ceil(n / 4)::INT + 1], 6) AS high_y, low_z, high_z FROM l""")
def robust_bounds(spark, d):
    return ordered.robust_bounds(V.part(spark, d), ["cloud_id"]).select("cloud_id", "low_x", "high_x", *_r("low_y", "high_y"), "low_z", "high_z")


@query(f"SELECT cloud_id, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, round(avg(z), 6) AS cz, count(*)::BIGINT AS n FROM ({V.EVENT}) GROUP BY cloud_id")
def centroid(spark, d):
    return geometry.centroid(V.event(spark, d), ["cloud_id"]).select("cloud_id", *_r("cx", "cy", "cz"), "n")


@query(f"""SELECT cloud_id, count(*)::BIGINT AS n, round(sum(x * x) - sum(x) * sum(x) / count(*), 2) AS sxx, round(sum(x * y) - sum(x) * sum(y) / count(*), 2) AS sxy, round(sum(x * z) - sum(x) * sum(z) / count(*), 2) AS sxz,
  round(sum(y * y) - sum(y) * sum(y) / count(*), 2) AS syy, round(sum(y * z) - sum(y) * sum(z) / count(*), 2) AS syz, round(sum(z * z) - sum(z) * sum(z) / count(*), 2) AS szz FROM ({V.PART}) GROUP BY cloud_id""")
def scatter3(spark, d):
    return geometry.scatter(V.part(spark, d), ["cloud_id"]).select("cloud_id", "n", *(F.round(f"s{k}", 2).alias(f"s{k}") for k in ("xx", "xy", "xz", "yy", "yz", "zz")))


@query(f"""WITH p AS ({V.PART}), s AS (SELECT cloud_id, sum(x * x) - sum(x) * sum(x) / count(*) AS a, sum(x * y) - sum(x) * sum(y) / count(*) AS b, sum(y * y) - sum(y) * sum(y) / count(*) AS c FROM p GROUP BY cloud_id),
e AS (SELECT cloud_id, a, b, c, (a + c) / 2 + sqrt(((a - c) / 2) * ((a - c) / 2) + b * b) - c AS ux FROM s),
x AS (SELECT cloud_id, CASE WHEN b = 0 THEN (a >= c)::INT ELSE ux / sqrt(ux * ux + b * b) END AS ax, CASE WHEN b = 0 THEN (a < c)::INT ELSE b / sqrt(ux * ux + b * b) END AS ay FROM e),
q AS (SELECT cloud_id, x * ax + y * ay AS u, y * ax - x * ay AS v, z FROM p JOIN x USING (cloud_id))
SELECT cloud_id, count(*)::BIGINT AS n, round(max(u) - min(u), 5) AS length, round(max(v) - min(v), 5) AS width, max(z) - min(z) AS height FROM q GROUP BY cloud_id""")
def obb_xy(spark, d):
    return geometry.oriented_boxes(V.part(spark, d), ["cloud_id"]).select("cloud_id", "n", F.round("length", 5).alias("length"), F.round("width", 5).alias("width"), "height")


@query()
def noise(spark, d):
    return C.add_noise(V.part(spark, d), 0.1, 7)


@query()
def ransac_batch(spark, d):
    p = V.emb(spark, d)
    return geometry.count_inliers(p, geometry.candidate_planes(p, 32, 5), 0.05)


@query()
def ransac(spark, d):
    p = V.emb(spark, d)
    plane = geometry.ransac(p, 0.05, 10_000, 0.7, 5)
    if plane is None:
        return spark.createDataFrame([], "plane int, a double, b double, c double, d double, inliers long")
    return geometry.count_inliers(p, [plane], 0.05)


@query()
def hull_rectangles(spark, d):
    return geometry.least_rectangle(V.part(spark, d), "cloud_id")


@query()
def point_normals(spark, d):
    return geometry.normals(V.emb(spark, d), 0.2)


@query(f"""WITH p AS ({V.EMB}), b AS (SELECT (min(x) + max(x)) / 2 AS mx, (min(y) + max(y)) / 2 AS my, (min(z) + max(z)) / 2 AS mz, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) AS s FROM p),
q AS (SELECT pid, (x - mx) / s AS x, (y - my) / s AS y, (z - mz) / s AS z FROM p, b), c AS (SELECT pid, CASE WHEN x >= 0.5 THEN 49 ELSE trunc((x + 0.5) * 50)::INT END AS xi, CASE WHEN y >= 0.5 THEN 49 ELSE trunc((y + 0.5) * 50)::INT END AS yi, CASE WHEN z >= 0.5 THEN 49 ELSE trunc((z + 0.5) * 50)::INT END AS zi FROM q)
SELECT xi, yi, zi, min(pid) AS pid FROM c GROUP BY xi, yi, zi""")
def unit_cells(spark, d):
    return grid.unit_cells(V.emb(spark, d)).select(*grid.CELL, "pid")


@query(f"""WITH p AS (SELECT pid, x, y, z - 3 AS z, r * 65536 + g * 256 + b AS rgb FROM ({V.EMB})), u AS (SELECT pid, rgb, x / -z AS u, y / -z AS v FROM p WHERE -z > 1), f AS (SELECT greatest(max(abs(u)), max(abs(v))) AS far FROM u),
q AS (SELECT pid, rgb, trunc(u * (63 * 0.9::DOUBLE) / (2 * far) + 32)::INT AS xi, trunc(v * (47 * 0.9::DOUBLE) / (2 * far) + 24)::INT AS yi FROM u, f) SELECT xi, yi, arg_max(rgb, pid) AS rgb FROM q WHERE xi BETWEEN 0 AND 63 AND yi BETWEEN 0 AND 47 GROUP BY xi, yi""")
def camera_image(spark, d):
    p = V.emb(spark, d).withColumns({"rgb": C.pack_rgb(F.col("r"), F.col("g"), F.col("b")), "z": F.col("z") - 3})
    return C.project_image(p, 1.0, 64, 48)


@query(f"""WITH {_cells(0.05)}, c AS (SELECT a.xi, a.yi, a.zi, (abs(sum(b.xi - a.xi)) + abs(sum(b.yi - a.yi)) + abs(sum(b.zi - a.zi)))::BIGINT AS k FROM v a JOIN v b ON abs(a.xi - b.xi) <= 3 AND abs(a.yi - b.yi) <= 3 AND abs(a.zi - b.zi) <= 3 GROUP BY ALL),
s AS (SELECT *, (k - min(k) OVER ()) / (max(k) OVER () - min(k) OVER ()) AS f FROM c)
SELECT xi, yi, zi, k AS curvature, CASE WHEN f <= 0 THEN 128 WHEN f <= 0.25 THEN trunc(128 * (1 - f / 0.25))::INT WHEN f <= 0.5 THEN 65280
  WHEN f <= 0.75 THEN 255 * 65536 + 256 * trunc(255 + (0.5 - f) / 0.25 * 127)::INT WHEN f <= 1 THEN 255 * 65536 + 256 * trunc(128 * (1 - f) / 0.25)::INT ELSE 255 * 65536 END AS rgb FROM s""")
def curvature_colours(spark, d):
    return grid.curvature_colours(V.cells(V.emb(spark, d), 0.05))


@query(f"""WITH p AS ({V.EMB}), l AS (SELECT pid, [CASE WHEN v / 255.0 > 0.04045 THEN pow((v / 255.0 + 0.055) / 1.055, 2.4) ELSE v / 255.0 / 12.92 END * 100 FOR v IN [r, g, b]] AS c FROM p),
x AS (SELECT pid, [CASE WHEN v > 0.008856 THEN pow(v, 1.0::DOUBLE / 3) ELSE (903.3 * v + 16) / 116 END FOR v IN [(c[1] * 0.4124 + c[2] * 0.3576 + c[3] * 0.1805) / 95.047,
  (c[1] * 0.2126 + c[2] * 0.7152 + c[3] * 0.0722) / 100, (c[1] * 0.0193 + c[2] * 0.1192 + c[3] * 0.9505) / 108.883]] AS v FROM l),
y AS (SELECT pid, greatest(0, 116 * v[2] - 16) AS l, 500 * (v[1] - v[2]) AS a, 200 * (v[2] - v[3]) AS b FROM x)
SELECT pid, trunc((l - min(l) OVER ()) * 255 / (max(l) OVER () - min(l) OVER ()))::INT AS r, trunc((a - min(a) OVER ()) * 255 / (max(a) OVER () - min(a) OVER ()))::INT AS g, trunc((b - min(b) OVER ()) * 255 / (max(b) OVER () - min(b) OVER ()))::INT AS b FROM y""")
def lab_stretch(spark, d):
    return C.stretch_lab(V.emb(spark, d)).select("pid", "r", "g", "b")


@query(f"""WITH p AS (SELECT obj_id, list_reduce(list_prepend(0.0::DOUBLE, list_transform(features, lambda v: v * v)), lambda s, v: s + v) AS e FROM ({V.DESC})), q AS (SELECT obj_id, coalesce(e / nullif(max(e) OVER (), 0), 0) AS f FROM p)
SELECT obj_id, CASE WHEN f <= 0 THEN 128 WHEN f <= 0.25 THEN trunc(128 * (1 - f / 0.25))::INT WHEN f <= 0.5 THEN 65280
  WHEN f <= 0.75 THEN 255 * 65536 + 256 * trunc(255 + (0.5 - f) / 0.25 * 127)::INT WHEN f <= 1 THEN 255 * 65536 + 256 * trunc(128 * (1 - f) / 0.25)::INT ELSE 255 * 65536 END AS rgb FROM q""")
def energy_colours(spark, d):
    return C.energy_colours(V.desc(spark, d)).select("obj_id", "rgb")
