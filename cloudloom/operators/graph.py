"""Connected components and the clusterings that are made of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloudloom.functions.tables import discard, materialize
from cloudloom.operators import grid, spatial


ONE_TASK = 1 << 20  # edges that one task may hold


def _stars(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    """A star forest with the components that the edges have, by repeated hooking onto the least neighbour."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        for end in (a, b):
            np.minimum.at(new, root[end], low)
            np.minimum.at(new, end, low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    moved = root != np.arange(len(nodes))
    return pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[root[moved]])], names=["u", "v"])


def _shrink(batches):
    for batch in batches:
        yield _stars(batch.column(0).to_numpy(), batch.column(1).to_numpy())


def _settle(batches):
    held = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches]
    if held:
        yield _stars(*(np.concatenate(x) for x in zip(*held, strict=True)))


def connected_components(edges: DataFrame, most_rounds: int = 60, one_task: int = ONE_TASK) -> DataFrame:
    """(node, component) for each node of an edge table (u, v), both long: the least node that can be reached.

    Each batch is reduced to a forest where it is read.  At most ``one_task``
    edges are settled in one task, which then holds them.  While there are
    more, large-star and small-star steps alternate, which need O(log^2 n)
    rounds on any graph.  A node's neighbours are never gathered: its least one
    comes from a partial aggregate and is joined back, and AQE splits the join
    where one node has many edges.  Self-loops and repeated edges do no harm;
    nulls and nodes without edges aren't in the result.  No edges give no rows.
    """
    u, v = F.col("u"), F.col("v")
    edges = edges.select(u.cast("long").alias("u"), v.cast("long").alias("v")).where(u.isNotNull() & v.isNotNull() & (u != v))
    held = materialize(edges.mapInArrow(_shrink, "u long, v long").distinct(), "edges")
    checksum = lambda t: tuple(t.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    said = checksum(held)
    for _ in range(most_rounds):
        if said[0] <= one_task:
            settled = held.coalesce(1).mapInArrow(_settle, "u long, v long")
            new = materialize(settled, "edges")
            discard(held)
            held = new
            break
        both = held.unionAll(held.select(v.alias("u"), u.alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").where(v > u).select(v.alias("u"), F.col("m").alias("v")).where(u != v).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.explode(F.array(F.struct(v.alias("u"), F.col("m").alias("v")), F.struct(u.alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where(u != v)
        new = materialize(small.distinct(), "edges")
        now = checksum(new)
        discard(held)
        held = new
        if now == said:
            break
        said = now
    else:
        raise RuntimeError("components did not settle")
    return held.select(u.alias("node"), v.alias("component")).unionAll(held.select(v.alias("node"), v.alias("component")).distinct())


def components_of(pairs: DataFrame, vertices: DataFrame, key: str, other: str) -> DataFrame:
    """(key, component) of all vertices, by pairs (key, other) of longs; a lone vertex is its own."""
    comps = connected_components(pairs.select(F.col(key).alias("u"), F.col(other).alias("v")))
    return vertices.select(key).join(comps, vertices[key] == comps["node"], "left").select(key, F.coalesce("component", key).alias("component"))


def cell_key(prefix: str = ""):
    """A long that orders cells as (xi, yi, zi) does, for indices of less than 2**20."""
    x, y, z = (F.col(f"{prefix}{c}").cast("long") for c in grid.CELL)
    return ((x + 524288) * 1048576 + (y + 524288)) * 1048576 + (z + 524288)


def cluster_cells(cells: DataFrame, offsets: list[tuple[int, ...]], axes: list[str] | None = None) -> DataFrame:
    """``cells`` with ``component`` (the least key) of the graph in which cells one of the offsets apart are joined."""
    axes = axes or grid.CELL
    flat = cells if len(axes) == 3 else cells.select(*axes).distinct().withColumn("zi", F.lit(0))
    half = [o for o in offsets if o > tuple([0] * len(axes))]  # each pair once
    pairs = grid.neighbours(flat, half, axes)
    if len(axes) == 2:
        pairs = pairs.withColumn("n_zi", F.lit(0))
    comps = components_of(pairs.select(cell_key().alias("key"), cell_key("n_").alias("other")), flat.select(cell_key().alias("key")), "key", "other")
    return flat.withColumn("key", cell_key()).join(comps, "key").select(*axes, "component")


def cluster_points(points: DataFrame, d: float, metric: str = "linf", strict: bool = False) -> DataFrame:
    """(pid, component): points within ``d`` of each other are joined."""
    pairs = spatial.range_join(points.select("pid", "x", "y", "z"), points.select("pid", "x", "y", "z"), d, metric, strict=strict).where("pid < n_pid")
    return components_of(pairs.select("pid", "n_pid"), points, "pid", "n_pid")


def rank_clusters(members: DataFrame, most: int | None = None, least_size: int = 1, largest: int | None = None, order: str = "size") -> DataFrame:
    """``members`` with ``cluster_id``: 0, 1, .. by falling size (ties: the least component first) or, with ``order="first"``, by component; -1 for clusters outside the sizes or past the first ``most``.

    Only the wanted clusters are numbered: they are the top of a sorted limit,
    not of a window over all.
    """
    sizes = members.groupBy("component").agg(F.count("*").alias("size")).where(F.col("size") >= least_size)
    if largest is not None:
        sizes = sizes.where(F.col("size") <= largest)
    keys = [F.desc("size"), F.asc("component")] if order == "size" else [F.asc("component")]
    top = sizes.orderBy(*keys)
    if most is not None:
        top = top.limit(most)
    named = top.withColumn("cluster_id", F.row_number().over(Window.orderBy(*keys)) - 1).select("component", "cluster_id")
    return members.join(named, "component", "left").withColumn("cluster_id", F.coalesce("cluster_id", F.lit(-1)))


def grow_regions(cells: DataFrame, colour_limit: int = 35000, curvature_limit: int = 200) -> DataFrame:
    """Regions of cells (xi, yi, zi, r, g, b, curvature) joined over faces if their colours and curvatures are near.  Strongly curved cells don't grow: they join the least region that touches them, or are alone."""
    keep = cells.withColumn("key", cell_key())
    moved = grid.neighbours(keep, grid.offsets(1)).withColumn("other", cell_key("n_"))
    about = keep.select(F.col("key").alias("other"), *(F.col(c).alias(f"n_{c}") for c in ("r", "g", "b", "curvature")))
    pairs = moved.join(about, "other")
    diff = sum(((F.col(c) - F.col(f"n_{c}")) * (F.col(c) - F.col(f"n_{c}")) for c in "gb"), (F.col("r") - F.col("n_r")) * (F.col("r") - F.col("n_r")))
    pairs = pairs.where((diff <= colour_limit) & (F.abs(F.col("curvature") - F.col("n_curvature")) <= curvature_limit))
    core = keep.where(F.col("curvature") <= curvature_limit)
    inner = pairs.where((F.col("curvature") <= curvature_limit) & (F.col("n_curvature") <= curvature_limit) & (F.col("key") < F.col("other")))
    comps = components_of(inner.select("key", "other"), core, "key", "other")
    rim = pairs.where((F.col("curvature") > curvature_limit) & (F.col("n_curvature") <= curvature_limit)).select("key", "other")
    rim = rim.join(comps.select(F.col("key").alias("other"), "component"), "other").groupBy("key").agg(F.min("component").alias("component"))
    found = comps.unionByName(rim)
    return keep.join(found, "key", "left").withColumn("component", F.coalesce("component", "key")).drop("key")


def islands(rows: DataFrame, index: str, by: list[str] | None = None) -> DataFrame:
    """``rows`` with ``island``: runs of consecutive whole numbers, numbered from 0 in each group."""
    w = Window.partitionBy(*(by or [])).orderBy(index)
    gap = F.when(F.col(index) - F.lag(index).over(w) > 1, 1).otherwise(0)
    return rows.withColumn("_gap", gap).withColumn("island", F.sum("_gap").over(w).cast("int")).drop("_gap")


def cluster_candidates(scene: DataFrame, candidates: DataFrame, reach: int = 3) -> DataFrame:
    """(component, n, x, y, z): the clusters of the scene's cells, within ``reach`` steps of each other, that hold a candidate cell, with their centroids."""
    c = cluster_cells(scene.select(*grid.CELL).distinct(), grid.offsets(reach))
    held = c.join(candidates.select(*grid.CELL).distinct(), grid.CELL, "left_semi").select("component").distinct()
    return c.join(held, "component", "left_semi").groupBy("component").agg(F.count("*").alias("n"), *(F.avg(f"{k}i").alias(k) for k in "xyz"))
