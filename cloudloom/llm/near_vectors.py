"""Near-duplicate vectors by cross-polytope hashing after fast Hadamard rotations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudloom.llm import kernels
from cloudloom.operators.graph import connected_components
from cloudloom.llm.storage import materialize, partitions

U64 = np.uint64
BLOCK = 2048  # members of a bucket that are compared at once


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row; the number of columns is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x


def polytope_keys(x: np.ndarray, tables: int, seed: int = 7) -> np.ndarray:
    """Keys of each unit vector, ``3 * tables`` a row: in each table the two nearest polytope corners under two rotations, and the two buckets with the second nearest corner under one of them."""
    n, dim = x.shape
    d = 1 << max(dim - 1, 1).bit_length()
    padded = np.zeros((n, d))
    padded[:, :dim] = x
    rng = np.random.default_rng(seed)
    out = np.empty((n, 3 * tables), U64)
    rows = np.arange(n)
    for t in range(tables):
        best = []
        for _ in range(2):
            y = padded
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], d))
            size = np.abs(y)
            one = size.argmax(1)
            size[rows, one] = -1
            two = size.argmax(1)
            best.append([(2 * c + (y[rows, c] > 0)).astype(U64) for c in (one, two)])
        for k, (a, b) in enumerate(((0, 0), (1, 0), (0, 1))):
            out[:, 3 * t + k] = (U64(t) * U64(2 * d) + best[0][a]) * U64(2 * d) + best[1][b]
    return out


def _hash(batches, tables: int):
    for batch in batches:
        lists = batch.column("vec")
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
        flat, at = lists.flatten().to_numpy(zero_copy_only=False).astype(float), np.append(0, np.cumsum(sizes))
        label = batch.column("label").to_numpy(zero_copy_only=False).astype(np.int64)
        keys: list = [None] * batch.num_rows
        for dim in np.unique(sizes):
            rows = np.flatnonzero(sizes == dim)
            x = flat[at[rows][:, None] + np.arange(dim)]
            x = x / np.abs(x).max(1, keepdims=True)
            x = x / np.sqrt((x * x).sum(1, keepdims=True))
            k = kernels.mix(polytope_keys(x, tables) ^ kernels.mix(label[rows].view(U64) * U64(1024) + U64(dim))[:, None])
            for r, own in zip(rows, np.sort(k.view(np.int64), axis=1), strict=True):
                keys[r] = np.unique(own)
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("cid", "rep", "n", "label", "vec")), pa.array(keys, pa.list_(pa.int64()))], names=["cid", "rep", "n", "label", "vec", "keys"])


def _unit(lists: pa.Array, rows: slice) -> np.ndarray:
    """Vectors of one length, in double precision and of length 1."""
    x = np.stack([lists[r].values.to_numpy() for r in range(rows.start, rows.stop)]).astype(float)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _compare(batches, least: float):
    """In each pair of blocks of a bucket: how many vectors each one links with, and links that join what all links join.  A pair counts in the first bucket that it shares: where its two have no earlier key in common."""
    for table in kernels.groups_in(batches, ["key", "p", "q"]):
        key, own, p, q, cid, n = (table.column(k).to_numpy() for k in ("key", "own", "p", "q", "cid", "n"))
        vec, earlier = table.column("vec").combine_chunks(), table.column("earlier").combine_chunks()
        begins = kernels.runs(table, ["key", "p", "q"])
        for s, e in zip(begins[:-1], begins[1:], strict=True):
            left, right = np.flatnonzero(own[s:e] == p[s]), np.flatnonzero(own[s:e] == q[s])
            if e - s < 2 or not len(left) or not len(right):
                continue
            x = _unit(vec, slice(s, e))
            before = [earlier[r].values.to_numpy() for r in range(s, e)]
            width = max(map(len, before))
            k, real = np.zeros((e - s, width), np.int64), np.zeros((e - s, width), bool)
            for r, values in enumerate(before):
                k[r, : len(values)], real[r, : len(values)] = values, True
            i, j = np.nonzero(x[left] @ x[right].T >= least)
            i, j = left[i], right[j]
            if p[s] == q[s]:
                i, j = i[i < j], j[i < j]
            here = []
            for y in range(0, len(i), 20_000):
                a, b = i[y : y + 20_000], j[y : y + 20_000]
                here.append(~((k[a][:, :, None] == k[b][:, None, :]) & real[a][:, :, None] & real[b][:, None, :]).any((1, 2)))
            if not here:
                continue
            here = np.concatenate(here)
            i, j = i[here], j[here]
            if not len(i):
                continue
            size, ids = n[s:e], cid[s:e]
            links = np.bincount(i, size[j], e - s) + np.bincount(j, size[i], e - s)
            t = kernels.forest(e - s, i, j)
            some = np.flatnonzero(links)
            u = np.concatenate([ids[some], ids[i[t]]])
            v = pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(ids[j[t]])])
            yield pa.RecordBatch.from_arrays([pa.array(u), v, pa.array(np.concatenate([links[some].astype(np.int64), np.zeros(len(t), np.int64)]))], names=["u", "v", "links"])


def near_duplicate_vectors(rows: DataFrame, least: float = 0.98, tables: int = 10) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``rows`` (vec_id, embedding, label; other columns are ignored).

    Vectors with one label (not null) are linked if their cosine in double
    precision is ``least`` or more; component_id is the least vec_id that links
    reach.  Candidates share a bucket of one of ``tables`` tables: the nearest
    corners of the cross-polytope under two pseudo-random rotations, with two
    more buckets probed.  Each pair is verified, and none below ``least`` is
    linked.  Pairs can be missed; recall is measured in the tests.

    Equal vectors of a label are one class, grouped by the vectors themselves,
    and take one place in a bucket.  Buckets are compared in blocks of bounded
    size; a pair counts in the first bucket that it shares, so links needn't be
    gathered to be counted once.  What a bucket holds of a vector is the vector
    as the table has it (floats stay floats) and its keys before the bucket's.

    Vectors that are null, empty, zero or hold a null or non-finite component,
    or have no label, link with nothing and are their own component.  Vectors
    of different lengths don't link.  Repeated rows link with one another.  A
    row with a null vec_id may connect others and is never kept.  An empty
    table gives an empty result.
    """
    spark = rows.sparkSession
    e = F.col("e")
    valid = F.col("label").isNotNull() & e.isNotNull() & (F.size("e") > 0) & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("e", lambda x: x != 0)
    given = rows.schema["embedding"].dataType.simpleString()
    kind = given if given in ("array<float>", "array<double>") else "array<double>"
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("e"), F.col("label").cast("long").alias("label"))
    named = rows.select("vec_id", "label", F.when(F.coalesce(valid, F.lit(False)), e).alias("vec"))
    classes = named.where("vec is not null").groupBy("label", "vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    classes = classes.select(F.monotonically_increasing_id().alias("cid"), "rep", "n", "label", "vec")  # written at once, so a class keeps its number
    hashed = materialize(classes.mapInArrow(lambda it: _hash(it, tables), f"cid long, rep long, n long, label long, vec {kind}, keys array<long>"), "vectors")

    posted = hashed.select("cid", F.explode("keys").alias("key"))
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    several = posted.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key", blocks.alias("k"))
    own = F.pmod(F.xxhash64("cid", "key"), F.col("k")).cast("int")
    spread = posted.join(several, "key").select("key", "cid", "k", own.alias("own")).join(hashed.select("cid", "n", "vec", "keys"), "cid")
    spread = spread.select("key", "cid", "k", "own", "n", "vec", F.filter("keys", lambda x: x < F.col("key")).alias("earlier"))
    dealt = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).withColumns({"p": F.least("own", "other"), "q": F.greatest("own", "other")}).drop("other", "k")
    dealt = dealt.repartition(partitions(spark), "key", "p", "q").sortWithinPartitions("key", "p", "q")
    found = materialize(dealt.mapInArrow(lambda it: _compare(it, least), "u long, v long, links long"), "links")

    comps = connected_components(found.where("v is not null").select("u", "v"))
    links = found.where("v is null").groupBy("u").agg(F.sum("links").alias("links"))
    rooted = hashed.select("cid", "rep", "n", "label", "vec").join(comps, F.col("cid") == F.col("node"), "left").select("cid", "rep", "n", "label", "vec", F.coalesce("component", "cid").alias("root"))
    least_id = rooted.groupBy("root").agg(F.min("rep").alias("component"))
    about = rooted.join(least_id, "root").join(links, F.col("cid") == F.col("u"), "left").select("label", "vec", "component", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    unlinked = named.where("vec is null").select("vec_id", "vec", F.lit(None).cast("long").alias("component"), F.lit(0).cast("long").alias("n_links"))
    out = named.where("vec is not null").join(about, ["label", "vec"], "left").select("vec_id", "vec", "component", "n_links").unionByName(unlinked)
    component = F.when(F.col("vec").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
