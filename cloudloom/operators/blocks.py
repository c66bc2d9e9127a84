"""All pairs of two sets of feature vectors, block against block.

Vectors go to Python packed, some hundred a row.  Both sides are dealt in blocks
of at most ``BLOCK`` vectors, and each block of the left meets each of the right
in one task, by matrix products.  These only choose: a distance that can decide
is computed again as the sum over the dimensions in their order.  Where the
copies of the blocks would take much disk, the left goes in several passes.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from cloudloom.functions.tables import discard, materialize

#: Vectors in a pack, in a block; entries of a table of distances; pairs computed again at once; cells for tables of more than a few pairs; copies of a side, in rows of the larger side.
PACK, BLOCK, TILE, AGAIN, CELLS, COPIES = 1024, 32_768, 2_000_000, 32_768, 16, 4
_DOUBLE, _LONG = DoubleType(), LongType()


class Vectors:
    """Vectors in one matrix, and the columns that belong to them.  Rows that aren't whole (nulls, no finite values, another length) are ``odd``: null is NaN in ``x`` and False in ``there``."""

    def __init__(self, columns: pa.Table, x: np.ndarray, there: np.ndarray | None = None):
        self.columns, self.x, self.there = columns, x, there

    def __len__(self) -> int:
        return len(self.x)

    def take(self, at: np.ndarray) -> Vectors:
        return Vectors(self.columns.take(pa.array(at)), self.x[at], None if self.there is None else self.there[at])


def _whole(lists: pa.Array) -> tuple[np.ndarray, int]:
    """Which lists have the commonest length and only finite values that can be squared, and that length."""
    n = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False)
    if not (n > 0).any():
        return np.zeros(len(n), bool), 0
    d = int(np.bincount(n[n > 0]).argmax())
    good = n == d
    x = lists.filter(pa.array(good)).flatten().cast(pa.float64())
    fit = np.abs(np.nan_to_num(x.to_numpy(zero_copy_only=False), nan=np.inf)).reshape(-1, d).max(1) < 1e100
    good[good] = fit
    return good, d


def _packed(columns: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = TaskContext.get().partitionId()
        for b in batches:
            t = pa.Table.from_batches([b])
            lists = t["features"].combine_chunks()
            lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
            good, d = _whole(lists)
            out = defaultdict(list)
            for whole in (True, False):
                for part in np.split(found := np.flatnonzero(good == whole), range(PACK, len(found), PACK)):
                    if not len(part):
                        continue
                    rows, matrix = t.select(columns).take(pa.array(part)), b""
                    if whole:
                        x = lists.take(pa.array(part)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
                        small = x.astype(np.float32)
                        matrix = small.tobytes() if (small == x).all() else x.tobytes()
                    else:
                        rows = rows.append_column("features", lists.take(pa.array(part)).cast(pa.list_(pa.float64())))
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, rows.schema) as w:
                        w.write_table(rows)
                    out["at"].append(at)
                    out["n"].append(len(part))
                    out["d"].append(d if whole else 0)
                    out["rows"].append(sink.getvalue().to_pybytes())
                    out["x"].append(matrix)
                    at += 1
            if out:
                yield pa.RecordBatch.from_pydict(dict(out), schema=pa.schema([("at", pa.int64()), ("n", pa.int64()), ("d", pa.int32()), ("rows", pa.binary()), ("x", pa.binary())]))

    return pack


def _packs(df: DataFrame, columns: list[str]) -> DataFrame:
    return materialize(df.select(*columns, "features").mapInArrow(_packed(columns), "at long, n long, d int, rows binary, x binary"), "packs")


def _unpacked(packs: list[dict]) -> tuple[Vectors | None, Vectors | None]:
    """Whole vectors and odd ones; whole ones of a rarer length are odd."""
    whole, lists = defaultdict(list), []
    for p in packs:
        rows = pa.ipc.open_stream(p["rows"]).read_all()
        if not p["d"]:
            lists.append(rows)
            continue
        x = np.frombuffer(p["x"], np.float32 if len(p["x"]) == 4 * p["n"] * p["d"] else np.float64).reshape(p["n"], p["d"])
        whole[p["d"]].append((rows, x.astype(np.float64)))
    most = max(whole, key=lambda d: (sum(len(x) for _, x in whole[d]), d), default=0)
    for d, parts in whole.items():
        if d != most:
            lists += [r.append_column("features", pa.array(x.tolist(), pa.list_(pa.float64()))) for r, x in parts]
    clean = Vectors(pa.concat_tables([r for r, _ in whole[most]]), np.concatenate([x for _, x in whole[most]])) if most else None
    if not lists:
        return clean, None
    t = pa.concat_tables(lists)
    values = [v or [] for v in t["features"].to_pylist()]
    x = np.full((len(values), max(most, *map(len, values), 1)), np.nan)
    there = np.zeros(x.shape, bool)
    for k, v in enumerate(values):
        there[k, : len(v)] = [a is not None for a in v]
        x[k, : len(v)] = [np.nan if a is None else a for a in v]
    return clean, Vectors(t.drop_columns(["features"]), x, there)


def _wide(v: Vectors, d: int) -> tuple[np.ndarray, np.ndarray]:
    there = np.ones(v.x.shape, bool) if v.there is None else v.there
    more = ((0, 0), (0, d - v.x.shape[1]))
    return np.pad(v.x, more, constant_values=np.nan), np.pad(there, more)


def _again(a: Vectors, b: Vectors, i: np.ndarray, k: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Distances of the pairs, summed in the dimensions' order over those that both have, and which pairs have any."""
    dist, any_ = np.empty(len(i)), np.ones(len(i), bool)
    odd = a.there is not None or b.there is not None
    if odd:
        d = max(a.x.shape[1], b.x.shape[1])
        (ax, am), (bx, bm) = _wide(a, d), _wide(b, d)
    else:
        ax, bx = a.x, b.x
    for at in range(0, len(i), AGAIN):
        s = slice(at, at + AGAIN)
        with np.errstate(all="ignore"):
            t = ax[i[s]] - bx[k[s]]
            t = np.abs(t) if metric == "l1" else t * t
            if odd:
                both = am[i[s]] & bm[k[s]]
                t[~both] = 0.0
                any_[s] = both.any(1)
            total = np.zeros(len(t))
            for j in range(t.shape[1]):
                total += t[:, j]
        dist[s] = total
    return dist, any_


def _tiles(a: Vectors, b: Vectors, metric: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, distances of some rows of ``a`` to all of ``b``, what they may be off by at most, by row)."""
    if metric == "l1":
        rows, wide = 64, 2048
        bt, small = np.ascontiguousarray(b.x.T.astype(np.float32)), a.x.astype(np.float32)
        if not (np.isfinite(bt).all() and np.isfinite(small).all()):
            bt, small = np.ascontiguousarray(b.x.T), a.x
        unit = np.finfo(small.dtype).eps
        t = np.empty((rows, wide), small.dtype)
        slack = (np.abs(a.x).sum(1) + np.abs(b.x).sum(1).max()) * unit * (a.x.shape[1] + 8)
        for at in range(0, len(a), rows):
            c = small[at : at + rows]
            out = np.empty((len(c), len(b)), small.dtype)
            for lo in range(0, len(b), wide):
                total = np.zeros((len(c), min(wide, len(b) - lo)), small.dtype)
                u = t[: len(c), : total.shape[1]]
                for j in range(c.shape[1]):
                    np.subtract(bt[j, lo : lo + wide], c[:, j, None], out=u)
                    np.abs(u, out=u)
                    total += u
                out[:, lo : lo + wide] = total
            yield at, out, slack[at : at + rows]
        return
    na, nb = (a.x * a.x).sum(1), (b.x * b.x).sum(1)
    slack = (na + nb.max()) * np.finfo(float).eps * 4 * (a.x.shape[1] + 8)
    rows = max(1, TILE // len(b))
    bt = np.ascontiguousarray(b.x.T)
    for at in range(0, len(a), rows):
        out = a.x[at : at + rows] @ bt
        out *= -2.0
        out += nb
        out += na[at : at + rows, None]
        yield at, out, slack[at : at + rows]


# --- what a task does with its blocks; each yields (rows of a, rows of b, distance, has any) ----


def _codes(a: pa.ChunkedArray, b: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of values that are equal where the values are (nulls too)."""
    all_ = pa.chunked_array([*a.chunks, *b.chunks], a.type).combine_chunks()
    all_ = pa.concat_arrays(all_.chunks) if isinstance(all_, pa.ChunkedArray) else all_
    n = all_.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return n[: len(a)], n[len(a) :]


def _first_copies(b: Vectors, most: int, *also: np.ndarray) -> np.ndarray:
    """Places of the first ``most`` of rows with the same vector."""
    rows = np.ascontiguousarray(np.column_stack([b.x + 0.0, *also]))
    _, same = np.unique(rows.view(np.dtype((np.void, rows.shape[1] * 8)))[:, 0], return_inverse=True)
    order = np.argsort(same, kind="stable")
    first = np.r_[True, same[order][1:] != same[order][:-1]]
    rank = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    return np.sort(order[rank < most])


def _top(i, k, dist, any_, most: int) -> np.ndarray:
    """Places of the ``most`` first of each i, by distance (none at all last) and k."""
    order = np.lexsort((k, dist, ~any_, i))
    first = np.r_[True, i[order][1:] != i[order][:-1]] if len(order) else np.zeros(0, bool)
    rank = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0)) if len(order) else np.zeros(0, int)
    return order[rank < most]


def _nearest_of(a: Vectors, b: Vectors, most: int, metric: str, same: tuple[np.ndarray, np.ndarray] | None):
    """Pairs of each row of ``a`` with its nearest of ``b`` (ordered by id)."""
    if a.there is None and b.there is None and a.x.shape[1] == b.x.shape[1]:
        kept = _first_copies(b, most, *([same[1]] if same else []))  # copies with an id each, so that the own one can go
        if same:
            kept = _first_copies(b, most + 1) if len(np.unique(same[1])) == len(b) else kept
            order = np.argsort(same[1][kept], kind="stable")
            lo, hi = (np.searchsorted(same[1][kept][order], same[0], side) for side in ("left", "right"))
        near = b.take(kept)
        for at, d, slack in _tiles(a, near, metric):
            if same:
                for step in range(int((hi - lo)[at : at + len(d)].max(initial=0))):
                    own = np.flatnonzero(lo[at : at + len(d)] + step < hi[at : at + len(d)])
                    d[own, order[lo[at + own] + step]] = np.inf
            if most == 1:
                last = d.min(1)
            else:
                last = np.partition(d, most - 1, axis=1)[:, most - 1] if most <= d.shape[1] else d.max(1, where=np.isfinite(d), initial=0.0)
            i, k = np.nonzero((d <= (last + 2 * slack)[:, None]) & np.isfinite(d))
            dist, any_ = _again(a, near, i + at, k, metric)
            best = _top(i, k, dist, any_, most)
            yield i[best] + at, kept[k[best]], dist[best], any_[best]
        return
    rows = max(1, AGAIN * 8 // len(b))
    for at in range(0, len(a), rows):
        i, k = (x.ravel() for x in np.meshgrid(np.arange(at, min(at + rows, len(a))), np.arange(len(b)), indexing="ij"))
        if same:
            other = same[0][i] != same[1][k]
            i, k = i[other], k[other]
        dist, any_ = _again(a, b, i, k, metric)
        best = _top(i, k, dist, any_, most)
        yield i[best], k[best], dist[best], any_[best]


def _nearest_in(key: str, other: str, most: int, metric: str, skip: bool):
    def run(a: Vectors, b: Vectors) -> Iterator[pa.Table]:
        b = b.take(pc.sort_indices(b.columns[other]).to_numpy())
        same = _codes(a.columns[key], b.columns[other]) if skip else None
        for i, k, dist, any_ in _nearest_of(a, b, most, metric, same):
            rows = b.columns.take(pa.array(k))
            yield pa.table({"_lid": a.columns[key].take(pa.array(i)), "dist": pa.array(dist, mask=~any_), **{c: rows[c] for c in rows.column_names}})

    return run


def _labels(b: Vectors) -> tuple[np.ndarray, np.ndarray, pa.ChunkedArray]:
    """An order of the rows by label, where each label begins, and the labels."""
    codes = b.columns["label"].combine_chunks()
    codes = pa.concat_arrays(codes.chunks) if isinstance(codes, pa.ChunkedArray) else codes
    codes = codes.dictionary_encode(null_encoding="encode")
    n = codes.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(n, kind="stable")
    begins = np.flatnonzero(np.r_[True, n[order][1:] != n[order][:-1]])
    return order, begins, codes.dictionary.take(pa.array(n[order][begins]))


def _all_pairs(a: Vectors, b: Vectors) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, exact distances of some rows of ``a`` to all of ``b``, which have any), for rows that aren't whole."""
    rows = max(1, AGAIN * 8 // len(b))
    for at in range(0, len(a), rows):
        n = min(rows, len(a) - at)
        dist, any_ = _again(a, b, np.repeat(np.arange(at, at + n), len(b)), np.tile(np.arange(len(b)), n), "l2")
        yield at, dist.reshape(n, -1), any_.reshape(n, -1)


def _plain(a: Vectors, b: Vectors) -> bool:
    return a.there is None and b.there is None and a.x.shape[1] == b.x.shape[1]


def _by_label(key: str, labels: pa.Array, at: int, a: Vectors, values: np.ndarray, there: np.ndarray, name: str) -> pa.Table:
    i, j = np.nonzero(there)
    return pa.table({"_lid": a.columns[key].take(pa.array(i + at)), "label": labels.take(pa.array(j)), name: pa.array(values[i, j]), **{c: a.columns[c].take(pa.array(i + at)) for c in a.columns.column_names if c != key}})


def _counts_in(key: str, limit: float, skip: bool):
    def run(a: Vectors, b: Vectors) -> Iterator[pa.Table]:
        order, begins, labels = _labels(b)
        b = b.take(order)
        same = _codes(a.columns[key], b.columns["_rid"]) if skip else None
        plain = _plain(a, b)
        for at, d, x in _tiles(a, b, "l2") if plain else _all_pairs(a, b):
            near = d < limit
            if plain:
                i, k = np.nonzero(np.abs(d - limit) <= 2 * x[:, None])
                near[i, k] = _again(a, b, i + at, k, "l2")[0] < limit
            else:
                near &= x
            if same:
                own = same[0][at : at + len(d)]
                for code in np.unique(own[np.isin(own, same[1])]):
                    near[np.ix_(own == code, same[1] == code)] = False
            n = np.add.reduceat(near, begins, axis=1, dtype=np.int64)
            yield _by_label(key, labels, at, a, n, n > 0, "n")

    return run


def _least_in(key: str):
    def run(a: Vectors, b: Vectors) -> Iterator[pa.Table]:
        order, begins, labels = _labels(b)
        b = b.take(order)
        group = np.repeat(np.arange(len(begins)), np.diff(np.r_[begins, len(b)]))
        if plain := _plain(a, b):
            kept = _first_copies(b, 1, group.astype(float))
            b, group = b.take(kept), group[kept]
            begins = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        for at, d, x in _tiles(a, b, "l2") if plain else _all_pairs(a, b):
            if plain:
                least = np.minimum.reduceat(d, begins, axis=1)
                i, k = np.nonzero(d <= least[:, group] + 2 * x[:, None])
                out = np.full(least.shape, np.inf)
                np.minimum.at(out, (i, group[k]), _again(a, b, i + at, k, "l2")[0])
                there = np.ones(out.shape, bool)
            else:
                d = np.where(x, d, np.nan)
                out = np.fmin.reduceat(d, begins, axis=1)
                there = np.logical_or.reduceat(x, begins, axis=1)
            yield _by_label(key, labels, at, a, out, there, "d")

    return run


# --- dealing ------------------------------------------------------------------


def _met(left: DataFrame, right: DataFrame, a_columns: list[str], b_columns: list[str], schema: StructType, kernel) -> DataFrame:
    """What ``kernel`` yields of each block of ``left`` with each block of ``right`` (both with ``features`` and the named columns)."""
    a, b = _packs(left, a_columns), _packs(right, b_columns)
    na, nb = (p.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for p in (a, b))
    ka, kb = max(1, -(-na // BLOCK)), max(1, -(-nb // BLOCK))
    if na * nb > 10_000_000 and ka * kb < CELLS:
        wide = max(ka, min(CELLS // kb, round((CELLS * na / nb) ** 0.5)))
        ka, kb = wide, max(kb, -(-CELLS // wide))
    most = COPIES * max(na, nb, 1)
    together = max([n for n in range(1, ka + 1) if n * nb + n * na * kb / ka <= most], default=1)
    types = [f.name for f in schema]

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict = defaultdict(lambda: ([], []))
        for batch in batches:
            for row in batch.to_pylist():
                found[row["cell"]][row["side"]].append(row)
        for cell in sorted(found):
            sides = [_unpacked(x) for x in found.pop(cell)]
            for u in sides[0]:
                for v in sides[1]:
                    if u is not None and v is not None:
                        for t in kernel(u, v):
                            yield from t.select(types).combine_chunks().to_batches(max_chunksize=50_000)

    parts = []
    for first in range(0, ka, together):
        n = min(together, ka - first)
        place = F.pmod(F.col("at"), F.lit(ka)).cast("int")
        mine = a.where((place >= first) & (place < first + n)).withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0), F.lit(kb - 1)), lambda k: (place - first) * kb + k)))
        its = b.withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: k * kb + F.pmod(F.col("at"), F.lit(kb)).cast("int"))))
        both = mine.withColumn("side", F.lit(0)).unionByName(its.withColumn("side", F.lit(1)))
        dealt = both.repartitionById(n * kb, F.col("cell").cast("int"))
        parts.append(materialize(dealt.mapInArrow(cells, schema), "met"))
    discard(a)
    discard(b)
    return reduce(DataFrame.unionByName, parts)


def _field(df: DataFrame, column: str, name: str | None = None) -> StructField:
    return StructField(name or column, df.schema[column].dataType)


def nearest(left: DataFrame, right: DataFrame, most: int, metric: str, skip_self: bool) -> DataFrame:
    """(_lid, dist, _rid, label if the right has one): the ``most`` nearest of each block of ``right`` for the rows (_lid, features) of ``left``."""
    labels = ["label"] if "label" in right.columns else []
    if skip_self:
        left, right = left.where("_lid is not null"), right.where("_rid is not null")
    schema = StructType([_field(left, "_lid"), StructField("dist", _DOUBLE), _field(right, "_rid"), *(_field(right, c) for c in labels)])
    return _met(left, right, ["_lid"], ["_rid", *labels], schema, _nearest_in("_lid", "_rid", most, metric, skip_self))


def counts_under(left: DataFrame, right: DataFrame, limit: float, skip_self: bool) -> DataFrame:
    """(_lid, label, n): rows of ``right`` (_rid, label, features) at a squared distance under ``limit``, by label, for those of ``left``."""
    if skip_self:
        left, right = left.where("_lid is not null"), right.where("_rid is not null")
    schema = StructType([_field(left, "_lid"), _field(right, "label"), StructField("n", _LONG)])
    parts = _met(left, right, ["_lid"], ["_rid", "label"], schema, _counts_in("_lid", limit, skip_self))
    return parts.groupBy("_lid", "label").agg(F.sum("n").alias("n"))


def least_by_label(left: DataFrame, right: DataFrame, by: str) -> DataFrame:
    """(by, _lid, label, d): the least squared distance to a row of ``right`` (label, features) of each label."""
    schema = StructType([_field(left, by), _field(left, "_lid"), _field(right, "label"), StructField("d", _DOUBLE)])
    parts = _met(left, right, ["_lid", by], ["label"], schema, _least_in("_lid"))
    return parts.groupBy(by, "_lid", "label").agg(F.min("d").alias("d"))
