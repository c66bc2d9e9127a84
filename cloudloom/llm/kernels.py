"""Vectorised kernels on the UTF-8 bytes of many texts at once."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
PIECE = 1 << 20
_ODD = U64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def tidily(batches: Iterator) -> Iterator:
    """The batches; after the last one, what the allocators of a Python worker still hold goes back to the machine."""
    yield from batches
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit (splitmix64)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.ones(max(n, 1), U64)
    size = 1
    while size < n:
        more = min(size, n - size)
        out[size : size + more] = out[:more] * U64(pow(base, size, 1 << 64))
        size += more
    return out


def text_slices(column: pa.Array, most: int = 4 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about ``most`` bytes: first row, last row (exclusive), their bytes, row offsets into them.  A null text is an empty one."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, n + 1 + column.offset)[column.offset :]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1)
        yield i, j, raw[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def _cuts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The rows' offsets, and in rows of over ``PIECE`` bytes also places after white space, about so far apart."""
    more = []
    for r in np.flatnonzero(np.diff(at) > PIECE):
        s = int(at[r])
        while s + PIECE < at[r + 1]:
            blank = np.flatnonzero(_SPACE[data[s + PIECE // 2 : s + PIECE]])
            s = s + PIECE // 2 + int(blank[-1]) + 1 if len(blank) else s + PIECE
            if len(blank):
                more.append(s)
    return np.unique(np.concatenate([at, np.array(more, np.int64)]))


def pieces(column: pa.Array, most: int, overlap: int):
    """As ``text_slices``, but a longer text comes in pieces that share ``overlap`` bytes with the next: first row, last row, bytes, offsets, how many bytes are the piece's own, whether the row goes on."""
    for i, j, data, at in text_slices(column, most):
        if len(data) <= 2 * most:
            yield i, j, data, at, len(data), False
            continue
        for s in range(0, len(data), most):
            part = data[s : s + most + overlap]
            yield i, j, part, np.array([0, len(part)]), min(most, len(data) - s), s + most < len(data)


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, and for each row where its words begin (one more entry at the end)."""
    if len(data) > PIECE:  # by and by, to hold little
        cuts = _cuts(data, at)
        if len(cuts) > 2:
            found, starts, i = [], [], 0
            while i < len(cuts) - 1:
                j = max(i + 1, int(np.searchsorted(cuts, cuts[i] + PIECE, side="right")) - 1)
                h, b = words(data[cuts[i] : cuts[j]], cuts[i : j + 1] - cuts[i])
                found.append(h)
                starts.append(np.diff(b))
                i = j
            total = np.append(0, np.cumsum(np.concatenate(starts)))
            return np.concatenate(found), total[np.searchsorted(cuts, at)]
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = at[:-1][at[:-1] < at[1:]]  # a row's first byte begins a word even if the row before ends in one
    begins[first] = inside[first]
    kept = np.flatnonzero(inside)
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, U64), np.zeros(len(at), np.int64)
    pos = np.searchsorted(kept, starts)
    lengths = np.diff(np.append(pos, len(kept)))
    within = np.arange(len(kept)) - np.repeat(pos, lengths)
    p = powers(0x100000001B3, int(lengths.max()))
    hashed = np.add.reduceat((_LOWER[data[kept]].astype(U64) + U64(1)) * p[within], pos)
    return mix(hashed ^ (lengths.astype(U64) * _ODD)), np.searchsorted(starts, at)


def shingles(hashes: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of ``width`` words in a row, sorted within each row; a row of fewer words has one for all its words, a row without words none."""
    counts = np.diff(at)
    rows = len(counts)
    out: list[np.ndarray] = []
    owner: list[np.ndarray] = []
    row = np.repeat(np.arange(rows), counts)
    if len(hashes) >= width:
        m = powers(0x9E3779B97F4A7C15 | 1, width)
        n = len(hashes) - width + 1
        total = np.zeros(n, U64)
        for k in range(width):
            total += hashes[k : k + n] * m[k]
        whole = row[:n] == row[width - 1 :]
        out.append(mix(total[whole]))
        owner.append(row[:n][whole])
    for r in np.flatnonzero((counts > 0) & (counts < width)):
        own = hashes[at[r] : at[r + 1]]
        out.append(mix(np.array([(own * powers(0x9E3779B97F4A7C15 | 1, len(own))).sum() + U64(len(own))], U64)))
        owner.append(np.array([r]))
    if not out:
        return np.zeros(0, U64), np.zeros(rows + 1, np.int64)
    h, o = np.concatenate(out), np.concatenate(owner)
    order = np.lexsort((h, o))
    h, o = h[order], o[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    h, o = h[new], o[new]
    return h, np.searchsorted(o, np.arange(rows + 1))


def crc32_text(ids) -> np.ndarray:
    """crc32 of each id written as text."""
    from zlib import crc32

    return np.fromiter((crc32(str(i).encode()) for i in ids), np.int64)


def groups_in(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole groups of rows that are sorted by ``keys``, across batch borders; each yielded table holds one or more whole groups."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        end = tuple(c[-1] for c in cols)
        same = np.ones(batch.num_rows, bool)
        for c in cols:
            same &= c == c[-1]
        cut = int(batch.num_rows - same.sum())  # sorted, so the last group is the tail
        if last is not None and (cut > 0 or end != last):
            begins = tuple(c[0] for c in cols)
            if begins != last:
                if held:
                    yield pa.Table.from_batches(held)
                    held = []
            if cut > 0:
                yield pa.Table.from_batches([*held, batch.slice(0, cut)])
                held = []
        elif cut > 0:
            yield pa.Table.from_batches([batch.slice(0, cut)])
        held.append(batch.slice(cut))
        last = end
    if held:
        yield pa.Table.from_batches(held)


def runs(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where the groups of equal ``keys`` begin, and the number of rows at the end."""
    n = table.num_rows
    new = np.zeros(n, bool)
    new[:1] = True
    for k in keys:
        c = table.column(k).to_numpy()
        new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), n)


def union(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node of each node's component, for nodes 0..n-1 and edges a-b."""
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        low = np.minimum(ra, rb)
        before = root.copy()
        np.minimum.at(root, ra, low)
        np.minimum.at(root, rb, low)
        root = root[root]
        while (root != root[root]).any():
            root = root[root]
        if (root == before).all():
            return root


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of edges that join nodes 0..n-1 as all edges do; of several choices the earlier edge."""
    root, taken = np.arange(n), []
    open_ = np.arange(len(a))
    while True:
        ra, rb = root[a[open_]], root[b[open_]]
        differ = ra != rb
        open_, high = open_[differ], np.maximum(ra, rb)[differ]
        if not len(open_):
            return np.concatenate(taken) if taken else open_
        first = np.unique(high, return_index=True)[1]
        taken.append(open_[first])
        root = union(n, np.concatenate([np.arange(n), a[open_[first]]]), np.concatenate([root, b[open_[first]]]))
