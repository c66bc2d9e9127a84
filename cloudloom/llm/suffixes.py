"""Removal of repeated byte strings by a suffix sort that compares hashes."""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from cloudloom.llm import kernels
from cloudloom.llm.storage import discard, materialize, partitions, short_batches

U64 = np.uint64
BASE = 0x5851F42D4C957F2D
GRAM = 24  # bytes of the string that windows are dealt by
LAST = 2**63 - 1
HOT = 4096  # windows of a group beyond which it is split
SLICE = 1 << 20  # bytes of text that are worked on at once
BUCKET = 32 << 20  # bytes of text for which there is one more bucket
SAMPLE = 64  # one of so many documents tells which grams are very frequent
CHUNK = 32 << 10  # bytes of a text that equal runs are checked with at once
SORT, DONE, FULL, WANTED = range(4)


def _rolling(data: np.ndarray, *lengths: int) -> list[np.ndarray]:
    """Polynomial hashes modulo 2**64 of all strings of each length; entries that would pass the end are left out."""
    out = [(np.zeros(len(data), U64), 0) for _ in lengths]
    h, size = data.astype(U64) + U64(1), 1
    while size <= max(lengths):
        for k, n in enumerate(lengths):
            if n & size:
                total, at = out[k]
                m = max(len(h) - at, 0)
                out[k] = total[:m] * U64(pow(BASE, size, 1 << 64)) + h[at : at + m], at + size
        h = h[:-size] * U64(pow(BASE, size, 1 << 64)) + h[size:] if len(h) > size else h[:0]
        size *= 2
    return [total for total, _ in out]


def _anchored(data: np.ndarray, at: np.ndarray, length: int):
    """Runs of windows of ``length`` bytes that share the gram of least hash: first window, number of windows, place of the gram, hash of the gram, hash of all windows."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none.view(U64), none.view(U64)
    valid = np.zeros(len(data), bool)
    for s, e in zip(at[:-1], at[1:], strict=True):
        if e - s >= length:
            valid[s : e - length + 1] = True
    gram, whole = _rolling(data, GRAM, length)
    gram = kernels.mix(gram)
    wide = length - GRAM + 1
    key = (gram & ~U64(0xFFFFFF)) | np.arange(len(gram), dtype=U64)
    pad = -len(key) % wide
    block = np.append(key, np.full(pad, ~U64(0))).reshape(-1, wide)
    before = np.minimum.accumulate(block, axis=1).reshape(-1)
    after = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    n = len(whole)
    place = (np.minimum(after[:n], before[wide - 1 : wide - 1 + n]) & U64(0xFFFFFF)).astype(np.int64)
    valid = valid[:n]
    begins = valid.copy()
    begins[1:] &= ~valid[:-1] | (place[1:] != place[:-1])
    windows = np.flatnonzero(valid)
    starts = np.flatnonzero(begins)
    if not len(starts):
        return none, none, none, none.view(U64), none.view(U64)
    pos = np.searchsorted(windows, starts)
    count = np.diff(np.append(pos, len(windows)))
    within = np.arange(len(windows)) - np.repeat(pos, count)
    content = np.add.reduceat(kernels.mix(whole[windows]) * kernels.powers(BASE | 1, wide)[within], pos)
    return starts, count, place[starts], gram[place[starts]], kernels.mix(content + count.astype(U64))


_FIELDS = [("anchor", "<u8"), ("content", "<u8"), ("did", "<i8"), ("tie", "<i8"), ("start", "<i8"), ("count", "<u1"), ("off", "<u1"), ("kind", "<u1")]
_PLACE = ("did", "tie", "start")


def _pieces(column: pa.Array, length: int, most: int):
    """Slices of texts; a longer text comes in pieces whose windows don't overlap: first row, bytes, offsets, first byte in the text."""
    for i, _, data, at in kernels.text_slices(column, most):
        if len(data) <= most + length:
            yield i, data, at, 0
        else:
            for s in range(0, len(data) - length + 1, most):
                part = data[s : s + most + length - 1]
                yield i, part, np.array([0, len(part)]), s


def _anchors(batches, length: int, most: int):
    """How many runs of a slice have a gram, for those that have several."""
    for batch in batches:
        for _, data, at, _ in _pieces(batch.column("text"), length, most):
            anchor, n = np.unique(_anchored(data, at, length)[3], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(n)], names=["anchor", "n"])


def _equal(data: np.ndarray, x: np.ndarray, y: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether strings of ``data`` are equal, byte by byte."""
    out = np.ones(len(x), bool)
    step = max((1 << 20) // int(size.max(initial=1)), 1)
    for s in range(0, len(x), step):
        span = np.minimum(np.arange(size[s : s + step].max()), size[s : s + step, None] - 1)
        out[s : s + step] = (data[x[s : s + step, None] + span] == data[y[s : s + step, None] + span]).all(1)
    return out


def _leads(f: dict[str, np.ndarray]):
    """For runs sorted by gram, content and place: which are the first of their content, the first one of each, and which are that same run."""
    first = np.append(True, (f["anchor"][1:] != f["anchor"][:-1]) | (f["content"][1:] != f["content"][:-1]))[: len(f["anchor"])]
    lead = np.flatnonzero(first)[np.cumsum(first) - 1]
    return first, lead, np.logical_and.reduce([f[k] == f[k][lead] for k in _PLACE])


def _deal(batches, length: int, buckets: int, hot: np.ndarray, bits: int, most: int):
    """Runs of windows by the hash of their gram, packed; a run that repeats an earlier one of the same slice, byte for byte, is done."""
    press = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        did_all, tie_all = (batch.column(k).to_numpy() for k in ("did", "tie"))
        for i, data, at, base in _pieces(batch.column("text"), length, most):
            start, count, place, anchor, content = _anchored(data, at, length)
            if not len(start):
                continue
            row = np.searchsorted(at, start, side="right") - 1
            f = {"anchor": anchor, "content": content >> U64(64 - bits), "did": did_all[i + row], "tie": tie_all[i + row], "start": start - at[row] + base, "count": count, "off": place - start, "pos": start}
            order = np.lexsort((f["start"], f["tie"], f["did"], f["content"], anchor))
            f = {k: v[order] for k, v in f.items()}
            first, lead, own = _leads(f)
            bucket = (np.where(np.isin(f["anchor"], hot), kernels.mix(f["anchor"] ^ kernels.mix(f["content"])), f["anchor"]) % U64(buckets)).astype(np.int64)
            f["kind"] = np.full(len(first), FULL)
            again = np.flatnonzero(~own)
            same = _equal(data, f["pos"][again], f["pos"][lead[again]], f["count"][again] + length - 1) & (f["count"][again] == f["count"][lead[again]])
            f["kind"][again] = np.where(same, DONE, SORT)
            clash = lead[again[~same]]  # another string with the same hash: both are sorted
            kept = np.append(np.flatnonzero(first | ~own), clash)
            f = {k: v[kept] for k, v in f.items()}
            if len(clash):
                f["kind"][-len(clash) :] = SORT
            bucket = bucket[kept]
            order = np.lexsort((f["start"], f["tie"], f["did"], bucket))
            bucket = bucket[order]
            cuts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
            blobs = []
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                o = order[s:e]
                open_ = f["kind"][o] == FULL
                parts = [np.where(open_, f[k][o], 0).astype(t) if k in ("anchor", "content") else f[k][o].astype(t) for k, t in _FIELDS]
                for p in parts[2:5]:
                    p[1:] = np.diff(p)
                blobs.append(press.compress(b"".join(x.tobytes() for x in parts)))
            yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]].astype(np.int32)), pa.array(blobs, pa.binary())], names=["bucket", "blob"])


def _unpack(blobs) -> dict[str, np.ndarray]:
    press = zstandard.ZstdDecompressor()
    found = []
    width = sum(np.dtype(t).itemsize for _, t in _FIELDS)
    for b in blobs:
        raw = press.decompress(b)
        n, at, one = len(raw) // width, 0, {}
        for k, t in _FIELDS:
            one[k] = np.frombuffer(raw, t, n, at)
            at += n * np.dtype(t).itemsize
            if k in _PLACE:
                one[k] = np.cumsum(one[k])
        found.append(one)
    return {k: np.concatenate([x[k] for x in found]) for k, _ in _FIELDS}


_RUN = ["kind", "did", "tie", "start", "count", "off", "ldid", "ltie", "lstart", "lcount", "loff"]


def _runs_of(kind: int, f: dict[str, np.ndarray], where: np.ndarray, lead: np.ndarray):
    for s in range(0, len(where), 1 << 17):
        w, l = where[s : s + (1 << 17)], lead[s : s + (1 << 17)]
        columns = [np.full(len(w), kind, np.int32), *(f[k][w].astype(np.int64) for k in _RUN[1:6]), *(f[k][l].astype(np.int64) for k in (*_PLACE, "count", "off"))]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=_RUN)


def _meet(batches, hot: np.ndarray, most: int):
    """In each bucket: runs that repeat an earlier one by their hash (full, with that one); the first ones of different runs with the same gram are to be sorted.  What is held is a run for each content."""
    for table in kernels.groups_in(batches, ["bucket"]):
        for rows in np.split(np.arange(table.num_rows), kernels.runs(table, ["bucket"])[1:-1]):
            held: dict[str, np.ndarray] = {}
            sizes = np.cumsum([len(b.as_buffer()) for b in table.column("blob").take(pa.array(rows))])
            for part in np.split(rows, np.flatnonzero(np.diff(sizes // most)) + 1):
                f = _unpack([table.column("blob")[int(r)].as_py() for r in part])
                for kind in (DONE, SORT):
                    w = np.flatnonzero(f["kind"] == kind)
                    yield from _runs_of(kind, f, w, w)
                open_ = f["kind"] == FULL
                f = {k: np.concatenate([held[k], v[open_]]) if held else v[open_] for k, v in f.items()}
                order = np.lexsort((f["start"], f["tie"], f["did"], f["content"], f["anchor"]))
                f = {k: v[order] for k, v in f.items()}
                first, lead, own = _leads(f)
                w = np.flatnonzero(~own)
                yield from _runs_of(FULL, f, w, lead[w])
                held = {k: v[first] for k, v in f.items()}
            group = np.cumsum(np.append(True, held["anchor"][1:] != held["anchor"][:-1])[: len(held["anchor"])]) - 1
            several = (np.bincount(group)[group] > 1) | np.isin(held["anchor"], hot) if len(group) else np.zeros(0, bool)
            w = np.flatnonzero(several)
            yield from _runs_of(SORT, held, w, w)


_STRING = ["kind", "key", "did", "tie", "start", "count", "off", "ldid", "ltie", "lstart", "bytes"]


def _cut(batches, length: int):
    """Bytes of runs: those to be sorted, each in two parts (windows with half of the rest left of the gram, and the others); those to be checked, joined with neighbours that repeat the same text and cut where its chunks end; and chunks that others are checked with."""
    half = (length - GRAM) // 2
    for batch in batches:
        lists = batch.column("todo")
        at = np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))
        flat = lists.flatten()
        f = {k: flat.field(k).to_numpy(zero_copy_only=False) for k in (*_RUN[:1], *_RUN[3:9])}
        out: list[tuple] = []
        size = 0
        for r in range(batch.num_rows):
            raw = batch.column("text")[r].as_py().encode()
            ids = batch.column("did")[r].as_py(), batch.column("tie")[r].as_py()
            x = {k: v[at[r] : at[r + 1]] for k, v in f.items()}
            w = np.flatnonzero(x["kind"] == SORT)
            for s, n, off in zip(x["start"][w].tolist(), x["count"][w].tolist(), x["off"][w].tolist(), strict=True):
                place = s + off
                mid = min(max(place - half + 1 - s, 0), n)  # windows before have `half` bytes or more to the left
                for a, m, named, side in ((s, mid, raw[place - half : place + GRAM], 1), (s + mid, n - mid, raw[place : place + GRAM + half], 2)):
                    if m:
                        out.append((SORT, xxh3_64_intdigest(named, side) - 2**63, *ids, a, m, place - a, 0, 0, 0, raw[a : a + m - 1 + length]))
            for c in x["start"][x["kind"] == WANTED].tolist():
                out.append((WANTED, c, *ids, 0, 0, 0, 0, 0, 0, raw[c * CHUNK : (c + 1) * CHUNK]))
            w = np.flatnonzero(x["kind"] == FULL)
            if len(w):
                ld, lt, ls, s = (x[k][w] for k in ("ldid", "ltie", "lstart", "start"))
                e = s + x["count"][w] - 1 + length
                o = np.lexsort((s, ls - s, lt, ld))
                ld, lt, ls, s, e = (v[o] for v in (ld, lt, ls, s, e))
                new = np.append(True, (ld[1:] != ld[:-1]) | (lt[1:] != lt[:-1]) | ((ls - s)[1:] != (ls - s)[:-1]) | (s[1:] > e[:-1]))
                b = np.flatnonzero(new)
                last = np.append(b[1:], len(s)) - 1  # runs of one text and shift end in the order in which they start
                for d, t, a, z, l in zip(ld[b].tolist(), lt[b].tolist(), s[b].tolist(), e[last].tolist(), ls[b].tolist(), strict=True):
                    while a < z:
                        c = l // CHUNK
                        m = min(z - a, (c + 1) * CHUNK - l)
                        out.append((FULL, c, *ids, a, 0, 0, d, t, l, raw[a : a + m]))
                        a, l = a + m, l + m
            size += len(raw)
            if out and (size > 2 * SLICE or r == batch.num_rows - 1):
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[1:-1]), pa.array(columns[-1], pa.binary())], names=_STRING)
                out, size = [], 0


def suffix_sort(data: np.ndarray, where: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Stable sort of the suffixes ``where`` of ``data`` within each group (equal values stand together), by their first ``length`` bytes.

    Returns the order, and for each place in it whether the suffix equals the
    one before.  Prefix polynomial hashes give the hash of any substring;
    two suffixes are compared by a binary search for the length of their
    common extension and one byte after it, so a comparison takes
    O(log length).  Merges run bottom-up, in all groups at once: an element's
    place is its own rank plus its rank in the sibling run.  Equal hashes at
    the end are checked on the bytes; a difference raises.
    """
    prefix = np.zeros(len(data) + 1, U64)
    up = kernels.powers(BASE, len(data) + 1)
    down = kernels.powers(pow(BASE, -1, 1 << 64), len(data) + 1)
    np.cumsum((data.astype(U64) + U64(1)) * down[: len(data)], out=prefix[1:])

    def string(at, n):
        return (prefix[at + n] - prefix[at]) * up[at]

    def extension(a, b):
        n = np.zeros(len(a), np.int64)
        step = 1 << (length.bit_length() - 1)
        while step:
            fits = n + step <= length
            m = np.where(fits, step, 0)
            n += np.where(fits & (string(a + n, m) == string(b + n, m)), step, 0)
            step >>= 1
        return n

    def compared(a, b):
        """-1, 0, 1 for suffixes a and b."""
        n = extension(a, b)
        same = n == length
        last = np.where(same, 0, n)
        x, y = data[a + last].astype(np.int16), data[b + last].astype(np.int16)
        return np.where(same, 0, np.sign(x - y))

    n = len(where)
    order = np.arange(n)
    if not n:
        return order, np.zeros(0, bool)
    begins = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    sizes = np.diff(np.append(begins, n))
    base, size = np.repeat(begins, sizes), np.repeat(sizes, sizes)
    rank = np.arange(n) - base
    run = 1
    while run < sizes.max():
        active = np.flatnonzero(size > run)
        r, s, b = rank[active], size[active], base[active]
        mine = r // run
        left = mine % 2 == 0
        other = np.where(left, mine + 1, mine - 1) * run
        lo, hi = np.minimum(other, s), np.minimum(other + run, s)
        start = lo.copy()
        at = where[order[active]]
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) // 2
            c = compared(where[order[b[open_] + mid]], at[open_])
            further = (c < 0) | ((c == 0) & ~left[open_])
            lo[open_] = np.where(further, mid + 1, lo[open_])
            hi[open_] = np.where(further, hi[open_], mid)
        place = b + (mine // 2) * 2 * run + (r - mine * run) + (lo - start)
        moved = order.copy()
        moved[place] = order[active]
        order = moved
        run *= 2
    equal = np.zeros(n, bool)
    pair = np.flatnonzero(group[1:] == group[:-1]) + 1
    x, y = where[order[pair - 1]], where[order[pair]]
    equal[pair] = extension(x, y) == length
    check = pair[equal[pair]]
    for s in range(0, len(check), 65536):
        c = check[s : s + 65536]
        span = np.arange(length)
        if (data[where[order[c - 1]][:, None] + span] != data[where[order[c]][:, None] + span]).any():
            raise ArithmeticError("two different strings have the same hash")
    return order, equal


_WINDOW = ["first", "key", "did", "tie", "start", "count", "off", "bytes"]
_SORTED = "first boolean, key long, did long, tie long, start long, count long, off long, bytes binary"


def _sorted(batches, length: int):
    """Windows of a group that repeat an earlier one, as runs; and of groups that are one of several (sub > 0), which hold single windows, the first one of equal windows."""
    for table in kernels.groups_in(batches, ["key", "sub"]):
        begins = kernels.runs(table, ["key", "sub"])
        group_of = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
        f = {k: table.column(k).to_numpy() for k in ("did", "tie", "start", "count", "off")}
        blobs = table.column("bytes").combine_chunks()
        ends = np.cumsum(f["count"] + length - 1)
        at, rows = 0, table.num_rows
        while at < rows:
            # whole groups of about 1 MB
            to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 20)))
            to = begins[min(np.searchsorted(begins, max(to, at + 1)), len(begins) - 1)]
            part = slice(at, to)
            data = np.frombuffer(b"".join(blobs[at:to].to_pylist()), np.uint8)
            count = f["count"][part]
            row = np.repeat(np.arange(to - at), count)
            within = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            zero = np.cumsum(count + length - 1) - (count + length - 1)
            where = zero[row] + within
            start = f["start"][part][row] + within
            did, tie = f["did"][part][row], f["tie"][part][row]
            off = f["off"][part][row] - within
            order = np.lexsort((start, tie, did, off, group_of[part][row]))
            g = group_of[part][row][order] * 1024 + off[order]
            done, equal = suffix_sort(data, where[order], g, length)
            order = order[done]
            first = ~equal
            lead = np.flatnonzero(first)[np.cumsum(first) - 1]
            d, t, s = did[order], tie[order], start[order]
            again = equal & ((d != d[lead]) | (t != t[lead]) | (s != s[lead]))
            d, t, s = d[again], t[again], s[again]
            o = np.lexsort((s, t, d))
            d, t, s = d[o], t[o], s[o]
            new = np.append(True, (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (s[1:] > s[:-1] + 1)) if len(s) else np.zeros(0, bool)
            b = np.flatnonzero(new)
            e = np.append(b[1:], len(s)) - 1 if len(b) else b
            none = pa.nulls(len(b), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(b), bool)), none, pa.array(d[b]), pa.array(t[b]), pa.array(s[b]), pa.array(s[e] - s[b] + 1), none, pa.nulls(len(b), pa.binary())], names=_WINDOW)
            o = order[first]
            o = at + row[o[table.column("sub").to_numpy()[part][row[o]] > 0]]
            if len(o):
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(o), bool)), *(table.column(k).combine_chunks().take(pa.array(o)) for k in _WINDOW[1:])], names=_WINDOW)
            at = to


def _removed(batches, length: int):
    for batch in batches:
        texts, lists = batch.column("text"), batch.column("runs")
        n_removed, n_spans, sha, size = [], [], [], []
        for r in range(batch.num_rows):
            raw = (texts[r].as_py() or "").encode()
            size.append(len(raw))
            spans = lists[r].as_py()
            kept, gone, pieces, end = [], 0, 0, 0
            if spans:
                cur_s = cur_e = -1
                for s, e in sorted((x["start"], x["start"] + x["count"] - 1 + length) for x in spans):
                    if s > cur_e:
                        if cur_e >= 0:
                            kept.append(raw[end:cur_s])
                            gone, pieces, end = gone + cur_e - cur_s, pieces + 1, cur_e
                        cur_s, cur_e = s, e
                    else:
                        cur_e = max(cur_e, e)
                kept.append(raw[end:cur_s])
                gone, pieces, end = gone + cur_e - cur_s, pieces + 1, cur_e
            kept.append(raw[end:])
            n_removed.append(gone)
            n_spans.append(pieces)
            sha.append(hashlib.sha256(b"".join(kept)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (size, n_removed, n_spans)), pa.array(sha, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_strings(docs: DataFrame, length: int = 100, bits: int = 64, slice_bytes: int = SLICE) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) per row of ``docs`` (doc_id, text; other columns are ignored).

    A byte goes if a string of ``length`` bytes over it also starts earlier: in
    a document with a smaller doc_id, or earlier in the same one.  Strings are
    judged on the input.

    * The windows of ``length`` bytes in which the same gram has the least hash
      follow one another in runs; equal windows have equal grams at equal
      places.  Only hashes of runs are dealt out, by gram; grams that a sample
      finds very frequent, by the content of the run too.  Texts are read in
      slices of ``slice_bytes``, and of equal runs of a slice one is dealt out.
    * Runs with equal hashes (``bits`` of them) are one run after their bytes
      have been compared: within a slice at once, else by a join of neighbouring
      runs with chunks of the text that they repeat.  Runs that differ are
      sorted with the others.
    * Different runs around one gram are cut from the texts and sorted with
      ``suffix_sort``, per place of the gram in the window.  They are dealt by
      the gram and half of the bytes beside it.  Groups of over ``HOT`` members
      are first sorted in parts, by a hash of the place in the corpus; the first
      ones of equal windows of each part are then sorted by place of the gram
      and hash of the window.

    A null text is an empty one: no bytes, nothing removed.  A null doc_id
    counts as the last.  Rows with one doc_id are ordered by a hash of the
    text; rows that also have the same text are one document, and have one
    result.  An empty table gives an empty result.
    """
    if not 2 * GRAM <= length <= 128:
        raise ValueError(f"length must be from {2 * GRAM} to 128")
    spark = docs.sparkSession
    short_batches(spark)
    n = partitions(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("did"), F.xxhash64("text").alias("tie"), "text")
    long_ = rows.where(F.octet_length("text") >= length)
    total = int(long_.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0)
    buckets = max(4 * n, total // BUCKET + 1)
    sample = long_.where(F.pmod(F.xxhash64("did"), F.lit(SAMPLE)) == 0).select("text")
    often = max(total // (SAMPLE * GRAM * 8 * buckets), 32)
    found = sample.mapInArrow(lambda it: kernels.tidily(_anchors(it, length, slice_bytes)), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where(F.col("n") > often).select("anchor").collect()
    hot = np.array([r.anchor for r in found], np.int64).view(U64)  # at most 8 a bucket; only what is dealt where depends on it

    dealt = long_.select("did", "tie", "text").mapInArrow(lambda it: kernels.tidily(_deal(it, length, buckets, hot, bits, slice_bytes)), "bucket int, blob binary")
    met = dealt.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(lambda it: kernels.tidily(_meet(it, hot, 8 << 20)), "kind int, did long, tie long, start long, count long, off long, ldid long, ltie long, lstart long, lcount long, loff long")
    met = materialize(met, "runs")

    def strings(todo: DataFrame) -> DataFrame:
        listed = todo.groupBy("did", "tie").agg(F.collect_list(F.struct("kind", *_RUN[3:9])).alias("todo"))
        text = long_.select("did", "tie", "text").join(listed, ["did", "tie"])
        return materialize(text.mapInArrow(lambda it: kernels.tidily(_cut(it, length)), "kind int, key long, did long, tie long, start long, count long, off long, ldid long, ltie long, lstart long, bytes binary"), "strings")

    full = met.where(F.col("kind") == FULL)
    chunks = F.sequence(F.floor(F.col("lstart") / CHUNK), F.floor((F.col("lstart") + F.col("count") + length - 2) / CHUNK))
    zero = F.lit(0).cast("long")
    wanted = full.select(F.col("ldid").alias("did"), F.col("ltie").alias("tie"), F.explode(chunks).alias("start")).distinct()
    wanted = wanted.select(F.lit(WANTED).alias("kind"), "did", "tie", "start", *(zero.alias(k) for k in _RUN[4:]))
    cut = strings(met.where(F.col("kind").isin(SORT, FULL)).unionAll(wanted))

    # equal hashes are no proof
    lead = cut.where(F.col("kind") == WANTED).select(F.col("did").alias("ldid"), F.col("tie").alias("ltie"), "key", F.col("bytes").alias("lead"))
    told = F.expr(f"substring(lead, cast(lstart - key * {CHUNK} + 1 as int), octet_length(bytes))")
    differ = cut.where(F.col("kind") == FULL).join(lead, ["ldid", "ltie", "key"], "left").where(~told.eqNullSafe(F.col("bytes")))
    bad = materialize(differ.select("did", "tie", "ldid", "ltie", "start", "lstart", F.octet_length("bytes").cast("long").alias("size")), "differing")
    if bad.isEmpty():
        again = _again(cut.where(F.col("kind") == SORT), length, n)
    else:  # what those runs and the ones they were taken for hold may be in any run of their gram
        x, y = full.alias("x"), bad.alias("y")
        here = [F.col(f"x.{k}") == F.col(f"y.{k}") for k in ("did", "tie", "ldid", "ltie")]
        shift = F.col("x.start") - F.col("x.lstart") == F.col("y.start") - F.col("y.lstart")
        over = (F.col("x.start") < F.col("y.start") + F.col("y.size")) & (F.col("x.start") + F.col("x.count") - 1 + length > F.col("y.start"))
        wrong = materialize(x.join(y, [*here, shift, over], "left_semi"), "wrong")
        members = wrong.withColumn("kind", F.lit(SORT))
        firsts = members.select("kind", F.col("ldid").alias("did"), F.col("ltie").alias("tie"), F.col("lstart").alias("start"), F.col("lcount").alias("count"), F.col("loff").alias("off"), *_RUN[6:])
        others = met.where(F.col("kind") == SORT)
        again = _again(strings(others.unionAll(members.select(*_RUN)).unionAll(firsts).distinct()), length, n)
        full = full.join(wrong, ["did", "tie", "start", "ldid", "ltie", "lstart"], "left_anti")

    spans = [met.where(F.col("kind") == DONE), full, again]
    runs = functools.reduce(DataFrame.unionAll, [x.select("did", "tie", "start", "count") for x in spans]).groupBy("did", "tie").agg(F.collect_list(F.struct("start", "count")).alias("runs"))
    runs = materialize(runs, "removed")
    discard(met)
    discard(cut)
    out = rows.join(runs, ["did", "tie"], "left").select("doc_id", "text", "runs")
    return out.mapInArrow(lambda it: kernels.tidily(_removed(it, length)), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _again(cut: DataFrame, length: int, n: int) -> DataFrame:
    """Sort the strings that share a key with others: the windows that repeat an earlier one."""

    def sort(groups: DataFrame) -> DataFrame:
        dealt = groups.select("key", "sub", "did", "tie", "start", "count", "off", "bytes").repartition(n, "key", "sub").sortWithinPartitions("key", "sub", "did", "tie", "start")
        return dealt.mapInArrow(lambda it: kernels.tidily(_sorted(it, length)), _SORTED)

    sizes = cut.groupBy("key").agg(F.sum("count").alias("windows"), F.count("*").alias("members")).where("members > 1")
    shared = cut.join(sizes, "key")
    w = F.col("w")
    window = F.expr(f"substring(bytes, cast(w + 1 as int), {length})")
    cool = shared.where(F.col("members") <= HOT).withColumn("sub", F.lit(0))
    hot = shared.where(F.col("members") > HOT).withColumn("w", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)))
    hot = hot.select("key", "did", "tie", (F.col("start") + w).alias("start"), F.lit(1).cast("long").alias("count"), (F.col("off") - w).alias("off"), window.alias("bytes"), F.ceil(F.col("windows") / HOT).cast("int").alias("parts"))
    hot = hot.withColumn("sub", 1 + F.pmod(F.xxhash64("did", "tie", "start"), F.col("parts")).cast("int"))
    columns = ["key", "sub", "did", "tie", "start", "count", "off", "bytes"]
    once = materialize(sort(cool.select(*columns).unionAll(hot.select(*columns))), "sorted")
    firsts = once.where("first").drop("first")
    if firsts.isEmpty():
        return once
    parts = firsts.groupBy("key").agg(F.ceil(F.count("*") / HOT).cast("long").alias("parts"))
    sub = -1 - (F.col("off") + F.lit(length) * F.pmod(F.xxhash64("bytes"), F.col("parts")))
    twice = materialize(sort(firsts.join(parts, "key").withColumn("sub", sub)), "sorted")
    return once.where("not first").unionAll(twice)
