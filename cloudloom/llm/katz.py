"""Katz backoff trigram model: Good-Turing discounts, counts in tables dealt by context, documents scored slice by slice with what the tables answer."""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudloom.llm import kernels
from cloudloom.llm.storage import discard, materialize, partitions, short_batches

U64 = np.uint64
ORDER = 3
TRUST = 5  # counts above it keep what they have
SLICE = 4 << 20  # bytes of text that are worked on at once
BUCKET = 500_000  # tokens for which there is one more bucket
START_HASH, END_HASH = U64(0x5354415254), U64(0x454E44)
NONE, START, FIRST = U64(0), U64(1), U64(2)  # codes; those of words begin with FIRST
NULL_ID = -(2**63)
_PRESS, _UNPRESS = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
_SUMS = ["total", *(f"t{r}" for r in range(1, TRUST + 1)), "lower"]


def _save(**arrays: np.ndarray) -> bytes:
    """Arrays, the bytes of each dealt by place so that they compress; high places of unsigned ones that hold only zeros are left out."""
    out = {}
    for k, a in arrays.items():
        width = a.dtype.itemsize
        used = width if a.dtype.kind != "u" else (int(a.max()).bit_length() + 7) // 8 if len(a) else 0
        rows = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), width)
        planes = np.empty((used, len(a)), np.uint8)
        for p in range(used):
            planes[p] = rows[:, p]
        out[k] = a.dtype.str, len(a), used, _PRESS.compress(planes) if planes.size else b""
    return pickle.dumps(out, protocol=5)


def _load(blob: bytes) -> dict[str, np.ndarray]:
    out = {}
    for k, (t, n, used, raw) in pickle.loads(blob).items():
        a = np.zeros(n, t)
        rows = a.view(np.uint8).reshape(n, a.dtype.itemsize)
        planes = np.frombuffer(_UNPRESS.decompress(raw) if raw else b"", np.uint8).reshape(used, n)
        for p in range(used):
            rows[:, p] = planes[p]
        out[k] = a
    return out


def _bits(most: int) -> int:
    return max(int(most), 1).bit_length()


def _distinct(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order that sorts keys of so many bits, where in it each distinct key begins, and the place of each key among the distinct ones."""
    n, low = len(key), _bits(len(key))
    if bits + low <= 64:  # sorting numbers is several times as fast as sorting places
        packed = (key << U64(low)) | np.arange(n, dtype=U64)
        packed.sort()
        by = (packed & U64((1 << low) - 1)).astype(np.int64)
        packed >>= U64(low)
    else:
        by = np.argsort(key)
        packed = key[by]
    new = np.ones(n, bool)
    np.not_equal(packed[1:], packed[:-1], out=new[1:])
    place = np.empty(n, np.int64)
    place[by] = np.cumsum(new) - 1
    return by, np.flatnonzero(new), place


def _cuts(sorted_: np.ndarray) -> np.ndarray:
    return np.append(np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1])), len(sorted_)) if len(sorted_) else np.zeros(1, np.int64)


def _texts(column: pa.Array):
    """For slices of rows, or pieces of a very long row: first row, last row, word hashes, where each row's words begin, the two words before, whether the row began before, whether it goes on."""
    for i, j, data, at in kernels.text_slices(column, SLICE):
        before = np.array([START_HASH, START_HASH])
        if len(data) <= SLICE:
            yield i, j, *kernels.words(data, at), before, False, False
            continue
        cuts = kernels._cuts(data, at)  # one row
        a, began = 0, False
        while a < len(cuts) - 1:
            b = max(a + 1, int(np.searchsorted(cuts, cuts[a] + SLICE, side="right")) - 1)
            hashes, _ = kernels.words(data[cuts[a] : cuts[b]], np.array([0, cuts[b] - cuts[a]]))
            last = b == len(cuts) - 1
            if len(hashes) or last:
                yield i, j, hashes, np.array([0, len(hashes)]), before, began, not last
                before = np.append(before, hashes)[-2:]
                began = True
            a = b


def _slice(batches):
    """Tokens of a slice as places in its own dictionary; each row's tokens follow the two before them."""
    task, seen, whole = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        did = batch.column("did").to_numpy()
        learn = batch.column("learn").to_numpy(zero_copy_only=False).astype(np.uint8)
        for i, j, hashes, begins, before, began, goes_on in _texts(batch.column("text")):
            n = np.diff(begins)
            size = n + (2 if goes_on else 3)
            first = np.cumsum(size) - size
            w = np.full(int(size.sum()), END_HASH)
            w[first], w[first + 1] = before
            w[np.arange(len(hashes)) + np.repeat(first + 2 - begins[:-1], n)] = hashes
            names, tok = np.unique(w, return_inverse=True)
            slice_ = (task << 32) + seen
            whole = whole if began else slice_
            body = _save(names=names, tok=tok.astype(np.uint32), size=size.astype(np.uint32), did=did[i:j], learn=learn[i:j])
            tokens, taught = int(size.sum()) - 2 * len(size), int(((size - 2) * learn[i:j]).sum())
            yield pa.RecordBatch.from_arrays([pa.array([slice_]), pa.array([whole]), pa.array([began or goes_on]), pa.array([tokens]), pa.array([taught]), pa.array([body], pa.binary())], names=["slice", "whole", "part", "tokens", "taught", "body"])
            seen += 1


def _context(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Names of contexts of one or two words (u is ``NONE`` for one)."""
    return kernels.mix(kernels.mix(u + U64(0x9E3779B97F4A7C15)) ^ (v * U64(0xD1342543DE82EF95)))


class _Grams:
    """The distinct n-grams of a slice in the order in which they are asked for: by bucket, context and word."""

    def __init__(self, s: dict[str, np.ndarray], order: int, buckets: int, hot: np.ndarray):
        size = s["size"].astype(np.int64)
        first = np.cumsum(size) - size
        own = np.ones(len(s["tok"]), bool)
        own[first] = own[first + 1] = False
        self.own = np.flatnonzero(own)
        tok = s["tok"].astype(U64)
        width = _bits(len(s["names"]))  # bits of a word's place in the dictionary of the slice
        if order * width > 64:
            raise OverflowError("a slice has too many distinct words")
        key = tok[2:].copy()  # a slice begins with the two before its first row's tokens
        for back in range(1, order):
            key |= tok[2 - back : len(tok) - back] << U64(width * back)
        key = key[own[2:]]
        by, begins, at = _distinct(key, order * width)
        key = key[by[begins]]
        del tok, own, by
        mask = U64((1 << width) - 1)
        w = (key & mask).astype(np.int64)
        above = key >> U64(width)
        new = np.ones(len(key), bool)
        np.not_equal(above[1:], above[:-1], out=new[1:])
        of = np.cumsum(new) - 1  # contexts by their places, in order
        above = above[new]
        v, u = (above & mask).astype(np.int64), (above >> U64(width)).astype(np.int64)
        names = s["names"] if order == 1 else np.cumsum(s["names"], dtype=U64)
        none = np.zeros(len(above), U64)
        v_code, u_code = names[v] if order > 1 else none, names[u] if order > 2 else none
        context = _context(u_code, v_code)
        code = names[w]
        bucket = (context % U64(buckets)).astype(np.uint16 if buckets < 65536 else np.uint32)[of]
        if len(hot):
            split = np.flatnonzero((hot[np.minimum(np.searchsorted(hot, context), len(hot) - 1)] == context)[of])
            bucket[split] = kernels.mix(context[of[split]] ^ kernels.mix(code[split])) % U64(buckets)
        perm = np.argsort(bucket, kind="stable")
        back = np.empty(len(perm), np.int64)
        back[perm] = np.arange(len(perm))
        self.at = back[at]  # n-gram of each token
        self.bucket, self.w, self.w_at, of = bucket[perm], code[perm], w[perm], of[perm]
        new[1:] = (of[1:] != of[:-1]) | (self.bucket[1:] != self.bucket[:-1])
        self.runs = np.flatnonzero(new)  # where n-grams of one context begin
        self.run = np.cumsum(new) - 1
        of = of[self.runs]
        self.context, self.u, self.v, self.v_at = context[of], u_code[of], v_code[of], v[of]  # of each run


def _ask(batches, order: int, buckets: int, hot: np.ndarray):
    """What a slice asks each bucket: its distinct n-grams with how often training rows have them, and the counts of the shorter ones."""
    for batch in batches:
        for slice_, body in zip(batch.column("slice").to_pylist(), batch.column("body"), strict=True):
            s = _load(body.as_py())
            g = _Grams(s, order, buckets, hot)
            n = np.bincount(g.at[np.repeat(s["learn"].astype(bool), s["size"] - 2)], minlength=len(g.w)).astype(np.uint32)
            lower = np.zeros(len(g.w), np.uint32)
            if order == 2:
                lower = s["c1"][g.w_at]
            elif order == 3:
                lower[g.at] = s["c2"]
            ends = np.append(g.runs, len(g.w))
            whole = s["whole2"][g.v_at] if order == 3 else np.zeros(len(g.runs), U64)
            c = _cuts(g.bucket)
            cut = np.searchsorted(g.runs, c)
            blobs = []
            for a, b, p, q in zip(c[:-1], c[1:], cut[:-1], cut[1:], strict=True):
                about = {"u": np.diff(g.u[p:q], prepend=NONE), "v": g.v[p:q], "whole": whole[p:q]} if order > 1 else {}
                blobs.append(_save(**about, run=np.diff(ends[p : q + 1]).astype(np.uint32), w=g.w[a:b], n=n[a:b], lower=lower[a:b]))
            yield pa.RecordBatch.from_arrays([pa.array(g.bucket[c[:-1]].astype(np.int32)), pa.array(np.full(len(blobs), slice_)), pa.array(blobs, pa.binary())], names=["bucket", "slice", "blob"])


def reduced(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Discounted counts."""
    return np.append(d, 1.0)[np.minimum(c, TRUST + 1).astype(np.int64)] * c


_MET = "kind int, slice long, bucket int, blob binary, stats array<double>"
_ANSWER, _HOT, _COUNTS, _OFTEN = range(1, 5)


def _row(kind: int, ids, bucket: int, blobs, stats):
    n = len(ids)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, kind, np.int32)), pa.array(np.asarray(ids).astype(np.int64)), pa.array(np.full(n, bucket, np.int32)), pa.array(blobs if blobs is not None else [None] * n, pa.binary()), pa.array(stats if stats is not None else [None] * n, pa.list_(pa.float64()))],
        names=["kind", "slice", "bucket", "blob", "stats"],
    )


def _meet(batches, order: int, buckets: int, hot: np.ndarray, d: np.ndarray, whole: float, often: float):
    """The table of a bucket: counts of its n-grams, and of each context all counts, how many are 1 to ``TRUST`` and what the words after it have in the shorter model; answers to each slice.  Words get a code here."""
    for table in kernels.groups_in(batches, ["bucket"]):
        for rows in np.split(np.arange(table.num_rows), kernels.runs(table, ["bucket"])[1:-1]):
            bucket = table.column("bucket")[int(rows[0])].as_py()
            asked = [_load(table.column("blob")[int(r)].as_py()) for r in rows]
            if order > 1:
                asked = [x | {"u": np.cumsum(x["u"], dtype=U64)} for x in asked]
            slices = table.column("slice").to_numpy()[rows]
            f = {k: np.concatenate([x[k] for x in asked]) for k in asked[0]}
            size = [len(x["w"]) for x in asked]
            runs = [len(x["run"]) for x in asked]
            del asked
            if order == 1:
                f |= dict.fromkeys(("u", "v", "whole"), np.zeros(len(f["run"]), U64))
            context = _context(f["u"], f["v"])
            by, begins, run_at = _distinct(context, 64)
            names = context[by[begins]]
            u, v, wholes = (f[k][by[begins]] for k in ("u", "v", "whole"))
            if (u[run_at] != f["u"]).any() or (v[run_at] != f["v"]).any():
                raise ArithmeticError("two contexts have the same hash")
            del context, by, begins, u
            at = np.repeat(run_at, f["run"])
            word, width = f["w"], _bits(f["w"].max())
            if _bits(len(names) - 1) + width > 64 and len(names) > 1:
                begins, word = _distinct(word, width)[1:]
                word, width = word.astype(U64), _bits(len(begins))
            gram = word if len(names) == 1 else (at.astype(U64) << U64(width)) | word
            by, begins, place = _distinct(gram, min(width + (_bits(len(names) - 1) if len(names) > 1 else 0), 64))
            first = by[begins]
            n = np.add.reduceat(f["n"][by], begins, dtype=np.int64)
            del gram, word, by, begins
            count = n[place]
            held = n > 0
            c, x = n[held], first[held]
            of = at[x]  # in order
            del at
            below = reduced(f["lower"][x].astype(float), d) / (whole if order == 2 else np.maximum(wholes[of], 1)) if order > 1 else np.zeros(len(x))
            total = np.bincount(of, c, len(names))
            few = c <= TRUST
            small = np.bincount(of[few] * TRUST + c[few] - 1, minlength=TRUST * len(names)).reshape(-1, TRUST).T
            s = np.bincount(of, below, len(names))
            yield _row(_COUNTS, [0], bucket, None, [[*np.bincount(np.minimum(c, TRUST + 2), minlength=TRUST + 3)[1 : TRUST + 2].astype(float).tolist(), float(len(c))]])
            split = np.flatnonzero(np.isin(names, hot))
            if len(split):
                yield _row(_HOT, names[split].view(np.int64), bucket, None, np.column_stack([total[split], small[:, split].T, s[split]]).tolist())
            if order == 1:
                code = np.empty(len(n), U64)  # the most frequent words have the least codes
                code[np.argsort(-n, kind="stable")] = np.arange(len(n), dtype=U64) * U64(buckets) + U64(bucket) + FIRST
            if order < ORDER and (c > often).any():
                top = x[c > often]
                known = _context(v[of[c > often]], f["w"][top] if order > 1 else code[held][c > often])
                yield _row(_OFTEN, known.view(np.int64), bucket, None, None)
            some = small.any(0)
            ends, run_ends = np.cumsum(size), np.cumsum(runs)
            kind = np.uint32 if count.max() < 2**32 else U64
            run_first = np.cumsum(f["run"], dtype=np.int64) - f["run"]
            blobs = []
            for k in range(len(rows)):
                e = slice(ends[k] - size[k], ends[k])
                own = run_at[run_ends[k] - runs[k] : run_ends[k]]
                answer = {"c": count[e].astype(kind)}
                if order == 1:
                    answer["code"] = code[place[e]] // U64(buckets)
                else:
                    answer["total"] = total[own].astype(U64)
                    answer["some"] = some[own].astype(np.uint8)
                    begin = run_first[run_ends[k] - runs[k] : run_ends[k]] - (ends[k] - size[k])
                    unseen = own[np.logical_or.reduceat(count[e] == 0, begin)] if size[k] else own
                    answer |= {f"t{r}": small[r - 1][unseen].astype(np.uint32) for r in range(1, TRUST + 1)} | {"lower": s[unseen]}
                blobs.append(_save(**answer))
            yield _row(_ANSWER, slices, bucket, blobs, None)


def discounts(counts) -> np.ndarray:
    """Katz's d_r for r = 1..TRUST from n_1..n_(TRUST+1) (Good-Turing, renormalised so that counts above TRUST keep theirs); where the counts of counts give none between 0 and 1, (r - 0.5) / r."""
    n = np.asarray(counts, float)
    out = np.zeros(TRUST + 1)
    tail = (TRUST + 1) * n[TRUST] / n[0] if n[0] else 1.0
    for r in range(1, TRUST + 1):
        d = ((r + 1) * n[r] / (r * n[r - 1]) - tail) / (1 - tail) if n[r - 1] and tail != 1 else 0.0
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


def left_over(small: np.ndarray, d: np.ndarray) -> np.ndarray:
    """What contexts give away, from how many of their words have a count of 1 to ``TRUST`` (rows); one, with one more in the total, where they have none."""
    given = (np.asarray(small, float) * (np.arange(1, TRUST + 1) * (1 - d[1:]))[:, None]).sum(0)
    return np.where(given > 0, given, 1.0)


class _Hot:
    """Sums of the contexts that are dealt over many buckets."""

    def __init__(self, names: np.ndarray, sums: np.ndarray):
        order = np.argsort(names)
        self.names, self.sums = names[order], sums[order]

    def find(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the contexts are hot, and the sums of those."""
        if not len(self.names):
            return np.zeros(0, np.int64), np.zeros((0, len(_SUMS)))
        at = np.minimum(np.searchsorted(self.names, context), len(self.names) - 1)
        found = np.flatnonzero(self.names[at] == context)
        return found, self.sums[at[found]]


def _answers(s: dict[str, np.ndarray], order: int, buckets: int, hot: _Hot, d: np.ndarray, blobs: list[bytes]):
    """The n-grams of a slice, their counts, and of each of their contexts the whole (total, and one more if it has no small count) and log10 of the backoff weight (0 for one never seen)."""
    g = _Grams(s, order, buckets, hot.names)
    got = [_load(b) for b in blobs]  # in order of buckets
    f = {k: np.concatenate([x[k] for x in got]) for k in got[0]}
    if len(f["c"]) != len(g.w):
        raise RuntimeError("an answer is missing")
    if order == 1:
        return g, f["c"], f["code"] * U64(buckets) + g.bucket + FIRST, None
    some, weight = f["some"].astype(bool), np.zeros(len(g.runs))
    total = f["total"].astype(float)
    new = np.logical_or.reduceat(f["c"] == 0, g.runs) if len(g.runs) else np.zeros(0, bool)
    unseen = np.flatnonzero(new)
    small = np.zeros((TRUST, len(g.runs)))
    lower = np.zeros(len(g.runs))
    for r in range(TRUST):
        small[r, unseen] = f[f"t{r + 1}"]
    lower[unseen] = f["lower"]
    is_hot, sums = hot.find(g.context)
    total[is_hot], small[:, is_hot], lower[is_hot] = sums[:, 0], sums[:, 1 : TRUST + 1].T, sums[:, -1]
    some[is_hot] = sums[:, 1 : TRUST + 1].any(1)
    whole = total + ((total > 0) & ~some)
    ask = np.flatnonzero((total > 0) & new)
    weight[ask] = np.log10(left_over(small[:, ask], d)) - np.log10(whole[ask]) - np.log10(np.maximum(1 - lower[ask], 1e-300))
    return g, f["c"], whole, weight


def _slices_in(batches):
    """Each slice with the answers of the buckets."""
    for table in kernels.groups_in(batches, ["slice"]):
        for rows in np.split(np.arange(table.num_rows), kernels.runs(table, ["slice"])[1:-1]):
            pick = lambda k, r=0, table=table, rows=rows: table.column(k)[int(rows[r])].as_py()
            yield pick, _load(pick("blob")), [pick("blob", r) for r in range(1, len(rows))]


def _learn_words(batches, buckets: int, hot: _Hot):
    """A slice with the counts of its words, which are named by codes from now on."""
    for pick, s, blobs in _slices_in(batches):
        g, c, codes, _ = _answers(s, 1, buckets, hot, None, blobs)
        c1, code = np.zeros(len(s["names"]), c.dtype), np.full(len(s["names"]), START)
        c1[g.w_at], code[g.w_at] = c, codes
        by = np.argsort(code)
        to = np.empty(len(by), np.uint32)
        to[by] = np.arange(len(by), dtype=np.uint32)
        body = _save(**s | {"names": np.diff(code[by], prepend=NONE), "c1": c1[by], "tok": to[s["tok"]]})
        yield pa.RecordBatch.from_arrays([pa.array([pick("slice")]), pa.array([body], pa.binary())], names=["slice", "body"])


def _learn_pairs(batches, buckets: int, hot: _Hot, d: np.ndarray):
    """A slice with the count of each token after the one before, and of each word as a context its whole and backoff weight."""
    for pick, s, blobs in _slices_in(batches):
        g, c, whole, weight = _answers(s, 2, buckets, hot, d, blobs)
        whole2, weight2 = np.zeros(len(s["names"]), U64), np.zeros(len(s["names"]))
        v = g.v_at
        whole2[v] = whole.astype(U64)
        asked = weight != 0  # runs of one context have one weight, or none where nothing was asked
        weight2[v[asked]] = weight[asked]
        body = _save(**s | {"c2": c[g.at], "whole2": whole2, "weight2": weight2})
        yield pa.RecordBatch.from_arrays([pa.array([pick("slice")]), pa.array([body], pa.binary())], names=["slice", "body"])


def _log(x: np.ndarray) -> np.ndarray:
    return np.log10(np.maximum(x, 1e-300))


def _evaluate(batches, buckets: int, hot: _Hot, d: list[np.ndarray], total: int, kinds: int, whole: float, unknown: float):
    """Log10 probabilities of the tokens, from the shortest model up, added up by row."""
    for pick, s, blobs in _slices_in(batches):
        g, c, wholes, weight = _answers(s, 3, buckets, hot, d[2], blobs)
        tok = s["tok"].astype(np.int64)
        w, v = tok[g.own], tok[g.own - 1]
        c1 = s["c1"].astype(float)
        p = np.where(c1 > 0, _log(reduced(c1, d[0])) - _log(np.array(max(whole, 1))), _log(np.array(unknown)))[w]
        c2, whole2 = s["c2"].astype(float), s["whole2"].astype(float)
        p = np.where(c2 > 0, _log(reduced(c2, d[1])) - _log(whole2)[v], s["weight2"][v] + p)
        own3, seen = np.where(c > 0, _log(reduced(c.astype(float), d[2])) - _log(wholes)[g.run], weight[g.run]), c > 0  # of each n-gram
        p = own3[g.at] + np.where(seen[g.at], 0.0, p)
        rows, row = len(s["did"]), np.repeat(np.arange(len(s["did"])), s["size"] - 2)
        base = np.log10(c1 + 0.5)[w] - np.log10(total + 0.5 * (kinds + 1))
        sums = [np.bincount(row, x, rows) for x in (base, p)]
        n = [np.bincount(row, x, rows).astype(np.int64) for x in (None, (c1 > 0)[w])]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(rows, pick("slice"))), pa.array(s["did"], mask=s["did"] == NULL_ID), *map(pa.array, n), pa.array(np.full(rows, total)), *map(pa.array, sums)],
            names=["slice", "doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )


def score(docs: DataFrame, learn: Column) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) per row of ``docs`` (doc_id, text; other columns only through ``learn``), learning from the rows where ``learn`` is true.

    Tokens are the words of a text, A-Z lower-cased, and an end.
    ``base_score`` is the log10 probability under add-half word counts,
    ``score`` that under the model::

        p(w | u v) = d3(c(u v w)) c(u v w) / c(u v)   for triples that were seen
                   = a(u v) p(w | v)                  else
        p(w | v)   = d2(c(v w)) c(v w) / c(v)         for pairs that were seen
                   = a(v) p(w)                        else
        p(w)       = d1(c(w)) c(w) / N                for known words, the rest of 1 for unknown ones

    with u v the two tokens before (starts, at the beginning).  d are Katz's
    Good-Turing discounts for counts to ``TRUST``; larger counts keep what they
    have.  a make the words after a context sum to 1; a context that was never
    seen has a = 1.  Where a context has no small count, nothing would be left
    for unseen words: its total counts one more, and that is left.

    Words, pairs and triples are counted in turn.  A slice of about ``SLICE``
    bytes of texts asks for its distinct n-grams, with how often its training
    rows have them.  A bucket is the n-grams of some contexts; it adds up what
    slices say and answers each.  There is one more bucket for every ``BUCKET``
    tokens.  Contexts more frequent than a quarter of a bucket are dealt over
    all buckets by the word too, and only their sums (at most four contexts a
    bucket) go through the driver.  So an n-gram takes one place in a slice,
    however often it occurs, and no document is gathered in one task.  Words
    are known by 64-bit hashes; contexts whose hashes agree are compared by
    their words, and n-grams are told apart by the words themselves.

    A null text is an empty one, and has only the end.  Without training rows
    both scores are 0 for each token.  Repeated rows count each, and each has
    a row in the result.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    short_batches(spark)
    n = partitions(spark)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("did"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    slices = materialize(rows.mapInArrow(lambda it: kernels.tidily(_slice(it)), "slice long, whole long, part boolean, tokens long, taught long, body binary"), "slices")
    tokens, taught = (int(x or 0) for x in slices.agg(F.sum("tokens"), F.sum("taught")).first())
    buckets = max(n, tokens // BUCKET + 1)
    often = taught / (4 * buckets)
    none = np.zeros(1, U64)

    def level(state: DataFrame, order: int, hot: np.ndarray, d, whole: float):
        """Answers of the buckets, counts of counts, sums of hot contexts, and n-grams that are hot contexts of the next level."""
        asked = state.select("slice", "body").mapInArrow(lambda it: kernels.tidily(_ask(it, order, buckets, hot)), "bucket int, slice long, blob binary")
        dealt = asked.repartition(n, "bucket").sortWithinPartitions("bucket", "slice")
        met = materialize(dealt.mapInArrow(lambda it: kernels.tidily(_meet(it, order, buckets, hot, d, whole, often)), _MET), "answers")
        counts = [float(x or 0) for x in met.where(F.col("kind") == _COUNTS).agg(*(F.sum(F.col("stats")[k]) for k in range(TRUST + 2))).first()]
        sums = met.where(F.col("kind") == _HOT).groupBy("slice").agg(*(F.sum(F.col("stats")[k]).alias(k_) for k, k_ in enumerate(_SUMS))).collect()
        table = _Hot(np.array([r.slice for r in sums], np.int64).view(U64), np.array([r[1:] for r in sums], float).reshape(-1, len(_SUMS)))
        return met, counts, table

    def heavy(met: DataFrame, start: tuple) -> np.ndarray:
        """The contexts of the next level that are dealt over many buckets."""
        often = [r.slice for r in met.where(F.col("kind") == _OFTEN).select("slice").collect()]
        return np.unique(np.append(np.array(often, np.int64).view(U64), _context(np.array([start[0]]), np.array([start[1]]))))

    def answered(state: DataFrame, met: DataFrame) -> DataFrame:
        own = state.select("slice", F.lit(0).alias("kind"), F.lit(-1).alias("bucket"), F.col("body").alias("blob"))
        said = met.where(F.col("kind") == _ANSWER).select("slice", "kind", "bucket", "blob")
        return own.unionAll(said).repartition(n, "slice").sortWithinPartitions("slice", "kind", "bucket")

    met, counts, table1 = level(slices, 1, _context(none, none), None, 1.0)
    sums = table1.sums.sum(0)
    d1, total, kinds = discounts(counts), int(sums[0]), int(counts[-1])
    whole = total + (total > 0 and not sums[1 : TRUST + 1].any())
    unknown = float(left_over(sums[1 : TRUST + 1, None], d1)[0]) / whole if total else 1.0
    state = materialize(answered(slices, met).mapInArrow(lambda it: kernels.tidily(_learn_words(it, buckets, table1)), "slice long, body binary"), "words")
    hot = heavy(met, (NONE, START))
    discard(met)
    pieces = materialize(slices.where("part").select("slice", "whole"), "pieces")
    discard(slices)

    met, counts, table2 = level(state, 2, hot, d1, float(whole))
    d2 = discounts(counts)
    hot = heavy(met, (START, START))
    before, state = state, materialize(answered(state, met).mapInArrow(lambda it: kernels.tidily(_learn_pairs(it, buckets, table2, d2)), "slice long, body binary"), "pairs")
    discard(met)
    discard(before)

    met, counts, table3 = level(state, 3, hot, d2, 1.0)
    d = [d1, d2, discounts(counts)]
    columns = "slice long, doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    scored = answered(state, met).mapInArrow(lambda it: kernels.tidily(_evaluate(it, buckets, table3, d, total, kinds, float(whole), unknown)), columns)
    out = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    if pieces.isEmpty():
        return scored.select(*out)
    scored = scored.join(pieces, "slice", "left")
    whole_rows = scored.where("whole is not null").groupBy("whole", "doc_id", "train_tokens").agg(*(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")))
    return scored.where("whole is null").select(*out).unionAll(whole_rows.select(*out))
