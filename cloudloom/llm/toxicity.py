"""Toxicity: a linear classifier on character n-grams that are scaled by naive Bayes log-count ratios."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudloom.llm import kernels
from cloudloom.llm.storage import materialize, partitions, short_batches

U64 = np.uint64
GRAMS = (3, 4, 5, 6)
BITS = 20
_TEXT = "__text_to_score"


def grams(data: np.ndarray, at: np.ndarray):
    """For each row the distinct hashed n-grams of its bytes, A-Z lower-cased; n-grams don't cross rows."""
    low = kernels._LOWER[data].astype(np.uint32) + np.uint32(1)
    row = np.repeat(np.arange(len(at) - 1, dtype=np.uint32), np.diff(at))
    found = []
    h = low
    for n in range(2, max(GRAMS) + 1):
        h = h[: len(low) - n + 1] * np.uint32(0x01000193) + low[n - 1 :] if len(low) >= n else low[:0]
        if n in GRAMS:
            x = h ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)
            x = (x ^ (x >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
            found.append((x >> np.uint32(32 - BITS), row[: len(h)], row[n - 1 :][: len(h)]))
    return found


def _present(column, wanted: np.ndarray):
    """For slices of rows: first row, last row, and the distinct (row, gram) pairs of the wanted grams."""
    held: list[np.ndarray] = []
    for i, j, data, at, _, goes_on in kernels.pieces(column, 1 << 18, max(GRAMS) - 1):
        for x, first, last in grams(data, at):
            k = np.flatnonzero((first == last) & wanted[x])
            held.append((first[k].astype(np.int64) << BITS) | x[k])
        if not goes_on:
            yield i, j, np.unique(np.concatenate(held))
            held = []
        elif len(held) > 64:
            held = [np.unique(np.concatenate(held))]


def _tally(column, classes: np.ndarray, total: np.ndarray, stamp: np.ndarray) -> None:
    """Add to ``total`` (by class and gram) the rows that have each gram.  ``stamp`` holds who came last at each gram, which leaves one place for each in a row."""
    seen: np.ndarray | None = None  # of a row in pieces
    for i, j, data, at, _, goes_on in kernels.pieces(column, 1 << 18, max(GRAMS) - 1):
        found = grams(data, at)
        for r in range(j - i):
            span = [slice(*np.searchsorted(last, (r, r + 1))) for _, _, last in found]
            x = np.concatenate([v[s][first[s] == r] for (v, first, _), s in zip(found, span, strict=True)])
            if goes_on or seen is not None:
                seen = np.zeros(1 << BITS, bool) if seen is None else seen
                seen[x] = True
                if not goes_on:
                    total[classes[i]] += seen
                    seen = None
                continue
            places = np.arange(len(x), dtype=np.int32)
            stamp[x] = places
            total[classes[i + r], x[stamp[x] == places]] += 1


def _count(batches):
    """In how many texts of each class each n-gram is: (gram, texts, toxic texts), added up per task."""
    total = np.zeros((2, 1 << BITS), np.int64)
    rows = np.zeros(2, np.int64)
    stamp = np.zeros(1 << BITS, np.int32)
    for batch in batches:
        y = batch.column("y").to_numpy()
        rows += np.bincount(y, minlength=2)
        _tally(batch.column("text"), y, total, stamp)
    some = np.flatnonzero(total.any(0))
    yield pa.RecordBatch.from_arrays([pa.array(np.append(-1, some)), pa.array(np.append(rows[0], total[0][some])), pa.array(np.append(rows[1], total[1][some]))], names=["gram", "clean", "toxic"])


def _rows(batches, wanted: np.ndarray):
    """Class and selected n-grams of each training text."""
    slot = np.cumsum(wanted) - 1
    for batch in batches:
        y = batch.column("y").to_numpy()
        for i, j, p in _present(batch.column("text"), wanted):
            cut = np.searchsorted(p >> BITS, np.arange(j - i + 1))
            x = slot[p & ((1 << BITS) - 1)].astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(y[i:j]), pa.array([x[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], names=["y", "x"])


class Model:
    """Weights by hashed n-gram and an intercept."""

    def __init__(self, wanted: np.ndarray, weights: np.ndarray, bias: float):
        self.wanted, self.weights, self.bias = wanted, weights, bias

    def logits(self, column: pa.Array) -> np.ndarray:
        out = np.full(len(column), self.bias)
        for i, j, p in _present(column, self.wanted):
            out[i:j] += np.bincount(p >> BITS, self.weights[p & ((1 << BITS) - 1)], j - i)
        return out


def _minimise(y, rows, cols, ratio, penalty: float, most_steps: int = 100, most_inner: int = 200, close: float = 1e-6):
    """Weights and intercept that minimise the logistic loss with an L2 penalty, over features 1 * ratio.

    Newton's steps, each solved by conjugate gradients (scaled by the diagonal)
    as exactly as the gradient is small, and halved until the loss falls.  The
    end is a gradient of ``close`` times the first one.
    """
    n, m = len(y), len(ratio)
    value = ratio[cols]
    across = lambda v: np.bincount(rows, value * v[cols], n) + v[m]
    down = lambda g: np.append(np.bincount(cols, value * g[rows], m), g.sum())
    ridge = np.append(np.full(m, penalty), 0.0)  # the intercept is free
    sign = 2 * y - 1
    loss = lambda w, f: np.logaddexp(0, -sign * f).sum() + 0.5 * (ridge * w) @ w
    w, f = np.zeros(m + 1), np.zeros(n)
    now, first = loss(w, f), 0.0
    for _ in range(most_steps):
        p = 0.5 * (1 + np.tanh(0.5 * f))
        g = down(p - y) + ridge * w
        size = float(np.sqrt(g @ g))
        first = first or size
        if size <= close * first:
            break
        d = np.maximum(p * (1 - p), 1e-10)
        scale = 1 / (np.append(np.bincount(cols, value * value * d[rows], m), d.sum()) + ridge + 1e-12)
        step, rest = np.zeros(m + 1), -g
        z = scale * rest
        way, rz = z, rest @ z
        until = min(0.1, np.sqrt(size / first)) * size
        for _ in range(most_inner):
            bent = down(d * across(way)) + ridge * way
            t = rz / (way @ bent)
            step, rest = step + t * way, rest - t * bent
            if np.sqrt(rest @ rest) <= until:
                break
            z = scale * rest
            rz, before = rest @ z, rz
            way = z + rz / before * way
        along, slope, t = across(step), g @ step, 1.0
        while (then := loss(w + t * step, f + t * along)) > now + 1e-4 * t * slope and t > 1e-8:
            t /= 2
        if then >= now:
            break
        w, f, now = w + t * step, f + t * along, then
    return w[:m], w[m]


def fit(labelled: DataFrame, most_rows: int = 20_000, most_entries: int = 1_000_000, smoothing: float = 1.0, penalty: float = 1.0) -> Model:
    """Learn from ``labelled`` (doc_id, text, y in 0, 1).

    At most about ``most_rows`` rows are used: all if there are fewer, else
    those with the least hashes of doc_id.  Each n-gram's log-count ratio is
    ln((p + s) / P) - ln((q + s) / Q) for the numbers of toxic and clean texts
    that have it.  N-grams are the features, each scaled by its ratio: all of
    them, or where the rows have more than ``most_entries`` n-grams together
    those whose rates differ most surely between the classes (by z-score), up to
    as many entries.  So the fit takes bounded memory, and small tables use all
    that they have.  With rows of one class only, or none, all scores are about
    the share of toxic rows (0 of none, so that nothing is rejected).
    """
    short_batches(labelled.sparkSession)
    rows = labelled.where("y in (0, 1)").select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("y").cast("long").alias("y"))
    n = rows.count()
    if n > most_rows:
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(most_rows / n * (1 << 30)))
    rows = materialize(rows.select("text", "y"), "labelled").repartition(partitions(labelled.sparkSession))
    counts = rows.mapInArrow(lambda it: kernels.tidily(_count(it)), "gram long, clean long, toxic long").groupBy("gram").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    z = counts.where("gram < 0").agg(F.sum("clean"), F.sum("toxic")).first()
    clean, toxic = int(z[0] or 0), int(z[1] or 0)
    wanted = np.zeros(1 << BITS, bool)
    if not clean or not toxic:
        p = toxic / (clean + toxic) if clean + toxic else 0.0
        return Model(wanted, np.zeros(1 << BITS), float(np.log((p + 1e-3) / (1 - p + 1e-3))))
    p, q = F.col("toxic") / toxic, F.col("clean") / clean
    share = (F.col("toxic") + F.col("clean") + 1) / float(toxic + clean + 2)
    score = (p - q) / F.sqrt(share * (1 - share) * (1 / toxic + 1 / clean))
    ratio = F.log((F.col("toxic") + smoothing) / (toxic + 2 * smoothing)) - F.log((F.col("clean") + smoothing) / (clean + 2 * smoothing))
    table = counts.where("gram >= 0").select("gram", ratio.alias("ratio"), F.abs(score).alias("z"), (F.col("clean") + F.col("toxic")).alias("n")).toArrow()  # at most 2**BITS rows
    gram, ratios, z, n = (table.column(k).to_numpy() for k in ("gram", "ratio", "z", "n"))
    best = np.lexsort((gram, -z))
    best = np.sort(best[np.cumsum(n[best]) <= max(most_entries, n[best[0]])])
    best = best[np.argsort(gram[best])]
    chosen, ratios = gram[best], ratios[best]
    wanted[chosen] = True
    got = rows.mapInArrow(lambda it: kernels.tidily(_rows(it, wanted)), "y long, x binary").collect()
    got = sorted((r.y, bytes(r.x)) for r in got)  # the same in every run
    y = np.array([float(k) for k, _ in got])
    at = np.repeat(np.arange(len(got), dtype=np.int32), [len(x) // 4 for _, x in got])
    cols = np.frombuffer(b"".join(x for _, x in got), np.int32)
    w, b = _minimise(y, at, cols, ratios, penalty)
    weights = np.zeros(1 << BITS)
    weights[chosen] = w * ratios
    return Model(wanted, weights, float(b))


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: toxic is likelier) and ``predicted`` (1 from ``threshold`` on), from the whole texts; columns of these names are replaced.

    A null or empty text is scored by the intercept alone.  Each row is scored
    for itself, so repeated rows have one score.  An empty table gives none.
    """
    short_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)  # one weight a hash value, whatever the input

    def run(batches):
        m = held.value
        for batch in batches:
            p = 1 / (1 + np.exp(-m.logits(batch.column(_TEXT))))
            arrays = {c: batch.column(c) for c in batch.schema.names if c != _TEXT}
            yield pa.RecordBatch.from_pydict(arrays | {"score": pa.array(p), "predicted": pa.array((p >= threshold).astype(np.int32))})

    docs = docs.drop("score", "predicted")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.withColumn(_TEXT, F.col("text").cast("string")).mapInArrow(run, f"{kept}{', ' if kept else ''}score double, predicted int")


def training_rows(docs: DataFrame, labels: DataFrame, learn: Column) -> DataFrame:
    """(doc_id, text, y) of the documents that have a label and may be learnt from."""
    y = labels.select(F.col("doc_id"), F.col("toxic").cast("int").alias("y")).where("doc_id is not null and y is not null").groupBy("doc_id").agg(F.max("y").alias("y"))
    return docs.select("doc_id", "text").where(learn).join(y, "doc_id")
