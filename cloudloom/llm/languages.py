"""Language identification by the nearest of several TF-IDF n-gram centroids per language."""

from __future__ import annotations

import regex

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudloom.llm import kernels
from cloudloom.llm.storage import short_batches

BITS = 13
SIZE = 1 << BITS
GRAMS = (1, 2, 3)
ROWS = 128  # whose counts are held at once
_TEXT = "__text_to_name"
_LETTER = regex.compile(r"\p{L}")
_KEPT = np.array([c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256)], np.uint8)


def counts(column: pa.Array):
    """For slices of rows: first row, last row, and counts of the hashed byte n-grams of each (dense), A-Z lower-cased and runs of other ASCII than letters as one blank."""
    for first in range(0, len(column), ROWS):
        for i, j, c in _counts(column.slice(first, ROWS)):
            yield first + i, first + j, c


def _counts(column: pa.Array):
    held = None
    for i, j, data, at, own_bytes, goes_on in kernels.pieces(column, 1 << 19, max(GRAMS) - 1):
        plain = _KEPT[data]
        kept = np.ones(len(plain), bool)
        kept[1:] = (plain[1:] != 32) | (plain[:-1] != 32)
        kept[at[:-1][at[:-1] < len(plain)]] = True
        upto = np.append(0, np.cumsum(kept))
        at, own_bytes = upto[at], int(upto[own_bytes])
        low = plain[kept].astype(np.uint32) + np.uint32(1)
        row = np.repeat(np.arange(j - i, dtype=np.int64), np.diff(at))
        out = np.zeros((j - i) * SIZE)
        h = low
        for n in range(1, max(GRAMS) + 1):
            if n > 1:
                h = h[: len(low) - n + 1] * np.uint32(0x01000193) + low[n - 1 :] if len(low) >= n else low[:0]
            x = (h ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
            x = ((x ^ (x >> np.uint32(15))) * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BITS)
            x = x[:own_bytes]  # what begins in the overlap is the next piece's
            last = row[n - 1 :][: len(x)]
            own = row[: len(x)] == last
            out += np.bincount(last[own] * SIZE + x[own], minlength=(j - i) * SIZE)
        held = out if held is None else held + out
        if not goes_on:
            yield i, j, held.reshape(j - i, SIZE)
            held = None


def vectors(count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit vectors of damped counts times idf; zero rows stay zero."""
    x = np.log1p(count) * idf
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


def _document_counts(batches):
    """In how many texts each n-gram is, added up per task: (gram, texts), texts themselves as gram -1."""
    total, n = np.zeros(SIZE, np.int64), 0
    for batch in batches:
        for i, j, c in counts(batch.column("text")):
            total += (c > 0).sum(0)
            n += j - i
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(-1, some)), pa.array(np.append(n, total[some]))], names=["gram", "texts"])


def _sample_vectors(batches, idf):
    for batch in batches:
        for i, j, c in counts(batch.column("text")):
            x = vectors(c, idf).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column("lang").slice(i, j - i), pa.array([v.tobytes() for v in x], pa.binary())], names=["lang", "x"])


class Model:
    def __init__(self, idf: np.ndarray, names: list[str], owner: np.ndarray, centroids: np.ndarray, reach: np.ndarray):
        self.idf, self.names, self.owner, self.centroids, self.reach = idf, names, owner, centroids, reach

    def nearest(self, column: pa.Array):
        """Name, cosine and whether the centroid is too far, for each row."""
        names, score, far = np.zeros(len(column), np.int64), np.zeros(len(column)), np.zeros(len(column), bool)
        for i, j, c in counts(column):
            cosines = vectors(c, self.idf) @ self.centroids.T
            best = cosines.argmax(1)
            names[i:j], score[i:j] = self.owner[best], np.clip(cosines[np.arange(j - i), best], 0, 1)
            far[i:j] = score[i:j] < self.reach[best]
        return names, score, far


def _cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from spread-out starts."""
    start = [int((x @ x.mean(0)).argmax())]
    near = x @ x[start[0]]
    while len(start) < min(k, len(x)):
        start.append(int(near.argmin()))
        near = np.maximum(near, x @ x[start[-1]])
    centre = x[start].copy()
    for _ in range(rounds):
        own = (x @ centre.T).argmax(1)
        for c in range(len(centre)):
            if (own == c).any():
                centre[c] = x[own == c].mean(0)
        centre /= np.maximum(np.sqrt((centre * centre).sum(1, keepdims=True)), 1e-12)
    return centre


def fit(docs: DataFrame, learn: Column, clusters: int = 4, per_language: int = 400, quantile: float = 0.005) -> Model:
    """Learn from the rows of ``docs`` (doc_id, text, lang) where ``learn`` is true and lang isn't null.

    Document frequencies are counted over all of them.  Centroids are fitted to
    a bounded sample: the ``per_language`` texts with letters of each language
    whose hashes, of id and text, are least.  A text is too far from its centroid if its
    cosine is less than that of all but ``quantile`` of the centroid's own
    sample texts.
    """
    short_batches(docs.sparkSession)
    rows = docs.where(learn).where("lang is not null").select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), "lang")
    df = rows.select("text").mapInArrow(_document_counts, "gram long, texts long").groupBy("gram").agg(F.sum("texts").alias("n")).collect()  # one row a hash value
    seen = {r.gram: r.n for r in df}
    n = seen.pop(-1, 0)
    idf = np.array([np.log((n + 1) / (seen.get(g, 0) + 1)) + 0.05 for g in range(SIZE)])
    lettered = rows.where(F.col("text").rlike(r"\p{L}"))
    sizes = {r.lang: r.n for r in lettered.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0)
    for lang, size in sizes.items():  # far more than are taken, so that few texts are sorted
        share = F.when(F.col("lang") == lang, F.lit(int(min(1.0, 2 * per_language / size) * (1 << 30)))).otherwise(share)
    rank = F.xxhash64("doc_id", "text")
    near = lettered.where(F.pmod(rank, F.lit(1 << 30)) < share).withColumn("rank", F.pmod(rank, F.lit(1 << 30)))
    first = near.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("rank", "text"))).where(F.col("place") <= per_language)
    raw: dict[str, list[bytes]] = {lang: [] for lang in sizes}
    for r in first.select("lang", "text").mapInArrow(lambda it: _sample_vectors(it, idf), "lang string, x binary").collect():  # at most per_language a language
        raw[r.lang].append(bytes(r.x))
    names, owner, centroids, reach = sorted(sizes), [], [], []
    for k, lang in enumerate(names):
        if not raw[lang]:  # equal rows have equal hashes: all of a language's can be too great
            alike = lettered.where(F.col("lang") == lang).orderBy(rank, "text").limit(per_language)
            raw[lang] = [bytes(r.x) for r in alike.select("lang", "text").mapInArrow(lambda it: _sample_vectors(it, idf), "lang string, x binary").collect()]
        x = np.stack([np.frombuffer(b, np.float32) for b in sorted(raw[lang])]).astype(float)
        centre = _cluster(x, clusters)
        cosines = x @ centre.T
        own = cosines.argmax(1)
        for c in range(len(centre)):
            near = cosines[own == c, c]
            owner.append(k)
            centroids.append(centre[c])
            reach.append(np.quantile(near, quantile) if len(near) else 0.0)
    return Model(idf, names, np.array(owner, np.int64), np.array(centroids).reshape(len(owner), SIZE), np.array(reach))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (cosine to the nearest centroid, 0 to 1) and ``rejected`` (the text is too far from it), from the whole texts; columns of these names are replaced.

    ``lang_pred`` is ``und`` for a null text and one without letters, and if
    nothing was learnt; their score is 0.  Each row is judged for itself.  An
    empty table gives an empty result.
    """
    short_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)  # a few centroids a language, whatever the input

    def run(batches):
        m = held.value
        for batch in batches:
            column = batch.column(_TEXT)
            lettered = np.array([bool(t.is_valid and _LETTER.search(t.as_py())) for t in column], bool)
            if len(m.names):
                name, score, far = m.nearest(column)
            else:
                lettered[:] = False
            if not lettered.any():
                name, score, far = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows), np.ones(batch.num_rows, bool)
            said = [m.names[k] if ok else "und" for k, ok in zip(name, lettered, strict=True)]
            arrays = {c: batch.column(c) for c in batch.schema.names if c != _TEXT}
            yield pa.RecordBatch.from_pydict(arrays | {"lang_pred": pa.array(said, pa.string()), "score": pa.array(np.where(lettered, score, 0.0)), "rejected": pa.array(far | ~lettered)})

    docs = docs.drop("lang_pred", "score", "rejected")
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema)
    return docs.withColumn(_TEXT, F.col("text").cast("string")).mapInArrow(run, f"{kept}lang_pred string, score double, rejected boolean")
