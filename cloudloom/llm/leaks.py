"""Benchmark decontamination by pigeonhole edit matching."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudloom.llm.storage import short_batches

_KEPT = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
MATCH = "array<struct<item_id:long,distance:int,start:int,end:int>>"


def normalise(text: str) -> str:
    """UTF-8 bytes (one character each) with A-Z lower-cased and runs of other ASCII than letters and digits as one blank."""
    return b" ".join(text.encode().translate(_KEPT).split()).decode("latin-1")


def best_match(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """Least edit distance of ``pattern`` to any substring of ``text`` and the first end where it is reached, or None if it is over ``most`` (Myers' bit-parallel algorithm, one machine of as many bits as the pattern has)."""
    m = len(pattern)
    mask, top = (1 << m) - 1, 1 << (m - 1)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | (1 << i)
    pv, mv, score, best, where = mask, 0, m, most + 1, -1
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        if score < best:
            best, where = score, j + 1
        ph, mh = ph << 1, mh << 1
        pv = (mh | ~(xv | ph)) & mask
        mv = ph & xv & mask
    return (best, where) if where >= 0 else None


class Items:
    """A block of test items: an automaton of their pieces."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items = items
        self.budget = [int(rate * len(x)) for _, x in items]
        self.automaton = ahocorasick.Automaton()
        for i, (_, x) in enumerate(items):
            n = self.budget[i] + 1  # so many pieces can't all be hit by an edit
            cut = [len(x) * j // n for j in range(n + 1)]
            for a, z in zip(cut[:-1], cut[1:], strict=True):
                found = self.automaton.get(x[a:z], None)
                if found is None:
                    self.automaton.add_word(x[a:z], [(i, z)])
                else:
                    found.append((i, z))
        if len(self.automaton):
            self.automaton.make_automaton()

    def matches(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        """(item_id, distance, start, end) of the best match of each item within its budget; places are in the normalised text."""
        if not len(self.automaton):
            return
        begins: dict[int, set[int]] = {}
        for end, found in self.automaton.iter(text):
            for i, z in found:
                begins.setdefault(i, set()).add(end + 1 - z)
        for i, places in begins.items():
            item_id, x = self.items[i]
            k, best = self.budget[i], None
            windows: list[list[int]] = []
            for p in sorted(places):
                lo, hi = max(p - k, 0), min(p + len(x) + k, len(text))
                if windows and lo <= windows[-1][1] - len(x) + k:
                    windows[-1][1] = hi
                else:
                    windows.append([lo, hi])
            for lo, hi in windows:
                got = best_match(x, text[lo:hi], k if best is None else best[0] - 1)
                if got:
                    best = got[0], lo + got[1]
                    if not got[0]:
                        break
            if best:
                back = best_match(x[::-1], text[max(best[1] - len(x) - k, 0) : best[1]][::-1], best[0])
                yield item_id, best[0], best[1] - back[1], best[1]


def _blocks(benchmark: DataFrame, most_bytes: int) -> Iterator[list[tuple[int, str]]]:
    block, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").toLocalIterator():
        x = normalise(r.text)
        if x:
            block.append((r.item_id, x))
            size += len(x)
        if size >= most_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


_TEXT = "__text_to_match"


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = 0.08, block_bytes: int = 2 << 20) -> DataFrame:
    """``docs`` with ``matches``: for each item of ``benchmark`` (item_id, text) that the whole text holds with an edit distance of at most ``rate`` times the item's length, the item, the distance, and where the best match is in the normalised text.

    Text and items are compared as UTF-8 bytes, A-Z lower-cased, punctuation and
    white space as single blanks.  An item with a budget of k edits is cut into
    k + 1 pieces; one of them is whole in any match.  All pieces are looked up
    at once, and only the places around hits are verified.

    The items are the query set: blocks of ``block_bytes`` of them are sent to
    the tasks, and the documents are read once for each block and never
    shuffled, so a passage that many documents share weighs nowhere.

    A null or empty text, and an item that is null or has no letters or digits,
    match nothing.  Repeated items and rows are matched each.  A column named
    ``matches`` is replaced.  Without items all lists are empty.
    """
    spark = docs.sparkSession
    short_batches(spark)
    out = docs.drop("matches").withColumn("matches", F.array().cast(MATCH))
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema)
    for block in _blocks(benchmark, block_bytes):
        held = spark.sparkContext.broadcast(block)

        def run(batches, held=held):
            items = Items(held.value, rate)
            for batch in batches:
                found = []
                for text, before in zip(batch.column(_TEXT), batch.column("matches"), strict=True):
                    text = text.as_py()
                    own = [dict(zip(("item_id", "distance", "start", "end"), x, strict=True)) for x in items.matches(normalise(text))] if text else []
                    found.append(before.as_py() + own if own and len(before) else own or before.as_py())
                arrays = {c: batch.column(c) for c in batch.schema.names if c != _TEXT}
                kind = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
                yield pa.RecordBatch.from_pydict(arrays | {"matches": pa.array(found, kind)})

        out = out.withColumn(_TEXT, F.col("text").cast("string")).mapInArrow(run, columns)
    return out
