"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from cloudloom.llm.storage import materialize

WORD = r"[^\x20\x09-\x0D]+"
BINS = 4096  # of one source's ranks
HALF = 100  # words of a document of middling merit


def allot(sizes: list[tuple[str | None, int]], weights: list[float], share: float, most: float) -> dict[str | None, float]:
    """Targets in words by source: ``share`` times all sizes, dealt by weight; what would pass ``most`` times a source's size goes to the others by weight, until none is above (or all are full)."""
    sizes = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))  # by code point, null last
    weight = {s: float(weights[k % len(weights)]) for k, (s, _) in enumerate(sizes)}
    cap = {s: most * n for s, n in sizes}
    left, open_ = share * sum(n for _, n in sizes), [s for s, _ in sizes]
    target: dict[str | None, float] = {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > cap[s]]
        if not full:
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in full:
            target[s] = cap[s]
            left -= cap[s]
            open_.remove(s)
    return target


def uniform(key: Column) -> Column:
    """A number in (0, 1) from the md5 of a text, the same everywhere."""
    return (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def mix(docs: DataFrame, weights: list[float], share: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """``docs`` (doc_id, text, source, any others) with ``size`` (words), ``source_size``, ``target`` and ``taken`` (words the mix takes of the document); columns of these names are replaced.

    A document's merit is 1000 * size / (size + ``HALF``), in whole numbers:
    longer documents are taken more often.  It is expected to be taken
    t + min(t, most - t) * (merit - m) / 1000 times, where t is the target of its
    source divided by the source's size, and m the source's mean merit by words;
    so the source is expected to give its target, and no document is taken more
    than ``most`` times.  Whole copies of that are certain.  For the rest, p,
    which differs between documents, they draw u from a hash of their id and
    are ranked by (u / (1 - u)) / (p / (1 - p)), and taken in that order up to
    the rest of the target: a document is in if half of it or more still fits,
    so a source misses its target by at most half a document.

    The order is never sorted in whole.  Words are added up in ``BINS`` bins of
    ranks a source, by partial aggregation; only the bin that the target falls
    in is cut again into as many, and the few ranks in a bin of that are taken
    one by one.  What is collected has a row for each source; documents aren't
    shuffled by source.

    A null text has no words and is taken 0 times.  A null source is one, the
    last.  Rows with one id have one rank and are in or out together.  An empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.drop("size", "source_size", "target", "taken")
    sized = docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
    keys = materialize(sized.select("source", "doc_id", "size"), "sizes")
    merit = F.floor(1000 * F.col("size") / (F.col("size") + HALF))
    sums = keys.groupBy("source").agg(F.sum("size").alias("n"), F.sum(F.col("size") * merit).alias("merit")).collect()
    sizes = [(r.source, r.n) for r in sums]
    target = allot(sizes, weights, share, most)
    small = F.broadcast if len(sizes) <= 100_000 else lambda df: df
    plan = {r.source: (r.n, target[r.source], target[r.source] / r.n if r.n else 0.0, r.merit / r.n if r.n else 0.0) for r in sums}
    about = small(spark.createDataFrame([(s, t, m) for s, (_, _, t, m) in plan.items()], "_s string, t double, mean double").coalesce(1))
    t = F.col("t")
    expected = F.least(F.greatest(t + F.least(t, F.lit(most) - t) * (merit - F.col("mean")) / 1000, F.lit(0.0)), F.lit(float(most)))
    u = uniform(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))

    def drawn(rows: DataFrame) -> DataFrame:
        """Rows with their certain copies and their rank for one more; null where there is none."""
        rows = rows.join(about, F.col("source").eqNullSafe(F.col("_s"))).withColumn("__mix_e", expected).withColumn("__mix_whole", F.floor("__mix_e"))
        p = F.col("__mix_e") - F.col("__mix_whole")
        return rows.withColumn("__mix_rank", F.when(p > 0, u / (1 - u) / (p / (1 - p)))).drop("_s", "t", "mean", "__mix_e")

    ranked = drawn(keys)
    certain = {r.source: r.n for r in ranked.groupBy("source").agg(F.sum(F.col("size") * F.col("__mix_whole")).alias("n")).collect()}
    rests = small(spark.createDataFrame([(s, target[s] - certain[s]) for s in plan], "_s string, rest double").coalesce(1))
    ranked = ranked.where("__mix_rank is not null").withColumnRenamed("__mix_rank", "rank").join(rests, F.col("source").eqNullSafe(F.col("_s")))
    part = F.col("rank") / (1 + F.col("rank"))

    # where the rest of each target falls: a range of parts, and the words before it
    border = {s: (0.0, 1.0, 0) for s in plan if target[s] > certain[s]}
    for _ in range(2):
        inside = ranked.join(_ranges(spark, border, small), F.col("source").eqNullSafe(F.col("_b"))).where((part >= F.col("lo")) & (part < F.col("hi")))
        place = F.least(F.floor((part - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS), F.lit(BINS - 1)).cast("int")
        bins = inside.groupBy("source", "before", "rest", "lo", "hi", place.alias("bin")).agg(F.sum("size").alias("words"))
        up = bins.withColumn("upto", F.col("before") + F.sum("words").over(Window.partitionBy("source").orderBy("bin")))  # at most BINS rows a source
        falls = up.where("upto >= rest").groupBy("source").agg(F.min(F.struct("bin", "upto", "words", "lo", "hi")).alias("x"))
        for r in falls.collect():
            x, width = r.x, (r.x.hi - r.x.lo) / BINS
            border[r.source] = (x.lo + x.bin * width - width * 1e-6, x.lo + (x.bin + 1) * width + width * 1e-6, None)
        lows = ranked.join(_ranges(spark, border, small), F.col("source").eqNullSafe(F.col("_b"))).where(part < F.col("lo"))
        sums = {r.source: r.n for r in lows.groupBy("source").agg(F.sum("size").alias("n")).collect()}
        border = {s: (lo, hi, sums.get(s, 0)) for s, (lo, hi, _) in border.items()}
    edge = ranked.join(_ranges(spark, border, small), F.col("source").eqNullSafe(F.col("_b"))).where((part >= F.col("lo")) & (part < F.col("hi")))
    ties = edge.groupBy("source", "rank", "before", "rest").agg(F.sum("size").alias("words"))
    upto = F.col("before") + F.sum("words").over(Window.partitionBy("source").orderBy("rank"))
    last = {r.source: r.rank for r in ties.withColumn("upto", upto).where(2 * F.col("upto") - F.col("words") <= 2 * F.col("rest")).groupBy("source").agg(F.max("rank").alias("rank")).collect()}
    cuts = [(s, n, goal, last.get(s), border[s][0] if s in border else None) for s, (n, goal, _, _) in plan.items()]
    decided = small(spark.createDataFrame(cuts, "__mix_s string, source_size long, target double, __mix_cut double, __mix_lo double").coalesce(1))
    out = drawn(sized).join(decided, F.col("source").eqNullSafe(F.col("__mix_s")))
    rank = F.col("__mix_rank")
    more = F.coalesce((rank <= F.col("__mix_cut")) | (rank / (1 + rank) < F.col("__mix_lo")), F.lit(False))
    taken = F.col("size") * (F.col("__mix_whole") + more.cast("int"))
    return out.select(*docs.columns, "size", "source_size", "target", taken.cast("long").alias("taken"))


def _ranges(spark, border, small) -> DataFrame:
    rows = [(s, lo, hi, before) for s, (lo, hi, before) in border.items()]
    return small(spark.createDataFrame(rows, "_b string, lo double, hi double, before long").coalesce(1))
