"""MinHash near-duplicates by an inverted join on signature coordinates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudloom.llm import kernels
from cloudloom.operators.graph import connected_components
from cloudloom.llm.storage import discard, materialize, partitions, short_batches

U64 = np.uint64
BLOCK = 4096  # members of a posting list that are compared at once


def _read(batches, width: int, coordinates: int, with_sets: bool):
    """Per row: id, size of the set, two independent 64-bit names of the set, and its signature or the set itself."""
    rng = np.random.default_rng(20240501)
    factors = rng.integers(0, 2**63, coordinates, dtype=np.uint64) * U64(2) + U64(1)
    for batch in batches:
        for i, j, data, at in kernels.text_slices(batch.column("text")):
            hashes, begins = kernels.words(data, at)
            sets, ends = kernels.shingles(hashes, begins, width)
            n = np.diff(ends)
            full = np.flatnonzero(n)
            one, two = np.zeros(len(n), U64), np.zeros(len(n), U64)
            if len(full):
                where = ends[:-1][full]
                one[full] = kernels.mix(np.add.reduceat(sets, where) + n[full].astype(U64))
                two[full] = kernels.mix(np.add.reduceat(kernels.mix(sets ^ U64(0xA5A5A5A5A5A5A5A5)), where))
            ids = batch.column("doc_id").slice(i, j - i)
            named = [pa.array(n, pa.int64()), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))]
            if with_sets:
                raw = sets.tobytes()
                yield pa.RecordBatch.from_arrays([*named[1:], pa.array([raw[8 * ends[r] : 8 * ends[r + 1]] for r in range(len(n))], pa.binary())], names=["one", "two", "words"])
                continue
            sig = np.zeros((len(n), coordinates), np.int64)
            if len(full):
                for k in range(coordinates):
                    sig[full, k] = np.minimum.reduceat(sets * factors[k], where).view(np.int64)
            flat = pa.ListArray.from_arrays(np.arange(len(n) + 1, dtype=np.int32) * coordinates, pa.array(sig.reshape(-1)))
            yield pa.RecordBatch.from_arrays([ids, *named, flat], names=["doc_id", "n_shingles", "one", "two", "sig"])


def _common(batches, num: int, den: int):
    """Keep the pairs whose full sets are similar enough."""
    for batch in batches:
        a, b = batch.column("a_words"), batch.column("b_words")
        keep = np.zeros(batch.num_rows, bool)
        for r in range(batch.num_rows):
            x, y = (np.frombuffer(c[r].as_buffer(), U64) for c in (a, b))
            keep[r] = den * min(len(x), len(y)) >= num * max(len(x), len(y)) and _similar(x, y, num, den)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["u", "v"]).filter(pa.array(keep))


def _similar(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    both = np.concatenate([x, y])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return den * shared >= num * (len(both) - shared)


def _meetings(table: pa.Table, matches: int):
    """For each pair of blocks of a posting list: the rows, and pairs of them from different components that agree in ``matches`` coordinates and meet in no earlier list, best first."""
    comp, own, p, q, tok, mask = (table.column(k).to_numpy() for k in ("comp", "own", "p", "q", "tok", "mask"))
    sig = np.stack(table.column("sig").to_numpy())
    begins = kernels.runs(table, ["tok", "p", "q"])
    bits = np.int64(1) << np.arange(sig.shape[1], dtype=np.int64)
    for s, e in zip(begins[:-1], begins[1:], strict=True):
        if e - s < 2 or (comp[s:e] == comp[s]).all():
            continue
        left = np.arange(s, e)[own[s:e] == p[s]]
        right = np.arange(s, e)[own[s:e] == q[s]]
        if not len(left) or not len(right):
            continue
        here = int(np.argmax(sig[s] == tok[s]))
        earlier = (np.int64(1) << np.int64(here)) - 1
        found = []
        for x in range(0, len(left), 64):
            l = left[x : x + 64]
            near = comp[l][:, None] != comp[right][None]
            if p[s] == q[s]:
                near &= l[:, None] < right[None]
            i, j = np.nonzero(near)
            for y in range(0, len(i), 100_000):
                li, rj = l[i[y : y + 100_000]], right[j[y : y + 100_000]]
                same = sig[li] == sig[rj]
                n = same.sum(1)
                ok = np.flatnonzero(n >= matches)
                before = (same[ok] * bits).sum(1) & mask[li[ok]] & mask[rj[ok]] & earlier
                ok = ok[before == 0]
                found.append((li[ok], rj[ok], n[ok]))
        if found:
            a, b, n = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(-n, kind="stable")
            yield s, e, a[order], b[order]


def _collisions(batches, matches: int):
    """Of the pairs that meet, enough to join all that they join."""
    for table in kernels.groups_in(batches, ["tok", "p", "q"]):
        cid = table.column("cid").to_numpy()
        for s, e, a, b in _meetings(table, matches):
            t = kernels.forest(e - s, a - s, b - s)
            x, y = cid[a[t]], cid[b[t]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])


def _settle(batches, matches: int, num: int, den: int):
    """Confirm the pairs that meet on their full sets, unless confirmed links of the block have joined them already; the links."""
    for table in kernels.groups_in(batches, ["tok", "p", "q"]):
        cid, comp = table.column("cid").to_numpy(), table.column("comp").to_numpy()
        words = table.column("words").combine_chunks()
        for s, e, a, b in _meetings(table, matches):
            sets = [np.frombuffer(words[r].as_buffer(), U64) for r in range(s, e)]
            size = np.array([len(x) for x in sets])
            x, y = a - s, b - s
            able = den * np.minimum(size[x], size[y]) >= num * np.maximum(size[x], size[y])
            x, y = x[able], y[able]
            root = np.unique(comp[s:e], return_inverse=True)[1]
            links = []
            for i, j in zip(x.tolist(), y.tolist(), strict=True):
                if root[i] != root[j] and _similar(sets[i], sets[j], num, den):
                    links.append((i, j))
                    root[root == root[j]] = root[i]
            if links:
                i, j = np.array(links).T
                yield pa.RecordBatch.from_arrays([pa.array(cid[s:e][i]), pa.array(cid[s:e][j])], names=["u", "v"])


def near_duplicates(docs: DataFrame, width: int = 5, num: int = 75, den: int = 100, coordinates: int = 32, matches: int = 13) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of ``docs`` (doc_id, text; other columns are ignored).

    Documents are linked when ``den * |A & B| >= num * |A | B|`` for their sets
    of distinct ``width``-word shingles (A-Z lower-cased); component_id is the
    least doc_id that links reach.  A set's MinHash signature has
    ``coordinates`` values.  Two sets with similarity 0.75 agree in fewer than
    13 of 32 with a probability of 8e-6.

    * Equal sets form a class, of which one set goes on.  Sets are known to be
      equal by 128 bits of their shingles, classes by a number.
    * A class is posted under each signature value that another class has too.
      Of its values, sorted by how many classes share them, only the first
      ``coordinates - matches + 1`` make pairs: two classes that agree in
      ``matches`` values meet there.  The long lists are skipped; they count
      only when the signatures of two classes that met are compared.
    * First each class is compared with the least class of the list it shares
      most often, then with what a forest of the best matches in each list
      names; both are linear in the postings.  Last, all pairs of a list that
      agree in enough values and are still in different components are
      confirmed in place, in blocks of bounded size, each pair in the first
      list where it meets.  Every link is confirmed on the full sets.

    Null or empty texts and texts of white space have an empty set, no links
    and themselves as component.  With fewer words than ``width`` all of them
    are one shingle.  Repeated rows are equal sets.  A row with a null doc_id
    may connect others, takes their component_id and is never kept.  An empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    short_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    read = materialize(rows.mapInArrow(lambda it: kernels.tidily(_read(it, width, coordinates, False)), "doc_id long, n_shingles long, one long, two long, sig array<long>"), "signatures")
    grouped = read.where("n_shingles > 0").groupBy("one", "two").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"))
    classes = materialize(grouped.withColumn("cid", F.monotonically_increasing_id()), "classes")

    tokens = classes.select("cid", F.explode("sig").alias("tok"))
    shared = tokens.groupBy("tok").agg(F.count("*").alias("n")).where("n > 1")
    ranked = tokens.join(shared, "tok").groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("n", "tok"))).alias("t"))
    posted = F.size("t") - F.lit(matches - 1)  # a value that no other class has comes first in the order, and makes no pair
    postings = materialize(ranked.where(posted > 0).select("cid", F.explode(F.slice("t", F.lit(1), posted)).alias("e")).select("cid", "e.tok"), "postings")

    met = classes.join(postings.select("cid").distinct(), "cid", "left_semi").select("cid", "one", "two", "rep")
    asked = rows.join(met.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").unionAll(rows.where("doc_id is null"))  # a class may have no id
    held = asked.mapInArrow(lambda it: kernels.tidily(_read(it, width, 0, True)), "one long, two long, words binary")
    sets = materialize(held.join(met.select("cid", "one", "two"), ["one", "two"]).select("cid", "words").dropDuplicates(["cid"]), "sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        a = sets.select(F.col("cid").alias("a"), F.col("words").alias("a_words"))
        b = sets.select(F.col("cid").alias("b"), F.col("words").alias("b_words"))
        return pairs.join(a, "a").join(b, "b").select("a", "b", "a_words", "b_words").mapInArrow(lambda it: kernels.tidily(_common(it, num, den)), "u long, v long")

    least = postings.groupBy("tok").agg(F.min("cid").alias("a"), F.count("*").alias("n")).where("n > 1").select("tok", "a")
    stars = postings.join(least, "tok").where("cid <> a").groupBy("cid", "a").agg(F.count("*").alias("n"))
    best = stars.groupBy("cid").agg(F.max_by("a", F.struct("n", "a")).alias("a")).select("a", F.col("cid").alias("b"))
    first = materialize(confirmed(best), "links")

    placed = postings.join(classes.select("cid", "sig"), "cid").select("cid", F.expr("shiftleft(1L, cast(array_position(sig, tok) as int) - 1)").alias("bit"))
    known = classes.select("cid", "sig").join(placed.groupBy("cid").agg(F.bit_or("bit").alias("mask")), "cid")

    def mixed(links: DataFrame, extra: DataFrame | None) -> DataFrame:
        """The lists whose members are in several components of ``links``, dealt in pairs of blocks."""
        comps = connected_components(links)
        placed = postings.join(comps, F.col("cid") == F.col("node"), "left").select("tok", "cid", F.coalesce("component", "cid").alias("comp"))
        lists = placed.groupBy("tok").agg(F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
        blocks = F.ceil(F.col("n") / BLOCK).cast("int")
        spread = placed.join(lists, "tok").select("tok", "cid", "comp", blocks.alias("k"), F.pmod(F.xxhash64("cid"), blocks).cast("int").alias("own")).join(known, "cid")
        if extra is not None:
            spread = spread.join(extra, "cid")
        dealt = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).withColumns({"p": F.least("own", "other"), "q": F.greatest("own", "other")}).drop("other", "k")
        return dealt.repartition(partitions(spark), "tok", "p", "q").sortWithinPartitions("tok", "p", "q", "cid")

    pairs = mixed(first, None).mapInArrow(lambda it: kernels.tidily(_collisions(it, matches)), "a long, b long").distinct()
    first = materialize(first.unionAll(confirmed(pairs)), "links")
    second = materialize(mixed(first, sets).mapInArrow(lambda it: kernels.tidily(_settle(it, matches, num, den)), "u long, v long"), "links")

    comps = connected_components(first.unionAll(second))
    for table in (postings, sets, first, second):
        discard(table)
    rooted = classes.select("cid", "one", "two", "rep").join(comps, F.col("cid") == F.col("node"), "left").select("one", "two", "rep", F.coalesce("component", "cid").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("rep").alias("component_id")), "root").select("one", "two", "component_id")
    out = read.select("doc_id", "n_shingles", "one", "two").join(named, ["one", "two"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))
