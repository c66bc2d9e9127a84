"""The registered queries: each operator on its whole table, with the columns that its result is compared by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudloom.llm import katz, languages, leaks, mixing, near_text, near_vectors, private, suffixes, toxicity, urls

RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(modulus: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(modulus))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(_remainder(4) == 2, F.lit(False))
    model = toxicity.fit(toxicity.training_rows(docs, _table(spark, sf_dir, "labels"), ~held_out))
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op2_cross_polytope_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_duplicate_vectors(_table(spark, sf_dir, "embeddings"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"), weights=[3, 1, 2])
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and test item that it holds; clean documents have none."""
    found = leaks.find_leaks(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*")


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_text.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return private.find_private(docs, private.fit(docs))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"), RULES)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(_remainder(4) == 2, F.lit(False))
    model = languages.fit(docs, ~held_out)
    return languages.predict(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op9_katz_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = katz.score(_table(spark, sf_dir, "documents"), F.coalesce(_remainder(5) != 1, F.lit(True)))
    return scored.withColumn("held_out", F.coalesce(_remainder(5) == 1, F.lit(False)))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_strings(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i+4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s
  FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (
  SELECT a.doc_id AS u, b.doc_id AS v
  FROM e AS a JOIN e AS b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
r AS (
  SELECT doc_id, doc_id AS root FROM documents
  UNION SELECT p.v, r.root FROM r JOIN p ON r.doc_id = p.u),
c AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM s JOIN c USING (doc_id)
"""


OP3_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS n, [3.0::DOUBLE, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w
  FROM d GROUP BY source),
r AS (
  SELECT 1 AS step, source, n, w, NULL::DOUBLE AS target, 1.5::DOUBLE * sum(n) OVER () AS left_, sum(w) OVER () AS open_w FROM s
  UNION ALL
  SELECT step + 1, source, n, w, t,
    left_ - coalesce(sum(2.0::DOUBLE * n) FILTER (target IS NULL AND t IS NOT NULL) OVER (), 0),
    coalesce(sum(w) FILTER (t IS NULL) OVER (), 0)
  FROM (SELECT *, CASE WHEN target IS NOT NULL THEN target WHEN left_ * w / open_w > 2.0::DOUBLE * n THEN 2.0::DOUBLE * n END AS t FROM r WHERE open_w > 0 AND step <= (SELECT count(*) + 1 FROM s))),
e AS (SELECT * FROM r WHERE step = (SELECT max(step) FROM r)),
t AS (SELECT source, n, coalesce(target, left_ * w / open_w) AS target FROM e),
m AS (SELECT source, sum(size * ((1000 * size) // (size + 100)))::DOUBLE AS merit FROM d GROUP BY source),
p AS (SELECT t.*, CASE WHEN n > 0 THEN target / n ELSE 0 END AS avg_, CASE WHEN n > 0 THEN merit / n ELSE 0 END AS mean FROM t JOIN m ON t.source IS NOT DISTINCT FROM m.source),
x AS (
  SELECT d.*, p.n, p.target, least(greatest(avg_ + least(avg_, 2.0::DOUBLE - avg_) * ((1000 * size) // (size + 100) - mean) / 1000, 0.0::DOUBLE), 2.0::DOUBLE) AS e
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
k AS (
  SELECT *, floor(e) AS whole, e - floor(e) AS p, target - sum(size * floor(e)) OVER (PARTITION BY source) AS rest,
    (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM x),
o AS (SELECT *, CASE WHEN p > 0 THEN u / (1 - u) / (p / (1 - p)) END AS rank FROM k),
g AS (
  SELECT source, rank, 2 * sum(sum(size)) OVER (PARTITION BY source ORDER BY rank) - sum(size) <= 2 * any_value(rest) AS more
  FROM o WHERE rank IS NOT NULL GROUP BY source, rank)
SELECT o.doc_id, o.size, o.n::BIGINT AS source_size, o.target, (o.size * (o.whole + coalesce(g.more, false)::INT))::BIGINT AS taken
FROM o LEFT JOIN g ON o.source IS NOT DISTINCT FROM g.source AND o.rank = g.rank
"""


OP2_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e,
    coalesce(label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false) AS ok
  FROM embeddings),
p AS (
  SELECT a.vec_id AS u, b.vec_id AS v
  FROM v AS a JOIN v AS b ON a.label = b.label AND a.vec_id <> b.vec_id AND a.ok AND b.ok AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (
  SELECT vec_id, vec_id AS root FROM embeddings
  UNION SELECT p.v, r.root FROM r JOIN p ON r.vec_id = p.u),
c AS (SELECT vec_id, min(root) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT u, count(*) AS n_links FROM p GROUP BY u)
SELECT c.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, c.component_id, c.vec_id = c.component_id AS kept
FROM c LEFT JOIN n ON c.vec_id = n.u
"""


OP10_SQL = r"""
WITH d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS s FROM (SELECT doc_id, h, unnest(range(n - 99)) AS i FROM d WHERE n >= 100)),
g AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM w) WHERE k > 1),
j AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS new FROM g),
r AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM j),
s AS (SELECT doc_id, run, min(i) AS a, max(i) + 100 AS z FROM r GROUP BY doc_id, run),
p AS (SELECT doc_id, run, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY run), 0) AS before FROM s),
t AS (SELECT doc_id, sum(z - a) AS removed, count(*) AS spans, max(z) AS last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY run) AS kept FROM p JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept || substr(h, 2 * last + 1), h))) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)
"""


def _op7_sql() -> str:
    parse = r"regexp_extract(coalesce({0}, ''), '(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?', {1})"
    parts = lambda c: f"translate({parse.format(c, 1)}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, {parse.format(c, 2)} AS path, {parse.format(c, 3)} AS query"
    ordered = sorted(RULES, key=lambda r: -len(r[1]))
    fits = lambda r: "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '/{1}')".format(*r.split("/", 1))
    rule = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r}'" for _, r in ordered) + " END"
    action = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{a}'" for a, r in ordered) + " END"
    value = lambda name: " || ".join(rf"""regexp_extract(t, '(?is)\b{name}\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))', {k})""" for k in (1, 2, 3))
    return rf"""
WITH RECURSIVE k AS (SELECT page_id, url, html, {parts("url")} FROM pages),
n AS (SELECT *, {rule} AS rule, {action} AS action, concat_ws(chr(1), host, path, query) AS node FROM k),
g AS (SELECT node, action, host, path, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS t FROM n WHERE host <> '' AND regexp_matches(html, '(?i)canonical|http-equiv')),
l AS (SELECT node, action, host, path, CASE WHEN regexp_matches(t, '(?is)^<link\b') AND regexp_matches(lower({value("rel")}), '(^|\s)canonical(\s|$)') THEN trim({value("href")})
  WHEN regexp_matches(t, '(?is)^<meta\b') AND lower({value("http-equiv")}) = 'refresh' THEN regexp_extract({value("content")}, '(?is)url\s*=\s*[''"]?\s*([^''"\s]+)', 1) END AS link FROM g),
f AS (SELECT *, CASE WHEN regexp_extract(path, '(?s)^(.*/)', 1) = '' THEN '/' ELSE regexp_extract(path, '(?s)^(.*/)', 1) END AS folder FROM l WHERE link <> ''),
r AS (SELECT node, action, CASE WHEN regexp_matches(link, '(?i)^[a-z][a-z0-9+.-]*://') THEN link WHEN starts_with(link, '//') THEN 'http:' || link WHEN starts_with(link, '/') THEN 'http://' || host || link
  WHEN link[1] IN ('#', '?') THEN 'http://' || host || path || link WHEN NOT regexp_matches(link, '(?i)^[a-z][a-z0-9+.-]*:') THEN 'http://' || host || folder || link END AS link FROM f),
x AS (SELECT node AS u, action AS a, {parts("link")} FROM r),
e AS (SELECT u, a, concat_ws(chr(1), host, path, query) AS v, {action} AS b FROM x WHERE host <> ''),
b AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
c AS (SELECT u AS node, u AS root FROM b UNION SELECT b.v, c.root FROM c JOIN b ON c.node = b.u),
o AS (SELECT node, min(root) AS root FROM c GROUP BY node),
m AS (SELECT u AS node, a AS action FROM e UNION SELECT v, b FROM e),
d AS (SELECT root FROM m JOIN o USING (node) GROUP BY root HAVING count(*) FILTER (action = 'block') > 0 AND count(*) FILTER (action = 'allow') = 0)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN host <> '' AND node IN (SELECT node FROM o JOIN d USING (root)) THEN 'block' ELSE 'allow' END) AS verdict FROM n
"""


OP7_SQL = _op7_sql()


def oracle_sql() -> dict[str, str]:
    return {"op7_url_filters": OP7_SQL, "op10_suffix_array_dedup": OP10_SQL, "op2_cross_polytope_dedup": OP2_SQL, "op3_source_mixing": OP3_SQL, "op5_minhash_near_dedup": OP5_SQL}
