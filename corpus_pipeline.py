"""A corpus pipeline: toxic documents go, one of each group of near copies stays, leaked benchmark items go, personal data is masked, sources are mixed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each result as Parquet and hands the table on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudloom.llm import leaks, mixing, near_text, private, toxicity
from cloudloom.llm.storage import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on all labelled ones, doesn't reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(toxicity.training_rows(docs, labels, F.lit(True)))
    return toxicity.score(docs.select(*COLUMNS), model).where("predicted = 0").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the least id; of repeated rows of it, one.

    A row with a null id stays only where its group has no id, one text of
    them: it is named by a hash of its text, from 2^62 on.
    """
    name = F.coalesce(F.col("doc_id").cast("long"), F.lit(1 << 62) + F.pmod(F.xxhash64("text"), F.lit(1 << 62)))
    rows = docs.select(*COLUMNS).withColumn("_name", name)
    kept = near_text.near_duplicates(rows.select(F.col("_name").alias("doc_id"), "text")).where("kept").select(F.col("doc_id").alias("_name")).distinct()
    return rows.join(kept, "_name", "left_semi").select(*COLUMNS).distinct()


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return leaks.find_leaks(docs.select(*COLUMNS), benchmark).where(F.size("matches") == 0).select(*COLUMNS)


def mask_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked and n_chars counted again."""
    masked = private.mask(docs.select(*COLUMNS), private.fit(docs))
    return masked.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with how often the mix takes each (``copies``)."""
    mixed = mixing.mix(docs.select(*COLUMNS), weights=[3, 1, 2])
    copies = F.when(F.col("size") > 0, (F.col("taken") / F.col("size")).cast("int")).otherwise(F.lit(0))
    return mixed.select("doc_id", "text", "lang", "source", "n_chars", "size", "source_size", "target", "taken", copies.alias("copies"))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_leaks),
    ("private_data", mask_private),
    ("source_mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs


ORACLE_SQL = None
