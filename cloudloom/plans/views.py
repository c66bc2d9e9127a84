"""The driver tables seen as points, descriptors and images, for Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def emb(spark, d) -> DataFrame:
    e = F.col("embedding")
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("pid"), *(e[k].cast("double").alias(c) for k, c in enumerate("xyz")), "label", *(F.floor((e[k].cast("double") + 1) * 127.5).cast("int").alias(c) for k, c in ((3, "r"), (4, "g"), (5, "b"))))


def part(spark, d) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("pid"), F.col("p_brand").alias("cloud_id"), F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") - 900).alias("y"), (F.col("p_partkey") % 50).cast("double").alias("z"))


def event(spark, d) -> DataFrame:
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").select(F.col("event_id").alias("pid"), F.col("event_type").alias("cloud_id"), ((micros - 1704067200000000) / 3.6e10).alias("x"), F.col("user_id").cast("double").alias("y"), F.col("value").alias("z"))


def desc(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("obj_id"), F.transform("embedding", lambda v: v.cast("double")).alias("features"), "label")


def cells(df: DataFrame, leaf: float, origin: float = -1.0) -> DataFrame:
    """Distinct cells of a fixed grid."""
    return df.select(*(((F.col(c) - origin) / leaf).cast("int").alias(f"{c}i") for c in "xyz")).distinct()


EMB = """SELECT vec_id AS pid, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, label,
  floor((embedding[4]::DOUBLE + 1) * 127.5)::INT AS r, floor((embedding[5]::DOUBLE + 1) * 127.5)::INT AS g, floor((embedding[6]::DOUBLE + 1) * 127.5)::INT AS b FROM embeddings"""
PART = "SELECT p_partkey AS pid, p_brand AS cloud_id, p_size::DOUBLE AS x, p_retailprice - 900 AS y, (p_partkey % 50)::DOUBLE AS z FROM part"
EVENT = "SELECT event_id AS pid, event_type AS cloud_id, (epoch_us(ts) - 1704067200000000) / 3.6e10 AS x, user_id::DOUBLE AS y, value AS z FROM events"
DESC = "SELECT vec_id AS obj_id, embedding::DOUBLE[] AS features, label FROM embeddings"
CELLS = "SELECT DISTINCT trunc((x + 1) / {leaf})::INT AS xi, trunc((y + 1) / {leaf})::INT AS yi, trunc((z + 1) / {leaf})::INT AS zi FROM p"
