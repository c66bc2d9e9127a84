"""Tables that cut lineage, and what the session is told."""

from __future__ import annotations

from pyspark.sql import SparkSession

from cloudloom.functions.tables import discard, materialize, shared_folder

__all__ = ["discard", "materialize", "partitions", "shared_folder", "short_batches"]

BATCH_ROWS = 2500


def short_batches(spark: SparkSession) -> None:
    """From now on let Spark hand at most ``BATCH_ROWS`` rows at once to Python in this session: texts are long, and each batch is held in the JVM, on the way and in Python."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def partitions(spark: SparkSession) -> int:
    """How many partitions a shuffle makes here."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
