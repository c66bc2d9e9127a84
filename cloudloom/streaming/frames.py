"""Frames that arrive over time, each processed as the batch operators process it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "cloud_id string, frame timestamp, pid long, x double, y double, z double"


def read_frames(spark: SparkSession, folder: str, schema: str = SCHEMA, files_per_batch: int = 64) -> DataFrame:
    """A stream of Parquet files of points."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def occupied_cells(points: DataFrame, leaf: float, late: str = "10 minutes", width: str = "1 minute") -> DataFrame:
    """Points by cell of a fixed grid and window of time; a window is given out when it can't change any more."""
    cells = points.withWatermark("frame", late).withColumns({f"{c}i": F.floor(F.col(c) / leaf).cast("int") for c in "xyz"})
    return cells.groupBy(F.window("frame", width).alias("w"), "cloud_id", "xi", "yi", "zi").agg(F.count("*").alias("n")).select("w.start", "cloud_id", "xi", "yi", "zi", "n")


def each_batch(points: DataFrame, process: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Run a batch operator on every batch; a batch that is run again after a failure replaces its own output."""

    def write(batch: DataFrame, number: int) -> None:
        process(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return points.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
