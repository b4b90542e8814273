"""The optional streaming layer: an event feed behind a cursor, windowed counts with late data, and batches of new files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def event_stream(spark: SparkSession, folder: str, schema: StructType, since: int | None = None) -> DataFrame:
    """Events of Parquet files as they arrive, past the cursor."""
    events = spark.readStream.schema(schema).parquet(folder)
    return events if since is None else events.filter(F.col("event_id") > since)


def windowed_counts(events: DataFrame, size: str = "1 day", late: str = "1 day") -> DataFrame:
    """Events by window and type; state older than the watermark goes."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def for_each_batch(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs a batch job (merge, validation, delivery) on what each trigger brings; ends when the input is used up."""
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
