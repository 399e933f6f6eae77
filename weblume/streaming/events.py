"""Streams of events or results: windowed counts with a watermark. The checks themselves have no streaming; this is an extension."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import delete_at_end, shared_folder


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, event_type, n and total of tumbling windows; batch and stream alike."""
    return (
        events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")
    )


def run_counts(spark: SparkSession, folder: str, pattern: str = "*.parquet", size: str = "1 hour") -> DataFrame:
    """All files of events in a folder as a stream, to the end; the windows as a table, the last update of each.

    Updates and their checkpoint go to the shared folder of the session.
    """
    out = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    delete_at_end(spark, out)
    schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", 64).parquet(folder)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/data/batch={number}")

    windowed_counts(stream, size).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    updates = spark.read.parquet(f"{out}/data")
    return updates.groupBy("start", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("x")).select("start", "event_type", "x.n", "x.total")
