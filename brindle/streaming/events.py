"""Windowed counts over the event table read as a stream."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed_counts(spark: SparkSession, sf_dir: str, size: str = "10 minutes", lateness: str = "1 day") -> DataFrame:
    """(start, event_type, n) of every window of the events, by a stream that ends when all input is read.

    Events go through a watermark, late ones within ``lateness`` count. Each batch writes the windows that it changed,
    with its number, to a table in the shared folder, whole or not at all and over what a failed try left; a window's
    last row there is its count. State is kept by key, in the stream's checkpoint there too; the driver holds no window.
    """
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    base = (spark.conf.get("spark.checkpoint.dir", None) or "/tmp/checkpoints").rstrip("/")
    root = f"{base}/events_{uuid.uuid4().hex}"
    path = f"{sf_dir}/events.parquet"
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path if not os.path.isfile(path) else sf_dir + "/events.parque[t]")
    stream = stream.withColumn("at", F.col("ts").cast("timestamp"))
    counts = stream.withWatermark("at", lateness).groupBy(F.window("at", size), "event_type").agg(F.count("*").alias("n"))
    changed = counts.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/windows/batch={number}")

    run = changed.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    windows = spark.read.schema("start timestamp_ntz, event_type string, n long, batch long").parquet(f"{root}/windows")
    return windows.groupBy("start", "event_type").agg(F.max_by("n", "batch").alias("n"))
