"""Structured Streaming: incremental ingestion into postings, first-seen records, windowed and session usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.functions import text as T
from tamarack.operators import ranking as R


def stream_table(spark: SparkSession, folder: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def first_seen(stream: DataFrame, time: str, key: Column, delay: str = "1 hour") -> DataFrame:
    """Each key once within the watermark; state is kept for ``delay`` only."""
    return stream.withColumn("_key", key).withWatermark(time, delay).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def windowed_counts(events: DataFrame, time: str, by: str, width: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    grouped = events.withWatermark(time, delay).groupBy(F.window(time, width), by)
    return grouped.agg(F.count("*").alias("events"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), by, "events", "value")


def sessions(events: DataFrame, time: str, user: str, gap: str = "30 minutes", delay: str = "2 hours") -> DataFrame:
    grouped = events.withWatermark(time, delay).groupBy(F.session_window(time, gap), user)
    return grouped.agg(F.count("*").alias("events")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), user, "events")


def ingest_postings(docs: DataFrame, text: str, path: str, checkpoint: str):
    """Starts a query that appends each batch's postings; a batch that is run again overwrites its own folder only."""

    def write(batch: DataFrame, number: int) -> None:
        R.postings(batch, T.legal_tokens(F.col(text))).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_memory(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a bounded stream to its end and gives the result as a table; for tests and small reports."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
