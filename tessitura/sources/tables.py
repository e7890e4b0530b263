"""Reading the given tables and the domain frames laid over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.sources.words import words_from_documents


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table of the folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def words(spark: SparkSession, folder: str) -> DataFrame:
    """The timed-word frame over ``documents``."""
    return words_from_documents(table(spark, folder, "documents"))


def event_clock(spark: SparkSession, folder: str) -> DataFrame:
    """``events`` with milliseconds since the first event; four streams."""
    events = table(spark, folder, "events")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    start = events.agg(F.min(micros).alias("_t0"))
    return events.join(F.broadcast(start)).select(
        (F.col("user_id") % 4).alias("stream_id"),
        "event_id",
        F.floor((micros - F.col("_t0")) / 1000).cast("long").alias("timestamp_ms"),
        "event_type",
        "value",
        "ts",
    )


def chat(spark: SparkSession, folder: str) -> DataFrame:
    """Chat messages over ``events``."""
    return event_clock(spark, folder).select(
        "stream_id", "event_id", "ts", (F.col("timestamp_ms") / F.lit(1000.0)).alias("timestamp_s"), F.col("event_type").alias("text")
    )
