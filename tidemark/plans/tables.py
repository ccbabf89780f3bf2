"""The event table and its disordered replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.ticks import arrival_position, epoch_micros, floor_div
from tidemark.session import pin_utc

MINUTE_US = 60_000_000


def events(spark: SparkSession, folder: str) -> DataFrame:
    """``event_id, user_id, key, value, us``: the events with their time in microseconds."""
    return (
        pin_utc(spark)
        .read.parquet(f"{folder}/events.parquet")
        .select("event_id", "user_id", F.col("event_type").alias("key"), "value", epoch_micros(F.col("ts")).alias("us"))
    )


def delay_us(event_id: Column) -> Column:
    """Up to an hour of delay, fixed per event."""
    return (event_id * 7919) % 3600 * 1_000_000


def replay(spark: SparkSession, folder: str) -> DataFrame:
    """Events out of order: time as a minute number ``t``, and the arrival ``pos`` / ``batch``
    (an hour of arrivals) after a delay."""
    arrival = F.col("us") + delay_us(F.col("event_id"))
    return (
        events(spark, folder)
        .withColumn("arrival", arrival)
        .withColumns(
            {
                "t": floor_div(F.col("us"), MINUTE_US),
                "pos": arrival_position(F.col("arrival"), F.col("event_id")),
                "batch": floor_div(F.col("arrival"), 60 * MINUTE_US),
            }
        )
    )
