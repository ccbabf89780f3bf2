"""Windowed counts on a stream, with Spark's own watermark, windows and state.

Progress on a stream is the largest event time of the finished micro-batches (minus the
watermark delay), so a live query agrees with the ``spark`` profile of the replay, and with the
per-record profiles only if every batch holds one row.

Control rows must keep moving the watermark. A filter on the key would be pushed below it, so
they are counted as zero and the empty results are left out after the aggregation, by the
count and not by the key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.routing import is_control
from tidemark.operators.windows import native_session, window_bounds_ms


def with_progress(df: DataFrame, time: str = "event_time", delay: str = "0 milliseconds") -> DataFrame:
    """Declare the event time and how long progress waits for late rows (lag, or grace)."""
    if dict(df.dtypes)[time] == "timestamp_ntz":
        df = df.withColumn(time, F.col(time).cast("timestamp"))
    return df.withWatermark(time, delay)


def with_punctuated_progress(
    df: DataFrame, control_key: str, time: str = "event_time", key: str = "key", ignore_case: bool = False
) -> DataFrame:
    """Only the data rows, below a progress that only control rows move.

    The watermark is declared on a column that has a time in control rows alone; a missing time doesn't move it. Control
    rows are told from data rows by that column, since a filter on it stays above the watermark, where one on the key would be
    pushed below. Progress is the stream's, not a key's, so it reaches the timers of every key.
    """
    control = is_control(key, control_key, ignore_case)
    moved = df.withColumn("_moves", F.when(control, F.col(time).cast("timestamp")))
    return moved.withWatermark("_moves", "0 milliseconds").filter(F.col("_moves").isNull()).drop("_moves")


def live_sliding_counts(
    events: DataFrame,
    size: str,
    slide: str | None = None,
    keys: list[str] | None = None,
    time: str = "event_time",
    delay: str = "0 milliseconds",
    control_key: str | None = None,
    key: str = "key",
    ignore_case: bool = False,
) -> DataFrame:
    """Count per sliding (``slide`` left out: tumbling) window and key."""
    keys = ["key"] if keys is None else keys
    window = F.window(time, size, slide) if slide else F.window(time, size)
    grouped = with_progress(events, time, delay).groupBy(window.alias("win"), *keys)
    if control_key is None:
        return window_bounds_ms(grouped.count(), keys)
    counted = F.sum(F.when(is_control(key, control_key, ignore_case), 0).otherwise(1)).alias("count")
    return window_bounds_ms(grouped.agg(counted), keys).filter("count > 0")


def live_session_counts(
    events: DataFrame,
    gap: str,
    keys: list[str] | None = None,
    time: str = "event_time",
    delay: str = "0 milliseconds",
    control_key: str | None = None,
    key: str = "key",
    keep_empty: bool = True,
) -> DataFrame:
    """Count per session and key. Sessions of control rows count zero; ``keep_empty=False`` leaves
    them out."""
    keys = ["key"] if keys is None else keys
    counted = None if control_key is None else ~is_control(key, control_key)
    result = native_session(with_progress(events, time, delay), time, gap, keys, counted)
    return result if keep_empty else result.filter("count > 0")


def merge_sessions_early(spark: SparkSession) -> SparkSession:
    """Merge session rows inside each partition before they are shuffled: less to move for keys
    with many rows per session."""
    spark.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    return spark
