"""Readers: text files and folders, in batch and as a stream, and a log topic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.lateness import SlidingPolicy
from tidemark.operators.running import MAX_GROUP_ROWS, Running, running
from tidemark.operators.session_policies import SessionPolicy
from tidemark.sources.parsing import ParsePolicy, parse_lines


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a file or folder with what orders them by arrival: file time, file, place in it."""
    return spark.read.text(path).select(
        "value",
        F.struct(
            F.col("_metadata.file_modification_time").alias("file_time"),
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            # within one block of a file this number rises with the line
            F.monotonically_increasing_id().alias("line"),
        ).alias("arrival"),
    )


def read_events(
    spark: SparkSession, path: str, policy: ParsePolicy | str = "spark", max_group_rows: int = MAX_GROUP_ROWS
) -> DataFrame:
    """Parsed events of a file or folder with ``pos``, their arrival number (from 1)."""
    parsed = parse_lines(read_lines(spark, path), policy, keep=["arrival"])
    return running(parsed, [], ["arrival"], {"pos": Running("count")}, max_group_rows).drop("arrival")


def ensure_folder(spark: SparkSession, folder: str) -> str:
    """Create a folder that is to be watched, on whatever store it is, if it is not there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    return folder


def stream_lines(
    spark: SparkSession, folder: str, files_per_trigger: int | None = None, arrival: str | None = None
) -> DataFrame:
    """New files of a folder as a stream of lines, oldest file first; ``files_per_trigger`` limits a batch. The folder is
    created if it is not there.

    ``arrival`` names a LONG column for the time the line's file was written, in microseconds: what a live policy takes
    as order within a batch. Lines of one file have no order on a stream.
    """
    reader = spark.readStream.format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    lines = reader.load(ensure_folder(spark, folder))
    return lines.select("value", F.unix_micros("_metadata.file_modification_time").alias(arrival)) if arrival else lines


def stream_events(
    spark: SparkSession, folder: str, policy: ParsePolicy | str = "spark", files_per_trigger: int | None = None,
    arrival: str | None = None,
) -> DataFrame:
    """Parsed events of a watched folder. Lines without a usable time are dropped: a stream has
    no arrival order to take a time from."""
    lines = stream_lines(spark, folder, files_per_trigger, arrival)
    return parse_lines(lines, policy, keep=[arrival] if arrival else None).filter("event_time IS NOT NULL")


def topic_options(servers: str, topic: str, starting: str = "earliest", **options: str) -> dict[str, str]:
    """Options of a log topic source. The connector has to be on the class path."""
    return {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": starting, **options}


def stream_topic(
    spark: SparkSession, servers: str, topic: str, policy: ParsePolicy | str = "kafka", **options: str
) -> DataFrame:
    """Parsed events of a log topic, with ``partition`` and ``offset``: the order of arrival within a partition."""
    raw = spark.readStream.format("kafka").options(**topic_options(servers, topic, **options)).load()
    lines = raw.select(F.col("value").cast("string").alias("value"), "partition", "offset")
    return parse_lines(lines, policy, keep=["partition", "offset"])


def with_flush_row(
    events: DataFrame, closes: SlidingPolicy | SessionPolicy, control_key: str = "W"
) -> DataFrame:
    """Batch events plus one control row, arriving last and so far after the last event that it closes every window
    or session that is still open under the policy ``closes`` (in milliseconds). Columns other than time, key and
    ``pos`` are NULL."""
    horizon_ms = closes.horizon
    flush = events.agg(F.max("ts_ms").alias("ts_ms"), F.max("pos").alias("pos")).select(
        *[
            {
                "ts_ms": (F.col("ts_ms") + horizon_ms).alias("ts_ms"),
                "pos": (F.col("pos") + 1).cast(events.schema["pos"].dataType).alias("pos"),
                "key": F.lit(control_key).alias("key"),
                "event_time": F.timestamp_millis(F.col("ts_ms") + horizon_ms).alias("event_time"),
            }.get(f.name, F.lit(None).cast(f.dataType).alias(f.name))
            for f in events.schema.fields
        ]
    ).filter(F.col("ts_ms").isNotNull())
    return events.unionByName(flush)
