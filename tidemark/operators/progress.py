"""Event-time progress in a replayed table.

A row sees the progress made by the rows that arrived before it. Two views of the same thing:

* per row, as a column (``watermark_*``): a running maximum over the arrival order;
* turned around (``first_reached``): for a bound ``x``, the arrival position at which progress
  first reaches ``x``. A row is late for ``x`` exactly if it arrives after that position.

The second view needs no order at all: it is a minimum per bound plus a minimum over all
higher bounds, so lateness is decided with hash aggregates and one lookup per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.running import MAX_GROUP_ROWS, Running, running
from tidemark.session import in_ranges


def watermark_per_record(
    df: DataFrame, time: str, pos: str | list[str], name: str = "wm_before", max_group_rows: int = MAX_GROUP_ROWS
) -> DataFrame:
    """Largest event time among the rows that arrived before; NULL for the first row."""
    return running(df, [], pos, {name: Running("max", time, inclusive=False)}, max_group_rows)


def stream_time(
    df: DataFrame, time: str, pos: str | list[str], name: str = "stream_time", max_group_rows: int = MAX_GROUP_ROWS
) -> DataFrame:
    """Largest event time up to and including the row."""
    return running(df, [], pos, {name: Running("max", time)}, max_group_rows)


def watermark_punctuated(
    df: DataFrame,
    time: str,
    pos: str | list[str],
    is_control: Column,
    name: str = "wm_before",
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Progress that only control rows move."""
    marked = df.withColumn("_control_time", F.when(is_control, F.col(time)))
    return running(
        marked, [], pos, {name: Running("max", "_control_time", inclusive=False)}, max_group_rows
    ).drop("_control_time")


def watermark_with_lag(
    df: DataFrame,
    time: str,
    pos: str | list[str],
    lag: int,
    every: int | None = None,
    name: str = "wm_before",
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Progress that trails the largest event time by ``lag``.

    ``every=n`` publishes it only after each n-th arrival (a periodic watermark; the replay
    counts arrivals, it has no wall clock). Between two publications the value stays.
    """
    if every is None:
        return watermark_per_record(df, time, pos, "_seen", max_group_rows).withColumn(
            name, F.col("_seen") - F.lit(lag)
        ).drop("_seen")
    seen = running(
        df,
        [],
        pos,
        {"_arrival": Running("count"), "_seen": Running("max", time)},
        max_group_rows,
    ).withColumn("_published", F.when(F.col("_arrival") % every == 0, F.col("_seen")))
    return (
        running(seen, [], pos, {"_last": Running("max", "_published", inclusive=False)}, max_group_rows)
        .withColumn(name, F.col("_last") - F.lit(lag))
        .drop("_arrival", "_seen", "_published", "_last")
    )


def timestamp_or_progress(
    df: DataFrame, raw_time: str, pos: str | list[str], name: str = "event_time", max_group_rows: int = MAX_GROUP_ROWS
) -> DataFrame:
    """Event time parsed from text; a row that does not parse takes the progress made so far."""
    parsed = df.withColumn("_parsed", F.trim(F.col(raw_time)).try_cast("bigint"))
    return (
        running(parsed, [], pos, {"_progress": Running("max", "_parsed", inclusive=False)}, max_group_rows)
        .withColumn(name, F.coalesce("_parsed", "_progress"))
        .drop("_parsed", "_progress")
    )


def first_reached(
    observed: DataFrame, probes: DataFrame, bound: str, pos: str, name: str, small: bool = False
) -> DataFrame:
    """For every ``bound`` in ``probes``: the smallest ``pos`` in ``observed`` at that bound or a
    higher one, as column ``name`` (NULL if progress never gets there).

    A suffix minimum over one row per bound. If the caller knows that there are few bounds
    (``small``) one window does it; otherwise two levels, within blocks of bounds in parallel
    and over the block minima. Blocks are ranges of about equally many bounds, however far apart they lie.
    """
    no_pos = F.lit(None).cast(observed.schema[pos].dataType)
    points = (
        observed.select(bound, F.col(pos).alias("_pos"), F.lit(False).alias("_probe"))
        .unionByName(probes.select(bound, no_pos.alias("_pos"), F.lit(True).alias("_probe")))
        .groupBy(bound)
        .agg(F.min("_pos").alias("_pos"), F.max("_probe").alias("_probe"))
    )
    upwards = (Window.unboundedPreceding, Window.currentRow)
    if small:
        suffix = F.min("_pos").over(Window.orderBy(F.desc(bound)).rowsBetween(*upwards))
        return points.withColumn(name, suffix).filter("_probe").select(bound, name)
    points = in_ranges(points, [bound], "_block")
    blocks = (
        points.groupBy("_block")
        .agg(F.min("_pos").alias("_block_pos"))
        .select(
            F.col("_block").alias("_of_block"),
            F.min("_block_pos")
            .over(Window.orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1))
            .alias("_after_block"),
        )
    )
    inside = Window.partitionBy("_block").orderBy(F.desc(bound)).rowsBetween(*upwards)
    return (
        points.withColumn("_within", F.min("_pos").over(inside))
        .filter("_probe")
        .join(F.broadcast(blocks), F.col("_block") == F.col("_of_block"))  # a row for each shuffle partition
        .select(bound, F.least("_within", "_after_block").alias(name))
    )
