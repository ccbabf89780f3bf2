"""Sliding windows over row counts, in arrival order.

A window of ``size`` rows fires at every ``slide``-th row of its group and covers the last
``size`` rows up to there; rows after the last firing never fire. Rows are first aggregated
to slices of ``gcd(size, slide)`` row numbers; the few slices, not the rows, go to the firings
that cover them. Only the row number needs the order, and ``running`` spreads a hot key over
many tasks for that.
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ticks import floor_div
from tidemark.operators.running import MAX_GROUP_ROWS, Running, running
from tidemark.operators.windows import Agg, Aggregate, finished_columns, merged_columns, partial_columns


def count_windows(
    df: DataFrame,
    time: str,
    pos: str | list[str],
    size: int,
    slide: int,
    keys: list[str],
    max_group_rows: int = MAX_GROUP_ROWS,
    aggs: dict[str, Aggregate] | None = None,
) -> DataFrame:
    """``keys, firing`` and the results of ``aggs`` (if not given: ``min_ts, max_ts, count``): ``firing`` is the row number that
    fired the window."""
    order = [pos] if isinstance(pos, str) else pos
    rows = df.select(*keys, time, *order) if aggs is None else df
    aggs = aggs or {"min_ts": Agg("min", F.col(time)), "max_ts": Agg("max", F.col(time)), "count": Agg("count")}
    numbered = number_rows(rows, order, keys, max_group_rows)
    slices = numbered.groupBy(*keys, slice_of(size, slide)).agg(*partial_columns(aggs), F.max("_rn").alias("_reached"))
    covering = at_firings(slices, size, slide)
    return (
        covering.groupBy(*keys, "firing")
        .agg(*merged_columns(aggs), F.max("_reached").alias("_reached"))
        .filter(F.col("_reached") == F.col("firing"))
        .select(*keys, "firing", *finished_columns(aggs))
    )


def number_rows(df: DataFrame, order: list[str], keys: list[str], max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """``df`` plus ``_rn``, the number of each row in its group from 1."""
    return running(df, keys, order, {"_rn": Running("count")}, max_group_rows)


def slice_of(size: int, slide: int) -> Column:
    """Number of the slice that row ``_rn`` is in. Firings and window bounds are multiples of a slice's rows, so a window is
    made of whole slices."""
    slice_rows = gcd(size, slide)
    return floor_div(F.col("_rn") + (slice_rows - 1), slice_rows).alias("_slice")


def at_firings(slices: DataFrame, size: int, slide: int) -> DataFrame:
    """Slices, each once for every ``firing`` that covers it."""
    slice_rows = gcd(size, slide)
    # The firings that cover the slice that ends at row e: multiples of slide in [e, e + size - slice_rows].
    end = F.col("_slice") * slice_rows
    first = floor_div(end + (slide - 1), slide) * slide
    last = floor_div(end + (size - slice_rows), slide) * slide
    step = F.lit(slide).cast("bigint")
    # with slide > size a slice may be covered by no firing at all
    return slices.filter(first <= last).withColumn("firing", F.explode(F.sequence(first, last, step)))


def each_row_a_window(df: DataFrame, time: str, pos: str | list[str], max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Count windows of one row: what a report of single late rows uses."""
    return count_windows(df, time, pos, 1, 1, [], max_group_rows)
