"""Sessions as islands in time, hot-key safe.

Rows of a key belong together while the next one follows within ``gap``. The chain runs along
the whole time axis, so a window function per key would sort a hot key in one task. Here:

1. rows are pre-aggregated per (key, tick);
2. keys and times are cut into blocks of about equally many points, and each (key, block) is chained on its own (a small
   input is one block);
3. only the first and last chain of a block can go on in a neighbour. Those (at most two per
   key and block) are chained across blocks; all others are finished.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ticks import floor_div
from tidemark.operators.running import Running, running
from tidemark.operators.windows import COUNT, Aggregate, finished_columns, partial_columns, state_merges
from tidemark.session import at_most, broadcast_if_small, expected_bytes, in_ranges, join_null_safe, materialise

# Points one task may chain, and the size that Spark may expect of an input that is not cut into blocks.
BLOCK_POINTS = 1 << 20
_SMALL_BYTES = 64 << 20


def _in_blocks(points: DataFrame, time: str, keys: list[str], block: int | None, rows: DataFrame | None) -> DataFrame:
    """``points`` with their ``_block``. ``block`` asks for blocks of so many points; ``rows`` is a materialised DataFrame with
    at least as many rows, if there is one."""
    if block is not None:
        points = materialise(points)
        return in_ranges(points, [*keys, time], "_block", -(-points.count() // block) or 1)
    small = expected_bytes(points) <= _SMALL_BYTES if rows is None else at_most(rows, BLOCK_POINTS)
    return points.withColumn("_block", F.lit(0)) if small else in_ranges(points, [*keys, time], "_block")


def _in_pieces(
    points: DataFrame, time: str, keys: list[str], gap: int | None, inclusive: bool, cut_after: str | None, block: int | None,
    rows: DataFrame | None,
):
    """Points with the piece of their block they belong to, and the rule for a break."""

    def breaks(previous_time: Column, previous_cut: Column, now: Column) -> Column:
        condition = previous_time.isNull()
        if gap is not None:
            distance = now - previous_time
            condition = condition | ((distance > gap) if inclusive else (distance >= gap))
        if cut_after is not None:
            condition = condition | F.coalesce(previous_cut, F.lit(False))
        return condition.cast("int")

    blocked = _in_blocks(points, time, keys, block, rows).withColumn("_cut", F.col(cut_after) if cut_after else F.lit(False))
    in_block = Window.partitionBy(*keys, "_block").orderBy(time)
    pieces = blocked.withColumn(
        "_break", breaks(F.lag(time).over(in_block), F.lag("_cut").over(in_block), F.col(time))
    ).withColumn("_piece", F.sum("_break").over(in_block))
    return pieces, breaks


def _bounds(pieces: DataFrame, time: str, keys: list[str], merged: list[Column]) -> DataFrame:
    """One row per piece, marked if it touches the edge of its block."""
    return (
        pieces.groupBy(*keys, "_block", "_piece")
        .agg(F.min(time).alias("first"), F.max(time).alias("last"), F.max_by("_cut", time).alias("_cut"), *merged)
        .withColumn("_pieces", F.max("_piece").over(Window.partitionBy(*keys, "_block")))
        .withColumn("_at_edge", (F.col("_piece") == 1) | (F.col("_piece") == F.col("_pieces")))
    )


def _chained(bounds: DataFrame, keys: list[str], breaks) -> DataFrame:
    """Pieces with the number of their chain. Pieces at an edge (at most two per key and block) are
    chained along the key; each of the others is a lane of its own and stays where it is."""
    lanes = bounds.withColumn("_lane", F.when(~F.col("_at_edge"), F.col("first")))
    along = Window.partitionBy(*keys, "_lane").orderBy("first")
    return lanes.withColumn(
        "_break", breaks(F.lag("last").over(along), F.lag("_cut").over(along), F.col("first"))
    ).withColumn("_chain", F.sum("_break").over(along))


def islands(
    points: DataFrame,
    time: str,
    keys: list[str],
    merges: dict[str, Callable[[str], Column]],
    gap: int | None,
    inclusive: bool = True,
    cut_after: str | None = None,
    block: int | None = None,
    rows: DataFrame | None = None,
) -> DataFrame:
    """Chain ``points`` (one row per key and ``time``) to islands.

    A new island starts where the distance to the previous point exceeds ``gap`` (reaches it,
    if not ``inclusive``) or where the previous point carries ``cut_after``. ``merges`` maps
    columns to the aggregate that merges them. Returns ``keys, first, last`` and the merged columns.
    """
    merged = [merge(name).alias(name) for name, merge in merges.items()]
    pieces, breaks = _in_pieces(points, time, keys, gap, inclusive, cut_after, block, rows)
    bounds = _bounds(pieces, time, keys, merged)
    return (
        _chained(bounds, keys, breaks)
        .groupBy(*keys, "_lane", "_chain")
        .agg(F.min("first").alias("first"), F.max("last").alias("last"), *merged)
        .select(*keys, "first", "last", *merges)
    )


def label_islands(
    points: DataFrame, time: str, keys: list[str], cut_after: str, label: str, rows: DataFrame, block: int | None = None
) -> DataFrame:
    """``points`` plus ``label``: the first tick of the island (ended by ``cut_after``) they are in.

    ``rows`` is a materialised DataFrame with at least as many rows as ``points``.
    """
    pieces, breaks = _in_pieces(points, time, keys, None, True, cut_after, block, rows)
    chained = _chained(_bounds(pieces, time, keys, []).filter("_at_edge"), keys, breaks)
    starts = chained.select(
        *keys, "_block", "_piece", F.min("first").over(Window.partitionBy(*keys, "_chain")).alias("_chain_first")
    )
    # edge pieces only: far fewer than points
    moved = broadcast_if_small(starts, rows)
    in_piece = Window.partitionBy(*keys, "_block", "_piece")
    own = pieces.withColumn("_piece_first", F.min(time).over(in_piece))
    return join_null_safe(own, moved, [*keys, "_block", "_piece"]).select(
        *points.columns, F.coalesce("_chain_first", "_piece_first").alias(label)
    )


def sessions(
    df: DataFrame,
    time: str,
    gap: int,
    keys: list[str],
    aggs: dict[str, Aggregate] = COUNT,
    inclusive: bool = True,
    start: str = "start",
    end: str = "end",
    block: int | None = None,
) -> DataFrame:
    """Aggregates per session: ``[first, last + gap)`` of rows that follow each other within ``gap``.

    ``inclusive=False`` keeps two sessions apart that only touch (distance exactly ``gap``).
    Rows without a time are in no session (``routing.without_time`` gives them).
    """
    points = df.filter(F.col(time).isNotNull()).groupBy(*keys, time).agg(*partial_columns(aggs))
    return islands(points, time, keys, state_merges(aggs), gap, inclusive, block=block).select(
        F.col("first").alias(start), (F.col("last") + gap).alias(end), *keys, *finished_columns(aggs)
    )


def range_min_ahead(
    points: DataFrame, probes: DataFrame, keys: list[str], time: str, values: dict[str, str], reach: int, small: bool = False
) -> DataFrame:
    """For every probe ``(keys, time)``: the smallest values of the key's points in
    ``(time, time + reach]``. ``values`` maps columns of ``points`` to result columns, which are
    NULL where there is no point.

    A sliding frame would look at every point of the frame for every row. Instead the axis is
    cut into cells of ``reach + 1`` ticks, so that the range covers the rest of the probe's own
    cell and a beginning of the next one: one running minimum backwards, one forwards. ``running`` spreads a cell that holds
    many points over tasks; where points and probes are known to be few (``small``) one task may have a whole cell.
    """
    cell = reach + 1

    def marked(df, at, role, with_values):
        return df.select(
            *keys,
            at.alias("_at"),
            F.lit(role).alias("_role"),
            *[
                F.col(name) if with_values else F.lit(None).cast(points.schema[name].dataType).alias(name)
                for name in values
            ],
        )

    time_col = F.col(time)
    everything = (
        marked(points, time_col, "point", True)
        .unionByName(marked(probes, time_col, "begin", False))
        .unionByName(marked(probes, time_col + cell, "end", False))
        .withColumn("_cell", floor_div(F.col("_at"), cell))
        .withColumn("_is_point", F.col("_role") == "point")
        .withColumn("_back", -F.col("_at"))
    )
    # At equal ticks a probe comes before the points: its own tick is outside the range.
    in_cell = [*keys, "_cell"]
    up, down = ({f"_{way}_{name}": Running("min", name) for name in values} for way in ("up", "down"))
    if small:
        forwards, backwards = (Window.partitionBy(*in_cell).orderBy(at, "_is_point") for at in ("_at", "_back"))
        both = everything.withColumns({c: r.over(forwards) for c, r in up.items()} | {c: r.over(backwards) for c, r in down.items()})
    else:
        both = running(running(everything, in_cell, ["_at", "_is_point"], up), in_cell, ["_back", "_is_point"], down)
    begin = F.col("_role") == "begin"
    return (
        both.filter(~F.col("_is_point"))
        .groupBy(*keys, F.when(begin, F.col("_at")).otherwise(F.col("_at") - cell).alias(time))
        .agg(
            *[
                F.min(F.when(begin, F.col(f"_down_{name}")).otherwise(F.col(f"_up_{name}"))).alias(result)
                for name, result in values.items()
            ]
        )
    )
