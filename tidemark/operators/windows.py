"""Time windows over a LONG event time: sliding, tumbling, right-closed.

A row is in ``size / slide`` sliding windows. Instead of copying every row that often, rows
are first aggregated per *pane* (the slices between window bounds, ``gcd(size, slide)`` wide);
only the few pane rows are copied to their windows and combined. The raw table is read once
and shrinks in the map-side aggregation before anything is shuffled.

``native_sliding`` and ``native_session`` are the same windows with Spark's own window
expressions over a TIMESTAMP column; live queries use those.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ticks import floor_to


class Aggregate:
    """An aggregate that works on partial states, so that no window's rows ever have to be in one place.

    Subclass it (or use ``Composed``) for an aggregate of your own in Spark expressions; ``user_functions`` takes Python
    code instead. A state is one or more columns, named after the result.
    """

    def partials(self, name: str) -> dict[str, Column]:
        """The state's columns as aggregates over input rows."""
        raise NotImplementedError

    def merges(self, name: str) -> dict[str, Callable[[str], Column]]:
        """For each column of the state the aggregate that merges several of it. Merging has no order."""
        raise NotImplementedError

    def finish(self, name: str) -> Column:
        """The result, from the columns of one state."""
        raise NotImplementedError


@dataclass(frozen=True)
class Agg(Aggregate):
    """A built-in aggregate. ``of`` is the input column; ``when`` a condition for the rows."""

    kind: str
    of: Column | None = None
    when: Column | None = None

    def _value(self) -> Column:
        value = F.lit(1) if self.of is None else self.of
        return value if self.when is None else F.when(self.when, value)

    def partials(self, name: str) -> dict[str, Column]:
        value = self._value()
        if self.kind == "count":
            return {name: F.count(value)}
        if self.kind == "avg":
            return {f"{name}__sum": F.sum(value), f"{name}__n": F.count(value)}
        return {name: {"sum": F.sum, "min": F.min, "max": F.max}[self.kind](value)}

    def merges(self, name: str) -> dict[str, Callable[[str], Column]]:
        if self.kind == "avg":
            return {f"{name}__sum": F.sum, f"{name}__n": F.sum}
        return {name: {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}[self.kind]}

    def finish(self, name: str) -> Column:
        if self.kind == "avg":
            return F.col(f"{name}__sum") / F.nullif(F.col(f"{name}__n"), F.lit(0))
        return F.col(name)


@dataclass(frozen=True)
class Composed(Aggregate):
    """An aggregate of one's own: ``states`` maps the parts of the state to the aggregate over input rows that makes them
    and the one that merges them, ``result`` makes the result from the parts.

    A geometric mean: ``Composed({"logs": (F.sum(F.ln("x")), F.sum), "n": (F.count("x"), F.sum)}, lambda s: F.exp(s["logs"] / s["n"]))``
    """

    states: dict[str, tuple[Column, Callable[[str], Column]]]
    result: Callable[[dict[str, Column]], Column]

    def partials(self, name: str) -> dict[str, Column]:
        return {f"{name}__{part}": made for part, (made, _) in self.states.items()}

    def merges(self, name: str) -> dict[str, Callable[[str], Column]]:
        return {f"{name}__{part}": merged for part, (_, merged) in self.states.items()}

    def finish(self, name: str) -> Column:
        return self.result({part: F.col(f"{name}__{part}") for part in self.states})


COUNT = {"count": Agg("count")}


def partial_columns(aggs: dict[str, Aggregate]) -> list[Column]:
    """Aggregates over input rows that make the states of ``aggs``."""
    return [expr.alias(column) for name, agg in aggs.items() for column, expr in agg.partials(name).items()]


def state_merges(aggs: dict[str, Aggregate]) -> dict[str, Callable[[str], Column]]:
    """All columns of the states of ``aggs``, with what merges them."""
    return {column: merge for name, agg in aggs.items() for column, merge in agg.merges(name).items()}


def merged_columns(aggs: dict[str, Aggregate]) -> list[Column]:
    """Aggregates over states that make one state."""
    return [merge(column).alias(column) for column, merge in state_merges(aggs).items()]


def finished_columns(aggs: dict[str, Aggregate]) -> list[Column]:
    """The results of ``aggs`` from their states."""
    return [agg.finish(name).alias(name) for name, agg in aggs.items()]


def window_starts(time: Column, size: int, slide: int) -> Column:
    """Starts of the windows ``[start, start + size)`` that hold ``time``, ascending."""
    last = floor_to(time, slide)
    first = floor_to(time - size, slide) + slide
    starts = F.sequence(first, last, F.lit(slide).cast("bigint"))
    # with slide > size there are times in no window: no list, so nothing to explode
    return starts if slide <= size else F.when(first <= last, starts)


def sliding(
    df: DataFrame,
    time: str,
    size: int,
    slide: int,
    keys: list[str],
    aggs: dict[str, Aggregate] = COUNT,
    start: str = "start",
    end: str = "end",
) -> DataFrame:
    """Aggregates per ``[start, end)`` window of ``size`` every ``slide``, per key (none: all rows).
    Rows without a time are in no window (``routing.without_time`` gives them)."""
    pane = gcd(size, slide)
    panes = df.filter(F.col(time).isNotNull()).groupBy(*keys, floor_to(F.col(time), pane).alias("_pane")).agg(*partial_columns(aggs))
    if size == slide:
        # the pane is the window: the second aggregation finds its rows already in place
        windows = panes.withColumnRenamed("_pane", start)
    else:
        windows = panes.withColumn(start, F.explode(window_starts(F.col("_pane"), size, slide)))
    windows = windows.groupBy(*keys, start).agg(*merged_columns(aggs))
    return windows.select(start, (F.col(start) + size).alias(end), *keys, *finished_columns(aggs))


def tumbling(
    df: DataFrame, time: str, size: int, keys: list[str], aggs: dict[str, Aggregate] = COUNT, **names: str
) -> DataFrame:
    """Windows that follow each other: sliding windows whose slide is their size."""
    return sliding(df, time, size, size, keys, aggs, **names)


def sliding_right_closed(
    df: DataFrame, time: str, size: int, slide: int, keys: list[str], aggs: dict[str, Aggregate] = COUNT, **names: str
) -> DataFrame:
    """Windows ``(start, end]``: one tick earlier in ``[start, end)``, with the same labels."""
    return sliding(df.withColumn("_tick", F.col(time) - 1), "_tick", size, slide, keys, aggs, **names)


def native_sliding(df: DataFrame, time: str, size: str, slide: str, keys: list[str]) -> DataFrame:
    """Count per window and key with Spark's window expression; works on streams too."""
    counted = df.filter(F.col(time).isNotNull()).groupBy(F.window(time, size, slide).alias("win"), *keys).count()
    return window_bounds_ms(counted, keys)


def native_session(df: DataFrame, time: str, gap: str, keys: list[str], counted: Column | None = None) -> DataFrame:
    """Count per session and key with Spark's session window; works on streams too.

    ``counted`` marks the rows to count. On a stream this conditional count, not a filter, is
    how control rows are left out: a filter on the key would be pushed below the watermark,
    and control rows would then stop moving it.
    """
    one = F.lit(1) if counted is None else F.when(counted, 1).otherwise(0)
    sessions = df.filter(F.col(time).isNotNull()).groupBy(F.session_window(time, gap).alias("win"), *keys).agg(F.sum(one).alias("count"))
    return window_bounds_ms(sessions, keys)


def window_bounds_ms(df: DataFrame, keys: list[str]) -> DataFrame:
    """The window struct as two LONG millisecond columns."""
    return df.select(
        F.unix_millis("win.start").alias("start_ms"),
        F.unix_millis("win.end").alias("end_ms"),
        *keys,
        "count",
    )
