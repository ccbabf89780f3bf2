"""Which rows sliding windows accept, drop or set aside, and what they report.

For each window two arrival positions matter: where it *fires* (progress reaches
``end + fire``) and where it stops accepting rows (progress reaches ``end + accept``). Both
come from one small table per window (``first_reached``). Later windows close later, so among
the windows of one row the closed ones come first: a row is described by its pane and by how
many of its windows were closed when it arrived. Counting these descriptions needs no order,
no state and no copy of the row per window; one aggregation shrinks the table map-side.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ticks import floor_to
from tidemark.operators.progress import first_reached
from tidemark.operators.running import MAX_GROUP_ROWS, Running, running
from tidemark.operators.windows import COUNT, Aggregate, finished_columns, merged_columns, partial_columns, state_merges, window_starts
from tidemark.session import BROADCAST_BYTES, BROADCAST_ROWS, at_most, materialise

# Bytes of one window in a pane's list: its start, two positions and their places.
_WINDOW_BYTES = 88

# Longest array handed from one row to the next step when a count is turned into rows.
CHUNK = 1 << 16


@dataclass(frozen=True)
class SlidingPolicy:
    """When windows ``[start, start + size)`` fire and stop accepting.

    ``fire`` and ``accept`` are distances from the window end to the progress value that
    fires the window and that makes further rows late. ``accept - fire`` is the allowed
    lateness. ``min_start`` leaves out windows that start earlier.
    """

    size: int
    slide: int
    fire: int = 0
    accept: int = 0
    min_start: int | None = None

    @property
    def pane(self) -> int:
        return gcd(self.size, self.slide)

    @property
    def horizon(self) -> int:
        """Ticks after an event at which progress has fired and closed all its windows."""
        return self.size + max(self.fire, self.accept, 0)

    @property
    def most_windows(self) -> int:
        return -(-self.size // self.slide)


@dataclass(frozen=True)
class _Closing:
    """When the windows of each pane close."""

    lists: DataFrame  # _pane, _windows: start and positions of the windows that hold the pane
    last_closed: int | None  # start of the last window that progress closed


def _closing_positions(
    df: DataFrame, time: str, pos: str, policy: SlidingPolicy, moves: Column | None, ending: bool = False
) -> _Closing:
    """One aggregation of the table gives the panes in use and the progress observations; the
    rest works on those few rows. ``ending`` asks for ``last_closed`` as well."""
    reached = {
        name: floor_to(F.col(time) - (policy.size + offset), policy.slide)
        for name, offset in (("fire", policy.fire), ("accept", policy.accept))
    }
    observed_pos = F.col(pos) if moves is None else F.when(moves, F.col(pos))
    seen = materialise(
        df.groupBy(
            floor_to(F.col(time), policy.pane).alias("pane"),
            reached["fire"].alias("fire_start"),
            reached["accept"].alias("accept_start"),
        ).agg(F.min(observed_pos).alias("pos"))
    )
    # a row of ``seen`` is exploded to its windows, and its list holds them all
    small = at_most(seen, min(BROADCAST_ROWS, BROADCAST_BYTES // _WINDOW_BYTES) // policy.most_windows)
    starts = window_starts(F.col("pane"), policy.size, policy.slide)
    used = seen.select("pane", F.explode(starts).alias("start"))
    if policy.min_start is not None:
        used = used.filter(F.col("start") >= policy.min_start)
    observed = seen.filter(F.col("pos").isNotNull())

    def position(name: str) -> DataFrame:
        at = observed.select(F.col(f"{name}_start").alias("start"), "pos")
        return first_reached(at, used, "start", "pos", f"{name}_pos", small)

    positions = position("fire")
    if policy.accept == policy.fire:
        positions = positions.withColumn("accept_pos", F.col("fire_pos"))
    else:
        positions = positions.join(position("accept"), "start")
    # size / slide windows per pane: a short list; at most as many lists as rows seen
    lists = used.join(positions, "start").groupBy(F.col("pane").alias("_pane")).agg(
        F.sort_array(F.collect_set(F.struct("start", "fire_pos", "accept_pos"))).alias("_windows")
    )
    last_closed = observed.agg(F.max("accept_start")).first()[0] if ending else None
    return _Closing(F.broadcast(lists) if small else lists, last_closed)


def _closed_before(windows: Column, field: str, pos: Column, most: int) -> Column:
    """How many of the windows had passed ``field`` when the row arrived."""
    if most <= 16:
        tests = [
            F.coalesce(F.get(windows, F.lit(i))[field] < pos, F.lit(False)).cast("int") for i in range(most)
        ]
        return reduce(lambda a, b: a + b, tests)
    return F.size(F.filter(windows, lambda w: w[field] < pos))


def _describe(df: DataFrame, time: str, pos: str, policy: SlidingPolicy, positions: DataFrame) -> DataFrame:
    def closed_before(field: str) -> Column:
        return _closed_before(F.col("_windows"), field, F.col(pos), policy.most_windows)

    joined = df.withColumn("_pane", floor_to(F.col(time), policy.pane)).join(positions, "_pane")
    described = joined.withColumn("_fired", closed_before("fire_pos"))
    same = policy.accept == policy.fire
    return described.withColumn("_closed", F.col("_fired") if same else closed_before("accept_pos"))


def with_closed_windows(
    df: DataFrame, time: str, pos: str, policy: SlidingPolicy, moves: Column | None = None
) -> DataFrame:
    """``df`` plus ``_windows`` (the row's windows), ``_fired`` and ``_closed`` (how many of them
    had fired, and no longer accepted rows, when the row arrived). ``moves`` marks the rows that
    move progress (default: all)."""
    return _describe(df, time, pos, policy, _closing_positions(df, time, pos, policy, moves).lists)


def _window_counts(
    df: DataFrame, time: str, pos: str, policy: SlidingPolicy, keys: list[str], closing: _Closing
) -> DataFrame:
    described = _describe(df, time, pos, policy, closing.lists)
    groups = described.groupBy(*keys, "_pane", "_fired", "_closed").agg(F.count(F.lit(1)).alias("_n"))
    each = _described_windows(groups, policy, [*keys, "_n"])
    n, i = F.col("_n"), F.col("_i")

    def where(condition):
        return F.sum(F.when(condition, n).otherwise(0))

    return each.groupBy(*keys, "start").agg(
        where(i >= F.col("_fired")).alias("on_time"),
        where((i < F.col("_fired")) & (i >= F.col("_closed"))).alias("late"),
        where(i < F.col("_closed")).alias("dropped"),
    ).withColumn("end", F.col("start") + policy.size)


def window_counts(
    df: DataFrame, time: str, pos: str, policy: SlidingPolicy, keys: list[str], moves: Column | None = None
) -> DataFrame:
    """Per window and key: ``on_time`` rows (arrived before it fired), ``late`` rows (accepted
    after that) and ``dropped`` rows."""
    return _window_counts(df, time, pos, policy, keys, _closing_positions(df, time, pos, policy, moves))


def final_counts(
    df: DataFrame,
    time: str,
    pos: str,
    policy: SlidingPolicy,
    keys: list[str],
    moves: Column | None = None,
    counted: Column | None = None,
    flush: bool = True,
    aggs: dict[str, Aggregate] = COUNT,
) -> DataFrame:
    """One result per window: fire once, report all rows accepted by then (their number, or other ``aggs``). Without ``flush``
    a window that progress never closed is not reported (there is no end of input). ``counted`` marks the rows that count
    (the others still move progress)."""
    closing = _closing_positions(df, time, pos, policy, moves, ending=not flush)
    rows = df if counted is None else df.filter(counted)
    windows = _window_states(rows, time, pos, policy, keys, closing, aggs, F.col("_i") >= F.col("_closed"))
    if not flush:
        windows = windows.filter(F.col("start") <= F.lit(closing.last_closed).cast("bigint"))
    return windows.select("start", (F.col("start") + policy.size).alias("end"), *keys, *finished_columns(aggs))


def _described_windows(described: DataFrame, policy: SlidingPolicy, columns: list[str]) -> DataFrame:
    """``columns`` of described rows or groups, once for each of their windows (``start``), with its place ``_i``."""
    starts = window_starts(F.col("_pane"), policy.size, policy.slide)
    if policy.min_start is not None:
        starts = F.filter(starts, lambda start: start >= policy.min_start)
    return described.select(*columns, "_fired", "_closed", F.posexplode(starts).alias("_i", "start"))


def _window_states(
    df: DataFrame, time: str, pos: str, policy: SlidingPolicy, keys: list[str], closing: _Closing, aggs: dict[str, Aggregate], kept: Column
) -> DataFrame:
    """``start, keys`` and the states of ``aggs`` over the rows that each window ``kept``. Rows are aggregated by pane and by how
    many windows were closed to them before anything is shuffled."""
    described = _describe(df, time, pos, policy, closing.lists)
    groups = described.groupBy(*keys, "_pane", "_fired", "_closed").agg(*partial_columns(aggs))
    each = _described_windows(groups, policy, [*keys, *state_merges(aggs)])
    return each.filter(kept).groupBy(*keys, "start").agg(*merged_columns(aggs))


def late_rows(df: DataFrame, time: str, pos: str, policy: SlidingPolicy, moves: Column | None = None) -> DataFrame:
    """Rows that no window accepted: the side output. A row that some window kept is not late."""
    described = with_closed_windows(df, time, pos, policy, moves)
    return described.filter(F.col("_closed") == F.size("_windows")).select(*df.columns)


def not_behind(df: DataFrame, time: str, pos: str, lag: int = 0, moves: Column | None = None) -> DataFrame:
    """Rows that are not behind progress when they arrive, progress trailing the largest event
    time by ``lag``. The test is on the row, not on its windows."""
    observed_pos = F.col(pos) if moves is None else F.when(moves, F.col(pos))
    ticks = materialise(df.groupBy(F.col(time).alias("_tick")).agg(F.min(observed_pos).alias("pos")))
    small = at_most(ticks, BROADCAST_ROWS)
    ahead = 1 + lag
    passed = first_reached(
        ticks.filter(F.col("pos").isNotNull()).select(F.col("_tick").alias("bound"), "pos"),
        ticks.select((F.col("_tick") + ahead).alias("bound")),
        "bound",
        "pos",
        "_passed",
        small,
    ).select((F.col("bound") - ahead).alias("_tick"), "_passed")
    passed = F.broadcast(passed) if small else passed
    in_time = F.col("_passed").isNull() | (F.col(pos) <= F.col("_passed"))
    return df.join(passed, F.col(time) == F.col("_tick")).filter(in_time).select(*df.columns)


def _ranges_to_rows(df: DataFrame, keep: list[str], name: str) -> DataFrame:
    """``keep`` columns and one row per value ``_first, _first + _step, ... <= _last``.

    In two steps with a repartition between them, so that a window with a huge count becomes
    many bounded rows on many tasks and never one huge array.
    """
    span = F.col("_step") * CHUNK
    parts = F.call_function("div", F.col("_last") - F.col("_first"), span)
    chunked = (
        df.filter(F.col("_first") <= F.col("_last"))
        .withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), parts)))
        .withColumn("_from", F.col("_first") + F.col("_part") * span)
        .repartition(*keep, "_part")
    )
    upto = F.least(F.col("_from") + (span - F.col("_step")), F.col("_last"))
    return chunked.withColumn(name, F.explode(F.sequence("_from", upto, "_step"))).select(*keep, name)


def panes(
    df: DataFrame,
    time: str,
    pos: str,
    policy: SlidingPolicy,
    keys: list[str],
    early_every: int | None = None,
    final: bool = True,
    moves: Column | None = None,
) -> DataFrame:
    """Every report of a window: ``start, end, keys, pane_kind, count``, counts accumulating.

    * ``early``: after every ``early_every``-th row before the window fired;
    * ``on_time``: when it fires (also if the last early pane had the same count);
    * ``late``: once for each row accepted after that.

    What a pane shows depends only on the counts, so no row order is needed here.
    """
    counts = window_counts(df, time, pos, policy, keys, moves)
    on_time = F.col("on_time")

    def reports(kind: str, first: Column, last: Column, step: int) -> Column:
        return F.struct(
            F.lit(kind).alias("pane_kind"),
            first.cast("bigint").alias("_first"),
            last.cast("bigint").alias("_last"),
            F.lit(step).cast("bigint").alias("_step"),
        )

    ranges = [reports("early", F.lit(early_every), on_time, early_every)] if early_every else []
    if final:
        # a window with no row in time does not fire: the range 1..0 is empty
        ranges.append(reports("on_time", F.greatest(on_time, F.lit(1)), on_time, 1))
        ranges.append(reports("late", on_time + 1, on_time + F.col("late"), 1))
    keep = ["start", "end", *keys]
    spread = counts.select(*keep, F.explode(F.array(*ranges)).alias("_report")).select(*keep, "_report.*")
    return _ranges_to_rows(spread, [*keep, "pane_kind"], "count")


def pane_aggregates(
    df: DataFrame,
    time: str,
    pos: str,
    policy: SlidingPolicy,
    keys: list[str],
    aggs: dict[str, Aggregate],
    early_every: int | None = None,
    moves: Column | None = None,
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """The reports of ``panes`` with other aggregates than the count: ``start, end, keys, pane_kind`` and ``aggs``, over the rows a
    window had taken by then.

    On-time panes come from states by pane, as final results do. A late pane shows the on-time state with the late rows up to
    it, an early pane the rows in time up to it: running aggregates in arrival order, over only the rows that are late (or,
    with ``early_every``, in time) for a window. They are made of sums, minima and maxima, so all parts of a state have to be.
    """
    closing = _closing_positions(df, time, pos, policy, moves)
    merges = state_merges(aggs)
    known = {F.sum: "sum", F.min: "min", F.max: "max"}
    if not set(merges.values()) <= set(known):
        raise ValueError("early and late panes need states that are sums, minima and maxima")
    so_far = {c: Running(known[m], c) for c, m in merges.items()}
    timely, late = F.col("_i") >= F.col("_fired"), (F.col("_i") < F.col("_fired")) & (F.col("_i") >= F.col("_closed"))
    on_time = _window_states(df, time, pos, policy, keys, closing, aggs, timely)
    described = _describe(df, time, pos, policy, closing.lists)
    group = [*keys, "start"]

    def by_row(kept: Column) -> DataFrame:
        """The states of single rows in the windows that kept them."""
        each = _described_windows(described, policy, df.columns).filter(kept).repartition(*group)
        return each.groupBy(*group, F.col(pos).alias("_at")).agg(*partial_columns(aggs))

    def shaped(panes: DataFrame, kind: str) -> DataFrame:
        return panes.select("start", (F.col("start") + policy.size).alias("end"), *keys, F.lit(kind).alias("pane_kind"), *finished_columns(aggs))

    # a window's on-time state comes before its late rows
    first = on_time.withColumn("_at", F.lit(None).cast(df.schema[pos].dataType)).withColumn("_after", F.lit(0))
    grown = _grown(by_row(late).withColumn("_after", F.lit(1)).unionByName(first), group, so_far, max_group_rows)
    result = shaped(on_time, "on_time").unionByName(shaped(grown.filter("_after = 1"), "late"))
    if early_every:
        early = _grown(by_row(timely).withColumn("_after", F.lit(1)), group, so_far, max_group_rows)
        result = result.unionByName(shaped(early.filter(F.col("_turn") % early_every == 0), "early"))
    return result


def _grown(states: DataFrame, group: list[str], so_far: dict[str, Running], max_group_rows: int) -> DataFrame:
    """States of single rows (``_after``, ``_at``: their order) replaced by those of all rows up to them; ``_turn`` numbers them."""
    added = {f"_sum_{c}": r for c, r in so_far.items()} | {"_turn": Running("count")}
    grown = running(states, group, ["_after", "_at"], added, max_group_rows)
    return grown.select(*group, "_after", "_turn", *[F.col(f"_sum_{c}").alias(c) for c in so_far])


def discarding(
    df: DataFrame, time: str, pos: str, policy: SlidingPolicy, keys: list[str], early_every: int
) -> DataFrame:
    """Panes that report only what is new since the pane before: ``early_every`` rows in each
    early pane, the rest in the on-time pane, one in each late pane."""
    accumulated = panes(df, time, pos, policy, keys, early_every)
    rest = F.pmod(F.col("count"), F.lit(early_every))
    new = (
        F.when(F.col("pane_kind") == "early", F.lit(early_every))
        .when(F.col("pane_kind") == "on_time", rest)
        .otherwise(F.lit(1))
    )
    return accumulated.withColumn("new", new.cast("bigint"))
