"""Sessions under a late-data policy.

Sessions depend on arrival order: a session that has closed is gone when a further row comes.
Replaying a key row by row would put a hot key into one task. Instead:

*Timely rows* (accepted on their own, whatever else is there) form sessions that can be told
from minima alone. A session that ends at tick ``v`` closes at a known arrival position, and
it goes on past ``v`` exactly if some timely row of the key with a later tick within reach had
arrived by then. So: one aggregation to (key, tick), one minimum over the ticks ahead, one
chain over the cuts this gives (``islands``), all cut into blocks along the time axis.

*Other rows* are dropped by a ``pre_merge`` policy. A post-merge policy accepts such a row if it
overlaps a session that is still open; it then reaches back in time and may let further rows
in. It can only belong to the earliest session open at that moment, and it is accepted if a row
of that session ahead of it within reach had been accepted before. These acceptance times are
relaxed until nothing changes; each round is a handful of joins and aggregates over one row
per (key, session, tick), and one round is the rule.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ticks import POSITION, floor_div, never
from tidemark.operators.islands import islands, label_islands, range_min_ahead
from tidemark.operators.progress import first_reached
from tidemark.operators.running import MAX_GROUP_ROWS, Running, running
from tidemark.operators.windows import Aggregate, finished_columns, merged_columns, partial_columns, state_merges
from tidemark.session import BROADCAST_ROWS, at_most, broadcast_if_small, join_null_safe, written


# What a late row carries along while its session is looked up.
_CARRIED = ["_weight", "_fire_pos", "_accept_pos"]


@dataclass(frozen=True)
class SessionPolicy:
    """How sessions with ``gap`` treat late rows.

    Distances are from the session end (``last + gap``) to a progress value: ``fire`` reports
    the session, ``alive`` removes it (later rows cannot join it), ``accept`` makes a row late.
    ``inclusive`` merges sessions that only touch. ``pre_merge`` tests a row on its own
    ``[t, t + gap)``; otherwise on the session it would join.
    """

    gap: int
    inclusive: bool = True
    fire: int = 0
    alive: int = 0
    accept: int = 0
    pre_merge: bool = False

    @property
    def horizon(self) -> int:
        """Ticks after an event at which progress has fired and removed its session."""
        return self.gap + max(self.fire, self.alive, self.accept, 0)

    @property
    def reach(self) -> int:
        """How far ahead a row of the same session can be."""
        return self.gap if self.inclusive else self.gap - 1


@dataclass(frozen=True)
class Decision:
    """What became of every row: session spines, late rows kept in them, single sessions, drops."""

    sessions: DataFrame  # keys, first, last, count, from timely rows
    timely: DataFrame  # rows accepted on their own
    points: DataFrame  # timely rows per (keys, time), with the session ("island") they are in
    joined: DataFrame  # late rows that joined a session, with it ("island")
    single: DataFrame  # rows accepted when their own session had already closed
    dropped: DataFrame


def _closing_positions(
    df: DataFrame, time: str, pos: str, policy: SessionPolicy, moves: Column | None
) -> DataFrame:
    """Per tick: where a session whose last row has that tick fires, is removed, and rejects rows."""
    number = F.col(pos).cast(POSITION)
    observed_pos = number if moves is None else F.when(moves, number)
    ticks = written(df.groupBy(time).agg(F.min(observed_pos).alias("pos")))
    small = at_most(ticks, BROADCAST_ROWS)
    observed = ticks.filter(F.col("pos").isNotNull()).select(F.col(time).alias("bound"), "pos")
    table, have = ticks.select(F.col(time).alias("tick")), {}
    for name, offset in (("fire", policy.fire), ("alive", policy.alive), ("accept", policy.accept)):
        if offset in have:
            table = table.withColumn(f"_{name}_pos", F.col(f"_{have[offset]}_pos"))
            continue
        have[offset] = name
        shift = policy.gap + offset
        probes = ticks.select((F.col(time) + shift).alias("bound"))
        reached = first_reached(observed, probes, "bound", "pos", f"_{name}_pos", small)
        table = table.join(
            reached.select((F.col("bound") - shift).alias("tick"), f"_{name}_pos"), "tick"
        )
    table = written(table)
    return F.broadcast(table) if small else table


def _not_after(pos: Column, bound: Column) -> Column:
    """The row arrived before progress went past the bound (a bound never reached is NULL)."""
    return bound.isNull() | (pos <= bound)


def _cuts(
    points: DataFrame, time: str, keys: list[str], policy: SessionPolicy, closes: str, cut: str, few: bool
) -> DataFrame:
    """``points`` plus ``cut``: nothing ahead within reach had arrived when the point closed."""
    ahead = range_min_ahead(
        points, points.select(*keys, time), keys, time, {"_first_pos": "_ahead_pos"}, policy.reach, few
    )
    joined = join_null_safe(points, ahead, [*keys, time])
    return joined.withColumn(
        cut, F.col("_ahead_pos").isNull() | F.coalesce(F.col("_ahead_pos") > F.col(closes), F.lit(False))
    ).drop("_ahead_pos")


def decide(
    df: DataFrame,
    time: str,
    pos: str,
    policy: SessionPolicy,
    keys: list[str],
    data: Column | None = None,
    moves: Column | None = None,
    counted: Column | None = None,
    max_group_rows: int = MAX_GROUP_ROWS,
    block: int | None = None,
    aggs: dict[str, Aggregate] | None = None,
    whole: bool = False,
) -> Decision:
    """Sort every row into a session, or out.

    ``data`` marks the rows that enter sessions, ``moves`` those that move progress, and
    ``counted`` those that count (default: all rows each). ``pos`` is unique, or a batch
    number if progress is made per finished batch.

    With ``aggs`` the sessions and points have their states too, over timely rows. With ``whole`` the rows have all columns
    of ``df``: what becomes of late rows is decided on positions only, and the rows are fetched by position after that.
    """
    aggs = aggs or {}
    closing = _closing_positions(df, time, pos, policy, moves)
    weight = F.lit(1) if counted is None else F.when(counted, 1).otherwise(0)
    more = [c for c in df.columns if c not in keys] if aggs or whole else []
    rows = df.select(
        *keys, *more, F.col(time).alias("_t"), F.col(pos).cast(POSITION).alias("_pos"), weight.cast("bigint").alias("_weight"),
        (F.lit(True) if data is None else data).alias("_data"),
    ).filter("_data").drop("_data").join(closing, F.col("_t") == F.col("tick")).drop("tick")

    at = F.col("_pos")
    timely = _not_after(at, F.col("_alive_pos")) & _not_after(at, F.col("_accept_pos"))
    points = written(
        rows.filter(timely)
        .groupBy(*keys, "_t")
        .agg(
            F.count(F.lit(1)).alias("_rows"),
            F.sum("_weight").alias("count"),
            F.min("_pos").alias("_first_pos"),
            F.min("_fire_pos").alias("_fire_pos"),
            F.min("_alive_pos").alias("_alive_pos"),
            F.min(F.least("_alive_pos", "_accept_pos")).alias("_joinable_pos"),
            *partial_columns(aggs),
        )
    )
    summary = points
    few = at_most(summary, MAX_GROUP_ROWS)
    points = _cuts(points, "_t", keys, policy, "_alive_pos", "_cut_after", few)
    late = rows.filter(~timely)

    if policy.pre_merge:
        merges = {"count": F.sum} | state_merges(aggs)
        spine = islands(points, "_t", keys, merges, None, cut_after="_cut_after", block=block, rows=summary)
        nothing = late.limit(0).withColumn("island", F.lit(None).cast("bigint"))
        return Decision(
            _with_fire(spine, closing, keys), rows.filter(timely), points, nothing, late.limit(0), late
        )
    narrow = late.drop(*more)

    def fetched(found: DataFrame) -> DataFrame:
        if not more:
            return found
        there = late.select(F.col("_pos").alias("_at"), *more)
        return found.join(there, F.col("_pos") == F.col("_at")).drop("_at")

    points = written(label_islands(points, "_t", keys, "_cut_after", "island", summary, block))
    spine = points.groupBy(*keys, "island").agg(
        F.min("_t").alias("first"), F.max("_t").alias("last"), F.sum("count").alias("count"), *merged_columns(aggs)
    ).drop("island")

    offered = _offered_session(narrow, points, keys, policy, max_group_rows, block, few)
    verdicts = _acceptance(offered, points, keys, policy, block, few)
    alone = ~F.col("_joins") & _not_after(at, F.col("_accept_pos"))
    return Decision(
        _with_fire(spine, closing, keys),
        rows.filter(timely),
        points,
        fetched(verdicts.filter("_joins").drop("_joins")),
        fetched(verdicts.filter(alone).drop("_joins", "island")),
        fetched(verdicts.filter(~F.col("_joins") & ~alone).drop("_joins", "island")),
    )


def _with_fire(spine: DataFrame, closing: DataFrame, keys: list[str]) -> DataFrame:
    """Sessions plus the position at which they fire (NULL: progress never got there)."""
    return spine.join(
        closing.select(F.col("tick").alias("last"), F.col("_fire_pos").alias("fire_pos")), "last"
    ).select(*spine.columns, "fire_pos")


def _offered_session(
    late: DataFrame, points: DataFrame, keys: list[str], policy: SessionPolicy, max_group_rows: int, block: int | None, few: bool
) -> DataFrame:
    """``late`` plus ``island``: the earliest session of the key that was open when the row came.

    "Open" means born before the row and still joinable. Where joinable ends before removal, a
    session may pause between two of its rows, so the stretches without a pause are looked at.
    """
    stretches = points
    if policy.accept < policy.alive:
        again = _cuts(points.drop("_cut_after"), "_t", keys, policy, "_joinable_pos", "_pause_after", few)
        stretches = label_islands(
            again.withColumn("_end_after", F.col("_pause_after")), "_t", keys, "_end_after", "_stretch", points, block
        )
    else:
        stretches = stretches.withColumn("_stretch", F.col("island"))
    stretches = stretches.groupBy(*keys, "_stretch").agg(
        F.first("island").alias("island"),
        F.min("_first_pos").alias("_born"),
        F.max_by("_joinable_pos", "_t").alias("_dies"),
    )
    # Over the stretches of a key from the last to the first: the following one, and the
    # earliest birth from here on.
    stretches = written(
        running(
            stretches,
            keys,
            "_stretch",
            {
                "_next": Running("min", "_stretch", inclusive=False),
                "_any_born": Running("min", "_born"),
            },
            max_group_rows,
            descending=True,
            rows=points,
        )
    )
    # The first stretch that had not ended when the row came. Stretches end in time order, so it
    # is the smallest one among those that end at or after the row's position.
    ends = stretches.select(
        *keys,
        F.coalesce("_dies", never()).alias("_at"),
        F.lit(1).alias("_is_end"),
        F.col("_stretch").alias("_candidate"),
        F.lit(None).cast("bigint").alias("_t"),
        F.lit(None).cast(POSITION).alias("_pos"),
        *[F.lit(None).cast(late.schema[c].dataType).alias(c) for c in _CARRIED],
    )
    asks = late.select(
        *keys,
        F.col("_pos").alias("_at"),
        F.lit(0).alias("_is_end"),
        F.lit(None).cast("bigint").alias("_candidate"),
        "_t",
        "_pos",
        *_CARRIED,
    )
    questions = written(ends.unionByName(asks))
    open_rows = written(
        running(
            questions,
            keys,
            ["_at", "_is_end"],
            {"_stretch": Running("min", "_candidate")},
            max_group_rows,
            descending=True,
            rows=questions,
        )
        .filter("_is_end = 0")
        .select(*keys, "_t", "_pos", *_CARRIED, "_stretch")
    )
    # That stretch may be born later than the row while a later one is already open.
    facts = broadcast_if_small(stretches)
    settled = []
    while True:
        looked = join_null_safe(open_rows, facts, [*keys, "_stretch"])
        found = F.coalesce(F.col("_born") < F.col("_pos"), F.lit(False))
        hopeless = F.col("_stretch").isNull() | F.coalesce(F.col("_any_born") >= F.col("_pos"), F.lit(True))
        done = looked.filter(found | hopeless).withColumn("island", F.when(found, F.col("island")))
        settled.append(done.select(*keys, "_t", "_pos", *_CARRIED, "island"))
        rest = looked.filter(~(found | hopeless))
        if rest.isEmpty():
            break
        open_rows = written(
            rest.select(*keys, "_t", "_pos", *_CARRIED, F.col("_next").alias("_stretch"))
        )
    result = settled[0]
    for more in settled[1:]:
        result = result.unionByName(more)
    return written(result)


# Ticks per block where runs of late ticks are followed: the most rows of a block, one for each tick.
_BLOCK_TICKS = 1 << 20
# Rounds of plain relaxation before runs of late ticks are followed inside their blocks.
_PLAIN_ROUNDS = 6


def _acceptance(
    offered: DataFrame, points: DataFrame, keys: list[str], policy: SessionPolicy, block: int | None, few: bool
) -> DataFrame:
    """``offered`` plus ``_joins``: was the late row accepted by the session it was offered?

    Two bounds per (keys, session, tick) close in on the position of the first row kept there:
    ``_most`` counts only rows known to be kept, ``_least`` also those that still may be. A row
    after ``_most`` of the ticks ahead joins, one not after ``_least`` does not; the others wait
    for the next round. The position at a tick depends on later ticks only, so the bounds meet.

    The rows that were in time never change: what they say for a tick (``_in_time``) is looked up
    once, and the rounds only look at ticks of late rows.
    """
    group = [*keys, "island"]
    at_tick = [*group, "_t"]
    columns = [*offered.columns, "_in_time"]
    late = offered.filter(F.col("island").isNotNull())
    unknown = F.lit(None).cast(POSITION)
    asked = written(late.groupBy(*at_tick).agg(F.min("_pos").alias("_least")))
    few = few and at_most(asked, MAX_GROUP_ROWS)
    in_time = range_min_ahead(
        points.select(*at_tick, "_first_pos"), asked.select(*at_tick), group, "_t", {"_first_pos": "_in_time"}, policy.reach, few
    )
    bounds = written(
        join_null_safe(asked, in_time, at_tick).select(*at_tick, unknown.alias("_most"), "_least", "_in_time")
    )
    waiting = join_null_safe(late, bounds.select(*at_tick, "_in_time"), at_tick).select(*columns)
    settled = [offered.filter(F.col("island").isNull()).withColumn("_joins", F.lit(False))]
    ticks, rounds = bounds, 0
    while True:
        ahead = range_min_ahead(
            bounds, ticks.select(*at_tick), group, "_t", {"_most": "_after_most", "_least": "_after_least"}, policy.reach, few
        )
        judged = written(join_null_safe(waiting, ahead, at_tick))
        joins = F.coalesce(F.col("_pos") > F.least("_after_most", "_in_time"), F.lit(False))
        may_join = F.coalesce(F.col("_pos") > F.least("_after_least", "_in_time"), F.lit(False))
        open_still = may_join & ~joins
        settled.append(judged.filter(~open_still).withColumn("_joins", joins).select(*offered.columns, "_joins"))
        waiting = judged.filter(open_still).select(*columns)
        if waiting.isEmpty():
            break
        rounds += 1
        ticks = judged.groupBy(*at_tick).agg(
            F.min(F.when(joins, F.col("_pos"))).alias("_new_most"),
            F.min(F.when(may_join, F.col("_pos"))).alias("_new_least"),
            F.min(F.when(open_still, F.col("_pos"))).alias("_earliest"),
            F.max(F.when(open_still, F.col("_pos"))).alias("_latest"),
        )
        updated = join_null_safe(bounds, ticks.withColumn("_seen", F.lit(True)), at_tick)
        bounds = updated.select(
            *at_tick,
            F.least("_most", "_new_most").alias("_most"),
            F.when(F.col("_seen"), F.least("_most", "_new_least")).otherwise(F.col("_least")).alias("_least"),
            "_in_time",
            "_earliest",
            "_latest",
        )
        bounds = written(bounds)
        if rounds > _PLAIN_ROUNDS:
            bounds = written(_along_ticks(bounds, group, policy.reach, block or max(_BLOCK_TICKS, 4 * policy.reach), few))
        ticks = bounds.filter(F.col("_earliest").isNotNull())
        bounds = bounds.select(*at_tick, "_most", "_least", "_in_time")
    result = settled[0]
    for more in settled[1:]:
        result = result.unionByName(more)
    return result


def _along_ticks(bounds: DataFrame, group: list[str], reach: int, width: int, few: bool) -> DataFrame:
    """Tighten both bounds down runs of unsettled ticks, from late to early.

    One input row per tick, so a block of ``width`` ticks (and the first ``reach`` ticks of the
    next one, to read from) bounds the group; a run that crosses blocks goes on in the next round.
    """
    columns = [*group, "_t", "_most", "_least", "_in_time", "_earliest", "_latest"]
    waits = F.col("_earliest").isNotNull()
    settled = bounds.filter(~waits)
    unsettled = bounds.filter(waits)
    outside = range_min_ahead(
        settled.select(*group, "_t", "_most"), unsettled.select(*group, "_t"), group, "_t", {"_most": "_outside"}, reach, few
    )
    own = floor_div(F.col("_t"), width)
    seen_by = F.array(own, floor_div(F.col("_t") - reach, width))
    frames = (
        join_null_safe(unsettled, outside, [*group, "_t"])
        .withColumn("_outside", F.least("_outside", "_in_time"))
        .withColumns({"_own": own, "_tick_block": F.explode(F.array_distinct(seen_by))})
        .withColumn("_mine", F.col("_own") == F.col("_tick_block"))
    )
    kinds = {f.name: f.dataType.simpleString() for f in bounds.schema.fields}

    def follow(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_t", ascending=False, ignore_index=True)
        frame["_most"], frame["_least"] = _follow(frame, reach)
        return frame.loc[frame["_mine"], columns]

    followed = frames.groupBy(*group, "_tick_block").applyInPandas(
        follow, ", ".join(f"`{c}` {kinds[c]}" for c in columns)
    )
    return settled.select(*columns).unionByName(followed)


def _follow(frame: pd.DataFrame, reach: int) -> tuple[list, list]:
    """The tightened bounds of ticks that are sorted from late to early."""
    ahead: tuple[deque, deque] = (deque(), deque())  # (tick, bound) of most / least, bounds rising

    def opened(queue: deque, tick: int, outside):
        while queue and queue[0][0] > tick + reach:
            queue.popleft()
        return min((b for b in (queue[0][1] if queue else None, outside) if b is not None), default=None)

    def remember(queue: deque, tick: int, bound) -> None:
        if bound is not None:
            while queue and queue[-1][1] >= bound:
                queue.pop()
            queue.append((tick, bound))

    mosts, leasts = [], []
    names = ["_t", "_mine", "_earliest", "_latest", "_most", "_least", "_outside"]
    for tick, mine, earliest, latest, most, least, outside in zip(*(frame[name] for name in names)):
        most_open, least_open = opened(ahead[0], tick, outside), opened(ahead[1], tick, outside)
        if mine:
            if most_open is not None and earliest > most_open and (most is None or earliest < most):
                most = earliest
            if least_open is None or latest <= least_open:
                least = most  # none of the waiting rows joins
            elif least <= least_open:
                least = least_open if most is None else min(most, least_open)
        mosts.append(most)
        leasts.append(least)
        remember(ahead[0], tick, most)
        remember(ahead[1], tick, least)
    return mosts, leasts


def policy_sessions(
    df: DataFrame,
    time: str,
    pos: str,
    policy: SessionPolicy,
    keys: list[str],
    data: Column | None = None,
    moves: Column | None = None,
    counted: Column | None = None,
    flush: bool = True,
    end_is_last: bool = False,
    max_group_rows: int = MAX_GROUP_ROWS,
    block: int | None = None,
    aggs: dict[str, Aggregate] | None = None,
) -> DataFrame:
    """One row per session with all the rows the policy accepted: ``start, end, keys, count``, or instead of the count the
    results of ``aggs``, which then say themselves (``Agg(when=...)``) which rows count.

    Without ``flush`` sessions that progress never closed are left out. ``end_is_last`` labels
    the session with its last event instead of ``last + gap``.
    """
    if aggs is not None:
        return _aggregated_sessions(df, time, pos, policy, keys, data, moves, flush, end_is_last, max_group_rows, block, aggs)
    decision = decide(df, time, pos, policy, keys, data, moves, counted, max_group_rows, block)
    fired = decision.sessions if flush else decision.sessions.filter(F.col("fire_pos").isNotNull())
    extra = decision.joined.groupBy(*keys, "island").agg(
        F.min("_t").alias("_from"), F.sum("_weight").alias("_more")
    )
    result = join_null_safe(fired, extra.withColumnRenamed("island", "first"), [*keys, "first"]).select(
        F.least("first", "_from").alias("first"),
        "last",
        *keys,
        (F.col("count") + F.coalesce("_more", F.lit(0))).alias("count"),
    )
    single = decision.single.select(
        F.col("_t").alias("first"), F.col("_t").alias("last"), *keys, F.col("_weight").alias("count")
    )
    end = F.col("last") if end_is_last else F.col("last") + policy.gap
    return result.unionByName(single).select(F.col("first").alias("start"), end.alias("end"), *keys, "count")


def _aggregated_sessions(
    df: DataFrame, time: str, pos: str, policy: SessionPolicy, keys: list[str], data: Column | None, moves: Column | None,
    flush: bool, end_is_last: bool, max_group_rows: int, block: int | None, aggs: dict[str, Aggregate],
) -> DataFrame:
    """`policy_sessions` with other aggregates: states of timely rows come with the sessions, those of late rows that
    joined are added by session, and rows that are alone are sessions of their own."""
    names, aggs = list(aggs), {f"_agg_{name}": agg for name, agg in aggs.items()}
    decision = decide(df, time, pos, policy, keys, data, moves, None, max_group_rows, block, aggs)
    states = list(state_merges(aggs))
    fired = decision.sessions if flush else decision.sessions.filter(F.col("fire_pos").isNotNull())
    joined = decision.joined.groupBy(*keys, F.col("island").alias("_session")).agg(F.min("_t").alias("_from"), *partial_columns(aggs))
    open_ended = F.lit(None).cast("bigint")
    both = fired.select(*keys, F.col("first").alias("_session"), F.col("first").alias("_from"), "last", *states).unionByName(
        joined.select(*keys, "_session", "_from", open_ended.alias("last"), *states))
    merged = both.groupBy(*keys, "_session").agg(F.min("_from").alias("first"), F.max("last").alias("last"), *merged_columns(aggs))
    single = decision.single.groupBy(*keys, "_t", "_pos").agg(*partial_columns(aggs)).select(
        *keys, F.col("_t").alias("first"), F.col("_t").alias("last"), *states)
    end = F.col("last") if end_is_last else F.col("last") + policy.gap
    # late rows of a session that is not reported have no last tick
    found = merged.filter(F.col("last").isNotNull()).select(*keys, "first", "last", *states).unionByName(single)
    results = [result.alias(name) for result, name in zip(finished_columns(aggs), names)]
    return found.select(F.col("first").alias("start"), end.alias("end"), *keys, *results)


def dropped_rows(
    df: DataFrame,
    time: str,
    pos: str,
    policy: SessionPolicy,
    keys: list[str],
    data: Column | None = None,
    moves: Column | None = None,
    **options,
) -> DataFrame:
    """The rows no session accepted: ``keys, time, pos``, or with ``whole=True`` all their columns."""
    decision = decide(df, time, pos, policy, keys, data, moves, None, **options)
    if options.get("whole"):
        return decision.dropped.select(*df.columns)
    return decision.dropped.select(
        *keys, F.col("_t").alias(time), F.col("_pos").cast(df.schema[pos].dataType).alias(pos)
    )
