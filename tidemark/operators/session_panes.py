"""Everything a session reports while it grows: early, on time, again after a late row.

Which session a row ends up in is decided by ``session_policies.decide``; here the rows of each
session are followed in arrival order.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from tidemark.functions.ticks import POSITION, arrival_position, floor_div, position_parts
from tidemark.operators.islands import range_min_ahead
from tidemark.operators.progress import watermark_per_record
from tidemark.operators.running import MAX_GROUP_ROWS, Running, largest_group, running
from tidemark.operators.session_policies import Decision, SessionPolicy, decide
from tidemark.session import join_null_safe, written


# What a task is told about a session, in this order at equal positions.
_UNTIL, _PART, _ROW, _STEP, _MARK = range(5)
# Reports a task holds before it passes them on.
_MOST_REPORTS = 10_000


def _members(decision: Decision, keys: list[str]) -> DataFrame:
    """All rows that sessions kept, with the session they are in."""
    timely = join_null_safe(
        decision.timely.select(*keys, "_t", "_pos", "_fire_pos"),
        decision.points.select(*keys, "_t", "island"),
        [*keys, "_t"],
        "inner",
    )
    return timely.unionByName(decision.joined.select(*keys, "_t", "_pos", "_fire_pos", "island"))


def early_panes(
    df: DataFrame,
    time: str,
    pos: str,
    policy: SessionPolicy,
    keys: list[str],
    every: int,
    reset_on_extend: bool = False,
    max_group_rows: int = MAX_GROUP_ROWS,
    **options,
) -> DataFrame:
    """A report after every ``every``-th row of a session and one when it closes:
    ``start, end, keys, pane_kind, count`` with the bounds and the count at that moment.

    For policies under which a key has one open session at a time (progress is the largest time
    seen, no allowed lateness). ``reset_on_extend`` starts counting anew whenever a row moves a
    bound of the session; otherwise the counter goes on.
    """
    if policy.alive > policy.fire or policy.accept > policy.fire:
        raise ValueError("with allowed lateness, session_panes gives early reports")
    decision = decide(df, time, pos, policy, keys, max_group_rows=max_group_rows, **options)
    group = [*keys, "island"]
    rows = written(_members(decision, keys))
    order = "_pos"
    grown = running(
        rows,
        group,
        order,
        {
            "first": Running("min", "_t"),
            "last": Running("max", "_t"),
            "count": Running("count"),
            "_first_before": Running("min", "_t", inclusive=False),
            "_last_before": Running("max", "_t", inclusive=False),
        },
        max_group_rows,
        rows=rows,
    )
    turn = F.col("count")
    if reset_on_extend:
        extends = F.col("_first_before").isNull() | (F.col("_t") < F.col("_first_before")) | (
            F.col("_t") > F.col("_last_before")
        )
        runs = running(
            grown.withColumn("_extends", extends.cast("bigint")), group, order, {"_run": Running("sum", "_extends")},
            max_group_rows, rows=rows,
        )
        grown = running(runs, [*group, "_run"], order, {"_turn": Running("count")}, max_group_rows, rows=rows)
        turn = F.col("_turn")
    early = grown.filter(turn % every == 0).withColumn("pane_kind", F.lit("early"))
    final = (
        rows.groupBy(*group)
        .agg(F.min("_t").alias("first"), F.max("_t").alias("last"), F.count(F.lit(1)).alias("count"))
        .withColumn("pane_kind", F.lit("on_time"))
    )
    shape = [F.col("first").alias("start"), (F.col("last") + policy.gap).alias("end"), *keys, "pane_kind", "count"]
    return early.select(*shape).unionByName(final.select(*shape))


def session_panes(
    df: DataFrame,
    time: str,
    pos: str,
    policy: SessionPolicy,
    keys: list[str],
    moves: Column | None = None,
    data: Column | None = None,
    repeat: bool = False,
    flush: bool = True,
    early_every: int | None = None,
    max_group_rows: int = MAX_GROUP_ROWS,
    **options,
) -> DataFrame:
    """Every report of a session: ``start, end, keys, pane_kind, count``.

    ``early`` when a row takes the count of a session that has not fired past a multiple of ``early_every``: when a row
    joins several sessions, their counters merge with them, and it reports if the merged count is past more multiples than
    the counts before were together. ``on_time`` when a session fires, ``late`` for each row that joins it after that. With
    ``repeat`` a fired session is reported again (``repeat``) each time progress moves, until it is removed. A bridge
    between two sessions that had fired apart shows as ``late`` with the merged bounds.

    Rows of a session stream through a task in arrival order; only its open parts are held. A session with more than
    ``max_group_rows`` rows is cut into chunks by arrival, each of which starts from the parts that were open by then
    (`_parts_before`). With ``repeat`` a session stays in one task.
    """
    decision = decide(df, time, pos, policy, keys, data=data, moves=moves, max_group_rows=max_group_rows, **options)
    group = [*keys, "island"]
    rows = written(_members(decision, keys))
    nothing = F.lit(None).cast(POSITION)
    chunk = F.lit(0).cast("bigint").alias("_chunk")
    shape = [*group, "_chunk", "_kind", "_t", "_pos", "_fire_pos", "_last", "_count", "_fired"]
    plain = {"_last": F.lit(None).cast("bigint"), "_count": F.lit(None).cast("bigint"), "_fired": F.lit(None).cast("boolean")}
    if repeat:
        parts = rows.select(*group, chunk, "_pos", F.lit(_ROW).alias("_kind"), "_t", "_fire_pos")
        parts = parts.unionByName(_steps(df, rows, decision, time, pos, policy, keys, moves, nothing).select("*", chunk))
        parts = parts.withColumns(plain)
    elif largest_group(rows, group) <= max_group_rows:
        parts = rows.select(*group, chunk, "_pos", F.lit(_ROW).alias("_kind"), "_t", "_fire_pos").withColumns(plain)
    else:
        numbered = running(rows, group, "_pos", {"_rn": Running("count")}, max_group_rows, rows=rows)
        chunked = written(numbered.withColumn("_chunk", floor_div(F.col("_rn") - 1, max_group_rows)).drop("_rn"))
        parts = chunked.withColumn("_kind", F.lit(_ROW)).withColumns(plain).select(*shape).unionByName(
            _parts_before(chunked, group, policy, max_group_rows).select(*shape))
    (hi, lo), (fire_hi, fire_lo) = position_parts(F.col("_pos")), position_parts(F.col("_fire_pos"))
    sent = parts.select(
        *group, "_chunk", "_kind", "_t", "_last", "_count", "_fired",
        hi.alias("_hi"), lo.alias("_lo"), fire_hi.alias("_fire_hi"), fire_lo.alias("_fire_lo"),
    )
    schema = StructType([
        StructField("start", LongType()), StructField("end", LongType()), *[sent.schema[k] for k in keys],
        StructField("pane_kind", StringType()), StructField("count", LongType()),
    ])
    arrow, width = to_arrow_schema(schema), len(group) + 1

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts = None, None
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                session, (kind, tick, last, count, fired, hi, lo, fire_hi, fire_lo) = row[:width], row[width:]
                if session != current:
                    if parts is not None:
                        out += parts.end(flush)
                    current, parts = session, _OpenParts(policy, repeat, early_every, session[: len(keys)])
                at = None if hi is None else hi << 64 | lo
                fire_at = None if fire_hi is None else fire_hi << 64 | fire_lo
                if kind == _ROW:
                    parts.row(tick, at, fire_at)
                elif kind == _STEP:
                    parts.step(at)
                elif kind == _PART:
                    parts.start(tick, last, count, fired, fire_at)
                else:
                    parts.until = at
                if len(parts.out) > _MOST_REPORTS:
                    out += parts.take()
            if parts is not None:
                out += parts.take()
            yield _reports(out, arrow)
        if parts is not None:
            yield _reports(parts.end(flush), arrow)

    # A session's rows, or those of a chunk, are in one partition, next to each other and in arrival order.
    ordered = sent.repartition(*group, "_chunk").sortWithinPartitions(*group, "_chunk", "_hi", "_lo", "_kind")
    return ordered.mapInArrow(follow, schema)


def _reports(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _parts_before(chunked: DataFrame, group: list[str], policy: SessionPolicy, max_group_rows: int) -> DataFrame:
    """What each chunk of a session starts from: the parts that the rows of all chunks before had made, with their counts and
    whether they had fired, and the position up to which the chunk settles what fires (the next one's first row).

    Parts of several chunks unite like intervals, and their counts add up. A part has fired if it holds a tick that was the
    last of its part when progress passed it: no row within reach ahead of it had come by then. So what a chunk adds is
    known from its own rows, and only these few parts and ticks go along the chunks of a session.
    """
    nothing, no_flag = F.lit(None).cast("bigint"), F.lit(None).cast("boolean")
    chunk = [*group, "_chunk"]
    begins = chunked.groupBy(*chunk).agg(F.min("_pos").alias("_begin"))
    along = Window.partitionBy(*group).orderBy("_chunk")  # as many rows as chunks
    untils = begins.withColumn("_until", F.lead("_begin").over(along))
    ticks = chunked.groupBy(*group, "_t").agg(F.min("_pos").alias("_first_pos"), F.first("_fire_pos").alias("_fire_pos"))
    ahead = range_min_ahead(ticks, ticks.select(*group, "_t"), group, "_t", {"_first_pos": "_ahead"}, policy.reach)
    passed = F.greatest("_first_pos", "_fire_pos")
    marks = (
        join_null_safe(ticks, ahead, [*group, "_t"])
        .filter(F.col("_fire_pos").isNotNull() & (F.col("_ahead").isNull() | (F.col("_ahead") > passed)))
        .select(*group, passed.alias("_pos"), F.lit(1).alias("_after"), nothing.alias("_begun"), "_t")
    )
    starts = begins.select(*group, F.col("_begin").alias("_pos"), F.lit(0).alias("_after"), F.col("_chunk").alias("_begun"), nothing.alias("_t"))
    placed = running(
        marks.unionByName(starts), group, ["_pos", "_after", "_t"], {"_chunk": Running("max", "_begun")}, max_group_rows
    ).filter("_begun IS NULL").select(*chunk, F.lit(_MARK).alias("_kind"), F.col("_t").alias("_first"), F.col("_t").alias("_last"),
                                      nothing.alias("_count"), F.lit(None).cast(POSITION).alias("_fire_pos"))
    by_tick = chunked.groupBy(*chunk, "_t").agg(F.count(F.lit(1)).alias("_count"), F.first("_fire_pos").alias("_fire_pos"))
    merges = {"_count": F.sum, "_fire_pos": lambda c: F.max_by(c, "_t")}
    pieces = label_pieces(by_tick, chunk, policy.reach)
    united = pieces.groupBy(*chunk, "_piece").agg(
        F.min("_t").alias("_first"), F.max("_t").alias("_last"), *[f(c).alias(c) for c, f in merges.items()]
    ).select(*chunk, F.lit(_PART).alias("_kind"), "_first", "_last", "_count", "_fire_pos")
    ends = untils.select(*chunk, F.lit(_UNTIL).alias("_kind"), nothing.alias("_first"), nothing.alias("_last"), nothing.alias("_count"), F.col("_until").alias("_fire_pos"))
    summary = united.unionByName(placed).unionByName(ends)
    hi, lo = position_parts(F.col("_fire_pos"))
    sent = summary.select(*chunk, "_kind", "_first", "_last", "_count", hi.alias("_hi"), lo.alias("_lo"))
    schema = StructType([*[sent.schema[c] for c in [*chunk, "_kind", "_first", "_last", "_count"]], StructField("_fired", BooleanType()), sent.schema["_hi"], sent.schema["_lo"]])
    arrow, width, reach = to_arrow_schema(schema), len(group), policy.reach

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, number, parts, found = None, None, [], []
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                session, (at, kind, first, last, count, hi, lo) = row[:width], row[width:]
                if session != current:
                    current, number, parts, found = session, at, [], []
                if at != number:
                    parts, found, number = _united(parts, found, reach), [], at
                if kind == _UNTIL:
                    out.append((*session, at, _UNTIL, None, None, None, None, hi, lo))
                    out += [(*session, at, _PART, f, last_, n, fired, *(fire or (None, None))) for f, last_, n, fired, fire in parts]
                else:
                    found.append((first, last, count or 0, kind == _MARK, None if hi is None else (hi, lo)))
            yield _reports(out, arrow)

    # in a chunk, what it starts from is given out first; its own parts and ticks follow
    order = F.when(F.col("_kind") == _UNTIL, 0).otherwise(1)
    carried = sent.withColumn("_order", order).repartition(*group).sortWithinPartitions(*chunk, "_order").drop("_order").mapInArrow(carry, schema)
    position = arrival_position(F.col("_hi"), F.col("_lo"))
    is_end = F.col("_kind") == _UNTIL
    return carried.select(
        *chunk, "_kind", F.col("_first").alias("_t"), F.when(is_end, position).alias("_pos"), F.when(~is_end, position).alias("_fire_pos"),
        "_last", "_count", "_fired",
    ).filter(~is_end | F.col("_pos").isNotNull())


def label_pieces(points: DataFrame, keys: list[str], reach: int) -> DataFrame:
    """``points`` (one row per key and ``_t``) plus ``_piece``: neighbours at most ``reach`` apart are in one."""
    along = Window.partitionBy(*keys).orderBy("_t")
    apart = F.coalesce(F.col("_t") - F.lag("_t").over(along) > reach, F.lit(True)).cast("int")
    return points.withColumn("_apart", apart).withColumn("_piece", F.sum("_apart").over(along)).drop("_apart")


def _united(parts: list[tuple], more: list[tuple], reach: int) -> list[tuple]:
    """Parts ``(first, last, count, fired, fire position)`` with some more; those within reach of each other become one."""
    out: list[tuple] = []
    for part in sorted([*parts, *more], key=lambda p: (p[0], p[1], p[4] is None)):
        if out and part[0] - out[-1][1] <= reach:
            first, last, count, fired, fire = out[-1]
            later = part if part[1] > last or (part[1] == last and fire is None) else out[-1]
            out[-1] = (first, max(last, part[1]), count + part[2], fired or part[3], later[4])
        else:
            out.append(part)
    return out


def _steps(df, rows, decision, time, pos, policy, keys, moves, nothing) -> DataFrame:
    """For every session the moments at which progress moved while it was there.

    A range join on blocks of ticks: a session takes part in the blocks it spans.
    """
    width = 4 * (policy.gap + max(policy.alive, 0) + 1)
    movers = df if moves is None else df.filter(moves)
    steps = (
        watermark_per_record(movers.select(F.col(time).alias("_to"), F.col(pos).cast(POSITION).alias("_pos")),
                             "_to", "_pos", "_from")
        .filter(F.col("_from").isNull() | (F.col("_to") > F.col("_from")))
        .withColumn("_block", floor_div(F.col("_to"), width))
    )
    spans = rows.groupBy(*keys, "island").agg(
        F.min("_t").alias("_lo"), F.max("_t").alias("_hi"), F.min("_pos").alias("_born")
    )
    low, high = F.col("_lo") + policy.gap + policy.fire, F.col("_hi") + policy.gap + policy.alive
    blocks = spans.withColumn("_block", F.explode(F.sequence(floor_div(low, width), floor_div(high, width))))
    inside = (
        blocks.join(steps, "_block")
        .filter((F.col("_to") >= low) & (F.col("_to") < high) & (F.col("_pos") > F.col("_born")))
        .select(*keys, "island", "_pos")
    )
    # the step that removes the session reports it once more
    removal = decision.points.groupBy(*keys, "island").agg(F.max_by("_alive_pos", "_t").alias("_pos")).filter(
        F.col("_pos").isNotNull()
    )
    return inside.unionByName(removal).select(
        *keys, "island", "_pos", F.lit(_STEP).alias("_kind"), F.lit(None).cast("bigint").alias("_t"),
        nothing.alias("_fire_pos"),
    )


class _OpenParts:
    """The parts of one session while its rows come in arrival order: intervals further apart than the reach, by time."""

    def __init__(self, policy: SessionPolicy, repeat: bool, early_every: int | None, key: tuple):
        self.policy, self.repeat, self.every, self.key = policy, repeat, early_every, key
        self.firsts: list[int] = []
        self.lasts: list[int] = []
        self.counts: list[int] = []
        self.fired: list[bool] = []
        self.fires: list[int | None] = []  # where progress passes the part's end
        self.next_fire: int | None = None  # the first of those that have not fired
        self.until: int | None = None
        self.out: list[tuple] = []

    def start(self, first: int, last: int, count: int, fired: bool, fire_at: int | None) -> None:
        i = bisect_right(self.firsts, first)
        self._insert(i, first, last, count, fired, fire_at)
        self._look_ahead()

    def _insert(self, i: int, first: int, last: int, count: int, fired: bool, fire_at: int | None) -> None:
        for held, value in ((self.firsts, first), (self.lasts, last), (self.counts, count), (self.fired, fired), (self.fires, fire_at)):
            held.insert(i, value)

    def _look_ahead(self) -> None:
        self.next_fire = min((at for at, done in zip(self.fires, self.fired) if at is not None and not done), default=None)

    def _report(self, i: int, kind: str) -> None:
        self.out.append((self.firsts[i], self.lasts[i] + self.policy.gap, *self.key, kind, self.counts[i]))

    def take(self) -> list[tuple]:
        out, self.out = self.out, []
        return out

    def _fire_before(self, at: int) -> None:
        for i, fire_at in enumerate(self.fires):
            if not self.fired[i] and fire_at is not None and fire_at < at:
                self.fired[i] = True
                self._report(i, "on_time")
        self._look_ahead()

    def row(self, tick: int, at: int, fire_at: int | None) -> None:
        # with ``repeat`` the steps fire
        if not self.repeat and self.next_fire is not None and self.next_fire < at:
            self._fire_before(at)
        reach, low, high = self.policy.reach, bisect_right(self.firsts, tick), bisect_right(self.firsts, tick)
        if low and tick - self.lasts[low - 1] <= reach:
            low -= 1
        if high < len(self.firsts) and self.firsts[high] - tick <= reach:
            high += 1
        first, last, count, fired, turns = tick, tick, 1, False, 0
        for i in range(low, high):
            first = min(first, self.firsts[i])
            if self.lasts[i] > last:
                last, fire_at = self.lasts[i], self.fires[i]
            count += self.counts[i]
            fired |= self.fired[i]
            turns += self.counts[i] // self.every if self.every else 0
        for held in (self.firsts, self.lasts, self.counts, self.fired, self.fires):
            del held[low:high]
        at_once = not self.repeat and fire_at is not None and fire_at < at  # complete before it came
        self._insert(low, first, last, count, fired or at_once, fire_at)
        if fired or at_once:
            self._report(low, "late")
        elif self.every and count // self.every > turns:
            self._report(low, "early")
        self._look_ahead()

    def step(self, at: int) -> None:
        """Progress moves at ``at``: parts that end by then report, for the first time or again."""
        for i, fire_at in enumerate(self.fires):
            if fire_at is not None and fire_at <= at:
                self._report(i, "repeat" if self.fired[i] else "on_time")
                self.fired[i] = True

    def end(self, flush: bool) -> list[tuple]:
        if self.until is not None:  # the next chunk goes on
            self._fire_before(self.until)
            return self.take()
        for i, fire_at in enumerate(self.fires):
            if not self.fired[i] and (flush or fire_at is not None):
                self.fired[i] = True
                self._report(i, "on_time")
        return self.take()
