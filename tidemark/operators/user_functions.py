"""Window functions in Python: a user's code over sliding, session and count windows.

A ``WindowFunction`` works on states: ``make`` an empty one, ``add`` rows to it, ``merge`` two, ``finish`` the result of a window.
Rows are folded to states where they are read, one state per key and slice of a window and task, in Arrow batches; only
states are shuffled, merged to windows, and finished. So no call ever gets a whole window, a row is read once whatever the
number of windows it is in, and a hot key costs a state per task and slice.

What can be said in Spark expressions is better given as ``windows.Composed``, which stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import gcd
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from tidemark.functions.ticks import floor_to
from tidemark.operators.count_windows import at_firings, number_rows, slice_of
from tidemark.operators.islands import islands, label_islands
from tidemark.operators.running import MAX_GROUP_ROWS
from tidemark.operators.windows import window_starts
from tidemark.session import join_null_safe, materialise

# A task holds this many states before it passes them on.
_MOST_STATES = 1 << 14


class WindowFunction:
    """A user's function over the rows of a window.

    ``inputs`` are the columns it reads, ``state`` and ``result`` the types (DDL) of a state, a tuple, and of the result.
    Rows are added and states merged in no particular order; whoever needs one keeps what orders rows in the state.
    """

    inputs: list[str] = []
    state: str = "n bigint"
    result: str = "bigint"

    def make(self) -> tuple:
        """The state of no rows."""
        raise NotImplementedError

    def add(self, state: tuple, rows: pa.Table) -> tuple:
        """The state with some rows of a window more; ``rows`` has the columns ``inputs``."""
        raise NotImplementedError

    def merge(self, left: tuple, right: tuple) -> tuple:
        """The state of the rows of both."""
        raise NotImplementedError

    def finish(self, state: tuple, window: dict[str, Any]) -> Any:
        """The result; ``window`` has the window's bounds (``start, end``, or ``firing``) and its keys."""
        raise NotImplementedError


def _state_type(function: WindowFunction) -> StructType:
    return StructType([StructField(f"_state_{f.name}", f.dataType) for f in StructType.fromDDL(function.state)])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def fold(df: DataFrame, groups: dict[str, Column], function: WindowFunction) -> DataFrame:
    """``groups``, the state of the function and ``_n``, the number of rows: one or more states for each group, folded by each
    task over its own rows. Nothing is shuffled."""
    keys = list(groups)
    picked = df.select(*[c.alias(k) for k, c in groups.items()], *[F.col(c).alias(f"_in_{c}") for c in function.inputs])
    schema = StructType([*picked.schema.fields[: len(keys)], *_state_type(function), *StructType.fromDDL("_n bigint")])
    arrow, inputs = to_arrow_schema(schema), list(function.inputs)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple, tuple[tuple, int]] = {}
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rows = table.select([f"_in_{c}" for c in inputs]).rename_columns(inputs)
            numbered = table.select(keys).append_column("_row", pa.array(range(table.num_rows), pa.int64()))
            places = numbered.group_by(keys, use_threads=False).aggregate([("_row", "list")])
            for *group, at in zip(*(places[k].to_pylist() for k in keys), places["_row_list"].to_pylist()):
                group = tuple(group)
                state, n = states.get(group) or (function.make(), 0)
                states[group] = (function.add(state, rows.take(pa.array(at, pa.int64()))), n + len(at))
            if len(states) >= _MOST_STATES:
                yield _batch([(*g, *s, n) for g, (s, n) in states.items()], arrow)
                states.clear()
        yield _batch([(*g, *s, n) for g, (s, n) in states.items()], arrow)

    return picked.mapInArrow(of, schema)


def merge_states(states: DataFrame, keys: list[str], function: WindowFunction) -> DataFrame:
    """One state for each group ``keys``, with the sum of ``_n``: tasks merge what they hold, the rest is shuffled by group."""
    schema = StructType([states.schema[c] for c in [*keys, *_state_type(function).names, "_n"]])
    arrow, width = to_arrow_schema(schema), len(keys)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                yield row[:width], row[width:-1], row[-1]

    def before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[tuple, int]] = {}
        for group, state, n in parts(batches):
            old = held.get(group)
            held[group] = (state, n) if old is None else (function.merge(old[0], state), old[1] + n)
            if len(held) >= _MOST_STATES:
                yield _batch([(*g, *s, n) for g, (s, n) in held.items()], arrow)
                held.clear()
        yield _batch([(*g, *s, n) for g, (s, n) in held.items()], arrow)

    def after(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        current: tuple | None = None
        for group, state, n in parts(batches):
            if current is not None and current[0] == group:
                current = (group, function.merge(current[1], state), current[2] + n)
                continue
            if current is not None:
                done.append((*current[0], *current[1], current[2]))
                if len(done) >= _MOST_STATES:
                    yield _batch(done, arrow)
                    done = []
            current = (group, state, n)
        if current is not None:
            done.append((*current[0], *current[1], current[2]))
        yield _batch(done, arrow)

    local = states.select(*schema.names).mapInArrow(before, schema)
    # a group's states are next to each other in one partition
    return local.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(after, schema)


def finish(states: DataFrame, window: list[str], function: WindowFunction, name: str) -> DataFrame:
    """``window`` (bounds and keys) and the function's result ``name``, for states of whole windows."""
    result = StructType.fromDDL(f"r {function.result}")["r"].dataType
    schema = StructType([*[states.schema[c] for c in window], StructField(name, result)])
    arrow, width = to_arrow_schema(schema), len(window)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns))
            yield _batch([(*r[:width], function.finish(r[width:], dict(zip(window, r)))) for r in rows], arrow)

    return states.select(*window, *_state_type(function).names).mapInArrow(of, schema)


def sliding_function(
    df: DataFrame, time: str, size: int, slide: int, keys: list[str], function: WindowFunction, name: str = "result"
) -> DataFrame:
    """``start, end, keys`` and the function's result for every sliding window with rows (``slide`` = ``size``: tumbling). Rows
    without a time are in no window."""
    pane = floor_to(F.col(time), gcd(size, slide))
    timed = df.filter(F.col(time).isNotNull())
    slices = merge_states(fold(timed, {**{k: F.col(k) for k in keys}, "_pane": pane}, function), [*keys, "_pane"], function)
    spread = slices.withColumn("start", F.explode(window_starts(F.col("_pane"), size, slide)))
    windows = merge_states(spread, [*keys, "start"], function).withColumn("end", F.col("start") + size)
    return finish(windows, ["start", "end", *keys], function, name)


def session_function(
    df: DataFrame, time: str, gap: int, keys: list[str], function: WindowFunction, name: str = "result",
    inclusive: bool = True, block: int | None = None,
) -> DataFrame:
    """``start, end, keys`` and the function's result for every session ``[first, last + gap)``. Rows are folded to one state
    per key and tick; which session a tick is in is told from the ticks alone."""
    timed = df.filter(F.col(time).isNotNull())
    ticks = merge_states(fold(timed, {**{k: F.col(k) for k in keys}, "_t": F.col(time)}, function), [*keys, "_t"], function)
    ticks = materialise(ticks)
    found = islands(ticks.select(*keys, "_t", "_n"), "_t", keys, {"_n": F.sum}, gap, inclusive, block=block)
    ends = found.select(*keys, F.col("last").alias("_t"), F.lit(True).alias("_ends"))
    labelled = label_islands(join_null_safe(ticks, ends, [*keys, "_t"]), "_t", keys, "_ends", "start", ticks, block)
    ended = labelled.withColumn("end", F.when(F.col("_ends"), F.col("_t") + gap))
    # the end is the largest tick of the session, known at its last one only
    sessions = merge_states(ended, [*keys, "start"], function)
    bounds = ended.filter("_ends").select(*keys, "start", "end")
    return finish(join_null_safe(sessions, bounds, [*keys, "start"]), ["start", "end", *keys], function, name)


def count_function(
    df: DataFrame, pos: str | list[str], size: int, slide: int, keys: list[str], function: WindowFunction, name: str = "result",
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """``keys, firing`` and the function's result for windows of the last ``size`` rows, every ``slide`` rows in arrival order."""
    order = [pos] if isinstance(pos, str) else pos
    needed = dict.fromkeys([*keys, *order, *function.inputs])
    numbered = number_rows(df.select(*needed), order, keys, max_group_rows)
    slices = fold(numbered, {**{k: F.col(k) for k in keys}, "_slice": slice_of(size, slide)}, function)
    slices = merge_states(slices, [*keys, "_slice"], function)
    fired = merge_states(at_firings(slices, size, slide), [*keys, "firing"], function)
    # the first windows are shorter; one whose firing row never came is not complete
    complete = fired.filter(F.col("_n") == F.least(F.col("firing"), F.lit(size)))
    return finish(complete, [*keys, "firing"], function, name)
