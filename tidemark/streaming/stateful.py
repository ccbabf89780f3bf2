"""Late-data policies on a stream that Spark's own windows do not offer.

Allowed lateness with further reports, early reports, late rows as output, and session rules
on the merged session need state of their own: ``transformWithStateInPandas`` (with the RocksDB
state store, which spills to disk). The state of a window is one number and a mark; the state
of a key's sessions are its open sessions only.

The event-time column is left out before the state, so that late rows get there instead of being
dropped, while the declared watermark (delay zero) is the progress the state sees.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.lateness import SlidingPolicy
from tidemark.operators.session_policies import SessionPolicy
from tidemark.operators.windows import window_starts
from tidemark.streaming.live import with_progress, with_punctuated_progress

STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}

# Rows of a key that are followed before their reports are passed on.
_SLICE = 10_000

PANE = "start_ms bigint, end_ms bigint, key string, pane_kind string, count bigint"


def use_state_store(spark: SparkSession) -> SparkSession:
    """Select the state store these queries need."""
    for name, value in STATE_STORE.items():
        spark.conf.set(name, value)
    return spark


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["start_ms", "end_ms", "key", "pane_kind", "count"])


class _WindowPanes(StatefulProcessor):
    """State per (key, window start): the count, and whether the window fired."""

    def __init__(self, policy: SlidingPolicy, early_every: int | None):
        self.policy, self.early_every = policy, early_every

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("window", "n bigint, fired boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        name, start = key
        start, end = int(start), int(start) + self.policy.size
        progress = timerValues.getCurrentWatermarkInMs()
        out = []
        if progress >= end + self.policy.accept:
            # only the last window of a row tells that no window took it
            for frame in rows:
                yield _frame([(int(t), int(t), name, "late_row", 1) for t in frame["ts_ms"][frame["is_last"]]])
            return
        n, fired = self.state.get() if self.state.exists() else (0, progress >= end + self.policy.fire)
        if n == 0:
            for at in {end + self.policy.fire, end + self.policy.accept}:
                if at > progress:
                    self.handle.registerTimer(at)
        elif not fired and progress >= end + self.policy.fire:
            # progress went past the window in the batch before; the timer comes after these rows
            out.append((start, end, name, "on_time", n))
            fired = True
        yield _frame(out)
        for frame in rows:
            before, n = n, n + len(frame)
            if fired:
                yield _frame([(start, end, name, "late", i) for i in range(before + 1, n + 1)])
            elif self.early_every:
                step = self.early_every
                yield _frame([(start, end, name, "early", i) for i in range((before // step + 1) * step, n + 1, step)])
        self.state.update((n, fired))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        name, start = key
        end = int(start) + self.policy.size
        out = []
        if self.state.exists():
            n, fired = self.state.get()
            at = expiredTimerInfo.getExpiryTimeInMs()
            if not fired and at >= end + self.policy.fire:
                out.append((int(start), end, name, "on_time", n))
                self.state.update((n, True))
            if at >= end + self.policy.accept:
                self.state.clear()
        yield _frame(out)

    def close(self) -> None:
        pass


def _under_progress(events: DataFrame, time: str, key: str, control_key: str | None, ignore_case: bool) -> DataFrame:
    """Rows with ``ts_ms``, below the progress that all rows move, or only control rows, which then are left out."""
    # the number is computed below the watermark, which keeps the event-time mark off it
    numbered = events.withColumn("ts_ms", F.unix_millis(time))
    if control_key is None:
        return with_progress(numbered, time)
    return with_punctuated_progress(numbered, control_key, time, key, ignore_case)


def live_panes(
    events: DataFrame, policy: SlidingPolicy, early_every: int | None = None, time: str = "event_time", key: str = "key",
    control_key: str | None = None, ignore_case: bool = False,
) -> DataFrame:
    """Early, on-time and late reports of sliding windows, and rows too late for all of them
    (``pane_kind`` = ``late_row``, bounds = the row's time): ``start_ms, end_ms, key, pane_kind, count``.

    Times are milliseconds. The state is spread over (key, window), so a hot key is not one task. With ``control_key`` only
    rows of that key move progress, and they are in no window.
    """
    rows = (
        _under_progress(events, time, key, control_key, ignore_case)
        .select(F.col(key).alias("key"), "ts_ms")
        .withColumn("start_ms", F.explode(window_starts(F.col("ts_ms"), policy.size, policy.slide)))
        .withColumn("is_last", F.col("start_ms") + policy.slide > F.col("ts_ms"))
    )
    if policy.min_start is not None:
        rows = rows.filter(F.col("start_ms") >= policy.min_start)
    return rows.groupBy("key", "start_ms").transformWithStateInPandas(
        _WindowPanes(policy, early_every), PANE, "Append", "EventTime"
    )


def _in_arrival_order(frames: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
    """Times of a key's rows in a batch. How the rows are cut to frames must not matter, so with an arrival column all
    of them are ordered together, held as two numbers each; without one they are taken as they come."""
    first = next(frames, None)
    if first is None:
        return
    if "arrival" not in first:
        yield first["ts_ms"].to_numpy()
        for frame in frames:
            yield frame["ts_ms"].to_numpy()
        return
    held = [(f["arrival"].to_numpy(), f["ts_ms"].to_numpy()) for f in (first, *frames)]
    arrival, ticks = (np.concatenate(column) for column in zip(*held))
    ticks = ticks[np.argsort(arrival, kind="stable")]
    for start in range(0, len(ticks), _SLICE):
        yield ticks[start : start + _SLICE]


class _SessionPanes(StatefulProcessor):
    """State per key: its open sessions."""

    def __init__(self, policy: SessionPolicy, refire: bool, repeat: bool, early_every: int | None):
        self.policy, self.refire, self.repeat, self.early_every = policy, refire, repeat, early_every

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sessions = handle.getListState("sessions", "first bigint, last bigint, n bigint, fired boolean")
        self.seen_until = handle.getValueState("seen_until", "progress bigint")

    def _open(self) -> list[tuple]:
        return [tuple(s) for s in self.sessions.get()] if self.sessions.exists() else []

    def _keep(self, sessions: list[tuple]) -> None:
        if sessions:
            self.sessions.put(sessions)
        else:
            self.sessions.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        name, policy = key[0], self.policy
        progress = timerValues.getCurrentWatermarkInMs()
        # timers come after the rows of a batch, so what progress has finished is finished here
        sessions, out = self._advance(name, progress)
        known = {s[1] for s in sessions}
        yield _frame(out)
        for ticks in _in_arrival_order(rows):
            out = []
            for t in ticks.tolist():
                joins = [s for s in sessions if s[0] - t <= policy.reach and t - s[1] <= policy.reach]
                first = min([t] + [s[0] for s in joins])
                last = max([t] + [s[1] for s in joins])
                tested = t if policy.pre_merge else last
                if progress >= tested + policy.gap + policy.accept:
                    out.append((t, t, name, "late_row", 1))
                    continue
                merged = (first, last, 1 + sum(s[2] for s in joins), any(s[3] for s in joins))
                at_once = progress >= last + policy.gap + policy.fire  # complete before the row came
                sessions = [s for s in sessions if s not in joins] + [(*merged[:3], merged[3] or (at_once and not self.repeat))]
                if sessions[-1][3]:
                    if self.refire:
                        out.append((first, last + policy.gap, name, "late", merged[2]))
                elif self.early_every and merged[2] // self.early_every > sum(s[2] // self.early_every for s in joins):
                    out.append((first, last + policy.gap, name, "early", merged[2]))
            yield _frame(out)
        for last in {s[1] for s in sessions} - known:
            for at in {last + policy.gap + policy.fire, last + policy.gap + policy.alive}:
                self.handle.registerTimer(max(at, progress + 1))
        self._keep(sessions)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        progress = timerValues.getCurrentWatermarkInMs()
        sessions, out = self._advance(key[0], progress)
        if self.repeat and any(s[3] for s in sessions):
            self.handle.registerTimer(progress + 1)
        self._keep(sessions)
        yield _frame(out)

    def _advance(self, name: str, progress: int) -> tuple[list[tuple], list[tuple]]:
        """The sessions still open at ``progress``, and the reports of those that fire at it."""
        policy, out, still_open = self.policy, [], []
        moved = self.seen_until.get()[0] if self.seen_until.exists() else None
        for first, last, n, fired in self._open():
            if progress >= last + policy.gap + policy.fire:
                if not fired or (self.repeat and progress != moved):
                    out.append((first, last + policy.gap, name, "repeat" if fired else "on_time", n))
                fired = True
            if progress < last + policy.gap + policy.alive:
                still_open.append((first, last, n, fired))
        self.seen_until.update((progress,))
        return still_open, out

    def close(self) -> None:
        pass


def live_session_panes(
    events: DataFrame,
    policy: SessionPolicy,
    refire: bool = True,
    repeat: bool = False,
    arrival: str | None = None,
    time: str = "event_time",
    key: str = "key",
    early_every: int | None = None,
    control_key: str | None = None,
    ignore_case: bool = False,
) -> DataFrame:
    """Reports of sessions under a policy: early, whenever the count of a session that has not fired passes a multiple of
    ``early_every`` (counters merge with their sessions), on time, again after each late row (``refire``), at every
    step of progress until removed (``repeat``), and rows that no session took (``late_row``).

    Within a batch a key's rows are taken in ``arrival`` order if there is such a column. A key's
    sessions are one state, so a key is one task; only its open sessions are held. With ``control_key`` only rows of that
    key move progress, and they are in no session.
    """
    columns = [F.col(key).alias("key"), "ts_ms"] + ([F.col(arrival).alias("arrival")] if arrival else [])
    rows = _under_progress(events, time, key, control_key, ignore_case).select(*columns)
    return rows.groupBy("key").transformWithStateInPandas(
        _SessionPanes(policy, refire, repeat, early_every), PANE, "Append", "EventTime"
    )


class _CountWindows(StatefulProcessor):
    """State per key: how many rows came, and the slices that a later window still covers."""

    def __init__(self, size: int, slide: int):
        self.size, self.slide, self.slice_rows = size, slide, gcd(size, slide)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "n bigint")
        self.slices = handle.getMapState("slices", "slice bigint", "min_ts bigint, max_ts bigint, n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n = self.seen.get()[0] if self.seen.exists() else 0
        held = {k[0]: tuple(v) for k, v in self.slices.iterator()} if n else {}
        before = set(held)
        changed: set[int] = set()
        for ticks in _in_arrival_order(rows):
            # rows of a slice are next to each other
            numbers = (np.arange(n, n + len(ticks)) // self.slice_rows) + 1
            begin = np.flatnonzero(np.concatenate([[True], numbers[1:] != numbers[:-1]])) if len(ticks) else np.empty(0, int)
            low, high = (f.reduceat(ticks, begin) if len(begin) else begin for f in (np.minimum, np.maximum))
            sizes = np.diff(np.append(begin, len(ticks)))
            for number, lo, hi, size in zip(numbers[begin].tolist(), low.tolist(), high.tolist(), sizes.tolist()):
                old = held.get(number)
                held[number] = (lo, hi, size) if old is None else (min(old[0], lo), max(old[1], hi), old[2] + size)
                changed.add(number)
            out = []
            for firing in range((n // self.slide + 1) * self.slide, n + len(ticks) + 1, self.slide):
                last = firing // self.slice_rows
                window = [held[k] for k in range(max(1, (firing - self.size) // self.slice_rows + 1), last + 1)]
                out.append((key[0], firing, min(w[0] for w in window), max(w[1] for w in window), sum(w[2] for w in window)))
            n += len(ticks)
            # the next window to fire begins after this row
            passed = ((n // self.slide + 1) * self.slide - self.size) // self.slice_rows
            for number in [k for k in held if k <= passed]:
                del held[number]
            yield pd.DataFrame(out, columns=["key", "firing", "min_ts", "max_ts", "count"])
        for number in before - set(held):
            self.slices.removeKey((number,))
        for number in changed & set(held):
            self.slices.updateValue((number,), held[number])
        self.seen.update((n,))

    def close(self) -> None:
        pass


def live_count_windows(
    events: DataFrame, size: int, slide: int, keyed: bool = True, arrival: str | None = None, time: str = "event_time", key: str = "key"
) -> DataFrame:
    """Windows of the last ``size`` rows of a key (of all rows, if not ``keyed``), every ``slide`` rows as they come: ``key,
    firing, min_ts, max_ts, count``, times in milliseconds, ``firing`` the number of the row that fired it.

    Within a batch rows are taken in ``arrival`` order if there is such a column. The state of a key is one aggregate for each
    slice of ``gcd(size, slide)`` rows that a window to come covers, at most ``size / gcd`` of them, and not its rows. A
    key is one task, and so is everything if not ``keyed``: row numbers follow from the order of all its rows.
    """
    columns = [(F.col(key) if keyed else F.lit(None).cast("string")).alias("key"), F.unix_millis(time).alias("ts_ms")]
    rows = events.select(*columns, *([F.col(arrival).alias("arrival")] if arrival else []))
    return rows.groupBy("key").transformWithStateInPandas(
        _CountWindows(size, slide), "key string, firing bigint, min_ts bigint, max_ts bigint, count bigint", "Append", "None"
    )


class _RunningAverage(StatefulProcessor):
    """State per key: how many results there were, and their sum."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("average", "n bigint, total double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, total = self.state.get() if self.state.exists() else (0, 0.0)
        for frame in rows:
            values = frame["value"].astype("float64")
            averages = (values.cumsum() + total) / (pd.Series(range(1, len(values) + 1), index=values.index) + n)
            n, total = n + len(values), total + float(values.sum())
            yield pd.DataFrame({"key": key[0], "value": values, "average": averages})
        self.state.update((n, total))

    def close(self) -> None:
        pass


def live_running_average(results: DataFrame, value: str = "count", key: str = "key") -> DataFrame:
    """Average of the results of a key so far, one row per result: ``key, value, average``."""
    rows = results.select(F.col(key).alias("key"), F.col(value).cast("double").alias("value"))
    return rows.groupBy("key").transformWithStateInPandas(
        _RunningAverage(), "key string, value double, average double", "Append", "None"
    )
