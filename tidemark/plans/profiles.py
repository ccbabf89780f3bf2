"""Named policy sets: the same windowed count under the rules of five streaming systems.

A profile fixes how progress is measured, when a window fires and closes, which late rows
count, what control rows do and what is reported. Distances are in ticks from the window end.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import lateness, session_policies
from tidemark.operators.lateness import SlidingPolicy
from tidemark.operators.routing import is_control
from tidemark.operators.session_policies import SessionPolicy
from tidemark.operators.windows import COUNT, Aggregate, sliding_right_closed


@dataclass(frozen=True)
class Profile:
    """One set of rules. ``lag`` is how far progress trails the largest time (right-closed windows). ``control``: ``count`` control rows like any other, report them as
    ``zero`` (sessions only), ``leave_out`` their results, or let them only carry ``progress``."""

    name: str
    fire: int = 0
    sliding_accept: int = 0
    session_alive: int = 0
    session_accept: int = 0
    lateness: int = 0
    lag: int = 0
    pre_merge: bool = False
    touching_merge: bool = True
    control: str = "count"
    session_control: str | None = None
    ignore_case: bool = False
    flush: bool = True
    per_batch: bool = False
    min_start: int | None = None
    right_closed: bool = False
    end_is_last: bool = False

    def with_lateness(self, lateness: int) -> Profile:
        """The same rules, keeping windows open ``lateness`` ticks longer."""
        return replace(self, lateness=lateness)

    def sliding_policy(self, size: int, slide: int) -> SlidingPolicy:
        return SlidingPolicy(size, slide, self.fire, self.sliding_accept + self.lateness, self.min_start)

    def session_policy(self, gap: int) -> SessionPolicy:
        return SessionPolicy(
            gap,
            self.touching_merge,
            self.fire,
            self.session_alive + self.lateness,
            self.session_accept + self.lateness,
            self.pre_merge,
        )

    def sliding(
        self, df: DataFrame, time: str, pos: str, size: int, slide: int, keys: list[str], control_key: str = "W",
        key: str = "key", aggs: dict[str, Aggregate] = COUNT,
    ) -> DataFrame:
        """Final count per window and key: ``start, end, keys, count``, or other ``aggs``.

        ``pos`` is the arrival position, or the batch number for a profile with ``per_batch``.
        """
        control = is_control(key, control_key, self.ignore_case)
        if self.right_closed:
            timely = lateness.not_behind(df, time, pos, self.lag)
            windows = sliding_right_closed(timely.filter(~control), time, size, slide, keys, aggs)
            if self.flush:
                return windows
            # without an end of input only windows that progress reached are reported
            reached = df.agg(F.max(time)).first()[0]
            return windows.filter(F.col("end") <= F.lit(reached).cast("bigint") - self.lag)
        counted = None if self.control == "count" else ~control
        moves = control if self.control == "progress" else None
        return lateness.final_counts(
            df, time, pos, self.sliding_policy(size, slide), keys, moves, counted, self.flush, aggs
        )

    def late(self, df: DataFrame, time: str, pos: str, size: int, slide: int) -> DataFrame:
        """Rows that no sliding window accepted."""
        return lateness.late_rows(df, time, pos, self.sliding_policy(size, slide))

    def _session_rows(self, control: Column) -> dict:
        rule = self.session_control or self.control
        return {
            "data": ~control if rule in ("leave_out", "progress") else None,
            "moves": control if rule == "progress" else None,
            "counted": ~control if rule == "zero" else None,
        }

    def sessions(
        self, df: DataFrame, time: str, pos: str, gap: int, keys: list[str], control_key: str = "W", key: str = "key",
        **options,
    ) -> DataFrame:
        """Final count per session and key: ``start, end, keys, count``, or other ``aggs`` (then sessions of control rows are
        no special case: the aggregates say which rows count)."""
        rows = self._session_rows(is_control(key, control_key, self.ignore_case))
        return session_policies.policy_sessions(
            df, time, pos, self.session_policy(gap), keys, flush=self.flush, end_is_last=self.end_is_last,
            **rows, **options,
        )

    def session_drops(
        self, df: DataFrame, time: str, pos: str, gap: int, keys: list[str], control_key: str = "W", key: str = "key",
        **options,
    ) -> DataFrame:
        """Rows that no session accepted."""
        rows = self._session_rows(is_control(key, control_key, self.ignore_case))
        rows.pop("counted")
        return session_policies.dropped_rows(df, time, pos, self.session_policy(gap), keys, **rows, **options)


# The rules of the five systems, as distances from the window end in ticks.
PROFILES: dict[str, Profile] = {
    # progress of finished micro-batches; a row is tested on its own session; open windows are
    # not reported at the end of the input; control rows are sessions that count nothing
    "spark": Profile("spark", pre_merge=True, session_control="zero", flush=False, per_batch=True),
    # a window is complete one tick before its end; a row is tested on the merged session
    "flink": Profile("flink", fire=-1, sliding_accept=-1, session_alive=-1, session_accept=-1),
    "beam": Profile("beam", pre_merge=True, touching_merge=False, control="leave_out", ignore_case=True),
    # windows start at zero or later; sessions are labelled first..last
    "kafka": Profile("kafka", session_accept=1, min_start=0, end_is_last=True),
    # progress comes from control rows only; sessions stay one tick past the lateness;
    # sliding windows are (start, end] and drop rows behind the progress of all rows
    "storm": Profile(
        "storm", session_alive=1, touching_merge=False, control="progress", ignore_case=False, flush=False,
        right_closed=True,
    ),
}


def profile_diff(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Windows on which two results differ: ``start, end, keys, left_count, right_count``.

    Results are aggregated already, one row per window and key; a window that only one side
    has shows NULL on the other.
    """
    on = ["start", "end", *keys]

    def counts(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*on).agg(F.sum("count").alias(name))

    sides = counts(left, "left_count").withColumn("right_count", F.lit(None).cast("bigint")).unionByName(
        counts(right, "right_count").withColumn("left_count", F.lit(None).cast("bigint"))
    )
    return (
        sides.groupBy(*on)
        .agg(F.sum("left_count").alias("left_count"), F.sum("right_count").alias("right_count"))
        .filter(~F.col("left_count").eqNullSafe(F.col("right_count")))
    )
