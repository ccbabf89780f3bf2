"""Event time as whole numbers.

Replay operators work on a LONG event time ("tick": a millisecond, a microsecond, a minute,
whatever the table uses), because the policies differ by exactly one tick at a bound.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def floor_to(value: Column, step: int) -> Column:
    """Largest multiple of ``step`` at or below ``value`` (also for negative values)."""
    return value - F.pmod(value, F.lit(step).cast("bigint"))


def floor_div(value: Column, step: int) -> Column:
    """Floor division in integer arithmetic (also for negative values)."""
    return F.call_function("div", floor_to(value, step), F.lit(step).cast("bigint"))


def epoch_micros(timestamp: Column) -> Column:
    """Epoch microseconds of a TIMESTAMP or TIMESTAMP_NTZ column (session zone must be UTC)."""
    return F.unix_micros(timestamp.cast("timestamp"))


# Fixed value: what the arrival is multiplied by, one more digit than a LONG tiebreak can have.
_SHIFT = "10000000000000000000"
POSITION = "decimal(38,0)"


def arrival_position(arrival: Column, tiebreak: Column) -> Column:
    """One comparable number for ``(arrival, tiebreak)``: ``arrival * 10^19 + tiebreak``.

    A DECIMAL stays in the fixed-width part of an aggregation buffer, so ``min`` over it runs
    as a hash aggregate; a struct of the two columns would fall back to a sort aggregate.
    Both inputs are LONG over their whole range, ``tiebreak`` is not negative. A table that already has a unique
    LONG arrival number (a log offset, say) uses that column as the position directly.
    """
    shift = F.lit(_SHIFT).cast("decimal(20,0)")
    return (
        (arrival.cast("decimal(19,0)") * shift).cast(POSITION) + tiebreak.cast("decimal(19,0)")
    ).cast(POSITION)


def never() -> Column:
    """A position that no row comes after."""
    last = F.lit(2**63 - 1).cast("bigint")
    return arrival_position(last, last)


def position_parts(position: Column) -> tuple[Column, Column]:
    """``(arrival, tiebreak)`` of such a number: two LONGs sort several times faster than it."""
    shift = F.lit(_SHIFT).cast("decimal(20,0)")
    tiebreak = F.pmod(position, shift)
    return F.call_function("div", position - tiebreak, shift).cast("bigint"), tiebreak.cast("bigint")
