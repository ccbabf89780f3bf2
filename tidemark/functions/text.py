"""Text forms of results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.ticks import floor_div


def format_row(start: Column, end: Column, key: Column, count: Column) -> Column:
    """``(start,end,key,count)``"""
    return F.format_string("(%d,%d,%s,%d)", start, end, key, count)


def format_average(average: Column) -> Column:
    """``Average so far is 3.500000``"""
    return F.format_string("Average so far is %f", average)


def gmt_text(epoch_ms: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss.`` and the milliseconds with at least two digits (1 -> ``01``,
    13 -> ``13``, 500 -> ``500``). The session zone must be UTC."""
    millis = F.pmod(epoch_ms, F.lit(1000).cast("bigint"))
    seconds = F.timestamp_seconds(floor_div(epoch_ms, 1000))
    digits = F.when(millis < 10, F.concat(F.lit("0"), millis.cast("string"))).otherwise(millis.cast("string"))
    return F.concat(F.date_format(seconds, "yyyy-MM-dd HH:mm:ss"), F.lit("."), digits)


def format_span(first_ms: Column, last_ms: Column, count: Column, key: Column | None = None) -> Column:
    """``(first time,last time,count)``, or with the key before the count: a report of a count window, times as `gmt_text`."""
    parts = [gmt_text(first_ms), gmt_text(last_ms), *([] if key is None else [key]), count.cast("string")]
    return F.concat(F.lit("("), F.concat_ws(",", *parts), F.lit(")"))


def bound_or_default(bound: Column, default: int = -1) -> Column:
    """A window bound that may be missing, as a number."""
    return F.coalesce(bound, F.lit(default).cast("bigint"))
