"""Text lines ``ts,key,value`` to events, under a chosen policy for what is malformed."""

from __future__ import annotations

from dataclasses import dataclass
from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ParsePolicy:
    """What to skip, how many fields a line needs, and what happens to the rest.

    ``short`` / ``bad_time`` / ``bad_value``: ``drop`` the line, ``fail`` the query, or keep it with
    ``null``. ``missing_value``: ``null``, ``zero``, ``empty`` (the text is empty) or ``random``
    (normal around 20, deviation 5, two decimals).
    """

    trim_line: bool = True
    skip_blank: bool = True
    comments: tuple[str, ...] = ()
    headers: tuple[str, ...] = ()
    drop_empty_tail: bool = False
    min_fields: int = 2
    short: str = "drop"
    trim_fields: bool = False
    missing_key: str = ""
    bad_time: str = "null"
    missing_value: str = "null"
    exact_value_fields: bool = False
    bad_value: str = "null"
    seed: int = 0


# The rules of the five line readers whose input this library accepts.
POLICIES: dict[str, ParsePolicy] = {
    "spark": ParsePolicy(),
    "flink": ParsePolicy(
        trim_line=False, skip_blank=False, comments=("*",), drop_empty_tail=True, min_fields=1, short="fail",
        missing_key="DUMMY", bad_time="fail", missing_value="random", exact_value_fields=True, bad_value="fail",
    ),
    "beam": ParsePolicy(
        comments=("#",), drop_empty_tail=True, min_fields=3, short="fail", trim_fields=True, bad_time="fail",
    ),
    "kafka": ParsePolicy(
        comments=("#",), headers=("ts", "timestamp"), trim_fields=True, bad_time="drop", missing_value="empty",
    ),
    "storm": ParsePolicy(
        comments=("*",), min_fields=1, bad_time="drop", missing_value="zero", bad_value="drop",
    ),
}


def skipped(line: Column, policy: ParsePolicy) -> Column:
    """Is the line blank, a comment or a header?"""
    tests = F.lit(False)
    if policy.skip_blank:
        tests = tests | (F.length(line) == 0)
    for prefix in policy.comments:
        tests = tests | line.startswith(prefix)
    for prefix in policy.headers:
        tests = tests | F.lower(line).startswith(prefix)
    return tests


def parse_lines(df: DataFrame, policy: ParsePolicy | str, line: str = "value", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``df`` and ``ts_ms, key, value_text, value, event_time``.

    ``event_time`` is the exact millisecond TIMESTAMP; ``value_text`` the value as written.
    """
    if isinstance(policy, str):
        policy = POLICIES[policy]
    keep = keep or []
    text = F.trim(F.col(line)) if policy.trim_line else F.col(line)
    lines = df.select(*keep, text.alias("_line")).filter(F.col("_line").isNotNull() & ~skipped(F.col("_line"), policy))
    body = F.regexp_replace("_line", ",+$", "") if policy.drop_empty_tail else F.col("_line")
    fields = lines.withColumn("_fields", F.split(body, ","))
    count = F.size("_fields")

    def field(i: int) -> Column:
        raw = F.get("_fields", F.lit(i))
        return F.trim(raw) if policy.trim_fields else raw

    short = count < policy.min_fields
    if policy.short == "drop":
        fields = fields.filter(~short)

    time = F.when(field(0).rlike(r"^[+-]?[0-9]+$"), field(0).try_cast("bigint"))
    if policy.bad_time == "fail":
        time = F.when(time.isNull(), F.raise_error(_problem("bad timestamp")).cast("bigint")).otherwise(time)
    if policy.short == "fail":
        time = F.when(short, F.raise_error(_problem("too few fields")).cast("bigint")).otherwise(time)

    given = (count == 3) if policy.exact_value_fields else (count >= 3)
    text_value = F.when(given, field(2))
    if policy.missing_value == "zero":
        text_value = F.when(F.length(text_value) > 0, text_value)
    number = text_value.try_cast("double")
    if policy.bad_value == "fail":
        bad = text_value.isNotNull() & number.isNull()
        number = F.when(bad, F.raise_error(_problem("bad value")).cast("double")).otherwise(number)
    if policy.missing_value == "zero":
        number = F.when(text_value.isNull(), F.lit(0.0)).otherwise(number)
    elif policy.missing_value == "random":
        number = F.coalesce(number, F.round(_normal(keep, policy.seed) * 5 + 20, 2))
    elif policy.missing_value == "empty":
        text_value = F.coalesce(text_value, F.lit(""))

    parsed = fields.select(
        *keep,
        time.alias("ts_ms"),
        F.coalesce(field(1), F.lit(policy.missing_key)).alias("key"),
        text_value.alias("value_text"),
        number.alias("value"),
    )
    if policy.bad_time == "drop":
        parsed = parsed.filter(F.col("ts_ms").isNotNull())
    if policy.bad_value == "drop":
        parsed = parsed.filter(F.col("value").isNotNull())
    return parsed.withColumn("event_time", F.timestamp_millis("ts_ms"))


def _normal(keep: list[str], seed: int) -> Column:
    """A normal number that is fixed by the line, what is kept beside it (its place, say) and the seed, so that it
    doesn't change with how the input is split. (Two uniform numbers from hashes, and the Box-Muller transform.)"""
    uniform = [
        (F.pmod(F.xxhash64(F.lit(seed), F.lit(part), F.col("_line"), *keep), F.lit(1 << 53)) + F.lit(0.5)) / float(1 << 53)
        for part in (1, 2)
    ]
    return F.sqrt(-2 * F.log(uniform[0])) * F.cos(uniform[1] * (2 * pi))


def _problem(what: str) -> Column:
    return F.concat(F.lit(what + ": "), F.col("_line"))
