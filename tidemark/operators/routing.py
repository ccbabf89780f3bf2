"""Leaving out, splitting and watching rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def is_control(key: str, control_key: str, ignore_case: bool = False) -> Column:
    """Marks control rows (rows that only carry progress)."""
    if ignore_case:
        return F.coalesce(F.upper(F.col(key)) == control_key.upper(), F.lit(False))
    return F.coalesce(F.col(key) == control_key, F.lit(False))


def without_control(df: DataFrame, key: str, control_key: str, ignore_case: bool = False) -> DataFrame:
    """Batch only: on a stream such a filter moves below the watermark (see ``native_session``)."""
    return df.filter(~is_control(key, control_key, ignore_case))


def without_time(df: DataFrame, time: str) -> DataFrame:
    """The rows that windows and sessions leave out: their time is NULL."""
    return df.filter(F.col(time).isNull())


def split(df: DataFrame, *predicates: Column) -> list[DataFrame]:
    """One DataFrame per predicate; a row goes to the first predicate it meets, others nowhere."""
    branches, taken = [], F.lit(False)
    for predicate in predicates:
        meets = F.coalesce(predicate, F.lit(False))
        branches.append(df.filter(meets & ~taken))
        taken = taken | meets
    return branches


def observed(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, Observation]:
    """``df`` with metrics that are collected while it runs, at no extra pass."""
    observation = Observation(name)
    return df.observe(observation, *[column.alias(n) for n, column in metrics.items()]), observation
