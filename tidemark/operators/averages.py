"""Averages of results as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.running import MAX_GROUP_ROWS, Running, running


def running_average(
    df: DataFrame, value: str, keys: list[str], order: str | list[str], name: str = "average",
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Average of ``value`` over the results of the key so far, this one included."""
    return (
        running(df, keys, order, {"_sum": Running("sum", value), "_n": Running("count", value)}, max_group_rows)
        .withColumn(name, F.col("_sum") / F.col("_n"))
        .drop("_sum", "_n")
    )
