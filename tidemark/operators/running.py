"""Running aggregates in a total order, without putting a whole key into one task.

``running`` adds, to every row, an aggregate over all rows of its group that come before it
(or up to and including it). A plain window function sorts each group in one task, which is
fine while groups are small and hopeless once a single key holds a third of the table. So the
size of the largest group is looked at first:

* small groups, or a small input: one window function, one shuffle;
* otherwise: range-partition by ``(keys, order)`` so that a hot group is spread over many
  tasks, number the sorted rows, cut the lineage, aggregate every (group, chunk) to one row,
  turn those into offsets with a prefix aggregate over the few chunk rows, and finish inside
  each chunk. Every task sees one chunk; the result is the same.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ticks import POSITION, position_parts
from tidemark.session import at_most, broadcast_if_small, expected_bytes, materialise

# Largest group a single window task is trusted with.
MAX_GROUP_ROWS = 1_000_000

# Bytes that a row takes in a file at least, or about: an input that Spark expects to be so small isn't looked at first.
_ROW_BYTES = 8

_FUNCTIONS = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}


@dataclass(frozen=True)
class Running:
    """One running aggregate: ``function`` over ``column``; ``inclusive`` counts the row itself."""

    function: str
    column: str | None = None
    inclusive: bool = True

    def over(self, window: Window) -> Column:
        end = 0 if self.inclusive else -1
        return _FUNCTIONS[self.function](self._input()).over(
            window.rowsBetween(Window.unboundedPreceding, end)
        )

    def partial(self) -> Column:
        return _FUNCTIONS[self.function](self._input())

    def merge(self, before: Column, within: Column) -> Column:
        if self.function in ("count", "sum"):
            total = F.coalesce(before, F.lit(0)) + F.coalesce(within, F.lit(0))
            # a sum over no rows at all stays NULL, as with a window function
            return total if self.function == "count" else F.when(before.isNull() & within.isNull(), None).otherwise(total)
        return (F.least if self.function == "min" else F.greatest)(before, within)

    def _input(self) -> Column:
        return F.lit(1) if self.column is None else F.col(self.column)


def largest_group(df: DataFrame, keys: list[str]) -> int:
    """Row count of the largest group: map-side combined, one number comes back."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")) if keys else df.agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.max("n")).first()[0] or 0


def running(
    df: DataFrame,
    keys: list[str],
    order: str | list[str],
    aggregates: dict[str, Running],
    max_group_rows: int = MAX_GROUP_ROWS,
    descending: bool = False,
    rows: DataFrame | None = None,
) -> DataFrame:
    """``df`` plus one column per entry of ``aggregates``. ``order`` must be unique in a group.

    ``rows``, a materialised DataFrame with at least as many rows, saves looking at the groups
    of a ``df`` that is small as a whole; so does a small size of the files it is read from.
    """
    columns = df.columns
    df, sort = _sortable(df, [order] if isinstance(order, str) else order, descending)
    small = expected_bytes(df) <= _ROW_BYTES * max_group_rows if rows is None else at_most(rows, max_group_rows)
    if small or largest_group(df, keys) <= max_group_rows:
        window = Window.partitionBy(*keys).orderBy(*sort)
        result = df.withColumns({name: agg.over(window) for name, agg in aggregates.items()})
    else:
        result = _running_in_chunks(df, keys, sort, aggregates)
    return result.select(*columns, *aggregates)


def _sortable(df: DataFrame, order: list[str], descending: bool) -> tuple[DataFrame, list[Column]]:
    """Sort columns, with wide decimals (positions) taken apart into two LONGs."""
    kinds, names, parts = dict(df.dtypes), [], {}
    for column in order:
        if kinds[column] == POSITION:
            names += [f"_hi_{column}", f"_lo_{column}"]
            parts[names[-2]], parts[names[-1]] = position_parts(F.col(column))
        else:
            names.append(column)
    return df.withColumns(parts) if parts else df, [F.desc(n) if descending else F.col(n) for n in names]


def _running_in_chunks(
    df: DataFrame, keys: list[str], order: list[Column], aggregates: dict[str, Running]
) -> DataFrame:
    # monotonically_increasing_id() of a sorted table is (partition number << 33) + row number,
    # partitions being ordered ranges. It is fixed by the checkpoint before anything reads it.
    numbered = materialise(
        df.orderBy(*keys, *order)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_chunk", F.shiftright("_at", 33))
    )
    totals = numbered.groupBy(*keys, "_chunk").agg(
        *[agg.partial().alias(f"_total_{name}") for name, agg in aggregates.items()]
    )
    # A group has at most one total per chunk, so this window is bounded by the chunk count.
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col("_chunk").alias("_in_chunk"),
        *[F.col(k).alias(f"_in_{k}") for k in keys],
        F.count(F.lit(1)).over(earlier).alias("_chunks_before"),
        *[
            (F.sum if agg.function == "count" else _FUNCTIONS[agg.function])(F.col(f"_total_{name}"))
            .over(earlier)
            .alias(f"_before_{name}")
            for name, agg in aggregates.items()
        ],
    )
    # Only a group that goes on from an earlier chunk needs an offset: at most one per chunk.
    offsets = broadcast_if_small(materialise(offsets.filter("_chunks_before > 0").drop("_chunks_before")))
    condition = F.col("_chunk") == F.col("_in_chunk")
    for key in keys:
        condition = condition & F.col(key).eqNullSafe(F.col(f"_in_{key}"))
    joined = numbered.join(offsets, condition, "left")
    window = Window.partitionBy(*keys, "_chunk").orderBy("_at")
    return joined.withColumns(
        {name: agg.merge(F.col(f"_before_{name}"), agg.over(window)) for name, agg in aggregates.items()}
    )
