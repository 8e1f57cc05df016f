"""Ordered-sequence primitives that never bring a whole key into one task.

A key (a recording, an owner) may hold a large share of all rows. Every helper
therefore works on (key, slice), where the slice is a coarse bucket of the order
column, and carries the few values that must cross a slice border through a
summary with one row per slice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE = "_slice"


def time_slice(ts: str = "ts", seconds: int = 3600) -> Column:
    return F.floor(F.unix_seconds(F.col(ts)) / seconds)


def with_previous(
    df: DataFrame, keys: Sequence[str], order: str, fields: Sequence[str], slice_by: Column
) -> DataFrame:
    """Adds ``prev_<field>`` from the row before in ``order`` (unique within a key)."""
    sliced = df.withColumn(SLICE, slice_by)
    within = Window.partitionBy(*keys, SLICE).orderBy(order)
    across = Window.partitionBy(*keys).orderBy(SLICE)
    tails = sliced.groupBy(*keys, SLICE).agg(
        F.max(order).alias("_tail_order"), *[F.max_by(f, order).alias(f"_tail_{f}") for f in fields if f != order]
    )
    carried = tails.select(
        *keys,
        SLICE,
        *[F.lag("_tail_order" if f == order else f"_tail_{f}").over(across).alias(f"_carry_{f}") for f in fields],
    )
    lagged = sliced.select(
        "*",
        F.row_number().over(within).alias("_at"),
        *[F.lag(f).over(within).alias(f"_lag_{f}") for f in fields],
    ).join(carried, [*keys, SLICE])
    return lagged.select(
        *[lagged[c] for c in df.columns],
        *[
            F.when(F.col("_at") == 1, F.col(f"_carry_{f}")).otherwise(F.col(f"_lag_{f}")).alias(f"prev_{f}")
            for f in fields
        ],
    )


def with_running(
    df: DataFrame,
    keys: Sequence[str],
    order: str | Sequence[str],
    slice_by: Column,
    index: str | None = None,
    sums: dict[str, Column] | None = None,
) -> DataFrame:
    """Adds a 0-based position and inclusive running sums within each key.

    ``slice_by`` must not decrease along ``order``.
    """
    sums = sums or {}
    order = [order] if isinstance(order, str) else list(order)
    sliced = df.select("*", slice_by.alias(SLICE), *[c.alias(f"_add_{n}") for n, c in sums.items()])
    within = Window.partitionBy(*keys, SLICE).orderBy(*order)
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    totals = sliced.groupBy(*keys, SLICE).agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(f"_add_{n}").alias(f"_sum_{n}") for n in sums]
    )
    carried = totals.select(
        *keys,
        SLICE,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n_before"),
        *[F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_before_{n}") for n in sums],
    )
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    local = sliced.select(
        "*",
        F.row_number().over(within).alias("_at"),
        *[F.sum(f"_add_{n}").over(upto).alias(f"_upto_{n}") for n in sums],
    ).join(carried, [*keys, SLICE])
    extra = [(F.col("_n_before") + F.col("_at") - 1).cast("long").alias(index)] if index else []
    extra += [(F.col(f"_before_{n}") + F.col(f"_upto_{n}")).alias(n) for n in sums]
    return local.select(*[local[c] for c in df.columns], *extra)
