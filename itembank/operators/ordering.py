"""Ordered numbering and running totals that do not funnel a hot key into one task.

A plain ``row_number() over (partition by key order by ...)`` sends every row of a key to one
task. Here rows are range-partitioned on (key, order), so a hot key lies in as many partitions as
its size asks for, whatever its ids look like. Each partition is sorted and written once with the
place of every row; the rows of a key in each partition are counted, and prefix sums of those
counts, a row per (partition, key), place the partitions of a key one after the other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itembank.session import materialize

_AT, _PART = "__at", "__part"


def _ranged(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The rows in (key, order) ranges, written once: ``__part`` tells the range, ``__at`` the place in it.

    Being read from a table, places stay the same however often a task is run again.
    """
    by = [*keys, *order]
    placed = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(_AT, F.monotonically_increasing_id())
    return materialize(placed, "ranged").withColumn(_PART, F.shiftrightunsigned(_AT, 33))


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    sums: dict[str, Column],
    totals: dict[str, Column] | None = None,
) -> DataFrame:
    """Add inclusive running sums per key, and whole-key totals, in the given order.

    Null keys are a group of their own. Sums and totals read the columns of ``df``.
    """
    totals = totals or {}
    keys = list(keys)
    rows = _ranged(df, keys, order)
    per_part = rows.groupBy(*keys, _PART).agg(
        *[F.sum(e).alias(f"__s_{n}") for n, e in sums.items()],
        *[F.sum(e).alias(f"__t_{n}") for n, e in totals.items()],
    )
    by_key = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = by_key.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select(
        *keys,
        _PART,
        *[F.coalesce(F.sum(f"__s_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in sums],
        *[F.sum(f"__t_{n}").over(by_key).alias(n) for n in totals],
    )
    within = Window.partitionBy(*keys, _PART).orderBy(_AT).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = join_null_safe(rows, offsets, [*keys, _PART])
    return joined.select(
        *df.columns,
        *[(F.sum(e).over(within) + F.col(f"__o_{n}")).alias(n) for n, e in sums.items()],
        *list(totals),
    )


def join_null_safe(rows: DataFrame, other: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """rows with the columns of other; null keys meet null keys, so no row is lost."""
    renamed = other.select(*[F.col(k).alias(f"__k_{k}") for k in keys], *[c for c in other.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return rows.join(renamed, on, how).drop(*[f"__k_{k}" for k in keys])


def ordinal(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str = "rank") -> DataFrame:
    """Add the 1-based position of each row within its key.

    The place of a row in its partition is known from the sort, so no window runs over rows.
    """
    keys = list(keys)
    rows = _ranged(df, keys, order)
    per_part = rows.groupBy(*keys, _PART).agg(F.min(_AT).alias("__first"), F.count("*").alias("__n"))
    before = Window.partitionBy(*keys or [F.lit(0)]).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select(
        *keys, _PART, (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first") + 1).alias("__shift")
    )
    return join_null_safe(rows, offsets, [*keys, _PART]).select(*df.columns, (F.col(_AT) + F.col("__shift")).alias(name))


def first_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int, name: str = "rank"
) -> DataFrame:
    """The first ``k`` rows of each key, numbered.

    Spark trims each map task to ``k`` rows per key ahead of the shuffle (window group limit),
    so a hot key ships at most ``k`` rows per task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the smallest in the given order, by a partially aggregated minimum."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*rest)
    picked = df.groupBy(*keys).agg(F.min_by(row, F.struct(*order)).alias("__row"))
    return picked.select(*keys, "__row.*").select(*df.columns)


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the largest in the given order (last write wins)."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*rest)
    picked = df.groupBy(*keys).agg(F.max_by(row, F.struct(*order)).alias("__row"))
    return picked.select(*keys, "__row.*").select(*df.columns)
