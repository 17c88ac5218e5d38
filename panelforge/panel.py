"""Panels: rows of (entity, trade_date, ...), and the window idioms that all causal operators share.

Horizons and windows count an entity's rows, never calendar days, and look backwards unless an operator
says otherwise. A windowed statistic is null until it has seen min_periods values that aren't null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def in_time(*entity: str, order: str = "trade_date") -> WindowSpec:
    """An entity's rows in time order."""
    return Window.partitionBy(*(entity or ("entity",))).orderBy(order)


def rolling(fn: Callable[[Column], Column], x: Column, n: int, min_periods: int, w: WindowSpec | None = None, skip: int = 0) -> Column:
    """fn over the last n rows (ending skip rows back), null under min_periods values."""
    frame = (w if w is not None else in_time()).rowsBetween(-(n - 1) - skip, -skip)
    return F.when(F.count(x).over(frame) >= min_periods, fn(x).over(frame))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero or either is null."""
    return F.try_divide(a, b)


def pct(x: Column, k: int, w: WindowSpec | None = None) -> Column:
    """Change over k rows; a gap isn't filled, so a null at either end gives null."""
    return ratio(x, F.lag(x, k).over(w if w is not None else in_time())) - 1


def zscore(x: Column, n: int, min_periods: int, w: WindowSpec | None = None) -> Column:
    """Distance from the rolling mean in population deviations; null where there is no spread."""
    return ratio(x - rolling(F.avg, x, n, min_periods, w), rolling(F.stddev_pop, x, n, min_periods, w))


def islands(df: DataFrame, value: str, out: str = "segment", entity: str = "entity", order: str = "trade_date") -> DataFrame:
    """Number the runs of equal consecutive values of each entity, from 1; a null is a value of its own."""
    w = in_time(entity, order=order)
    first = F.row_number().over(w) == 1
    starts = first | ~F.col(value).eqNullSafe(F.lag(value).over(w))
    return df.withColumn("_starts", starts.cast("bigint")).withColumn(out, F.sum("_starts").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_starts")


def average_rank(x: Column, *partition: str) -> Column:
    """Rank from 1 with ties sharing their mean rank; nulls have none."""
    by = Window.partitionBy(*partition)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*partition, x))
    return F.when(x.isNotNull(), F.rank().over(by.orderBy(x.asc_nulls_last())) + (ties - 1) / F.lit(2.0))


def bars(ticks: DataFrame, entity: str, when: str, price: str, quantity: str, order: list[str]) -> DataFrame:
    """Daily bars of trades: open and close by the given order, high, low, volume and amount.

    One aggregation with map-side combine: only a running first and last per day are shuffled.
    """
    key = F.struct(*order)
    return ticks.groupBy(F.col(entity).alias("entity"), F.to_date(when).alias("trade_date")).agg(
        F.min_by(price, key).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, key).alias("close"),
        F.sum(quantity).alias("volume"),
        F.sum(price).alias("amount"),
    )
