"""Order-dependent operators.

``with_prior_period`` works on raw loan-months. All others take tables that
were aggregated to one row per series and month, so a window partition holds
at most as many rows as the calendar has months.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..schema import LOAN, PERIOD


def prior_states(df: DataFrame, value: Column, name: str, key: str, period: str, *aggregates: Column) -> DataFrame:
    """One row per (key, period) with ``value`` of the key's previous period as ``name``.

    Loan-months are aggregated before anything is ordered, so repeated rows
    collapse on the map side and a window partition is bounded by the calendar
    however often one key occurs. Where a loan-month repeats, the value holds
    if it holds for any of its rows. Rows without a period keep their row, but are no
    month's predecessor and have none.
    """
    states = df.groupBy(key, period).agg(F.max(value).alias("_state"), *aggregates)
    newest_first = Window.partitionBy(key, F.col(period).isNull()).orderBy(F.col(period).desc())
    return states.withColumn(name, F.lead("_state").over(newest_first)).drop("_state")


def with_prior_period(df: DataFrame, value: Column, name: str, key: str = LOAN, period: str = PERIOD) -> DataFrame:
    """Add ``value`` of the same key's previous reported period.

    The join is on (key, period), which spreads a frequent key over its
    periods; only the key, the period and the value are shuffled twice.
    """
    prior = prior_states(df, value, name, key, period).select(
        F.col(key).alias("_key"), F.col(period).alias("_period"), name
    )
    same = F.col(key).eqNullSafe(F.col("_key")) & F.col(period).eqNullSafe(F.col("_period"))
    return df.join(prior, same).drop("_key", "_period")


def by_period(series: Sequence[str], period: str):
    return Window.partitionBy(*series).orderBy(F.col(period).asc_nulls_last())


def previous(c, series: Sequence[str], period: str) -> Column:
    return F.lag(c).over(by_period(series, period))


def running_total(c, series: Sequence[str], period: str) -> Column:
    frame = by_period(series, period).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.sum(c).over(frame)


def running_totals(df: DataFrame, columns: Sequence[str], series: Sequence[str], period: str) -> DataFrame:
    """Replace each column by its running sum; one window, hence one sort, serves all."""
    return df.withColumns({c: running_total(c, series, period) for c in columns})


def compounded(rate, step) -> Column:
    """Product of ``step`` equal growth factors."""
    return F.pow(F.lit(1.0) + rate, step)


def share_within(c, keys: Sequence[str]) -> Column:
    return F.col(c) / F.sum(c).over(Window.partitionBy(*keys))


def with_stack_offsets(df: DataFrame, c: str, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Lower and upper edge (``y0``, ``y1``) of each part stacked in category order."""
    within = Window.partitionBy(*keys).orderBy(*[F.col(o).asc_nulls_last() for o in order])
    upper = F.sum(c).over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn("y1", upper).withColumn("y0", F.col("y1") - F.col(c))


def with_position(df: DataFrame, series: Sequence[str], period: str, name: str = "t") -> DataFrame:
    """1-based time index within each series."""
    return df.withColumn(name, F.row_number().over(by_period(series, period)))


def recency(series: Sequence[str], period: str) -> Column:
    """1 for the last row of a series, 2 for the one before, and so on."""
    return F.row_number().over(Window.partitionBy(*series).orderBy(F.col(period).desc_nulls_last()))


def last_rows(df: DataFrame, n: int, series: Sequence[str], period: str) -> DataFrame:
    return df.withColumn("_recency", recency(series, period)).where(F.col("_recency") <= n).drop("_recency")


def last_value(c, period: str) -> Column:
    return F.max_by(c, period)
