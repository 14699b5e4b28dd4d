"""Run-rate forecast: trailing growth and charge-off ratio carried forward."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.dates import monthly_date, next_month
from ..functions.parsing import ratio
from ..operators.series import compounded, last_value, previous, recency, running_total
from ..schema import PERIOD

CHARGE_OFF = "chargedoffPrincipalAmount"
BALANCE = "reportingPeriodActualEndBalanceAmount"


def by_month(table: DataFrame, series: Sequence[str]) -> DataFrame:
    """Charge-offs and balance per series and month, added up, so that a series has no more rows than the calendar has months."""
    return table.groupBy(*series, PERIOD).agg(F.sum(CHARGE_OFF).alias(CHARGE_OFF), F.sum(BALANCE).alias(BALANCE))


def balance_ratios(months: DataFrame, series: Sequence[str]) -> DataFrame:
    """Charge-offs as a share of the balance, and month-on-month balance growth."""
    before = previous(BALANCE, series, PERIOD)
    return by_month(months, series).select(
        *series, PERIOD, CHARGE_OFF, BALANCE,
        ratio(F.col(CHARGE_OFF), F.col(BALANCE)).alias("charge_off_share"),
        (ratio(F.col(BALANCE), before) - 1).alias("balance_growth_mom"),
    )


def trailing_rates(ratios: DataFrame, series: Sequence[str], months: int = 12, *more: Column) -> DataFrame:
    """Per series the mean of both ratios over its last months, and where it ended."""
    recent = F.col("_recency") <= months
    return (
        ratios.withColumn("_recency", recency(series, PERIOD))
        .groupBy(*series)
        .agg(
            F.avg(F.when(recent, F.col("balance_growth_mom"))).alias("growth_rate"),
            F.avg(F.when(recent, F.col("charge_off_share"))).alias("charge_off_rate"),
            last_value(BALANCE, PERIOD).alias("last_balance"),
            F.max(PERIOD).alias("last_period"),
            *more,
        )
    )


def run_rate_forecast(
    months: DataFrame, series: Sequence[str] = (), h: int = 17, trailing: int = 12, start: Callable[[str], Column] = next_month
) -> DataFrame:
    """Actual and forecast months in one table, with the cumulative charge-off.

    ``start`` gives the first forecast date from the last actual one: a month on, or days
    with ``lambda last: F.date_add(last, 30)``. Rows of one series and month are added up. Each series becomes one row holding its months, as many as the calendar has,
    next to its rates; the forecast months are appended there. So the months are
    read once, and neither a join nor a union brings the two parts together.
    """
    ratios = balance_ratios(months, series).withColumn("Period", F.lit("Actual"))
    fields = [PERIOD, CHARGE_OFF, BALANCE, "charge_off_share", "balance_growth_mom", "Period"]
    rates = trailing_rates(ratios, series, trailing, F.collect_list(F.struct(*fields)).alias("_actual"))
    first = start("last_period")

    def ahead(step: Column) -> Column:
        balance = F.col("last_balance") * compounded(F.col("growth_rate"), step)
        missing = F.lit(None).cast("double")
        values = (monthly_date(first, step - 1), balance * F.col("charge_off_rate"), balance, missing, missing, F.lit("Forecast"))
        return F.struct(*[v.alias(f) for v, f in zip(values, fields)])

    both = F.concat("_actual", F.transform(F.sequence(F.lit(1), F.lit(h)), ahead))
    rows = rates.select(*series, F.inline_outer(both))
    return rows.withColumn("cumulative_charge_off", running_total(CHARGE_OFF, series, PERIOD))


def charge_off_totals(forecast: DataFrame, series: Sequence[str] = ()) -> DataFrame:
    """Charge-offs to the last actual month and to the end of the forecast."""
    actual = F.when(F.col("Period") == "Actual", F.col(CHARGE_OFF))
    return forecast.groupBy(*series).agg(
        F.coalesce(F.sum(actual), F.lit(0.0)).alias("actual_total"),
        F.coalesce(F.sum(CHARGE_OFF), F.lit(0.0)).alias("forecast_total"),
        F.max(PERIOD).alias("end_period"),
    )
