"""Forecast reports on monthly tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..forecast import arima, backtest, smoothing
from ..forecast.local_regression import smooth
from ..forecast.run_rate import run_rate_forecast
from ..forecast.series import as_arrays, with_every_month
from ..functions.dates import months_after
from ..functions.labels import money_label, significant
from ..operators.columns import stack_by_name
from ..operators.series import recency, running_total
from ..schema import PERIOD
from ..sources.storage import plain_number, report_line
from .reports import principal_interest_charge_off

CHARGE_OFF = "chargedoffPrincipalAmount"


def cumulative_charge_off(months: DataFrame, series: Sequence[str]) -> DataFrame:
    """Cumulative charge-offs as one array per series, with the months a series lacks between its first and last."""
    every = with_every_month(months, series, PERIOD, flows=[CHARGE_OFF])
    running = every.select(*series, PERIOD, running_total(CHARGE_OFF, series, PERIOD).alias("cumulative"))
    return as_arrays(running, series, PERIOD, "cumulative")


def model_forecasts(months: DataFrame, series: Sequence[str], h: int = 17) -> DataFrame:
    """Forecasts of cumulative charge-offs by both selected models, with intervals and dates."""
    return stack_by_name(smoothing_forecasts(months, series, h), arima_forecasts(months, series, h))


def smoothing_forecasts(months: DataFrame, series: Sequence[str], h: int = 17) -> DataFrame:
    fits = smoothing.select_smoothing(cumulative_charge_off(months, series), list(series))
    return dated(smoothing.smoothing_forecast(fits, list(series), h)).withColumn("method", F.lit("ETS"))


def arima_forecasts(months: DataFrame, series: Sequence[str], h: int = 17, **orders: int) -> DataFrame:
    fits = arima.select_arima(cumulative_charge_off(months, series), list(series), h, **orders)
    return dated(arima.arima_forecast(fits, list(series))).withColumn("method", F.lit("ARIMA"))


def dated(forecast: DataFrame) -> DataFrame:
    """The month of each step, counted from the last one of its series."""
    return forecast.withColumn(PERIOD, months_after("last_period", F.col("h")))


def model_comparison(months: DataFrame, series: Sequence[str], h: int = 17) -> DataFrame:
    """Cross-validated errors of both models per series."""
    arrays = cumulative_charge_off(months, series)
    models = (backtest.arima(), backtest.smoothing())
    errors = stack_by_name(*[backtest.rolling_origin(arrays, series, m, h) for m in models])
    return backtest.accuracy(errors, [*series, "model"])


def run_rate_lines(
    months: DataFrame,
    series: Sequence[str] = (),
    h: int = 17,
    trailing: int = 12,
    growth_text: str = "Balance growth, trailing mean: ",
    share_text: str = "Charge-off share of balance, trailing mean: ",
    total_text: str = "Charged off by ",
) -> DataFrame:
    """The run-rate forecast as report text: trailing rates and the cumulative value it ends with.

    The last line reads ``total_text``, the end date and the value.
    """
    forecast = run_rate_forecast(months, series, h, trailing)
    actual = F.col("Period") == "Actual"
    recent = recency([*series, "Period"], PERIOD) <= trailing
    marked = forecast.withColumn("_recent", actual & recent)
    rates = marked.groupBy(*series).agg(
        F.avg(F.when(F.col("_recent"), F.col("balance_growth_mom"))).alias("growth"),
        F.avg(F.when(F.col("_recent"), F.col("charge_off_share"))).alias("share"),
        F.sum(CHARGE_OFF).alias("total"),
        F.max(PERIOD).alias("end"),
    )

    def percent(c: str) -> Column:
        return plain_number(F.bround(F.col(c) * 100, 2))

    end = F.concat(F.lit(total_text), F.date_format("end", "MM/dd/yyyy"), F.lit(": $"), significant("total"))
    return rates.select(
        *series,
        report_line(growth_text, percent("growth"), "%").alias("growth_line"),
        report_line(share_text, percent("share"), "%").alias("share_line"),
        end.alias("total_line"),
    )


def smoothed_components(months: DataFrame, series: Sequence[str] = (), span: float = 0.75) -> DataFrame:
    """Principal, interest and charge-offs by month in long form, with smoother and axis label."""
    long = principal_interest_charge_off(months, series).withColumn("_day", F.unix_date(PERIOD))
    fits = smooth(long, [*series, "name"], "_day", "value", span)
    return fits.select(
        *series, "name", F.date_from_unix_date("_day").alias(PERIOD), "value", "fitted", "lo", "hi",
        money_label("value").alias("label"),
    )
