"""Rolling-origin cross-validation and forecast accuracy."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .arima import fit_all
from .series import fitted_once, spread
from .smoothing import Smoothing, default_grid, fit_prefixes


class Forecaster(NamedTuple):
    """Array of values in, array of ``h`` forecasts out, as a column function.

    One with ``prefixes`` takes the whole series and returns an array of such arrays, one for each prefix of at least one and
    less than all values, so prefixes share work. A costly one is spread over all cores, origin by origin.
    """

    name: str
    forecast: Callable[[Column, int], Column]
    costly: bool = False
    prefixes: bool = False


def naive() -> Forecaster:
    """Repeats the last value."""
    return Forecaster("naive", lambda y, h: F.array_repeat(F.element_at(y, -1), h))


def drift() -> Forecaster:
    """Continues the line from the first to the last value."""

    def forecast(y: Column, h: int) -> Column:
        slope = F.coalesce(F.try_divide(F.element_at(y, -1) - F.element_at(y, 1), F.size(y) - 1), F.lit(0.0))
        return F.transform(F.sequence(F.lit(1), F.lit(h)), lambda k: F.element_at(y, -1) + k * slope)

    return Forecaster("drift", forecast)


def smoothing(grid: Iterable[Smoothing] | None = None, name: str = "ets", refine: int | None = None) -> Forecaster:
    """Exponential smoothing, chosen and refined anew at each origin, as :func:`loantide.forecast.smoothing.select_smoothing` does."""
    candidates = list(grid or default_grid())
    passes = (0 if grid else 3) if refine is None else refine

    def forecast(y: Column, h: int) -> Column:
        @F.pandas_udf("array<array<double>>")
        def run(values: pd.Series) -> pd.Series:
            paths = []
            for fits in fit_prefixes(list(values), candidates, passes):
                fits = fits.iloc[:-1]
                damping = np.cumsum(fits["phi"].to_numpy(float)[:, None] ** np.arange(1, h + 1), axis=1)
                paths.append(list(fits["level"].to_numpy(float)[:, None] + damping * fits["trend"].to_numpy(float)[:, None]))
            return pd.Series(paths)

        return fitted_once(run)(y)

    return Forecaster(name, forecast, prefixes=True)


def arima(max_p: int = 5, max_q: int = 5, max_order: int = 5) -> Forecaster:
    """ARIMA, chosen anew at each origin; all origins of a task are fitted together."""

    def forecast(y: Column, h: int) -> Column:
        @F.pandas_udf("array<double>")
        def run(values: pd.Series) -> pd.Series:
            return pd.Series(list(fit_all(values, h, max_p, max_q, max_order)["mean"]))

        return fitted_once(run)(y)

    return Forecaster("arima", forecast, costly=True)


def rolling_origin(df: DataFrame, keys: Sequence[str], forecaster: Forecaster, h: int) -> DataFrame:
    """Forecast errors from every origin of the array column ``y``, 1 to ``h`` steps ahead.

    One row per origin and step, which is the error table itself; steps past
    the end of the series have a NULL error.
    """
    whole = df.where(F.size("y") > 1)
    if forecaster.prefixes:
        # One row per series: the forecasts of all its prefixes come from one pass.
        fitted = spread(whole, *keys, per_core=1).withColumn("_forecasts", forecaster.forecast(F.col("y"), h))
        origins = fitted.select(*keys, "y", F.posexplode("_forecasts").alias("_at", "_forecast")).withColumn("origin", F.col("_at") + 1)
    else:
        origins = whole.withColumn("origin", F.explode(F.sequence(F.lit(1), F.size("y") - 1)))
        if forecaster.costly:
            origins = spread(origins, *keys, "origin", per_core=1)
        known = F.slice("y", F.lit(1), F.col("origin"))
        origins = origins.withColumn("_forecast", forecaster.forecast(known, h))
    future = F.slice("y", F.col("origin") + 1, F.lit(h))
    return origins.select(
        *keys, "origin", future.alias("_future"), F.posexplode("_forecast").alias("_step", "forecast")
    ).select(
        *keys, "origin", (F.col("_step") + 1).alias("h"),
        (F.get("_future", F.col("_step")) - F.col("forecast")).alias("error"),
        F.lit(forecaster.name).alias("model"),
    )


def accuracy(errors: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Mean absolute and mean squared error, missing errors left out."""
    e = F.col("error")
    return errors.groupBy(*by).agg(F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"))
