"""Residual autocorrelation and the Ljung-Box test."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T


def residual_rows(fits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The ``residuals`` array of fitted series as rows (``t``, ``residual``)."""
    rows = fits.select(*keys, "parameters", F.posexplode("residuals").alias("_t", "residual"))
    return rows.withColumn("t", F.col("_t") + 1).drop("_t")


def autocorrelation(rows: DataFrame, keys: Sequence[str], lags: int, t: str = "t", value: str = "residual") -> DataFrame:
    """Autocorrelation of each series at lags 1 to ``lags``, one row each."""
    whole = Window.partitionBy(*keys)
    ordered = whole.orderBy(t)
    centred = rows.withColumn("_e", F.col(value) - F.avg(value).over(whole))
    products = centred.withColumns({f"_{k}": F.col("_e") * F.lag("_e", k).over(ordered) for k in range(1, lags + 1)})
    scale = F.sum(F.col("_e") * F.col("_e"))
    wide = products.groupBy(*keys).agg(
        F.count("_e").alias("n"),
        *[F.try_divide(F.coalesce(F.sum(f"_{k}"), F.lit(0.0)), scale).alias(str(k)) for k in range(1, lags + 1)],
    )
    long = wide.unpivot([*keys, "n"], [str(k) for k in range(1, lags + 1)], "lag", "acf")
    return long.withColumn("lag", F.col("lag").cast("int"))


def upper_tail(x: float, freedom: int) -> float:
    """Chance that a chi-square variable exceeds x, from its finite sums for whole degrees of freedom."""
    half = x / 2.0
    if freedom % 2 == 0:
        return math.exp(-half) * sum(half**i / math.factorial(i) for i in range(freedom // 2))
    tail = math.erfc(math.sqrt(half))
    return tail + math.exp(-half) * sum(half ** (i - 0.5) / math.gamma(i + 0.5) for i in range(1, freedom // 2 + 1))


@F.pandas_udf(T.DoubleType())
def chi_square_tail(x: pd.Series, freedom: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) else upper_tail(a, int(k)) for a, k in zip(x, freedom)], dtype=float)


def ljung_box(acf: DataFrame, keys: Sequence[str], fitted: int | str = 0) -> DataFrame:
    """Ljung-Box statistic, degrees of freedom and p-value; ``fitted`` is the number of fitted weights."""
    n, r = F.col("n"), F.col("acf")
    weights = F.lit(fitted) if isinstance(fitted, int) else F.max(fitted)
    tested = acf.groupBy(*keys).agg(
        F.sum(n * (n + 2) * r * r / F.nullif(n - F.col("lag"), F.lit(0))).alias("q"),
        F.greatest(F.lit(1), F.max("lag") - weights).alias("freedom"),
    )
    return tested.withColumn("p_value", chi_square_tail("q", "freedom"))


def array_autocorrelation(fits: DataFrame, keys: Sequence[str], lags: Column) -> DataFrame:
    """Autocorrelation of each ``residuals`` array at lags 1 to ``lags``, one row each, with its length ``n``.

    Missing residuals are left out before.
    """
    kept = fits.withColumn("_r", F.filter("residuals", lambda r: r.isNotNull() & ~F.isnan(r))).withColumn("n", F.size("_r"))
    add = lambda total, x: total + x
    mean = F.aggregate("_r", F.lit(0.0), add) / F.col("n")
    centred = kept.where("n > 0").withColumn("_mean", mean).withColumn("_e", F.transform("_r", lambda r: r - F.col("_mean")))
    rows = centred.withColumn("lag", F.explode(F.when(lags >= 1, F.sequence(F.lit(1), lags))))
    left = F.col("n") - F.col("lag")
    pairs = F.zip_with(F.slice("_e", F.lit(1), F.greatest(left, F.lit(0))), F.slice("_e", F.col("lag") + 1, F.greatest(left, F.lit(0))), lambda a, b: a * b)
    scale = F.aggregate(F.transform("_e", lambda e: e * e), F.lit(0.0), add)
    return rows.select(*keys, "n", "lag", F.try_divide(F.aggregate(pairs, F.lit(0.0), add), scale).alias("acf"))


def check_residuals(fits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ljung-Box test of fitted series.

    It covers ten lags or a fifth of the length, whichever is less, but always
    enough to leave three degrees of freedom. The lags follow from each fit; where the residuals are no
    longer than these lags there is no test, and its columns are NULL.
    """
    names = [*keys, "parameters"]
    n = F.size(F.filter("residuals", lambda r: r.isNotNull() & ~F.isnan(r)))
    used = F.greatest(F.least(F.lit(10), F.bround(n / 5, 0)).cast("int"), F.col("parameters").cast("int") + 3)
    short = fits.where(n <= used).select(*keys, F.lit(None).cast("double").alias("q"))
    tested = ljung_box(array_autocorrelation(fits.where(n > used), names, used), names, "parameters").drop("parameters")
    return tested.unionByName(
        short.withColumns({"freedom": F.lit(None).cast("int"), "p_value": F.lit(None).cast("double")}), allowMissingColumns=True
    )
