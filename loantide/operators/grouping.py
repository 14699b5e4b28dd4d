"""Aggregates that skip missing values the way the panel's reports expect."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..schema import OTHER_MEASURES
from .columns import across, columns_containing


def total(c) -> Column:
    """Sum without missing values; a group with none left is 0, not NULL."""
    return F.coalesce(F.sum(c), F.lit(0))


def measure_columns(df: DataFrame) -> list[str]:
    """The panel's numeric measures, picked by name."""
    named = columns_containing(df, "amount")
    named += [c for c in columns_containing(df, "percentage") if c not in named]
    return named + [c for c in OTHER_MEASURES if c in df.columns and c not in named]


def sums(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*across(columns, total))


def sums_and_means(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Every column summed and averaged, as ``<column>_sum`` and ``<column>_mean``."""
    return df.groupBy(*keys).agg(*across(columns, total, "{col}_sum"), *across(columns, F.avg, "{col}_mean"))


def latest(columns: dict[str, str], order: str) -> list[Column]:
    """Aggregates giving each column's latest-reported value, kept even where it is NULL.

    One struct maximum orders the group once for all columns. Rows that share
    the latest period are told apart by their values, so a rerun picks the same.
    """
    newest = F.max(F.struct(order, *[F.col(c).alias(name) for name, c in columns.items()]))
    return [newest[name].alias(name) for name in columns]


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once; empty for a sound loan-month panel."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)
