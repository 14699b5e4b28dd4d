"""Ranking of aggregated tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def descending_rank(c, within: Sequence[str] = ()) -> Column:
    """Competition rank, largest first, missing values last."""
    return F.rank().over(Window.partitionBy(*within).orderBy(F.col(c).desc_nulls_last()))


def top_with_ties(df: DataFrame, c: str, n: int, within: Sequence[str] = ()) -> DataFrame:
    """The ``n`` largest rows and every tie of the last one, with their ``rank``.

    The rank filter becomes a group limit below the exchange, so each task
    passes on only its own leaders.
    """
    return df.withColumn("rank", descending_rank(c, within)).where(F.col("rank") <= n)


def with_axis_position(df: DataFrame, c: str) -> DataFrame:
    """Position of each category on an axis ordered by falling ``c``."""
    return df.withColumn("position", F.dense_rank().over(Window.orderBy(F.col(c).desc_nulls_last())))
