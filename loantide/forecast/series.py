"""Series as arrays, and forecast tables from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import task_count

# Normal quantiles of the 80 % and 95 % intervals.
Z80 = 1.281552
Z95 = 1.959964


def with_every_month(df: DataFrame, series: Sequence[str], period: str, flows: Sequence[str] = (), levels: Sequence[str] = ()) -> DataFrame:
    """Rows for the months a series lacks between its first and last one, dated at their ends.

    A flow is 0 in such a month, a level (a running sum, say) the last one known, any other column
    NULL. Rows of one series and month are added up, rows without a period are left out.
    """
    month = F.last_day(F.col(period))
    known = df.where(F.col(period).isNotNull()).groupBy(*series, month.alias(period)).agg(*[F.sum(c).alias(c) for c in (*flows, *levels)])
    span = known.groupBy(*series).agg(F.min(period).alias("_first"), F.max(period).alias("_last"))
    starts = F.sequence(F.trunc("_first", "month"), F.trunc("_last", "month"), F.expr("INTERVAL 1 MONTH"))
    months = span.select(*[F.col(c).alias(f"_{c}") for c in series], F.explode(starts).alias("_start"))
    months = months.withColumn("_month", F.last_day("_start"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in series]
    every = months.join(known, [*same, F.col(period) == F.col("_month")], "left")
    so_far = Window.partitionBy(*[f"_{c}" for c in series]).orderBy("_month").rowsBetween(Window.unboundedPreceding, 0)
    return every.select(
        *[F.col(f"_{c}").alias(c) for c in series],
        F.col("_month").alias(period),
        *[F.when(F.col(period).isNull(), F.lit(0)).otherwise(F.col(c)).alias(c) for c in flows],
        *[F.last(c, ignorenulls=True).over(so_far).alias(c) for c in levels],
    )


def as_arrays(df: DataFrame, series: Sequence[str], period: str, value: str) -> DataFrame:
    """One row per series: values ``y`` in period order and the last period.

    Values of one period are added up first, so an array never holds more
    entries than the calendar has periods, whatever the table. Rows without a value or period are
    left out; :func:`with_every_month` fills the months a series lacks.
    """
    ordered = F.array_sort(F.collect_list(F.struct(F.col(period).alias("t"), F.col("_y").alias("y"))))
    return (
        df.where(F.col(value).isNotNull() & F.col(period).isNotNull())
        .groupBy(*series, period)
        .agg(F.sum(F.col(value).cast("double")).alias("_y"))
        .groupBy(*series)
        .agg(ordered.alias("_points"), F.max(period).alias("last_period"))
        .select(*series, "last_period", F.col("_points.y").alias("y"))
    )


def spread(df: DataFrame, *keys: str, per_core: int = 2) -> DataFrame:
    """Share rows over all cores: fitting costs far more than moving the few bytes of a series.

    The tasks follow the cores, whatever the shuffle setting. Keyed by a hash of its own, or the planner takes the aggregate's exchange
    for this one and sizes it by bytes.
    """
    return df.repartition(task_count(df.sparkSession, per_core), F.xxhash64(*keys)) if keys else df


def fitted_once(udf):
    """Keep the optimizer from copying a costly fit into the filter it infers for an explode."""
    return udf.asNondeterministic()


def with_intervals(df: DataFrame, mean: Column, variance: Column) -> DataFrame:
    m, sd = F.col("mean"), F.col("_sd")
    return (
        df.withColumns({"mean": mean, "_sd": F.sqrt(variance)})
        .withColumns(
            {
                "lo80": m - F.lit(Z80) * sd,
                "hi80": m + F.lit(Z80) * sd,
                "lo95": m - F.lit(Z95) * sd,
                "hi95": m + F.lit(Z95) * sd,
            }
        )
        .drop("_sd")
    )
