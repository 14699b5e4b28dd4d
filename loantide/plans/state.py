"""Monthly state that grows by the month that arrived: partial moments per period, and what is last known of each loan.

The state is a table like any other. Keep the months partitioned by period, so that a restated month replaces its own rows, and
the loans as one table per arrival. Reports of all months then read a few numbers per month instead of the panel.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..operators.columns import across
from ..operators.grouping import latest, measure_columns, total
from ..operators.series import prior_states
from ..schema import LOAN, PERIOD
from .panel import still_active
from .reports import loan_counts, loan_summary

LOAN_VALUES = ("creditScore", "employmentVerification", "incomeVerification", "paymentToIncome")


def month_moments(panel: DataFrame, by: Sequence[str] = (), period: str = PERIOD) -> DataFrame:
    """Per period, group and measure: values ``n``, their ``mean`` and the sum of squared ``deviations`` from it, in long form.

    Missing values do not count; a measure without values has n 0 and NULL mean. One partial aggregate over the panel.
    """
    measures = measure_columns(panel)
    parts = [
        F.struct(
            F.lit(m).alias("measure"), F.count(m).alias("n"), F.avg(m).alias("mean"), (F.var_pop(m) * F.count(m)).alias("deviations")
        )
        for m in measures
    ]
    return panel.groupBy(period, *by).agg(F.array(*parts).alias("_m")).select(period, *by, F.inline("_m"))


def merge_moments(moments: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Moments of the union of all rows that agree in ``keys`` and measure; other columns are merged over.

    Parts are centred on the merged mean, so nothing cancels however far the values lie from zero. Merging in steps equals
    merging at once up to rounding. Both aggregates combine on the map side; the means are as few as the result.
    """
    same = [*keys, "measure"]
    means = moments.groupBy(*[F.col(k).alias(f"_{k}") for k in same]).agg(
        (F.sum(F.col("n") * F.col("mean")) / F.nullif(F.sum("n"), F.lit(0))).alias("_mean")
    )
    apart = F.col("n") * F.pow(F.col("mean") - F.col("_mean"), F.lit(2))
    met = moments.join(means, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in same])
    return met.groupBy(*same).agg(
        F.sum("n").alias("n"), F.max("_mean").alias("mean"), (F.sum("deviations") + F.sum(apart)).alias("deviations")
    )


def spread(moments: DataFrame) -> DataFrame:
    """Moments with ``sum`` (0 without values) and the sample standard deviation ``sd`` (NULL below two values)."""
    sd = F.when(F.col("n") > 1, F.sqrt(F.col("deviations") / (F.col("n") - 1)))
    return moments.withColumns({"sum": F.coalesce(F.col("n") * F.col("mean"), F.lit(0.0)), "sd": sd})


def loan_state(panel: DataFrame) -> DataFrame:
    """The loan summary with the loan's latest period as ``asOf`` and whether it was active then as ``active``."""
    states = panel.groupBy(LOAN, PERIOD).agg(F.max(still_active()).alias("_active"))
    last = F.max(F.when(F.col(PERIOD).isNotNull(), F.struct(PERIOD, "_active"))).alias("_last")
    ends = states.groupBy(F.col(LOAN).alias("_loan")).agg(last).select("_loan", F.col(f"_last.{PERIOD}").alias("asOf"), "_last._active")
    met = loan_summary(panel).join(ends, F.col(LOAN).eqNullSafe(F.col("_loan"))).drop("_loan")
    return met.withColumnRenamed("_active", "active")


def merge_loan_states(*states: DataFrame) -> DataFrame:
    """The state of all months from the states of parts of them, in any order; no month may be in two parts.

    Each loan's latest attributes come from the part that saw it last; totals add up. As in the summary, a loan without any
    period has its attributes all the same.
    """
    every = states[0]
    for state in states[1:]:
        every = every.unionByName(state)
    newest = {c: c for c in LOAN_VALUES} | {"asOf": "asOf", "active": "active"}
    return every.withColumn("_period", F.col("asOf")).groupBy(LOAN).agg(
        *latest(newest, "_period"),
        total("totalChargeOffPrincipal").alias("totalChargeOffPrincipal"),
        total("prepaid").alias("prepaid"),
        F.max("zeroBalanceCode").alias("zeroBalanceCode"),
    )


def arrived_measures(panel: DataFrame, loans: DataFrame) -> DataFrame:
    """Monthly measures of months that follow those in ``loans``, the state of the loans before them.

    The state stands in for all earlier months: a payoff counts if the loan was active in the month before, be it among the arrived
    ones or the last in the state. Rows without a period have no predecessor. Only loan, period and state are shuffled by loan.
    """
    code = F.col("zeroBalanceCode")
    ends = [F.count_if(code == F.lit("4")).alias("defaults"), F.count_if(code == F.lit("1")).alias("prepayments")]
    base = panel.groupBy(PERIOD).agg(*across(measure_columns(panel), total), *loan_counts(), *ends)
    closed = F.count_if(code == F.lit("1")).alias("_closed")
    arrived = panel.groupBy(LOAN, PERIOD).agg(F.max(still_active()).alias("_active"), closed)
    before = loans.where("asOf IS NOT NULL").select(LOAN, F.col("asOf").alias(PERIOD), F.col("active").alias("_active"), F.lit(None).cast("long").alias("_closed"))
    states = prior_states(arrived.unionByName(before), F.col("_active"), "was_active", LOAN, PERIOD, F.sum("_closed").alias("_closed"))
    payoffs = states.groupBy(F.col(PERIOD).alias("_month")).agg(
        total(F.when(F.col("was_active"), F.col("_closed"))).alias("numberNewPrepaidLoans")
    )
    met = base.join(payoffs, F.col(PERIOD).eqNullSafe(F.col("_month")), "left").drop("_month")
    return met.withColumn("numberNewPrepaidLoans", F.coalesce("numberNewPrepaidLoans", F.lit(0)))
