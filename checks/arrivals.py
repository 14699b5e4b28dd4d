"""Reports from a state that grows by arriving months, next to the same reports over all months at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from loantide.plans import reports, state
from loantide.schema import PERIOD
from loantide.session import new_path
from loantide.sources.storage import read_snapshot, write_snapshot

from .panel import BRAND, EXACT, MEASURES, PANEL, flags, loan_month
from .registry import check, rounded
from .reports import COUNTS, LOANS, MEASURE_SUMS, MONTH

P = "reportingPeriodEndingDate"
FIRST, SECOND = "1995-06-30", "1997-01-31"


def stored(spark, df, name):
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


def parts(spark, sf):
    """The panel stored by month, and its months up to a first day, up to a second one, and later."""
    path = new_path(spark, "panel")
    write_snapshot(loan_month(spark, sf), path)
    panel, month = read_snapshot(spark, path), F.col(PERIOD)
    return panel.where(month <= FIRST), panel.where((month > FIRST) & (month <= SECOND)), panel.where(month > SECOND)


MOMENTS = " UNION ALL ".join(
    f"""SELECT {BRAND}, '{m}' AS measure, count({m}) AS n, coalesce(round(sum({m}), 2), 0) + 0.0 AS sum, round(stddev_samp({m}), 4) + 0.0 AS sd
    FROM loan_month GROUP BY 1"""
    for m in MEASURES
)


@check(PANEL, sql=MOMENTS)
def a09_moments_of_merged_months(spark, sf):
    """Deviations of each brand from the moments of its months; the panel is read once, when the months arrive."""
    path = new_path(spark, "moments")
    write_snapshot(state.month_moments(loan_month(spark, sf), [BRAND]), path)
    merged = state.spread(state.merge_moments(read_snapshot(spark, path), [BRAND]))
    return rounded(rounded(merged, 2, "sum"), 4, "sd").select(BRAND, "measure", "n", "sum", "sd")


@check(PANEL, flags("loan_month"), sql=f"SELECT {MONTH}, {MEASURE_SUMS}, {COUNTS} FROM flagged GROUP BY {P}")
def r08_monthly_measures_by_arrival(spark, sf):
    """Two later batches of months, each measured with the state of the loans before it instead of the months before it."""
    first, second, third = parts(spark, sf)
    before = stored(spark, state.loan_state(first), "loans")
    after = stored(spark, state.merge_loan_states(before, state.loan_state(second)), "loans")
    months = reports.monthly_measures(first).unionByName(state.arrived_measures(second, before))
    return rounded(months.unionByName(state.arrived_measures(third, after)), 2, *MEASURES)


@check(
    EXACT, LOANS,
    sql="""SELECT assetNumber, CAST(creditScore AS DOUBLE) AS creditScore, employmentVerification, incomeVerification,
           CAST(paymentToIncome AS DOUBLE) AS paymentToIncome, round(CAST(charged AS DOUBLE), 2) + 0.0 AS totalChargeOffPrincipal,
           prepaid, zeroBalanceCode FROM loans""",
)
def r03_loan_summary_of_merged_states(spark, sf):
    """Three states, merged out of order."""
    first, second, third = (state.loan_state(p) for p in parts(spark, sf))
    merged = state.merge_loan_states(state.merge_loan_states(third, first), second)
    return rounded(merged.drop("asOf", "active"), 2, "totalChargeOffPrincipal")
