"""A state that grows month by month equals one pass over all months."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from checks.panel import BRAND, loan_month
from loantide.plans import reports, state
from loantide.schema import LOAN, PERIOD

ROW = f"{LOAN} string, {PERIOD} date, zeroBalanceCode string, remainingTermToMaturityNumber double, obligorCreditScore double, " + ", ".join(
    ("chargedoffPrincipalAmount double", "paymentToIncomePercentage double", "obligorEmploymentVerificationCode string", "obligorIncomeVerificationLevelCode string")
)


def panel(spark, rows):
    """Rows (loan, month or None, code, term, charged) of 2031."""
    day = lambda m: None if m is None else f"2031-{m:02d}-28"
    full = [(loan, day(m), code, term, 700.0 + (m or 0), charged, 0.5, "1", str(m)) for loan, m, code, term, charged in rows]
    texts = ROW.replace(" date", " string")
    return spark.createDataFrame(full, texts).withColumn(PERIOD, F.col(PERIOD).cast("date"))


ROWS = [
    ("a", 1, None, 9.0, 1.0), ("a", 2, "1", 8.0, None), ("a", 3, "1", 7.0, 2.0),
    ("b", 1, None, 1.0, None), ("b", 3, "1", 0.0, 5.0),
    ("c", 1, None, 5.0, 0.0), ("c", 4, "1", 4.0, 0.0),
    ("d", 2, "4", None, 100.0), ("d", None, None, 3.0, 7.0), ("d", None, "1", 3.0, 7.0),
    ("e", 4, "1", 3.0, 1.0), ("f", None, "1", 3.0, None), (None, 1, None, 3.0, 1.0), (None, 2, "1", 3.0, 1.0),
    ("g", 1, None, 5.0, 1.0), ("g", 1, "2", 5.0, 1.0), ("g", 2, "1", 5.0, 1.0), ("g", 2, "1", 5.0, 1.0),
]


def rows_of(df, *columns):
    names = columns or df.columns
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=str)


def test_month_by_month_equals_one_pass(spark):
    whole = panel(spark, ROWS)
    loans = measures = None
    for m in (1, 2, 3, 4, None):
        arrived = whole.where(F.month(PERIOD) == m if m else F.col(PERIOD).isNull())
        before = loans if loans is not None else state.loan_state(whole.where("false"))
        found = state.arrived_measures(arrived, before)
        measures = found if measures is None else measures.unionByName(found)
        loans = state.merge_loan_states(before, state.loan_state(arrived))
    expected = reports.monthly_measures(whole)
    assert rows_of(measures.select(expected.columns)) == rows_of(expected)
    summary = reports.loan_summary(whole)
    assert rows_of(loans.select(summary.columns)) == rows_of(summary)
    assert rows_of(loans.select(state.loan_state(whole).columns)) == rows_of(state.loan_state(whole))


def test_merged_moments_lose_no_digits(spark):
    rng = random.Random(4)
    values = [(f"g{i % 3}", i % 7, 1e9 + rng.random() if i % 11 else None) for i in range(400)] + [("none", 1, None), ("one", 1, 5.0)]
    df = spark.createDataFrame(values, "g string, month int, paidAmount double")
    months = state.month_moments(df, ["g"], "month")
    steps = state.merge_moments(months.where("month < 3"), ["g"]).unionByName(state.merge_moments(months.where("month >= 3"), ["g"]))
    for merged in (state.merge_moments(months, ["g"]), state.merge_moments(steps, ["g"])):
        got = {r.g: r for r in state.spread(merged).collect()}
        for g in ("g0", "g1", "g2"):
            mine = [v for k, _, v in values if k == g and v is not None]
            assert got[g].n == len(mine) and got[g]["mean"] == pytest.approx(math.fsum(mine) / len(mine), rel=1e-15)
            assert got[g].sd == pytest.approx(statistics.stdev(mine), rel=1e-6)
        assert (got["none"].n, got["none"]["mean"], got["none"].sum, got["none"].sd) == (0, None, 0.0, None)
        assert (got["one"].n, got["one"].sum, got["one"].sd) == (1, 5.0, None)
    assert state.merge_moments(months.where("false"), ["g"]).count() == 0


def test_a_restated_month_replaces_its_moments(spark, sf_dir):
    df = loan_month(spark, sf_dir)
    month = df.agg(F.min(PERIOD)).first()[0]
    restated = df.withColumn("originalLoanAmount", F.when(F.col(PERIOD) == month, 1.0).otherwise(F.col("originalLoanAmount")))
    kept = state.month_moments(df, [BRAND]).where(F.col(PERIOD) != F.lit(month))
    again = state.month_moments(restated.where(F.col(PERIOD) == F.lit(month)), [BRAND])
    merged = {(r[BRAND], r.measure): (r.n, r["mean"]) for r in state.merge_moments(kept.unionByName(again), [BRAND]).collect()}
    once = {(r[BRAND], r.measure): (r.n, r["mean"]) for r in state.merge_moments(state.month_moments(restated, [BRAND]), [BRAND]).collect()}
    assert merged.keys() == once.keys()
    assert all(merged[k][0] == once[k][0] and merged[k][1] == pytest.approx(once[k][1], rel=1e-12) for k in once)
