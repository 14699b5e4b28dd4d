"""Relations that must hold on any panel."""

import pytest
from pyspark.sql import functions as F

from checks.panel import BRAND, MEASURES, loan_month, monthly, raw_panel
from loantide.operators import grouping, series
from loantide.plans import panel, reports
from loantide.schema import LOAN, PERIOD


@pytest.fixture(scope="module")
def clean(spark, sf_dir):
    return panel.clean_panel(raw_panel(spark, sf_dir)).cache()


def test_panel_is_unique(clean):
    assert grouping.repeated_keys(clean, [LOAN, PERIOD]).count() == 0


def test_no_row_is_lost_or_added(spark, sf_dir, clean):
    assert clean.count() == raw_panel(spark, sf_dir).count()


def test_no_payoff_in_a_first_month(clean):
    first = clean.groupBy(LOAN).agg(F.min(PERIOD).alias(PERIOD))
    assert clean.join(first, [LOAN, PERIOD]).where("prepaidFlagFirst = 1").count() == 0


def test_both_ways_to_monthly_measures_agree(spark, sf_dir, clean):
    wide = reports.monthly_measures(clean)
    narrow = reports.monthly_measures(panel.typed_panel(raw_panel(spark, sf_dir)))
    counts = [PERIOD, "numberActiveLoans", "numberNewPrepaidLoans", "numberPrepaidLoansTotal", "defaults", "prepayments"]
    assert sorted(map(tuple, wide.select(counts).collect())) == sorted(map(tuple, narrow.select(counts).collect()))


def test_payoffs_by_brand_add_up(clean):
    whole = reports.new_prepayments(clean).agg(F.sum("new_prepaid")).first()[0]
    assert reports.new_prepayments(clean, [BRAND]).agg(F.sum("new_prepaid")).first()[0] == whole


def test_shares_sum_to_one(clean):
    shares = reports.status_composition(clean).groupBy(PERIOD).agg(F.sum("share").alias("s"))
    assert shares.where(F.abs(F.col("s") - 1) > 1e-9).count() == 0


def test_last_running_sum_is_the_total(spark, sf_dir):
    months = monthly(spark, sf_dir, BRAND)
    last = series.last_rows(series.running_totals(months, MEASURES, [BRAND], PERIOD), 1, [BRAND], PERIOD)
    totals = {r[BRAND]: r for r in months.groupBy(BRAND).agg(*[F.sum(m).alias(m) for m in MEASURES]).collect()}
    for row in last.collect():
        for m in MEASURES:
            assert row[m] == pytest.approx(totals[row[BRAND]][m])


def test_stack_tops_are_group_totals(clean):
    parts = reports.charge_off_by_band_and_income(reports.loan_summary(clean))
    tops = parts.groupBy("band").agg(F.max("y1").alias("top"), F.sum("n").alias("n"), F.min("y0").alias("low"))
    assert tops.where("top <> n or low <> 0").count() == 0


def test_loans_with_flags_are_those_of_the_summary(spark, sf_dir, clean):
    flags = clean.groupBy(LOAN).agg(F.sum("prepaidFlag").alias("flags"))
    summary = reports.loan_summary(clean).join(flags, LOAN)
    assert summary.where(F.col("prepaid") != F.coalesce("flags", F.lit(0))).count() == 0
    assert loan_month(spark, sf_dir).select(LOAN).distinct().count() == summary.count()


def test_measures_by_brand_add_up(spark, sf_dir, clean):
    whole = reports.monthly_measures(clean)
    parts = reports.monthly_measures(panel.typed_panel(raw_panel(spark, sf_dir)), [BRAND])
    names = ["numberActiveLoans", "numberNewPrepaidLoans", "defaults", "prepayments"]
    added = parts.groupBy(PERIOD).agg(*[F.sum(n).alias(n) for n in names])
    assert sorted(map(tuple, added.select(PERIOD, *names).collect())) == sorted(map(tuple, whole.select(PERIOD, *names).collect()))
