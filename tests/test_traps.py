"""Missing-value, text and date rules, on tiny literal rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from loantide.functions import dates, labels, parsing
from loantide.operators import columns, grouping, ranking, series
from loantide.plans import panel, reports
from loantide.schema import INCOME_VERIFICATION, VALUE_SOURCE, ZERO_BALANCE
from loantide.sources import loan_records


def values(df, c="v"):
    return [r[c] for r in df.collect()]


def of(spark, items, kind="string", name="x"):
    return spark.createDataFrame([(i,) for i in items], f"{name} {kind}")


def test_t01_t02_sum_and_mean_of_nothing(spark):
    row = of(spark, [None, None], "double").agg(grouping.total("x").alias("s"), F.avg("x").alias("m")).first()
    assert row.s == 0 and row.m is None


def test_t03_t04_text_to_number(spark):
    texts = ["3", " 3 ", "-", "NaN", "1d", "1f", "2.5D ", "1e3", "", None, "abc", "01", "-4.5", "Inf"]
    got = values(of(spark, texts).select(parsing.to_number("x").alias("v")))
    assert got == [3, 3, None, None, None, None, None, 1000, None, None, None, 1, -4.5, float("inf")]


def test_t03_nan_never_reaches_a_sum(spark):
    df = of(spark, ["NaN", "2"]).select(parsing.to_number("x").alias("x"))
    assert df.agg(grouping.total("x").alias("v")).first().v == 2


def test_t05_text_to_date(spark):
    texts = ["04-30-2024", "4-3-2024", "13-45-2000", "", None, "2024-04-30"]
    got = values(of(spark, texts).select(parsing.to_day(F.col("x")).alias("v")))
    assert got == [dt.date(2024, 4, 30), dt.date(2024, 4, 3), None, None, None, None]


PANEL = "assetNumber string, reportingPeriodEndingDate date, zeroBalanceCode string, remainingTermToMaturityNumber double"


def loan(spark, *rows):
    return spark.createDataFrame([(a, dt.date(2024, m, 28), z, t) for a, m, z, t in rows], PANEL)


def test_t06_codes_compared_as_text(spark):
    df = loan(spark, ("a", 1, "01", 5.0), ("a", 2, "1", 5.0), ("a", 3, "1 ", 5.0))
    flagged = panel.with_prepayment_flags(df).orderBy("reportingPeriodEndingDate")
    assert values(flagged, "prepaidFlag") == [0, 1, 0]


def test_t07_unknown_condition_stays_unknown(spark):
    df = of(spark, [True, False, None], "boolean")
    assert values(df.select(parsing.if_else(F.col("x"), F.lit(1), F.lit(0)).alias("v"))) == [1, 0, None]


def test_t08_first_payoff_looks_at_the_previous_month(spark):
    df = loan(spark, ("a", 1, None, 9.0), ("a", 2, None, 8.0), ("a", 3, "1", 7.0), ("a", 4, "1", 6.0), ("b", 1, "1", 9.0))
    rows = panel.with_prepayment_flags(df).orderBy("assetNumber", "reportingPeriodEndingDate").collect()
    assert [r.prepaidFlagFirst for r in rows] == [None, None, 1, 0, None]
    assert [r.prepaidFlag for r in rows] == [None, None, 1, 1, 1]


def test_t08_previous_reported_month_skips_a_gap(spark):
    df = loan(spark, ("a", 1, None, 9.0), ("a", 5, "1", 5.0))
    rows = panel.with_prepayment_flags(df).orderBy("reportingPeriodEndingDate").collect()
    assert [r.prepaidFlagFirst for r in rows] == [None, 1]


def test_t09_latest_value_keeps_missing(spark):
    df = loan(spark, ("a", 1, "1", 9.0), ("a", 2, None, 8.0), ("b", 1, None, 3.0), ("b", 2, "4", None))
    got = df.groupBy("assetNumber").agg(
        *grouping.latest({"code": "zeroBalanceCode", "term": "remainingTermToMaturityNumber"}, "reportingPeriodEndingDate")
    )
    assert sorted(map(tuple, got.collect())) == [("a", None, 8.0), ("b", "4", None)]


def test_t10_text_maximum(spark):
    df = of(spark, ["10", "9", None])
    assert df.agg(F.max("x").alias("v")).first().v == "9"
    assert of(spark, [None]).agg(F.max("x").alias("v")).first().v is None


def test_t11_t12_missing_key_is_a_group_and_sorts_last(spark):
    df = spark.createDataFrame([("a", 2, 1.0), ("a", 1, 2.0), ("a", None, 4.0)], "s string, p int, v double")
    got = df.withColumn("v", series.running_total("v", ["s"], "p")).collect()
    assert {r.p: r.v for r in got} == {1: 2.0, 2: 3.0, None: 7.0}


def test_t13_bands_open_left_closed_right(spark):
    df = of(spark, [400.0, 400.5, 425.0, 425.1, 900.0, 901.0, None], "double")
    banded = df.withColumn("b", labels.band_index("x")).withColumn("v", labels.band_label("b"))
    assert values(banded) == [None, "(400,425]", "(400,425]", "(425,450]", "(875,900]", None, None]
    assert values(df.withColumn("v", labels.band_index("x", width=50))) == [None, 1, 1, 1, 10, None, None]


def test_t14_only_observed_bands(spark):
    loans = spark.createDataFrame([(410.0, 1.0), (890.0, 2.0), (0.0, 3.0), (None, 4.0), (950.0, 5.0)],
                                  "creditScore double, totalChargeOffPrincipal double")
    assert sorted(values(reports.charge_off_by_band(loans), "band")) == [1, 20]


def test_t15_ties_of_the_last_rank_stay(spark):
    df = of(spark, [5.0, 4.0, 4.0, 3.0, None], "double")
    assert sorted(values(ranking.top_with_ties(df, "x", 2), "x")) == [4.0, 4.0, 5.0]
    assert len(values(ranking.top_with_ties(df, "x", 9), "x")) == 5


def test_t16_deviation_of_one_row(spark):
    assert of(spark, [1.0], "double").agg(F.stddev_samp("x").alias("v")).first().v is None


def test_t17_name_pattern_ignores_case(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "originalLoanAmount int, AMOUNTx int, other int, ratePercentage int")
    assert columns.columns_containing(df, "amount") == ["originalLoanAmount", "AMOUNTx"]
    assert grouping.measure_columns(df) == ["originalLoanAmount", "AMOUNTx", "ratePercentage"]


def test_t18_month_run_overflows(spark):
    df = of(spark, [dt.date(2024, 5, 30)], "date")
    run = df.select(dates.monthly_dates("x", 17).alias("v")).first().v
    assert run[0] == dt.date(2024, 5, 30) and run[9] == dt.date(2025, 3, 2) and run[16] == dt.date(2025, 9, 30)
    assert df.select(dates.next_month(F.lit("2024-01-31").cast("date")).alias("v")).first().v == dt.date(2024, 2, 29)


def test_t19_division_by_zero(spark):
    assert of(spark, [0.0], "double").select(parsing.ratio(F.lit(1.0), F.col("x")).alias("v")).first().v is None


def test_t20_labels_of_text_codes(spark):
    df = of(spark, ["1", "01", "4", "9", "x", None])
    got = values(df.select(labels.code_label("x", ZERO_BALANCE, "Active").alias("v")))
    assert got == ["Prepaid or Matured", "Prepaid or Matured", "Charged-Off", None, "Active", "Active"]
    income = values(of(spark, ["2", "02", "9", None]).select(labels.text_label("x", INCOME_VERIFICATION).alias("v")))
    assert income == ["Stated, Not Verified", None, None, None]


def test_t21_status_labelled_after_and_source_before_grouping(spark):
    df = loan(spark, ("a", 1, "1", 9.0), ("b", 1, "01", 9.0))
    assert values(reports.status_composition(df), "n") == [1, 1]
    sources = of(spark, ["98", None, "3"], name="vehicleValueSourceCode").withColumn("reportingPeriodEndingDate", F.current_date())
    got = {r.vehicleValueSourceCode: r.records for r in reports.value_source_records(sources).collect()}
    assert got == {"Other": 2, VALUE_SOURCE[3]: 1}


def test_t22_no_difference_counts_as_overpaid(spark):
    schema = "remainingTermToMaturityNumber double, actualPrincipalCollectedAmount double, scheduledPrincipalAmount double, chargedoffPrincipalAmount double"
    df = spark.createDataFrame([(3.0, 5.0, 5.0, 0.0), (2.0, None, 5.0, 0.0), (1.0, 1.0, 5.0, 0.0)], schema)
    rows = reports.payments_by_remaining_term(df).collect()
    assert [(r.remainingTermToMaturity, r.payment) for r in rows] == [(3.0, "Overpaid"), (2.0, None), (1.0, "Underpaid")]


def test_t23_t24_leaf_text_survives(spark, tmp_path):
    text = "<assetData>\n <assets>\n  <assetNumber>007</assetNumber>\n  <zeroBalanceCode> 01 </zeroBalanceCode>\n </assets>\n <assets><assetNumber>8</assetNumber></assets>\n</assetData>"
    (tmp_path / "a.xml").write_text(text)
    schema = loan_records.record_schema(["assetNumber", "zeroBalanceCode"])
    for read in (loan_records.read_loan_records, loan_records.scan_loan_records):
        rows = sorted(map(tuple, read(spark, str(tmp_path), schema=schema).collect()))
        assert rows == [("007", " 01 "), ("8", None)]


@pytest.mark.parametrize(
    "heading, name",
    [("File number(s)", "file_number_s"), ("Filings URL", "filings_url"), ("Form type", "form_type"),
     ("assetNumber", "asset_number"), ("% paid", "percent_paid"), ("2nd", "x2nd"), ("", "x")],
)
def test_clean_name(heading, name):
    assert columns.clean_name(heading) == name


def test_clean_names_numbers_repeats(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, `A ` int, b int")
    assert columns.clean_names(df).columns == ["a", "a_2", "b"]


def test_number_texts(spark):
    df = of(spark, [127182426.61, 1234.5678, 0.5, -2500.0, 100000.0], "double")
    assert values(df.select(labels.significant("x").alias("v"))) == ["127,182,427", "1,234.568", "0.5", "-2,500", "100,000"]
    assert values(df.select(labels.money_label("x", suffix="k").alias("v"))) == ["$127,182k", "$1k", "$0k", "-$2k", "$100k"]


def test_paste_writes_missing_as_text(spark):
    df = spark.createDataFrame([("a", None)], "x string, y string")
    assert df.select(parsing.paste("x", "y", sep=" ").alias("v")).first().v == "a NA"


def test_undated_rows_are_no_predecessors(spark):
    df = loan(spark, ("a", 1, "1", 5.0)).unionByName(
        spark.createDataFrame([("a", None, None, 9.0)], PANEL)
    )
    flagged = {r.reportingPeriodEndingDate: r.prepaidFlagFirst for r in panel.with_prepayment_flags(df).collect()}
    assert flagged == {dt.date(2024, 1, 28): None, None: None}


def test_groups_of_one_loan_month_are_kept_apart(spark):
    """A repeated loan-month whose rows differ in brand, NULL among them."""
    rows = [("a", 1, None, 5.0, "x", 1.0), ("a", 2, "1", 4.0, "x", 2.0), ("a", 2, "1", 4.0, None, 4.0), ("a", 2, None, 4.0, "y", 8.0), ("b", 2, None, 4.0, None, 16.0)]
    schema = PANEL + ", vehicleManufacturerName string, chargedoffPrincipalAmount double"
    df = spark.createDataFrame([(a, dt.date(2024, m, 28), *rest) for a, m, *rest in rows], schema)
    got = {
        (r.reportingPeriodEndingDate.month, r.vehicleManufacturerName): (r.chargedoffPrincipalAmount, r.numberNewPrepaidLoans)
        for r in reports.monthly_measures(df, ["vehicleManufacturerName"]).collect()
    }
    assert got == {(1, "x"): (1.0, 0), (2, "x"): (2.0, 1), (2, None): (20.0, 1), (2, "y"): (8.0, 0)}
    table = reports.monthly_table(df, ["vehicleManufacturerName"])
    assert table.count() == 4 and table.agg(F.sum("chargedoffPrincipalAmount_sum")).first()[0] == 31.0


@pytest.mark.parametrize(
    "value, digits, text",
    [
        (0.0123456789, 7, "0.01234568"), (0.00174214695115508, 15, "0.00174214695115508"), (0.1, 7, "0.1"), (0.012, 7, "0.012"),
        (1.23456e-6, 4, "0.000001235"), (-0.00123, 2, "-0.0012"), (0.0, 7, "0"), (1234567.8, 7, "1,234,568"), (9.99999999e-4, 3, "0.001"),
    ],
)
def test_significant_digits_below_one(spark, value, digits, text):
    assert values(of(spark, [value], "double").select(labels.significant("x", digits).alias("v"))) == [text]


def test_loan_summary_of_repeated_months(spark):
    """The latest month decides; among its rows score and share do; a loan without dates keeps a row."""
    schema = PANEL + ", obligorCreditScore double, obligorEmploymentVerificationCode string, obligorIncomeVerificationLevelCode string, paymentToIncomePercentage double, chargedoffPrincipalAmount double"  # noqa: E501
    day = lambda m: m and dt.date(2024, m, 28)
    rows = [
        ("a", day(1), "4", 9.0, 850.0, "3", "2", 0.9, 1.0), ("a", day(2), None, 9.0, 700.0, "3", "2", 0.1, None),
        ("a", day(2), None, 9.0, 710.0, "3", "2", 0.2, 2.0), ("a", day(2), None, 9.0, 710.0, "3", "2", 0.3, 2.0),
        ("b", day(1), "1", 9.0, 600.0, "1", "1", 0.1, 1.0), ("b", day(2), "1", 9.0, None, None, None, None, 1.0),
        ("c", None, None, 9.0, 500.0, "2", None, 0.5, None),
    ]
    frame = spark.createDataFrame(rows, schema)
    got = {r.assetNumber: tuple(r)[1:] for r in reports.loan_summary(frame).collect()}
    assert got["a"] == (710.0, "3", "2", 0.3, 5.0, 0, "4")
    assert got["b"] == (None, None, None, None, 2.0, 2, "1") and got["c"] == (500.0, "2", None, 0.5, 0.0, 0, None)
    plan = reports.loan_summary(frame)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("partial_max_by") - 400 :]
    assert "HashAggregate" in below and "SortAggregate(key=[assetNumber" not in below.split("partial_max_by")[1]
