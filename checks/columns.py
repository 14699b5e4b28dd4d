"""Projections, filters, scalar functions and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from loantide.functions import dates, labels, parsing
from loantide.operators import columns as cols, grouping, series
from loantide.schema import INCOME_VERIFICATION, LOAN, PERIOD, VALUE_SOURCE, ZERO_BALANCE

from .panel import BRAND, EXACT, MEASURES, PANEL, RAW, loan_month, monthly, monthly_sql, raw_panel, table
from .registry import check, rounded

P = "reportingPeriodEndingDate"
KEY = f"assetNumber, CAST({P} AS VARCHAR) AS {P}"
AS_OF = "2000-04-30"


@check(sql="SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT'")
def p01_text_equality_filter(spark, sf):
    orders = table(spark, sf, "orders")
    return orders.where(F.col("o_orderpriority") == "1-URGENT").select("o_orderkey", "o_totalprice")


@check(
    PANEL,
    sql=f"SELECT {KEY}, vehicleValueAmount FROM loan_month WHERE {P} = DATE '{AS_OF}' AND vehicleValueSourceCode = '3'",
)
def p02_as_of_month_filter(spark, sf):
    panel = loan_month(spark, sf)
    chosen = panel.where((F.col(PERIOD) == F.lit(AS_OF).cast("date")) & (F.col("vehicleValueSourceCode") == "3"))
    return chosen.select(LOAN, PERIOD, "vehicleValueAmount")


@check(PANEL, sql=f"SELECT {KEY}, obligorCreditScore FROM loan_month WHERE obligorCreditScore > 0")
def p03_positive_score_filter(spark, sf):
    return loan_month(spark, sf).where(F.col("obligorCreditScore") > 0).select(LOAN, PERIOD, "obligorCreditScore")


@check(
    PANEL,
    sql=f"SELECT {KEY}, chargedoffPrincipalAmount FROM loan_month WHERE chargedoffPrincipalAmount IS NOT NULL",
)
def p04_not_missing_filter(spark, sf):
    panel = loan_month(spark, sf)
    return panel.where(F.col("chargedoffPrincipalAmount").isNotNull()).select(LOAN, PERIOD, "chargedoffPrincipalAmount")


@check(
    PANEL,
    sql="""SELECT vehicleManufacturerName, vehicleModelName, count(*) AS records FROM loan_month
           GROUP BY 1, 2 HAVING count(*) > 30""",
)
def p05_filter_after_aggregate(spark, sf):
    groups = loan_month(spark, sf).groupBy(BRAND, "vehicleModelName").agg(F.count(F.lit(1)).alias("records"))
    return groups.where(F.col("records") > 30)


@check(PANEL, sql=f"SELECT {KEY}, chargedoffPrincipalAmount, originalLoanAmount FROM loan_month")
def p06_projection(spark, sf):
    return loan_month(spark, sf).select(LOAN, PERIOD, "chargedoffPrincipalAmount", "originalLoanAmount")


@check(
    PANEL,
    sql=f"""SELECT {KEY}, vehicleValueAmount, originalLoanAmount, reportingPeriodActualEndBalanceAmount,
            chargedoffPrincipalAmount, actualPrincipalCollectedAmount, scheduledPrincipalAmount,
            actualInterestCollectedAmount FROM loan_month""",
)
def p07_projection_by_name_pattern(spark, sf):
    panel = loan_month(spark, sf)
    return panel.select(LOAN, PERIOD, *cols.columns_containing(panel, "AMOUNT"))


@check(sql="SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders")
def p08_projection_by_exclusion(spark, sf):
    orders = table(spark, sf, "orders")
    return orders.select(*cols.all_but(orders, "o_orderstatus", "o_orderdate"))


@check(
    PANEL,
    sql=f"""SELECT {KEY}, round(actualPrincipalCollectedAmount - scheduledPrincipalAmount, 2) + 0.0 AS diff,
            round(reportingPeriodActualEndBalanceAmount / nullif(originalLoanAmount, 0), 6) + 0.0 AS left_share
            FROM loan_month""",
)
def p09_computed_columns(spark, sf):
    panel = loan_month(spark, sf).withColumns(
        {
            "diff": F.col("actualPrincipalCollectedAmount") - F.col("scheduledPrincipalAmount"),
            "left_share": parsing.ratio(F.col("reportingPeriodActualEndBalanceAmount"), F.col("originalLoanAmount")),
        }
    )
    return rounded(rounded(panel.select(LOAN, PERIOD, "diff", "left_share"), 2, "diff"), 6, "left_share")


@check(
    RAW,
    sql="SELECT assetNumber, "
    + ", ".join(
        f"CASE WHEN isnan(TRY_CAST({m} AS DOUBLE)) THEN NULL ELSE TRY_CAST({m} AS DOUBLE) END AS {m}" for m in MEASURES
    )
    + " FROM raw_panel",
)
def p10_one_function_over_many_columns(spark, sf):
    raw = raw_panel(spark, sf)
    return raw.select(LOAN, *cols.across(MEASURES, parsing.to_number))


@check(PANEL, sql=f"SELECT {KEY}, 'Actual' AS Period FROM loan_month")
def p11_constant_tag(spark, sf):
    return loan_month(spark, sf).select(LOAN, PERIOD, F.lit("Actual").alias("Period"))


@check(
    monthly_sql(BRAND),
    sql=f"""SELECT m.vehicleManufacturerName, CAST(m.{P} AS VARCHAR) AS {P},
            round(m.originalLoanAmount / nullif(s.top, 0), 6) + 0.0 AS of_top
            FROM monthly m JOIN (SELECT vehicleManufacturerName, max(originalLoanAmount) AS top FROM monthly GROUP BY 1) s
            ON s.vehicleManufacturerName = m.vehicleManufacturerName""",
)
def p12_scalar_brought_back(spark, sf):
    months = monthly(spark, sf, BRAND)
    top = months.groupBy(BRAND).agg(F.max("originalLoanAmount").alias("top"))
    of_top = parsing.ratio(F.col("originalLoanAmount"), F.col("top")).alias("of_top")
    return rounded(months.join(top, BRAND).select(BRAND, PERIOD, of_top), 6, "of_top")


@check(
    PANEL,
    sql="""SELECT vehicleManufacturerName, round(coalesce(sum(CASE WHEN zeroBalanceCode = '4'
           THEN chargedoffPrincipalAmount END), 0), 2) + 0.0 AS charged_off FROM loan_month GROUP BY 1""",
)
def p13_aggregate_of_subset(spark, sf):
    chosen = F.when(F.col("zeroBalanceCode") == "4", F.col("chargedoffPrincipalAmount"))
    sums = loan_month(spark, sf).groupBy(BRAND).agg(grouping.total(chosen).alias("charged_off"))
    return rounded(sums, 2, "charged_off")


ACCESSION = "lpad(CAST(o_orderkey AS VARCHAR), 10, '0') || '-' || strftime(o_orderdate, '%y') || '-' || lpad(CAST(o_custkey AS VARCHAR), 6, '0')"


def accession():
    return F.concat_ws(
        "-",
        F.lpad(F.col("o_orderkey").cast("string"), 10, "0"),
        F.date_format(F.col("o_orderdate").cast("date"), "yy"),
        F.lpad(F.col("o_custkey").cast("string"), 6, "0"),
    )


@check(
    sql=f"""SELECT o_orderkey, 'https://archive.test/data/' || replace({ACCESSION}, '-', '') || '/exhibit.xml' AS link
            FROM orders""",
)
def p14_archive_link(spark, sf):
    from loantide.sources.filings import archive_link

    link = archive_link(accession(), "https://archive.test/data", "exhibit.xml")
    return table(spark, sf, "orders").select("o_orderkey", link.alias("link"))


@check(sql=f"SELECT o_orderkey, replace({ACCESSION}, '-', '') AS plain FROM orders")
def x01_remove_text(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", parsing.remove_text(accession(), "-").alias("plain"))


@check(
    PANEL,
    sql=f"""SELECT {KEY}, coalesce(vehicleManufacturerName, 'NA') || ' ' || coalesce(zeroBalanceCode, 'NA') AS pasted
            FROM loan_month""",
)
def x02_paste(spark, sf):
    pasted = parsing.paste(BRAND, "zeroBalanceCode", sep=" ").alias("pasted")
    return loan_month(spark, sf).select(LOAN, PERIOD, pasted)


@check(
    RAW,
    sql=f"""SELECT assetNumber, {P} AS filed, CAST(CAST(try_strptime({P}, '%m-%d-%Y') AS DATE) AS VARCHAR) AS ending,
            CAST(CAST(try_strptime(interestPaidThroughDate, '%m-%d-%Y') AS DATE) AS VARCHAR) AS paid FROM raw_panel""",
)
def x03_text_to_date(spark, sf):
    return raw_panel(spark, sf).select(
        LOAN, F.col(PERIOD).alias("filed"), parsing.to_day(F.col(PERIOD)).alias("ending"),
        parsing.to_day(F.col("interestPaidThroughDate")).alias("paid"),
    )


@check(
    RAW,
    sql=f"""SELECT assetNumber, {P}, CASE WHEN isnan(TRY_CAST(chargedoffPrincipalAmount AS DOUBLE)) THEN NULL
            ELSE TRY_CAST(chargedoffPrincipalAmount AS DOUBLE) END AS charged,
            TRY_CAST(remainingTermToMaturityNumber AS DOUBLE) AS term FROM raw_panel""",
)
def x04_text_to_number(spark, sf):
    return raw_panel(spark, sf).select(
        LOAN, PERIOD, parsing.to_number("chargedoffPrincipalAmount").alias("charged"),
        parsing.to_number("remainingTermToMaturityNumber").alias("term"),
    )


@check(
    PANEL,
    sql=f"""SELECT {KEY}, CASE WHEN zeroBalanceCode = '1' THEN 'paid' WHEN NOT (zeroBalanceCode = '1') THEN 'other' END
            AS state FROM loan_month""",
)
def x05_three_valued_if(spark, sf):
    state = parsing.if_else(F.col("zeroBalanceCode") == "1", F.lit("paid"), F.lit("other"))
    return loan_month(spark, sf).select(LOAN, PERIOD, state.alias("state"))


@check(
    PANEL,
    sql=f"""SELECT {KEY}, CASE WHEN zeroBalanceCode IS NULL THEN 'Active' WHEN zeroBalanceCode = '1' THEN 'Prepaid or Matured'
            WHEN zeroBalanceCode = '2' THEN 'Third-Party Sale' WHEN zeroBalanceCode = '3' THEN 'Repurchased or Replaced'
            WHEN zeroBalanceCode = '4' THEN 'Charged-Off' END AS status,
            CASE vehicleValueSourceCode WHEN '1' THEN 'Invoice Price' WHEN '2' THEN 'MSRP' WHEN '3' THEN 'Kelley Blue Book'
            ELSE 'Other' END AS source FROM loan_month""",
)
def x06_code_to_label(spark, sf):
    return loan_month(spark, sf).select(
        LOAN, PERIOD, labels.code_label("zeroBalanceCode", ZERO_BALANCE, "Active").alias("status"),
        labels.code_label("vehicleValueSourceCode", VALUE_SOURCE, "Other").alias("source"),
    )


@check(
    PANEL,
    sql=f"""SELECT {KEY}, CASE obligorIncomeVerificationLevelCode WHEN '2' THEN 'Stated, Not Verified'
            WHEN '3' THEN 'Stated, Verified' WHEN '4' THEN 'Stated, Level-4 Verified' END AS income FROM loan_month""",
)
def x07_conditions_without_default(spark, sf):
    income = labels.text_label("obligorIncomeVerificationLevelCode", INCOME_VERIFICATION)
    return loan_month(spark, sf).select(LOAN, PERIOD, income.alias("income"))


@check(
    PANEL,
    sql=f"""SELECT {KEY}, '(' || (400 + (band - 1) * 50) || ',' || (400 + band * 50) || ']' AS label, band
            FROM (SELECT *, CASE WHEN obligorCreditScore > 400 AND obligorCreditScore <= 900
                  THEN CAST(ceil((obligorCreditScore - 400) / 50) AS INTEGER) END AS band FROM loan_month)""",
)
def x08_equal_width_bands(spark, sf):
    banded = loan_month(spark, sf).withColumn("band", labels.band_index("obligorCreditScore", width=50))
    return banded.select(LOAN, PERIOD, "band", labels.band_label("band", width=50).alias("label"))


@check(PANEL, sql=f"SELECT {KEY}, zeroBalanceCode IS NULL AS no_code FROM loan_month")
def x09_missing_test(spark, sf):
    return loan_month(spark, sf).select(LOAN, PERIOD, F.col("zeroBalanceCode").isNull().alias("no_code"))


@check(
    PANEL,
    sql=f"""SELECT {KEY}, remainingTermToMaturityNumber > 0 AND zeroBalanceCode IS NULL AS active,
            NOT (zeroBalanceCode = '4') AND remainingTermToMaturityNumber < 20 AS late FROM loan_month""",
)
def x10_three_valued_logic(spark, sf):
    term, code = F.col("remainingTermToMaturityNumber"), F.col("zeroBalanceCode")
    return loan_month(spark, sf).select(
        LOAN, PERIOD, ((term > 0) & code.isNull()).alias("active"), (~(code == "4") & (term < 20)).alias("late")
    )


@check(
    PANEL,
    sql=f"""SELECT {KEY}, originalLoanAmount / nullif(obligorCreditScore, 0) AS per_point,
            paymentToIncomePercentage * 100 AS pct,
            round(pow(paymentToIncomePercentage, 2), 8) + 0.0 AS squared FROM loan_month""",
)
def x11_arithmetic(spark, sf):
    panel = loan_month(spark, sf).select(
        LOAN, PERIOD, parsing.ratio(F.col("originalLoanAmount"), F.col("obligorCreditScore")).alias("per_point"),
        (F.col("paymentToIncomePercentage") * 100).alias("pct"), F.pow("paymentToIncomePercentage", F.lit(2)).alias("squared"),
    )
    return rounded(panel, 8, "squared")


@check(
    PANEL,
    sql=f"SELECT {KEY}, round(abs(actualPrincipalCollectedAmount - scheduledPrincipalAmount), 2) AS gap FROM loan_month",
)
def x12_absolute_value(spark, sf):
    gap = F.abs(F.col("actualPrincipalCollectedAmount") - F.col("scheduledPrincipalAmount"))
    return rounded(loan_month(spark, sf).select(LOAN, PERIOD, gap.alias("gap")), 2, "gap")


@check(
    EXACT,
    sql=f"""SELECT assetNumber, CAST({P} AS VARCHAR) AS {P},
            CAST(round_even(CAST(paymentToIncomePercentage AS DOUBLE) * 50, 0) AS DOUBLE) + 0.0 AS rounded FROM loan_exact""",
)
def x13_round_half_even(spark, sf):
    value = F.bround(F.col("paymentToIncomePercentage") * 50, 0)
    return loan_month(spark, sf).select(LOAN, PERIOD, value.alias("rounded"))


@check(
    PANEL,
    sql=f"""SELECT {KEY}, format('{{:,}}', CAST(floor(originalLoanAmount) AS BIGINT)) AS whole,
            format('{{:,.2f}}', originalLoanAmount) AS cents FROM loan_month""",
)
def x14_thousands_text(spark, sf):
    return loan_month(spark, sf).select(
        LOAN, PERIOD, labels.thousands(F.floor("originalLoanAmount")).alias("whole"),
        labels.thousands("originalLoanAmount", 2).alias("cents"),
    )


@check(
    PANEL,
    sql=f"SELECT {KEY}, '$' || format('{{:,.1f}}', floor(originalLoanAmount) * 0.001) || 'k' AS label FROM loan_month",
)
def x15_money_label(spark, sf):
    label = labels.money_label(F.floor("originalLoanAmount"), suffix="k", digits=1)
    return loan_month(spark, sf).select(LOAN, PERIOD, label.alias("label"))


@check(
    PANEL,
    sql=f"""SELECT {KEY}, CAST(unnest(range(400, CAST(greatest(400, obligorCreditScore) AS INTEGER) + 1, 50)) AS INTEGER) AS edge
            FROM loan_month""",
)
def x16_numeric_sequence(spark, sf):
    """The band edges up to each loan's score."""
    upto = F.greatest(F.lit(400), F.col("obligorCreditScore").cast("int"))
    edges = F.sequence(F.lit(400), upto, F.lit(50))
    return loan_month(spark, sf).select(LOAN, PERIOD, F.explode(edges).alias("edge"))


@check(
    sql="""
SELECT o_orderkey, k, CAST(CAST(date_trunc('month', d) + to_months(CAST(k AS INTEGER)) AS DATE) + CAST(day(d) - 1 AS INTEGER) AS VARCHAR) AS month
FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(unnest(range(0, 17)) AS INTEGER) AS k FROM orders)""",
)
def x17_monthly_date_run(spark, sf):
    days = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    return days.select("o_orderkey", F.posexplode(dates.monthly_dates("d", 17)).alias("k", "month"))


@check(
    sql="""
SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + 30 AS VARCHAR) AS thirty_days,
       CAST(CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE) AS VARCHAR) AS one_month FROM orders""",
)
def x18_date_shift(spark, sf):
    day = F.col("o_orderdate").cast("date")
    return table(spark, sf, "orders").select(
        "o_orderkey", F.date_add(day, 30).alias("thirty_days"), dates.next_month(day).alias("one_month")
    )


@check(
    PANEL,
    sql="""SELECT assetNumber, chargedoffPrincipalAmount, NULL AS originalLoanAmount, 'Charge' AS kind FROM loan_month
           UNION ALL SELECT assetNumber, NULL, originalLoanAmount, 'Loan' FROM loan_month""",
)
def u01_stack_by_name(spark, sf):
    panel = loan_month(spark, sf)
    charges = panel.select(LOAN, "chargedoffPrincipalAmount", F.lit("Charge").alias("kind"))
    return cols.stack_by_name(charges, panel.select(F.lit("Loan").alias("kind"), "originalLoanAmount", LOAN))


@check(
    PANEL,
    sql=f"""SELECT {KEY}, unnest(['actualPrincipalCollectedAmount', 'actualInterestCollectedAmount']) AS name,
            unnest([actualPrincipalCollectedAmount, actualInterestCollectedAmount]) AS value FROM loan_month""",
)
def u02_wide_to_long(spark, sf):
    panel = loan_month(spark, sf).select(LOAN, PERIOD, "actualPrincipalCollectedAmount", "actualInterestCollectedAmount")
    return cols.to_long(panel, [LOAN, PERIOD])


@check(
    monthly_sql(BRAND),
    sql=f"""SELECT vehicleManufacturerName, CAST({P} AS VARCHAR) AS {P}, chargedoffPrincipalAmount,
            CAST(row_number() OVER (PARTITION BY vehicleManufacturerName ORDER BY {P}) AS INTEGER) AS t FROM monthly""",
)
def u03_series_index(spark, sf):
    months = series.with_position(monthly(spark, sf, BRAND), [BRAND], PERIOD)
    return months.select(BRAND, PERIOD, "chargedoffPrincipalAmount", "t")


