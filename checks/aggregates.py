"""Aggregations, windows, sorts and top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from loantide.functions import parsing
from loantide.operators import grouping, ranking, series
from loantide.plans.panel import still_active
from loantide.schema import LOAN, PERIOD

from .panel import BRAND, EXACT, MEASURES, PANEL, RAW, loan_month, monthly, monthly_sql, raw_panel
from .registry import check, rounded, rounded_means

P = "reportingPeriodEndingDate"
KEY = f"assetNumber, CAST({P} AS VARCHAR) AS {P}"
B = "vehicleManufacturerName"
MONTH = f"CAST({P} AS VARCHAR) AS {P}"


@check(PANEL, sql=f"SELECT {B}, vehicleModelName, count(*) AS n FROM loan_month GROUP BY 1, 2")
def a01_group_by_keys(spark, sf):
    return loan_month(spark, sf).groupBy(BRAND, "vehicleModelName").agg(F.count(F.lit(1)).alias("n"))


@check(
    PANEL,
    sql="""SELECT CASE WHEN obligorEmploymentVerificationCode = '3' THEN 'Verified' ELSE 'Not Verified' END AS employment,
           count(*) AS n FROM loan_month GROUP BY 1""",
)
def a02_group_by_expression(spark, sf):
    verified = F.col("obligorEmploymentVerificationCode") == "3"
    key = parsing.if_else(verified, F.lit("Verified"), F.lit("Not Verified")).alias("employment")
    return loan_month(spark, sf).groupBy(key).agg(F.count(F.lit(1)).alias("n"))


@check(monthly_sql(), sql=f"SELECT * REPLACE (CAST({P} AS VARCHAR) AS {P}) FROM monthly")
def a03_sum_of_all_measures(spark, sf):
    panel = loan_month(spark, sf)
    return rounded(grouping.sums(panel, [PERIOD], grouping.measure_columns(panel)), 2, *MEASURES)


@check(
    EXACT,
    sql=f"SELECT {MONTH}, "
    + ", ".join(
        f"coalesce(CAST(sum({m}) AS DOUBLE), 0) AS {m}_sum, round(CAST(sum({m}) AS DOUBLE) / nullif(count({m}), 0) + 1e-9, 6) + 0.0 AS {m}_mean"
        for m in MEASURES
    )
    + f" FROM loan_exact GROUP BY {P}",
)
def a04_sums_and_means(spark, sf):
    table = grouping.sums_and_means(loan_month(spark, sf), [PERIOD], MEASURES)
    return rounded_means(rounded(table, 2, *[f"{m}_sum" for m in MEASURES]), 6, *[f"{m}_mean" for m in MEASURES])


@check(PANEL, sql=f"SELECT {MONTH}, count(*) AS n FROM loan_month GROUP BY {P}")
def a05_row_count(spark, sf):
    return loan_month(spark, sf).groupBy(PERIOD).agg(F.count(F.lit(1)).alias("n"))


@check(
    PANEL,
    sql=f"""SELECT {MONTH}, count(CASE WHEN remainingTermToMaturityNumber > 0 AND zeroBalanceCode IS NULL THEN 1 END) AS active,
            count(CASE WHEN zeroBalanceCode = '4' THEN 1 END) AS defaults FROM loan_month GROUP BY {P}""",
)
def a06_conditional_count(spark, sf):
    code = F.col("zeroBalanceCode")
    return loan_month(spark, sf).groupBy(PERIOD).agg(
        F.count_if((F.col("remainingTermToMaturityNumber") > 0) & code.isNull()).alias("active"),
        F.count_if(code == "4").alias("defaults"),
    )


@check(
    EXACT,
    sql="SELECT assetNumber, coalesce(CAST(sum(chargedoffPrincipalAmount) AS DOUBLE), 0) AS charged FROM loan_exact GROUP BY 1",
)
def a07_sum_skipping_missing(spark, sf):
    sums = loan_month(spark, sf).groupBy(LOAN).agg(grouping.total("chargedoffPrincipalAmount").alias("charged"))
    return rounded(sums, 2, "charged")


@check(
    EXACT,
    sql="""SELECT remainingTermToMaturityNumber AS term, round(CAST(sum(actualPrincipalCollectedAmount) AS DOUBLE)
           / nullif(count(actualPrincipalCollectedAmount), 0) + 1e-9, 4) + 0.0 AS mean FROM loan_exact GROUP BY 1""",
)
def a08_mean_skipping_missing(spark, sf):
    groups = loan_month(spark, sf).groupBy(F.col("remainingTermToMaturityNumber").cast("int").alias("term"))
    return rounded_means(groups.agg(F.avg("actualPrincipalCollectedAmount").alias("mean")), 4, "mean")


@check(
    PANEL,
    sql=f"SELECT {B}, vehicleModelName, round(stddev_samp(vehicleValueAmount), 4) + 0.0 AS stdev FROM loan_month GROUP BY 1, 2",
)
def a09_sample_deviation(spark, sf):
    groups = loan_month(spark, sf).groupBy(BRAND, "vehicleModelName")
    return rounded(groups.agg(F.stddev_samp("vehicleValueAmount").alias("stdev")), 4, "stdev")


@check(
    PANEL,
    sql=f"""SELECT assetNumber, arg_max_null(obligorIncomeVerificationLevelCode, {P}) AS income,
            arg_max_null(zeroBalanceCode, {P}) AS code, arg_max_null(remainingTermToMaturityNumber, {P}) AS term
            FROM loan_month GROUP BY 1""",
)
def a10_latest_value(spark, sf):
    newest = {"income": "obligorIncomeVerificationLevelCode", "code": "zeroBalanceCode", "term": "remainingTermToMaturityNumber"}
    return loan_month(spark, sf).groupBy(LOAN).agg(*grouping.latest(newest, PERIOD))


@check(PANEL, sql="SELECT assetNumber, max(zeroBalanceCode) AS code FROM loan_month GROUP BY 1")
def a11_highest_code_as_text(spark, sf):
    return loan_month(spark, sf).groupBy(LOAN).agg(F.max("zeroBalanceCode").alias("code"))


@check(
    RAW,
    sql=f"""SELECT round(sum(CASE WHEN isnan(TRY_CAST(chargedoffPrincipalAmount AS DOUBLE)) THEN 0
            ELSE TRY_CAST(chargedoffPrincipalAmount AS DOUBLE) END), 2) + 0.0 AS charged,
            CAST(max(CAST(try_strptime({P}, '%m-%d-%Y') AS DATE)) AS VARCHAR) AS last_month FROM raw_panel""",
)
def a12_whole_table_aggregate(spark, sf):
    whole = raw_panel(spark, sf).agg(
        grouping.total(parsing.to_number("chargedoffPrincipalAmount")).alias("charged"),
        F.max(parsing.to_day(F.col(PERIOD))).alias("last_month"),
    )
    return rounded(whole, 2, "charged")


@check(
    EXACT,
    sql="""SELECT income, count(*) AS n, round(CAST(sum(charged) AS DOUBLE) / count(*) + 1e-9, 4) + 0.0 AS mean_charged
           FROM (SELECT assetNumber, arg_max_null(obligorIncomeVerificationLevelCode, reportingPeriodEndingDate) AS income,
                        coalesce(sum(chargedoffPrincipalAmount), 0) AS charged FROM loan_exact GROUP BY 1) GROUP BY 1""",
)
def a13_two_level_aggregate(spark, sf):
    loans = loan_month(spark, sf).groupBy(LOAN).agg(
        *grouping.latest({"income": "obligorIncomeVerificationLevelCode"}, PERIOD),
        grouping.total("chargedoffPrincipalAmount").alias("charged"),
    )
    groups = loans.groupBy("income").agg(F.count(F.lit(1)).alias("n"), F.avg("charged").alias("mean_charged"))
    return rounded_means(groups, 4, "mean_charged")


@check(
    PANEL,
    sql=f"""SELECT {KEY}, lead(zeroBalanceCode IS NULL AND remainingTermToMaturityNumber > 1)
            OVER (PARTITION BY assetNumber ORDER BY {P} DESC) AS was_active FROM loan_month""",
)
def w01_prior_month_state(spark, sf):
    panel = series.with_prior_period(loan_month(spark, sf), still_active(), "was_active")
    return panel.select(LOAN, PERIOD, "was_active")


@check(
    monthly_sql(B),
    sql=f"""SELECT {B}, {MONTH}, round(reportingPeriodActualEndBalanceAmount / nullif(lag(reportingPeriodActualEndBalanceAmount)
            OVER (PARTITION BY {B} ORDER BY {P}), 0) - 1, 8) + 0.0 AS growth FROM monthly""",
)
def w02_previous_row(spark, sf):
    balance = "reportingPeriodActualEndBalanceAmount"
    growth = parsing.ratio(F.col(balance), series.previous(balance, [BRAND], PERIOD)) - 1
    return rounded(monthly(spark, sf, BRAND).select(BRAND, PERIOD, growth.alias("growth")), 8, "growth")


@check(
    monthly_sql(B),
    sql=f"""SELECT {B}, {MONTH}, round(sum(chargedoffPrincipalAmount) OVER (PARTITION BY {B} ORDER BY {P}
            ROWS UNBOUNDED PRECEDING), 2) + 0.0 AS running FROM monthly""",
)
def w03_running_sum(spark, sf):
    running = series.running_total("chargedoffPrincipalAmount", [BRAND], PERIOD).alias("running")
    return rounded(monthly(spark, sf, BRAND).select(BRAND, PERIOD, running), 2, "running")


@check(
    monthly_sql(B),
    sql=f"SELECT {B}, {MONTH}, "
    + ", ".join(f"round(sum({m}) OVER w, 2) + 0.0 AS {m}" for m in MEASURES)
    + f" FROM monthly WINDOW w AS (PARTITION BY {B} ORDER BY {P} ROWS UNBOUNDED PRECEDING)",
)
def w04_running_sums_of_all(spark, sf):
    return rounded(series.running_totals(monthly(spark, sf, BRAND), MEASURES, [BRAND], PERIOD), 2, *MEASURES)


@check(
    EXACT,
    sql="""SELECT assetNumber, k, round(pow(1 + rate, k), 8) + 0.0 AS factor
           FROM (SELECT assetNumber, CAST(max(paymentToIncomePercentage) AS DOUBLE) AS rate, CAST(unnest(range(1, 18)) AS INTEGER) AS k
                 FROM loan_exact GROUP BY 1)""",
)
def w05_running_product(spark, sf):
    """Seventeen months at each loan's highest rate."""
    rates = loan_month(spark, sf).groupBy(LOAN).agg(F.max("paymentToIncomePercentage").alias("rate"))
    steps = rates.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(17))))
    return rounded(steps.select(LOAN, "k", series.compounded(F.col("rate"), F.col("k")).alias("factor")), 8, "factor")


@check(
    PANEL,
    sql=f"""SELECT {MONTH}, zeroBalanceCode AS code, n, round(n / sum(n) OVER (PARTITION BY {P}), 8) + 0.0 AS share
            FROM (SELECT {P}, zeroBalanceCode, count(*) AS n FROM loan_month GROUP BY 1, 2)""",
)
def w06_share_of_month(spark, sf):
    groups = loan_month(spark, sf).groupBy(PERIOD, F.col("zeroBalanceCode").alias("code")).agg(F.count(F.lit(1)).alias("n"))
    return rounded(groups.withColumn("share", series.share_within("n", [PERIOD])), 8, "share")


@check(
    PANEL,
    sql=f"""SELECT {B}, income, n, CAST(y1 - n AS BIGINT) AS y0, CAST(y1 AS BIGINT) AS y1 FROM (
            SELECT *, sum(n) OVER (PARTITION BY {B} ORDER BY income NULLS LAST ROWS UNBOUNDED PRECEDING) AS y1 FROM (
            SELECT {B}, obligorIncomeVerificationLevelCode AS income, count(*) AS n FROM loan_month GROUP BY 1, 2))""",
)
def w07_stack_offsets(spark, sf):
    income = F.col("obligorIncomeVerificationLevelCode").alias("income")
    groups = loan_month(spark, sf).groupBy(BRAND, income).agg(F.count(F.lit(1)).alias("n"))
    return series.with_stack_offsets(groups, "n", [BRAND], ["income"])


@check(
    PANEL,
    sql=f"""SELECT {B}, vehicleModelName, n, CAST(rank() OVER (PARTITION BY {B} ORDER BY n DESC) AS INTEGER) AS rank
            FROM (SELECT {B}, vehicleModelName, count(*) AS n FROM loan_month GROUP BY 1, 2)""",
)
def w08_rank_with_ties(spark, sf):
    groups = loan_month(spark, sf).groupBy(BRAND, "vehicleModelName").agg(F.count(F.lit(1)).alias("n"))
    return groups.withColumn("rank", ranking.descending_rank("n", [BRAND]))


@check(
    monthly_sql(),
    sql=f"SELECT {MONTH}, originalLoanAmount FROM monthly ORDER BY {P} NULLS LAST",
)
def l01_sorted_by_key(spark, sf):
    return monthly(spark, sf).select(PERIOD, "originalLoanAmount").orderBy(F.col(PERIOD).asc_nulls_last())


@check(
    monthly_sql(B),
    sql=f"""SELECT {B}, {MONTH}, originalLoanAmount FROM monthly
            QUALIFY row_number() OVER (PARTITION BY {B} ORDER BY {P} DESC NULLS LAST) <= 12""",
)
def l02_last_rows(spark, sf):
    months = monthly(spark, sf, BRAND).select(BRAND, PERIOD, "originalLoanAmount")
    return series.last_rows(months, 12, [BRAND], PERIOD)


@check(
    monthly_sql(B),
    sql=f"SELECT {B}, arg_max(originalLoanAmount, {P}) AS last_amount FROM monthly GROUP BY 1",
)
def l03_last_value(spark, sf):
    return monthly(spark, sf, BRAND).groupBy(BRAND).agg(series.last_value("originalLoanAmount", PERIOD).alias("last_amount"))


DISPERSION = f"""SELECT {B}, vehicleModelName, count(*) AS n, stddev_samp(vehicleValueAmount) AS stdev
                 FROM loan_month WHERE vehicleValueSourceCode = '3' GROUP BY 1, 2"""


def _dispersion(spark, sf):
    chosen = loan_month(spark, sf).where(F.col("vehicleValueSourceCode") == "3")
    return chosen.groupBy(BRAND, "vehicleModelName").agg(
        F.count(F.lit(1)).alias("n"), F.stddev_samp("vehicleValueAmount").alias("stdev")
    )


def _ranked(n):
    return f"""SELECT {B}, vehicleModelName, n, round(stdev, 4) + 0.0 AS stdev, CAST(rank AS INTEGER) AS rank FROM (
               SELECT *, rank() OVER (ORDER BY stdev DESC NULLS LAST) AS rank FROM ({DISPERSION})) WHERE rank <= {n}"""


@check(PANEL, sql=_ranked(10))
def l04_top_ten_with_ties(spark, sf):
    return rounded(ranking.top_with_ties(_dispersion(spark, sf), "stdev", 10), 4, "stdev")


@check(PANEL, sql=_ranked(1))
def l05_largest_row(spark, sf):
    return rounded(ranking.top_with_ties(_dispersion(spark, sf), "stdev", 1), 4, "stdev")


@check(
    PANEL,
    sql=f"""SELECT {B}, n, CAST(dense_rank() OVER (ORDER BY n DESC NULLS LAST) AS INTEGER) AS position
            FROM (SELECT {B}, count(*) AS n FROM loan_month GROUP BY 1)""",
)
def l06_category_order_by_measure(spark, sf):
    groups = loan_month(spark, sf).groupBy(BRAND).agg(F.count(F.lit(1)).alias("n"))
    return ranking.with_axis_position(groups, "n")


@check(
    PANEL,
    sql="""SELECT CAST(remainingTermToMaturityNumber AS INTEGER) AS term, count(*) AS n FROM loan_month
           GROUP BY 1 ORDER BY 1 DESC NULLS LAST""",
)
def l07_descending_axis(spark, sf):
    groups = loan_month(spark, sf).groupBy(F.col("remainingTermToMaturityNumber").cast("int").alias("term"))
    return groups.agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("term").desc_nulls_last())


