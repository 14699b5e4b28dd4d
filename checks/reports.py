"""The reports end to end, except those that read files or forecast."""

from __future__ import annotations


from loantide.plans import reports
from loantide.plans.panel import clean_panel, typed_panel

from .panel import AMOUNTS, BRAND, CLEAN, EXACT, MEASURES, PANEL, RAW, flags, loan_month, monthly, monthly_sql, raw_panel
from .registry import check, rounded, rounded_means

P = "reportingPeriodEndingDate"
MONTH = f"CAST({P} AS VARCHAR) AS {P}"
B = "vehicleManufacturerName"

LOANS = """
loans AS (
  SELECT assetNumber, arg_max_null(obligorCreditScore, reportingPeriodEndingDate) AS creditScore,
         arg_max_null(obligorEmploymentVerificationCode, reportingPeriodEndingDate) AS employmentVerification,
         arg_max_null(obligorIncomeVerificationLevelCode, reportingPeriodEndingDate) AS incomeVerification,
         arg_max_null(paymentToIncomePercentage, reportingPeriodEndingDate) AS paymentToIncome,
         coalesce(sum(chargedoffPrincipalAmount), 0) AS charged,
         CAST(coalesce(sum(CASE WHEN zeroBalanceCode = '1' AND remainingTermToMaturityNumber > 1 THEN 1 ELSE 0 END), 0)
           AS BIGINT) AS prepaid,
         max(zeroBalanceCode) AS zeroBalanceCode
  FROM loan_exact GROUP BY 1
)"""

BANDED = """
banded AS (
  SELECT *, '(' || (400 + (band - 1) * 25) || ',' || (400 + band * 25) || ']' AS creditScoreBin,
         CASE incomeVerification WHEN '2' THEN 'Stated, Not Verified' WHEN '3' THEN 'Stated, Verified'
              WHEN '4' THEN 'Stated, Level-4 Verified' END AS income
  FROM (SELECT *, CASE WHEN creditScore > 400 AND creditScore <= 900
                       THEN CAST(ceil((creditScore - 400) / 25) AS INTEGER) END AS band
        FROM loans WHERE creditScore > 0)
  WHERE band IS NOT NULL
)"""

COUNTS = """
coalesce(CAST(sum(CASE WHEN remainingTermToMaturityNumber > 0 AND zeroBalanceCode IS NULL THEN 1 END) AS BIGINT), 0) AS numberActiveLoans,
coalesce(CAST(sum(prepaidFlag) AS BIGINT), 0) AS numberPrepaidLoansTotal,
coalesce(CAST(sum(prepaidFlagFirst) AS BIGINT), 0) AS numberNewPrepaidLoans,
count(CASE WHEN zeroBalanceCode = '4' THEN 1 END) AS defaults,
count(CASE WHEN zeroBalanceCode = '1' THEN 1 END) AS prepayments"""


@check(
    CLEAN, flags("typed"),
    sql=f"""SELECT * EXCLUDE (was_active) REPLACE (CAST({P} AS VARCHAR) AS {P},
            CAST(reportingPeriodBeginningDate AS VARCHAR) AS reportingPeriodBeginningDate,
            CAST(interestPaidThroughDate AS VARCHAR) AS interestPaidThroughDate) FROM flagged""",
)
def r02_clean_panel(spark, sf):
    return clean_panel(raw_panel(spark, sf))


@check(
    EXACT, LOANS,
    sql="""SELECT assetNumber, CAST(creditScore AS DOUBLE) AS creditScore, employmentVerification, incomeVerification,
           CAST(paymentToIncome AS DOUBLE) AS paymentToIncome, CAST(charged AS DOUBLE) AS totalChargeOffPrincipal,
           prepaid, zeroBalanceCode FROM loans""",
)
def r03_loan_summary(spark, sf):
    return rounded(reports.loan_summary(loan_month(spark, sf)), 2, "totalChargeOffPrincipal")


@check(
    EXACT, LOANS, BANDED,
    sql="""SELECT band, creditScoreBin, count(*) AS n, round(CAST(sum(charged) AS DOUBLE) / count(*) + 1e-9, 4) + 0.0
           AS TotalChargeOffPrincipal FROM banded GROUP BY 1, 2""",
)
def r04_charge_off_by_credit_band(spark, sf):
    loans = reports.loan_summary(loan_month(spark, sf))
    return rounded_means(reports.charge_off_by_band(loans), 4, "TotalChargeOffPrincipal")


@check(
    EXACT, LOANS, BANDED,
    sql="""SELECT band, creditScoreBin, incomeVerification, n, TotalChargeOffPrincipal,
             CAST(y1 - n AS BIGINT) AS y0, CAST(y1 AS BIGINT) AS y1
           FROM (SELECT *, sum(n) OVER (PARTITION BY band ORDER BY incomeVerification NULLS LAST ROWS UNBOUNDED PRECEDING) AS y1
                 FROM (SELECT band, creditScoreBin, income AS incomeVerification, count(*) AS n,
                         round(CAST(sum(charged) AS DOUBLE) / count(*) + 1e-9, 4) + 0.0 AS TotalChargeOffPrincipal
                       FROM banded GROUP BY 1, 2, 3))""",
)
def r04_charge_off_by_band_and_income(spark, sf):
    loans = reports.loan_summary(loan_month(spark, sf))
    return rounded_means(reports.charge_off_by_band_and_income(loans), 4, "TotalChargeOffPrincipal")


def _mean(c: str) -> str:
    return f"CAST(sum({c}) AS DOUBLE) / nullif(count({c}), 0)"


@check(
    EXACT,
    sql=f"""SELECT CAST(term AS DOUBLE) AS remainingTermToMaturity, round(a + 1e-9, 4) + 0.0 AS actualPrincipalCollectedAmount,
            round(s + 1e-9, 4) + 0.0 AS scheduledPrincipalAmount, round(c + 1e-9, 4) + 0.0 AS totalChargeOffs, round(a - s + 1e-9, 4) + 0.0 AS diff,
            CASE WHEN a - s < 0 THEN 'Underpaid' WHEN NOT (a - s < 0) THEN 'Overpaid' END AS payment
            FROM (SELECT remainingTermToMaturityNumber AS term, {_mean("actualPrincipalCollectedAmount")} AS a,
                  {_mean("scheduledPrincipalAmount")} AS s, {_mean("chargedoffPrincipalAmount")} AS c
                  FROM loan_exact GROUP BY 1)""",
)
def r05_payments_by_remaining_term(spark, sf):
    curve = reports.payments_by_remaining_term(loan_month(spark, sf))
    return rounded_means(
        curve, 4, "actualPrincipalCollectedAmount", "scheduledPrincipalAmount", "totalChargeOffs", "diff"
    )


@check(
    EXACT, LOANS,
    sql="""SELECT CASE WHEN employmentVerification = '3' THEN 'Verified' WHEN NOT (employmentVerification = '3')
           THEN 'Not Verified' END AS employmentVerification, CAST(sum(charged) AS DOUBLE) AS total_charge_off_principal
           FROM loans GROUP BY 1""",
)
def r06_charge_off_by_employment(spark, sf):
    loans = reports.loan_summary(loan_month(spark, sf))
    return rounded(reports.charge_off_by_employment(loans), 2, "total_charge_off_principal")


@check(
    RAW,
    sql=f"""SELECT CAST(CAST(strptime({P}, '%m-%d-%Y') AS DATE) AS VARCHAR) AS {P}, code, n,
            CASE WHEN TRY_CAST(code AS DOUBLE) IS NULL THEN 'Active' WHEN CAST(code AS DOUBLE) = 1 THEN 'Prepaid or Matured'
                 WHEN CAST(code AS DOUBLE) = 2 THEN 'Third-Party Sale' WHEN CAST(code AS DOUBLE) = 3 THEN 'Repurchased or Replaced'
                 WHEN CAST(code AS DOUBLE) = 4 THEN 'Charged-Off' END AS zeroBalanceCode,
            round(n / sum(n) OVER (PARTITION BY {P}), 8) + 0.0 AS share
            FROM (SELECT strftime(strptime({P}, '%m-%d-%Y'), '%m-%d-%Y') AS {P}, zeroBalanceCode AS code, count(*) AS n
                  FROM raw_panel GROUP BY 1, 2)""",
)
def r07_status_composition(spark, sf):
    return rounded(reports.status_composition(typed_panel(raw_panel(spark, sf))), 8, "share")


MEASURE_SUMS = ", ".join(f"round(coalesce(sum({m}), 0), 2) + 0.0 AS {m}" for m in MEASURES)


@check(CLEAN, flags("typed"), sql=f"SELECT {MONTH}, {MEASURE_SUMS}, {COUNTS} FROM flagged GROUP BY {P}")
def r08_monthly_measures(spark, sf):
    """From the text panel; payoffs are found on a narrow path."""
    return rounded(reports.monthly_measures(typed_panel(raw_panel(spark, sf))), 2, *MEASURES)


@check(CLEAN, flags("typed"), sql=f"SELECT {MONTH}, {B}, {MEASURE_SUMS}, {COUNTS} FROM flagged GROUP BY {P}, {B}")
def r08_monthly_measures_by_brand(spark, sf):
    return rounded(reports.monthly_measures(typed_panel(raw_panel(spark, sf)), [BRAND]), 2, *MEASURES)


@check(PANEL, flags("loan_month"), sql=f"SELECT {MONTH}, {MEASURE_SUMS}, {COUNTS} FROM flagged GROUP BY {P}")
def r08_monthly_measures_of_flagged_panel(spark, sf):
    """From a panel that already carries both flags."""
    from loantide.plans.panel import with_prepayment_flags

    return rounded(reports.monthly_measures(with_prepayment_flags(loan_month(spark, sf))), 2, *MEASURES)


LONG_AMOUNTS = ", ".join(f"'{a}'" for a in AMOUNTS)


@check(
    monthly_sql(B),
    sql=f"""SELECT {B}, {MONTH}, unnest([{LONG_AMOUNTS}]) AS name, unnest([{", ".join(AMOUNTS)}]) AS value FROM (
            SELECT {B}, {P}, {", ".join(f"round(sum({a}) OVER w, 2) + 0.0 AS {a}" for a in AMOUNTS)}
            FROM monthly WINDOW w AS (PARTITION BY {B} ORDER BY {P} ROWS UNBOUNDED PRECEDING))""",
)
def r09_cumulative_amounts_long(spark, sf):
    return rounded(reports.cumulative_amounts_long(monthly(spark, sf, BRAND), [BRAND]), 2, "value")


@check(
    monthly_sql(),
    sql=f"""SELECT {MONTH}, chargedoffPrincipalAmount, reportingPeriodActualEndBalanceAmount, originalLoanAmount FROM monthly""",
)
def r11_balance_by_month(spark, sf):
    return reports.balance_by_month(monthly(spark, sf))


@check(
    RAW,
    sql="""SELECT value, 'Charged off to date: $' || CASE WHEN value >= 1000000
             THEN format('{:,}', CAST(round(value, 0) AS BIGINT)) ELSE regexp_replace(format('{:,.1f}', value), '\\.0$', '') END AS line
           FROM (SELECT round(sum(CASE WHEN isnan(TRY_CAST(chargedoffPrincipalAmount AS DOUBLE)) THEN 0
           ELSE TRY_CAST(chargedoffPrincipalAmount AS DOUBLE) END), 2) + 0.0 AS value FROM raw_panel)""",
)
def r12_charge_off_to_date(spark, sf):
    return rounded(reports.charge_off_to_date(raw_panel(spark, sf)), 2, "value")


@check(
    PANEL,
    sql=f"""SELECT CASE vehicleValueSourceCode WHEN '1' THEN 'Invoice Price' WHEN '2' THEN 'MSRP'
            WHEN '3' THEN 'Kelley Blue Book' ELSE 'Other' END AS vehicleValueSourceCode, count(*) AS records,
            format('{{:,}}', count(*)) AS records_text FROM loan_month WHERE {P} = DATE '2000-04-30' GROUP BY 1""",
)
def r15_records_by_value_source(spark, sf):
    return reports.value_source_records(loan_month(spark, sf), "2000-04-30")


def _dispersed(n: int) -> str:
    return f"""
SELECT {B}, vehicleModelName, records, round(stdev, 4) + 0.0 AS stdev, CAST(rank AS INTEGER) AS rank,
       {B} || ' ' || vehicleModelName AS vehicleMakeModel,
       CAST(dense_rank() OVER (ORDER BY stdev DESC NULLS LAST) AS INTEGER) AS position
FROM (SELECT *, rank() OVER (ORDER BY stdev DESC NULLS LAST) AS rank FROM (
      SELECT {B}, vehicleModelName, count(*) AS records, stddev_samp(vehicleValueAmount) AS stdev
      FROM loan_month WHERE vehicleValueSourceCode = '3' GROUP BY 1, 2 HAVING count(*) > 30))
WHERE rank <= {n}"""


@check(PANEL, sql=_dispersed(10))
def r16_top_ten_value_dispersion(spark, sf):
    """All months: one month of the test tables has too few records per make-model."""
    return rounded(reports.most_dispersed_vehicles(reports.vehicle_value_dispersion(loan_month(spark, sf)), 10), 4, "stdev")


@check(PANEL, sql=_dispersed(1))
def r16_largest_value_dispersion(spark, sf):
    return rounded(reports.most_dispersed_vehicles(reports.vehicle_value_dispersion(loan_month(spark, sf)), 1), 4, "stdev")
