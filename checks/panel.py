"""A loan-month panel made from lineitem and part, in Spark and in SQL.

A part is a loan and a shipping month its reporting month. Lines are
aggregated first, so only one row per loan-month meets ``part``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loantide.operators.columns import across
from loantide.operators.grouping import total
from loantide.schema import LOAN, PERIOD

AMOUNTS = (
    "vehicleValueAmount",
    "originalLoanAmount",
    "reportingPeriodActualEndBalanceAmount",
    "chargedoffPrincipalAmount",
    "actualPrincipalCollectedAmount",
    "scheduledPrincipalAmount",
    "actualInterestCollectedAmount",
)
MEASURES = (*AMOUNTS, "paymentToIncomePercentage", "remainingTermToMaturityNumber", "obligorCreditScore")
BRAND = "vehicleManufacturerName"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _whole(c: str, scale: int) -> Column:
    return F.rint(F.col(c) * scale).cast("long")


def _to_cents(c: Column) -> Column:
    """Hundredths of a cent to whole cents, halves up."""
    return F.call_function("div", c + 50, F.lit(100))


def _exact_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loan-months with amounts in whole cents, which add up exactly in any order.

    Flags are compared by character code: text extremes would force a sort.
    """
    price, discount, tax = _whole("l_extendedprice", 100), _whole("l_discount", 100), _whole("l_tax", 100)
    lines = table(spark, sf_dir, "lineitem")
    months = lines.groupBy("l_partkey", F.last_day(F.col("l_shipdate").cast("date")).alias("period")).agg(
        F.min(F.ascii("l_returnflag")).alias("flag_lo"),
        F.max(F.ascii("l_returnflag")).alias("flag_hi"),
        F.min("l_quantity").cast("int").alias("q_lo"),
        F.max("l_quantity").cast("int").alias("q_hi"),
        F.sum(F.col("l_quantity").cast("long")).alias("q_sum"),
        F.sum(price).alias("price"),
        F.sum(price * (100 - discount)).alias("net"),
        F.sum(price * discount).alias("cut"),
        F.sum(price * tax).alias("tax"),
    )
    parts = table(spark, sf_dir, "part").select(
        "p_partkey", "p_brand", "p_type", _whole("p_retailprice", 100).alias("retail")
    )
    p = F.col("l_partkey")
    lo, hi = F.col("q_lo"), F.col("q_hi")
    repossessed = (F.col("flag_hi") == ord("R")) & (lo >= 40)
    code = (
        F.when((F.col("flag_lo") == ord("A")) & (hi <= 12), "1").when(hi == 13, "2").when(hi == 14, "3").when(repossessed, "4")
    )
    charged = F.when(repossessed, _to_cents(F.col("cut"))).when(lo != 30, F.lit(0))
    source = F.when(p % 7 == 0, "1").when(p % 7 == 1, "2").when(p % 7 == 2, "98").when(p % 7 != 3, "3")
    return months.join(parts, F.col("p_partkey") == p).select(
        p.alias("loan_no"),
        p.cast("string").alias(LOAN),
        F.col("period").alias(PERIOD),
        code.alias("zeroBalanceCode"),
        (F.col("retail") * F.col("q_sum")).alias("vehicleValueAmount"),
        F.col("price").alias("originalLoanAmount"),
        _to_cents(F.col("net")).alias("reportingPeriodActualEndBalanceAmount"),
        charged.alias("chargedoffPrincipalAmount"),
        F.when(lo != 17, _to_cents(F.col("tax"))).alias("actualPrincipalCollectedAmount"),
        _to_cents(F.col("price") * 4).alias("scheduledPrincipalAmount"),
        _to_cents(F.col("price")).alias("actualInterestCollectedAmount"),
        (p % 20 + lo).alias("paymentToIncomePercentage"),
        F.when(lo != 25, lo - 1).alias("remainingTermToMaturityNumber"),
        F.when(p % 50 == 0, F.lit(0)).otherwise(380 + (p * 37) % 560).cast("int").alias("obligorCreditScore"),
        (1 + p % 3).cast("string").alias("obligorEmploymentVerificationCode"),
        (1 + (p + F.year("period")) % 5).cast("string").alias("obligorIncomeVerificationLevelCode"),
        source.alias("vehicleValueSourceCode"),
        F.col("p_brand").alias("vehicleManufacturerName"),
        F.col("p_type").alias("vehicleModelName"),
        lo.alias("q_lo"),
    )


# The same in SQL; ``loan_exact`` keeps decimals, ``loan_month`` has doubles.
EXACT = """
loan_lines AS (
  SELECT l_partkey, last_day(CAST(l_shipdate AS DATE)) AS period,
         min(l_returnflag) AS flag_lo, max(l_returnflag) AS flag_hi,
         CAST(min(l_quantity) AS INTEGER) AS q_lo, CAST(max(l_quantity) AS INTEGER) AS q_hi,
         CAST(sum(l_quantity) AS DECIMAL(12,0)) AS q_sum,
         sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS price,
         sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS net,
         sum(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2))) AS cut,
         sum(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_tax AS DECIMAL(4,2))) AS tax
  FROM lineitem GROUP BY 1, 2
),
loan_exact AS (
  SELECT l_partkey AS loan_no, CAST(l_partkey AS VARCHAR) AS assetNumber, period AS reportingPeriodEndingDate,
         CASE WHEN flag_lo = 'A' AND q_hi <= 12 THEN '1' WHEN q_hi = 13 THEN '2' WHEN q_hi = 14 THEN '3'
              WHEN flag_hi = 'R' AND q_lo >= 40 THEN '4' END AS zeroBalanceCode,
         CAST(CAST(p_retailprice AS DECIMAL(12,2)) * q_sum AS DECIMAL(18,2)) AS vehicleValueAmount,
         CAST(price AS DECIMAL(18,2)) AS originalLoanAmount,
         CAST(net AS DECIMAL(18,2)) AS reportingPeriodActualEndBalanceAmount,
         CASE WHEN flag_hi = 'R' AND q_lo >= 40 THEN CAST(cut AS DECIMAL(18,2))
              WHEN q_lo <> 30 THEN CAST(0 AS DECIMAL(18,2)) END AS chargedoffPrincipalAmount,
         CASE WHEN q_lo <> 17 THEN CAST(tax AS DECIMAL(18,2)) END AS actualPrincipalCollectedAmount,
         CAST(price * CAST('0.04' AS DECIMAL(4,2)) AS DECIMAL(18,2)) AS scheduledPrincipalAmount,
         CAST(price * CAST('0.01' AS DECIMAL(4,2)) AS DECIMAL(18,2)) AS actualInterestCollectedAmount,
         CAST((l_partkey % 20 + q_lo) * CAST('0.01' AS DECIMAL(4,2)) AS DECIMAL(18,2)) AS paymentToIncomePercentage,
         CASE WHEN q_lo <> 25 THEN q_lo - 1 END AS remainingTermToMaturityNumber,
         CASE WHEN l_partkey % 50 = 0 THEN 0 ELSE 380 + (l_partkey * 37) % 560 END AS obligorCreditScore,
         CAST(1 + l_partkey % 3 AS VARCHAR) AS obligorEmploymentVerificationCode,
         CAST(1 + (l_partkey + year(period)) % 5 AS VARCHAR) AS obligorIncomeVerificationLevelCode,
         CASE l_partkey % 7 WHEN 0 THEN '1' WHEN 1 THEN '2' WHEN 2 THEN '98' WHEN 3 THEN NULL ELSE '3' END
           AS vehicleValueSourceCode,
         p_brand AS vehicleManufacturerName, p_type AS vehicleModelName, q_lo
  FROM loan_lines JOIN part ON p_partkey = l_partkey
)
"""
PANEL = (
    EXACT.strip()
    + ",\nloan_month AS (SELECT assetNumber, reportingPeriodEndingDate, zeroBalanceCode,\n  "
    + ", ".join(f"CAST({m} AS DOUBLE) AS {m}" for m in MEASURES)
    + ",\n  obligorEmploymentVerificationCode, obligorIncomeVerificationLevelCode, vehicleValueSourceCode,"
    + "\n  vehicleManufacturerName, vehicleModelName FROM loan_exact)"
)


IN_CENTS = (*AMOUNTS, "paymentToIncomePercentage")


def loan_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed panel."""
    exact = _exact_month(spark, sf_dir).drop("loan_no", "q_lo")
    return exact.withColumns({m: F.col(m) / 100.0 if m in IN_CENTS else F.col(m).cast("double") for m in MEASURES})


def _cents_text(c: str) -> Column:
    return F.concat(F.call_function("div", F.col(c), F.lit(100)).cast("string"), F.lit("."), F.lpad((F.col(c) % 100).cast("string"), 2, "0"))


def _day_text(day: Column, padded: bool = True) -> Column:
    parts = [F.month(day).cast("string"), F.dayofmonth(day).cast("string")]
    return F.concat_ws("-", *[F.lpad(c, 2, "0") if padded else c for c in parts], F.year(day).cast("string"))


def raw_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel as filed: all text, with the faults that cleaning must take."""
    exact = _exact_month(spark, sf_dir)
    no, lo, period = F.col("loan_no"), F.col("q_lo"), F.col(PERIOD)
    text = {m: _cents_text(m) if m in IN_CENTS else F.col(m).cast("string") for m in MEASURES}
    charged = F.when(lo == 31, "NaN").when(lo == 32, "7d").otherwise(text["chargedoffPrincipalAmount"])
    term = F.when(lo == 33, "-").otherwise(F.concat(F.lit(" "), text["remainingTermToMaturityNumber"], F.lit(" ")))
    paid = F.when(no % 13 != 0, F.when(no % 11 == 0, "13-45-2000").otherwise(_day_text(F.date_sub(period, 5))))
    code = F.when((F.col("zeroBalanceCode") == "1") & (no % 10 == 0), "01").otherwise(F.col("zeroBalanceCode"))
    return exact.withColumns(
        {
            **text,
            "chargedoffPrincipalAmount": charged,
            "remainingTermToMaturityNumber": term,
            "zeroBalanceCode": code,
            "reportingPeriodBeginningDate": _day_text(F.trunc(period, "month")),
            "interestPaidThroughDate": paid,
            PERIOD: F.when(no % 4 == 0, _day_text(period, padded=False)).otherwise(_day_text(period)),
        }
    ).drop("loan_no", "q_lo")


RAW = (
    EXACT.strip()
    + """,
raw_panel AS (
  SELECT assetNumber,
         CASE WHEN loan_no % 4 = 0 THEN strftime(reportingPeriodEndingDate, '%-m-%-d-%Y')
              ELSE strftime(reportingPeriodEndingDate, '%m-%d-%Y') END AS reportingPeriodEndingDate,
         strftime(date_trunc('month', reportingPeriodEndingDate), '%m-%d-%Y') AS reportingPeriodBeginningDate,
         CASE WHEN loan_no % 13 = 0 THEN NULL WHEN loan_no % 11 = 0 THEN '13-45-2000'
              ELSE strftime(reportingPeriodEndingDate - INTERVAL 5 DAY, '%m-%d-%Y') END AS interestPaidThroughDate,
         CASE WHEN zeroBalanceCode = '1' AND loan_no % 10 = 0 THEN '01' ELSE zeroBalanceCode END AS zeroBalanceCode,
         CASE q_lo WHEN 31 THEN 'NaN' WHEN 32 THEN '7d' ELSE CAST(chargedoffPrincipalAmount AS VARCHAR) END
           AS chargedoffPrincipalAmount,
         CASE q_lo WHEN 33 THEN '-' ELSE ' ' || CAST(remainingTermToMaturityNumber AS VARCHAR) || ' ' END
           AS remainingTermToMaturityNumber,
         """
    + ", ".join(
        f"CAST({m} AS VARCHAR) AS {m}"
        for m in MEASURES
        if m not in ("chargedoffPrincipalAmount", "remainingTermToMaturityNumber")
    )
    + """,
         obligorEmploymentVerificationCode, obligorIncomeVerificationLevelCode, vehicleValueSourceCode,
         vehicleManufacturerName, vehicleModelName
  FROM loan_exact
)"""
)


def _number(c: str) -> str:
    return f"CASE WHEN isnan(TRY_CAST({c} AS DOUBLE)) THEN NULL ELSE TRY_CAST({c} AS DOUBLE) END"


CLEAN = (
    RAW
    + """,
typed AS (
  SELECT assetNumber, zeroBalanceCode, obligorEmploymentVerificationCode, obligorIncomeVerificationLevelCode,
         vehicleValueSourceCode, vehicleManufacturerName, vehicleModelName,
         CAST(try_strptime(reportingPeriodEndingDate, '%m-%d-%Y') AS DATE) AS reportingPeriodEndingDate,
         CAST(try_strptime(reportingPeriodBeginningDate, '%m-%d-%Y') AS DATE) AS reportingPeriodBeginningDate,
         CAST(try_strptime(interestPaidThroughDate, '%m-%d-%Y') AS DATE) AS interestPaidThroughDate,
         """
    + ", ".join(f"{_number(m)} AS {m}" for m in MEASURES)
    + """
  FROM raw_panel
)"""
)


def flags(source: str) -> str:
    """CTE ``flagged``: the source with both prepayment flags."""
    return f"""
flagged AS (
  SELECT *,
    CASE WHEN zeroBalanceCode = '1' AND remainingTermToMaturityNumber > 1 THEN 1
         WHEN NOT (zeroBalanceCode = '1' AND remainingTermToMaturityNumber > 1) THEN 0 END AS prepaidFlag,
    CASE WHEN zeroBalanceCode = '1' AND was_active THEN 1
         WHEN NOT (zeroBalanceCode = '1' AND was_active) THEN 0 END AS prepaidFlagFirst
  FROM (SELECT *, lead(zeroBalanceCode IS NULL AND remainingTermToMaturityNumber > 1)
          OVER (PARTITION BY assetNumber ORDER BY reportingPeriodEndingDate DESC) AS was_active FROM {source})
)"""


def monthly(spark: SparkSession, sf_dir: str, *by: str) -> DataFrame:
    """All measures summed per month, in exact cents."""
    sums = loan_month(spark, sf_dir).groupBy(PERIOD, *by).agg(*across(MEASURES, total))
    return sums.withColumns({m: F.round(m, 2) for m in MEASURES})


def monthly_sql(*by: str) -> str:
    """CTEs up to ``monthly``: the same."""
    keys = ", ".join(("reportingPeriodEndingDate", *by))
    sums = ", ".join(f"coalesce(CAST(sum({m}) AS DOUBLE), 0) AS {m}" for m in MEASURES)
    return f"{EXACT.strip()},\nmonthly AS (SELECT {keys}, {sums} FROM loan_exact GROUP BY {keys})"
