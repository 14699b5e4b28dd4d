"""Readers and writers, on files that Spark writes from the tables to the shared folder."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from loantide.forecast.run_rate import balance_ratios, trailing_rates
from loantide.functions.dates import monthly_date, next_month
from loantide.functions.parsing import to_day
from loantide.operators.columns import clean_names
from loantide.plans.panel import FILED_PERIOD, ingest_filings, restate_panel, snapshot_panel, typed_panel
from loantide.plans.reports import monthly_table, value_source_records
from loantide.schema import FILING_INDEX_COLUMNS, LOAN, PERIOD
from loantide.session import new_path
from loantide.sources import filings, loan_records, restated as restated_reader, storage

from .columns import ACCESSION, accession
from .forecasts import RUN_RATE, TYPE
from .panel import CLEAN, MEASURES, PANEL, RAW, flags, loan_month, monthly, monthly_sql, raw_panel, table
from .registry import check, rounded, rounded_means

P = "reportingPeriodEndingDate"
DESCRIPTION = "Loan data [parts A, B]"
LEAVES = (LOAN, PERIOD, "zeroBalanceCode", "chargedoffPrincipalAmount", "remainingTermToMaturityNumber", "vehicleModelName")
LEAF_SQL = ", ".join(LEAVES)
BASE, EXHIBIT = "https://archive.test/data", "exhibit_102.xml"


def write_index(spark, sf) -> str:
    """Orders as a filing index CSV with the archive's headings."""
    path, day = new_path(spark, "index"), F.col("o_orderdate").cast("date")
    form = F.when(F.col("o_orderpriority") == "1-URGENT", "ABS-EE").when(F.col("o_orderpriority") == "2-HIGH", "10-D").otherwise("8-K")
    values = (
        form, F.lit(DESCRIPTION), F.date_format(F.date_add(day, 29), "M/d/yyyy"), F.date_format(day, "M/d/yyyy"),
        F.lit("34"), F.col("o_custkey").cast("string"), F.lit(None).cast("string"), accession(),
        F.floor(F.col("o_totalprice")).cast("string"), F.concat(F.lit(f"{BASE}/"), accession(), F.lit("-index.htm")),
    )
    index = table(spark, sf, "orders").select(*[v.alias(c) for v, c in zip(values, FILING_INDEX_COLUMNS)])
    index.write.option("header", True).csv(path)
    return path


FORM_SQL = "CASE o_orderpriority WHEN '1-URGENT' THEN 'ABS-EE' WHEN '2-HIGH' THEN '10-D' ELSE '8-K' END"
INDEX_SQL = f"""
filing_index AS (
  SELECT {FORM_SQL} AS form_type, '{DESCRIPTION}' AS form_description,
         strftime(CAST(o_orderdate AS DATE) + 29, '%-m/%-d/%Y') AS filing_date, strftime(o_orderdate, '%-m/%-d/%Y') AS reporting_date,
         '34' AS act, CAST(o_custkey AS VARCHAR) AS film_number_s, CAST(NULL AS VARCHAR) AS file_number_s,
         {ACCESSION} AS accession_number, CAST(floor(o_totalprice) AS BIGINT) AS size,
         '{BASE}/' || {ACCESSION} || '-index.htm' AS filings_url
  FROM orders
)"""


@check(INDEX_SQL, sql="SELECT * FROM filing_index")
def s01_filing_index_scan(spark, sf):
    return filings.read_filing_index(spark, write_index(spark, sf))


@check(
    INDEX_SQL,
    sql="SELECT form_type, film_number_s, file_number_s, accession_number, CAST(size AS VARCHAR) AS size FROM filing_index",
)
def s02_column_name_cleaning(spark, sf):
    raw = spark.read.csv(write_index(spark, sf), header=True)
    return clean_names(raw).select("form_type", "film_number_s", "file_number_s", "accession_number", "size")


@check(RAW, sql=f"SELECT {LEAF_SQL} FROM raw_panel")
def s03_xml_record_scan(spark, sf):
    path = new_path(spark, "records")
    loan_records.write_loan_records(raw_panel(spark, sf).select(*LEAVES), path)
    return loan_records.read_loan_records(spark, path, schema=loan_records.record_schema(LEAVES))


@check(RAW, sql=f"SELECT {LEAF_SQL} FROM raw_panel")
def s03_xml_scan_of_split_files(spark, sf):
    path = new_path(spark, "records")
    loan_records.write_loan_records(raw_panel(spark, sf).select(*LEAVES), path, file_records=0)
    return loan_records.scan_loan_records(spark, path, schema=loan_records.record_schema(LEAVES))


@check(RAW, sql=f"SELECT {LEAF_SQL} FROM raw_panel")
def s04_record_text_widened_to_columns(spark, sf):
    text = F.to_xml(F.struct(*LEAVES), {"rowTag": "assets"})
    held = raw_panel(spark, sf).select(text.alias("record"))
    return loan_records.parse_loan_records(held, "record", loan_records.record_schema(LEAVES))


def _repeated_leaf(spark, sf):
    """Records whose ``code`` leaf occurs once or twice, parsed back from XML text."""
    once, twice = F.col("obligorEmploymentVerificationCode"), F.col("obligorIncomeVerificationLevelCode")
    codes = F.when(F.col("zeroBalanceCode").isNull(), F.array(once)).otherwise(F.array(once, twice))
    text = F.to_xml(F.struct(F.col(LOAN), F.col(PERIOD), codes.alias("code")), {"rowTag": "assets"})
    schema = loan_records.record_schema((LOAN, PERIOD, "code"), repeated=("code",))
    return loan_records.parse_loan_records(raw_panel(spark, sf).select(text.alias("record")), "record", schema)


@check(
    RAW,
    sql=f"""SELECT assetNumber, {P}, obligorEmploymentVerificationCode AS code_1,
            CASE WHEN zeroBalanceCode IS NOT NULL THEN obligorIncomeVerificationLevelCode END AS code_2 FROM raw_panel""",
)
def s04_repeated_leaf_widened(spark, sf):
    return loan_records.widen_repeated(_repeated_leaf(spark, sf), "code", 2)


@check(
    RAW,
    sql=f"""SELECT assetNumber, {P}, obligorEmploymentVerificationCode AS code FROM raw_panel
            UNION ALL SELECT assetNumber, {P}, obligorIncomeVerificationLevelCode FROM raw_panel WHERE zeroBalanceCode IS NOT NULL""",
)
def s05_list_columns_flattened(spark, sf):
    return loan_records.flatten_lists(_repeated_leaf(spark, sf), ["code"])


@check(
    RAW,
    sql=f"""SELECT assetNumber, {P}, zeroBalanceCode, chargedoffPrincipalAmount, remainingTermToMaturityNumber,
            CASE WHEN zeroBalanceCode IS NULL THEN vehicleModelName END AS vehicleModelName FROM raw_panel""",
)
def s06_files_of_different_leaves_in_one_scan(spark, sf):
    """Two folders, one of them without the model leaf, read together."""
    raw, closed = raw_panel(spark, sf).select(*LEAVES), F.col("zeroBalanceCode").isNotNull()
    paths = [new_path(spark, "filing-a"), new_path(spark, "filing-b")]
    loan_records.write_loan_records(raw.where(~closed), paths[0])
    loan_records.write_loan_records(raw.where(closed).drop("vehicleModelName"), paths[1])
    return loan_records.read_loan_records(spark, paths, schema=loan_records.record_schema(LEAVES))


@check(PANEL, sql=f"SELECT * REPLACE (CAST({P} AS VARCHAR) AS {P}) FROM loan_month")
def s07_snapshot_round_trip(spark, sf):
    path = new_path(spark, "snapshot")
    storage.write_snapshot(loan_month(spark, sf), path)
    return storage.read_snapshot(spark, path)


MONTHLY_TABLE = ", ".join(
    f"round(coalesce(sum({m}), 0), 2) + 0.0 AS {m}_sum, round(avg({m}) + 1e-9, 4) + 0.0 AS {m}_mean" for m in MEASURES
)


@check(
    PANEL, flags("loan_month"),
    sql=f"""SELECT CAST({P} AS VARCHAR) AS {P}, {MONTHLY_TABLE},
            count(CASE WHEN remainingTermToMaturityNumber > 0 AND zeroBalanceCode IS NULL THEN 1 END) AS numberActiveLoans,
            coalesce(CAST(sum(prepaidFlagFirst) AS BIGINT), 0) AS numberNewPrepaidLoans,
            coalesce(CAST(sum(prepaidFlag) AS BIGINT), 0) AS numberPrepaidLoansTotal FROM flagged GROUP BY {P}""",
)
def s08_monthly_table_export(spark, sf):
    months = monthly_table(loan_month(spark, sf))
    path = new_path(spark, "export")
    storage.export_table(months, path)
    back = storage.read_table(spark, path, months.schema)
    back = rounded_means(back, 4, *[f"{m}_mean" for m in MEASURES])
    return rounded(back, 2, *[f"{m}_sum" for m in MEASURES])


@check(
    PANEL,
    sql=f"""SELECT CAST({P} AS VARCHAR) AS {P}, zeroBalanceCode, count(*) AS n, CASE WHEN zeroBalanceCode = '4' THEN
            round(sum(chargedoffPrincipalAmount), 2) + 0.0 END AS charged FROM loan_month GROUP BY {P}, zeroBalanceCode""",
)
def s08_export_with_missing_values(spark, sf):
    code = F.col("zeroBalanceCode")
    charged = F.when(code == "4", F.round(F.sum("chargedoffPrincipalAmount"), 2)).alias("charged")
    groups = loan_month(spark, sf).groupBy(PERIOD, code).agg(F.count(F.lit(1)).alias("n"), charged)
    path = new_path(spark, "export")
    storage.export_table(groups, path)
    return storage.read_table(spark, path, groups.schema)


@check(
    monthly_sql(TYPE), RUN_RATE,
    sql=f"""SELECT {TYPE}, 'Growth a month: '
            || regexp_replace(regexp_replace(format('{{:.2f}}', round(g * 100, 2) + 0.0), '0+$', ''), '\\.$', '') || '%' AS line FROM rates""",
)
def s09_report_line(spark, sf):
    rates = trailing_rates(balance_ratios(monthly(spark, sf, TYPE), [TYPE]), [TYPE])
    value = storage.plain_number(F.round(F.col("growth_rate") * 100, 2))
    line = storage.report_line("Growth a month: ", value, "%")
    return rates.select(TYPE, line.alias("line"))


@check(
    monthly_sql(TYPE), RUN_RATE,
    sql=f"""SELECT {TYPE}, CAST(CAST(date_trunc('month', start) + to_months(CAST(k - 1 AS INTEGER)) AS DATE)
            + CAST(day(start) - 1 AS INTEGER) AS VARCHAR) AS {P}, CAST(k AS INTEGER) AS step, 'Forecast' AS Period
            FROM rates CROSS JOIN (SELECT unnest(range(1, 18)) AS k)""",
)
def s10_table_from_sequences(spark, sf):
    ends = monthly(spark, sf, TYPE).groupBy(TYPE).agg(next_month(F.max(PERIOD)).alias("start"))
    steps = ends.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(17))))
    return steps.select(
        TYPE, monthly_date("start", F.col("step") - 1).alias(PERIOD), "step", F.lit("Forecast").alias("Period")
    )


def filing_number(period):
    return F.concat(F.lit("0000012345-"), F.date_format(period, "yy"), F.lit("-"), F.date_format(period, "MMdd"), F.lit("01"))


@check(
    RAW,
    f"""filed AS (SELECT *, strptime({P}, '%m-%d-%Y') AS day FROM raw_panel)""",
    sql=f"""SELECT assetNumber, {P}, zeroBalanceCode, chargedoffPrincipalAmount, vehicleModelName,
            '0000012345-' || strftime(day, '%y-%m%d') || '01' AS accession_number,
            '{BASE}/0000012345' || strftime(day, '%y%m%d') || '01/{EXHIBIT}' AS data_file_link FROM filed""",
)
def r01_ingest_filings(spark, sf):
    """Index and landed files with one loan data filing per month, next to one report of another form."""
    raw = raw_panel(spark, sf)
    period = to_day(F.col(PERIOD))
    days = raw.select(PERIOD).distinct().select(period.alias("day")).distinct()
    filed = days.withColumn("form", F.explode(F.array(F.lit("ABS-EE"), F.lit("10-D"))))
    number, blank = filing_number(F.col("day")), F.lit(None).cast("string")
    known = {
        "Form type": F.col("form"),
        "Reporting date": F.date_format("day", "M/d/yyyy"),
        "Accession number": F.when(F.col("form") == "ABS-EE", number).otherwise(F.concat(number, F.lit("X"))),
    }
    index, landing, snapshot = (new_path(spark, n) for n in ("index", "landing", "snapshot"))
    filed.select(*[known.get(c, blank).alias(c) for c in FILING_INDEX_COLUMNS]).write.option("header", True).csv(index)
    # The number behind the exchange: before it, one generated method would hold it and all texts, too long to be compiled.
    landed = raw.hint("rebalance", F.col(PERIOD)).withColumn("accession_number", filing_number(period))
    loan_records.write_loan_records(landed, landing, partition_by=["accession_number"], compression="gzip")
    snapshot_panel(ingest_filings(spark, index, landing, BASE, EXHIBIT), snapshot)
    return storage.read_snapshot(spark, snapshot).select(
        LOAN, F.col(FILED_PERIOD).alias(PERIOD), "zeroBalanceCode", "chargedoffPrincipalAmount", "vehicleModelName",
        "accession_number", "data_file_link",
    )


@check(
    RAW,
    f"""filed AS (SELECT *, strptime({P}, '%m-%d-%Y') AS day FROM raw_panel)""",
    sql=f"""SELECT assetNumber, {P}, vehicleModelName, paymentToIncomePercentage AS riskNote,
            obligorEmploymentVerificationCode AS code_1,
            CASE WHEN zeroBalanceCode IS NOT NULL THEN obligorIncomeVerificationLevelCode END AS code_2,
            '0000012345-' || strftime(day, '%y-%m%d') || '01' AS accession_number FROM filed""",
)
def r01_ingest_filings_with_further_leaves(spark, sf):
    """Leaves outside the known ones, one of them repeated, and folders named without dashes."""
    raw = raw_panel(spark, sf)
    period = to_day(F.col(PERIOD))
    blank, number = F.lit(None).cast("string"), filing_number(F.col("day"))
    known = {"Form type": F.lit("ABS-EE"), "Accession number": number}
    index, landing, snapshot = (new_path(spark, n) for n in ("index", "landing", "snapshot"))
    days = raw.select(period.alias("day")).distinct()
    days.select(*[known.get(c, blank).alias(c) for c in FILING_INDEX_COLUMNS]).write.option("header", True).csv(index)
    once, twice = F.col("obligorEmploymentVerificationCode"), F.col("obligorIncomeVerificationLevelCode")
    codes = F.when(F.col("zeroBalanceCode").isNull(), F.array(once)).otherwise(F.array(once, twice))
    folder = F.replace(filing_number(period), F.lit("-"), F.lit(""))
    landed = raw.select(
        LOAN, PERIOD, "vehicleModelName", F.col("paymentToIncomePercentage").alias("riskNote"), codes.alias("code"),
        folder.alias("accession_number"),
    )
    loan_records.write_loan_records(landed.hint("rebalance", F.col("accession_number")), landing, partition_by=["accession_number"])
    snapshot_panel(ingest_filings(spark, index, landing, BASE, EXHIBIT), snapshot)
    return storage.read_snapshot(spark, snapshot).select(
        LOAN, F.col(FILED_PERIOD).alias(PERIOD), "vehicleModelName", "riskNote", "code_1", "code_2", "accession_number"
    )


def filed_batches(spark, sf):
    """Each month filed 20 days after its end. Every third is amended 30 days later: doubled charge-offs, closed loans left out."""
    raw = raw_panel(spark, sf).select(LOAN, PERIOD, "zeroBalanceCode", "chargedoffPrincipalAmount")
    day = to_day(F.col(PERIOD))
    first = raw.withColumns({"accession_number": filing_number(day), "filing_date": F.date_add(day, 20)})
    amended = raw.where(F.col("zeroBalanceCode").isNull() & (F.month(day) % 3 == 0)).withColumns({
        "accession_number": F.concat(filing_number(day), F.lit("A")),
        "filing_date": F.date_add(day, 50),
        "chargedoffPrincipalAmount": F.concat(F.lit("2*"), F.col("chargedoffPrincipalAmount")),
    })
    return first, amended


def restated(spark, sf):
    """Three batches: the amendments first, then every filing, then the first filings once more."""
    first, amended = filed_batches(spark, sf)
    path = new_path(spark, "restated")
    for batch in (amended, first.unionByName(amended), first):
        restate_panel(batch, path)
    return path


RESTATED = f"""numbered AS (
  SELECT assetNumber, {P} AS filed_{P}, CAST(strptime({P}, '%m-%d-%Y') AS DATE) AS day, zeroBalanceCode, chargedoffPrincipalAmount FROM raw_panel
),
restated AS (
  SELECT assetNumber, filed_{P}, day, zeroBalanceCode, '2*' || chargedoffPrincipalAmount AS chargedoffPrincipalAmount, day + 50 AS filed, 'A' AS mark
  FROM numbered WHERE zeroBalanceCode IS NULL AND month(day) % 3 = 0
),
months AS (SELECT DISTINCT day FROM restated)"""
RESTATED_ROWS = f"SELECT assetNumber, filed_{P}, zeroBalanceCode, chargedoffPrincipalAmount, CAST(day AS VARCHAR) AS {P}, CAST(CAST(filed AS DATE) AS VARCHAR) AS filing_date"
NUMBER = "'0000012345-' || strftime(day, '%y-%m%d') || '01' || mark AS accession_number"


@check(
    RAW, RESTATED,
    sql=f"""{RESTATED_ROWS}, {NUMBER} FROM (SELECT * FROM restated UNION ALL
            SELECT *, day + 20 AS filed, '' AS mark FROM numbered WHERE day NOT IN (SELECT day FROM months))""",
)
def r01_restated_filings(spark, sf):
    """The latest filing of a month counts, in whatever order and however often batches arrive."""
    return restated_reader.read_restated(spark, restated(spark, sf))


@check(
    RAW, RESTATED,
    sql=f"""{RESTATED_ROWS}, {NUMBER} FROM (
            SELECT * FROM restated WHERE filed <= DATE '1996-01-15' UNION ALL
            SELECT *, day + 20 AS filed, '' AS mark FROM numbered
            WHERE day + 20 <= DATE '1996-01-15' AND day NOT IN (SELECT day FROM months WHERE day + 50 <= DATE '1996-01-15'))""",
)
def r01_restated_filings_as_of(spark, sf):
    """The panel as it stood on a day on which the last amendment had not been filed."""
    return restated_reader.read_restated(spark, restated(spark, sf), as_of=date(1996, 1, 15))


@check(
    CLEAN,
    sql=f"""SELECT CASE vehicleValueSourceCode WHEN '1' THEN 'Invoice Price' WHEN '2' THEN 'MSRP'
            WHEN '3' THEN 'Kelley Blue Book' ELSE 'Other' END AS vehicleValueSourceCode, count(*) AS records,
            format('{{:,}}', count(*)) AS records_text FROM typed WHERE {P} = DATE '2000-04-30' GROUP BY 1""",
)
def r15_records_by_value_source_of_snapshot(spark, sf):
    """From the text snapshot; only the month's folder is read."""
    path = new_path(spark, "snapshot")
    snapshot_panel(raw_panel(spark, sf), path)
    return value_source_records(typed_panel(storage.read_snapshot(spark, path)), "2000-04-30")
