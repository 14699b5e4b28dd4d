"""From filed loan records to the clean panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.parsing import if_else, remove_text, to_day, to_number
from ..operators.grouping import measure_columns
from ..operators.series import with_prior_period
from ..schema import DATES, LOAN, PERIOD, loan_record_schema
from ..sources.filings import asset_filings, filing_day, read_filing_index
from ..sources.loan_records import file_report, leaf_names, record_schema, scan_loan_records, widen_repeated
from ..sources.restated import append_filings
from ..sources.storage import write_snapshot

ZERO_BALANCE = "zeroBalanceCode"
REMAINING = "remainingTermToMaturityNumber"


def closed_early() -> Column:
    """Paid off before term. The code is compared as text: ``01`` is not ``1``."""
    return (F.col(ZERO_BALANCE) == F.lit("1")) & (F.col(REMAINING) > 1)


def still_active() -> Column:
    return F.col(ZERO_BALANCE).isNull() & (F.col(REMAINING) > 1)


def prepaid_flag() -> Column:
    return if_else(closed_early(), F.lit(1), F.lit(0))


def typed_panel(raw: DataFrame) -> DataFrame:
    """Text panel with dates and measures typed; codes stay text, as do columns that have a type already."""
    text = {f.name for f in raw.schema.fields if isinstance(f.dataType, T.StringType)}
    dates = {c: to_day(F.col(c)) for c in DATES if c in text}
    measures = {c: to_number(F.col(c)) for c in measure_columns(raw) if c in text}
    return raw.withColumns({**dates, **measures})


def with_prepayment_flags(panel: DataFrame) -> DataFrame:
    """Add ``prepaidFlag`` and ``prepaidFlagFirst``, each 1, 0 or NULL.

    The first flag marks any loan-month closed early; the second the month of
    payoff, when the loan's previous reported month was still active.
    """
    flagged = with_prior_period(panel, still_active(), "_was_active", LOAN, PERIOD)
    payoff = (F.col(ZERO_BALANCE) == F.lit("1")) & F.col("_was_active")
    return flagged.withColumns(
        {"prepaidFlag": prepaid_flag(), "prepaidFlagFirst": if_else(payoff, F.lit(1), F.lit(0))}
    ).drop("_was_active")


def clean_panel(raw: DataFrame) -> DataFrame:
    return with_prepayment_flags(typed_panel(raw))


def accession_of(path: Column) -> Column:
    """Digits of the accession number in ``.../accession_number=<number>/...``, as text."""
    return remove_text(F.regexp_extract(path, "accession_number=([^/]+)/", 1), "-")


def unlanded_filings(spark: SparkSession, index: DataFrame, landing: str) -> DataFrame:
    """Filings of the index without a file under ``<landing>/accession_number=<number>/``; file contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(landing)
    landed = files.select(accession_of(F.col("path")).alias("_number")).distinct()
    return index.join(landed, remove_text(F.col("accession_number"), "-") == F.col("_number"), "left_anti")


def filing_report(spark: SparkSession, index: DataFrame, landing: str, row_tag: str = "assets") -> DataFrame:
    """Per filing of the index its ``records`` and ``state``: complete, cut off, without records, or missing."""
    files = file_report(spark, landing, row_tag).groupBy(accession_of(F.col("file")).alias("_number")).agg(
        F.sum("records").alias("records"), F.min("complete").alias("_complete")
    )
    state = (
        F.when(F.col("_number").isNull(), "missing").when(~F.col("_complete"), "cut off")
        .when(F.col("records") == 0, "without records").otherwise("complete")
    )
    met = index.join(files, remove_text(F.col("accession_number"), "-") == F.col("_number"), "left")
    return met.select("accession_number", F.coalesce("records", F.lit(0)).alias("records"), state.alias("state"))


def ingest_filings(
    spark: SparkSession,
    index_path: str,
    landing: str,
    base: str,
    exhibit: str,
    row_tag: str = "assets",
    schema: T.StructType | None = None,
    skip_missing: bool = False,
    form: str | Sequence[str] = "ABS-EE",
    dated: bool = False,
) -> DataFrame:
    """Text panel of all loan data files that the filing index lists, with their links, and with ``filing_date`` if ``dated``.

    Downloading is left to the user, who lands each file under
    ``<landing>/accession_number=<number>/``, the number with or without dashes. Files that the index does not list
    are left out; a listed filing without a file is an error unless ``skip_missing``. A malformed
    record stops the read; :func:`filing_report` tells files that were cut off.

    Without a ``schema`` every leaf of the files is kept: their names come from a pass of their own, known columns that no
    file has are NULL, and a leaf that repeats within a record becomes ``<leaf>_1``, ``<leaf>_2`` and so on. Write the
    result with :func:`snapshot_panel` before the panel is flagged, or the files are read again for the flags.

    Amendments are filings of a form of their own: name both as ``form`` and add the ``dated`` panel with :func:`restate_panel`, which
    lets the latest filing of a month count. A panel with both in a plain snapshot would hold the month twice.
    """
    filings = asset_filings(read_filing_index(spark, index_path), base, exhibit, form)
    if not skip_missing:
        lost = [r.accession_number for r in unlanded_filings(spark, filings, landing).limit(5).collect()]
        if lost:
            raise FileNotFoundError(f"listed filings have no file under {landing}, among them {', '.join(lost)}")
    repeated = {}
    if schema is None:
        known = loan_record_schema().names
        most = {r.leaf: r.most for r in leaf_names(spark, landing, row_tag, known).collect()}
        repeated = {leaf: n for leaf, n in sorted(most.items()) if n > 1}
        schema = record_schema([*known, *sorted(set(most) - set(known))], list(repeated))
    records = scan_loan_records(spark, landing, row_tag, schema, "_file")
    for leaf, n in repeated.items():
        records = widen_repeated(records, leaf, n)
    filed = [filing_day(F.col("filing_date")).alias("filing_date")] if dated else []
    listed = filings.select(
        "accession_number", "data_file_link", *filed, remove_text(F.col("accession_number"), "-").alias("_number")
    )
    return records.join(listed, accession_of(F.col("_file")) == F.col("_number")).drop("_file", "_number")


FILED_PERIOD = f"filed_{PERIOD}"


def snapshot_panel(raw: DataFrame, path: str) -> None:
    """Text panel to Parquet, partitioned by the reporting month as a date; the filed text stays as ``FILED_PERIOD``.

    Reports for a month then read its folder alone, and the flags read four columns again instead of the files.
    """
    write_snapshot(with_filed_period(raw), path)


def restate_panel(raw: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """The same text panel, dated, added to a snapshot of filings that may be amended; ``sources.restated.read_restated`` reads it."""
    append_filings(with_filed_period(raw), path, by)


def with_filed_period(raw: DataFrame) -> DataFrame:
    return raw.withColumns({FILED_PERIOD: F.col(PERIOD), PERIOD: to_day(F.col(PERIOD))})
