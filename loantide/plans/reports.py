"""Summaries of the clean panel by loan, month, credit band, term, status and vehicle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.labels import band_index, band_label, code_label, significant, text_label, thousands
from ..functions.parsing import if_else, paste, to_number
from ..operators.columns import across, columns_containing, to_long
from ..operators.grouping import latest, measure_columns, total
from ..operators.ranking import top_with_ties, with_axis_position
from ..operators.series import prior_states, running_totals, share_within, with_stack_offsets
from ..schema import (
    INCOME_VERIFICATION,
    LOAN,
    PERIOD,
    VALUE_SOURCE,
    VALUE_SOURCE_MISSING,
    ZERO_BALANCE,
    ZERO_BALANCE_MISSING,
)
from ..sources.storage import report_line
from .panel import prepaid_flag, still_active

COMPONENTS = ("actualPrincipalCollectedAmount", "actualInterestCollectedAmount", "chargedoffPrincipalAmount")


def loan_summary(panel: DataFrame) -> DataFrame:
    """One row per loan: latest borrower attributes, charge-off total, prepaid months, highest code.

    The panel is first hashed by loan and text codes with numeric aggregates only, which needs no
    sort; the few rows left per loan then meet. Rows of the latest month with the same codes are told apart by
    score, then by payment share.
    """
    slot = lambda c, scale, most: F.coalesce(F.least(F.greatest(F.col(c) * scale, F.lit(0.0)), F.lit(most)), F.lit(-1.0))
    # Whole days lead; score and share each keep to digits below, so they decide only within a day.
    rank = (
        F.coalesce(F.unix_date(PERIOD), F.lit(-40_000)) * F.lit(1e11)
        + F.floor(slot("obligorCreditScore", 1.0, 9_000.0)) * F.lit(1e7)
        + F.floor(slot("paymentToIncomePercentage", 1e4, 9e6))
    )
    codes = {
        "employmentVerification": "obligorEmploymentVerificationCode",
        "incomeVerification": "obligorIncomeVerificationLevelCode",
    }
    parts = panel.groupBy(LOAN, "zeroBalanceCode", *codes.values()).agg(
        F.max(PERIOD).alias("_period"),
        F.max_by("obligorCreditScore", rank).alias("creditScore"),
        F.max_by("paymentToIncomePercentage", rank).alias("paymentToIncome"),
        F.sum("chargedoffPrincipalAmount").alias("_charged"),
        F.sum(prepaid_flag()).alias("_prepaid"),
    )
    newest = {"creditScore": "creditScore", **codes, "paymentToIncome": "paymentToIncome"}
    return parts.groupBy(LOAN).agg(
        *latest(newest, "_period"),
        total("_charged").alias("totalChargeOffPrincipal"),
        total("_prepaid").alias("prepaid"),
        F.max("zeroBalanceCode").alias("zeroBalanceCode"),
    )


def credit_bands(loans: DataFrame, low: int = 400, high: int = 900, width: int = 25) -> DataFrame:
    """Loans with a positive score inside the bands, with band index and label."""
    return (
        loans.where(F.col("creditScore") > 0)
        .withColumn("band", band_index("creditScore", low, high, width))
        .where(F.col("band").isNotNull())
        .withColumn("creditScoreBin", band_label("band", low, width))
    )


def charge_off_by_band(loans: DataFrame, by: Sequence[str] = (), width: int = 25) -> DataFrame:
    """Loan count and mean charge-off per credit band, and per further columns."""
    return (
        credit_bands(loans, width=width)
        .groupBy("band", "creditScoreBin", *by)
        .agg(F.count(F.lit(1)).alias("n"), F.avg("totalChargeOffPrincipal").alias("TotalChargeOffPrincipal"))
    )


def charge_off_by_band_and_income(loans: DataFrame, width: int = 25) -> DataFrame:
    """The same by income verification, with the offsets of the stacked count bars."""
    labelled = loans.withColumn("incomeVerification", text_label("incomeVerification", INCOME_VERIFICATION))
    parts = charge_off_by_band(labelled, ["incomeVerification"], width)
    return with_stack_offsets(parts, "n", ["band"], ["incomeVerification"])


def payments_by_remaining_term(panel: DataFrame, labels: tuple[str, str] = ("Underpaid", "Overpaid")) -> DataFrame:
    """Mean actual and scheduled principal and charge-off per remaining term, longest term first."""
    return (
        panel.groupBy(F.col("remainingTermToMaturityNumber").alias("remainingTermToMaturity"))
        .agg(
            F.avg("actualPrincipalCollectedAmount").alias("actualPrincipalCollectedAmount"),
            F.avg("scheduledPrincipalAmount").alias("scheduledPrincipalAmount"),
            F.avg("chargedoffPrincipalAmount").alias("totalChargeOffs"),
        )
        .withColumn("diff", F.col("actualPrincipalCollectedAmount") - F.col("scheduledPrincipalAmount"))
        .withColumn("payment", if_else(F.col("diff") < 0, F.lit(labels[0]), F.lit(labels[1])))
        .orderBy(F.col("remainingTermToMaturity").desc_nulls_last())
    )


def charge_off_by_employment(loans: DataFrame, verified: str = "3") -> DataFrame:
    """Charge-off total of loans with verified and unverified employment."""
    status = if_else(F.col("employmentVerification") == F.lit(verified), F.lit("Verified"), F.lit("Not Verified"))
    return loans.groupBy(status.alias("employmentVerification")).agg(
        total("totalChargeOffPrincipal").alias("total_charge_off_principal")
    )


def status_composition(panel: DataFrame) -> DataFrame:
    """Loan-months per period and status, with the share of the period.

    Rows are grouped by the raw code and labelled afterwards, so two codes with
    one label stay two rows.
    """
    label = code_label("code", ZERO_BALANCE, ZERO_BALANCE_MISSING)
    return (
        panel.groupBy(PERIOD, F.col("zeroBalanceCode").alias("code"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("zeroBalanceCode", label)
        .withColumn("share", share_within("n", [PERIOD]))
    )


def new_prepayments(panel: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Payoffs per period, without carrying the wide panel through a shuffle by loan.

    Payoffs count for the groups of their own rows; whether the loan was active before is a
    matter of the loan, so rows of one loan-month may belong to several groups.
    """
    closed = F.count_if(F.col("zeroBalanceCode") == F.lit("1")).alias("closed")
    if not by:
        states = prior_states(panel, still_active(), "was_active", LOAN, PERIOD, closed)
    else:
        parts = panel.groupBy(LOAN, PERIOD, *by).agg(F.max(still_active()).alias("_active"), closed)
        prior = prior_states(parts, F.col("_active"), "was_active", LOAN, PERIOD).select(
            F.col(LOAN).alias("_loan"), F.col(PERIOD).alias("_month"), "was_active"
        )
        same = F.col(LOAN).eqNullSafe(F.col("_loan")) & F.col(PERIOD).eqNullSafe(F.col("_month"))
        states = parts.join(prior, same, "left")
    return states.groupBy(PERIOD, *by).agg(
        total(F.when(F.col("was_active"), F.col("closed"))).alias("new_prepaid")
    )


def monthly_totals(panel: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Every measure summed per period."""
    return panel.groupBy(PERIOD, *by).agg(*across(measure_columns(panel), total))


def loan_counts() -> list[Column]:
    return [
        F.count_if((F.col("remainingTermToMaturityNumber") > 0) & F.col("zeroBalanceCode").isNull()).alias("numberActiveLoans"),
        total(prepaid_flag()).alias("numberPrepaidLoansTotal"),
    ]


def monthly_measures(panel: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Measure sums and loan counts per period.

    On a panel that carries ``prepaidFlagFirst`` all columns come from one
    aggregate. Without it only loan, period and state are shuffled by loan to
    find the payoffs; the measures are summed where they are read.
    """
    code = F.col("zeroBalanceCode")
    ends = [F.count_if(code == F.lit("4")).alias("defaults"), F.count_if(code == F.lit("1")).alias("prepayments")]
    return with_new_prepayments(panel, [*across(measure_columns(panel), total), *loan_counts(), *ends], by)


def monthly_table(panel: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The monthly table for export: sums and means of every measure, and loan counts."""
    measures = measure_columns(panel)
    values = [*across(measures, total, "{col}_sum"), *across(measures, F.avg, "{col}_mean")]
    return with_new_prepayments(panel, [*values, *loan_counts()], by)


def with_new_prepayments(panel: DataFrame, aggregates: Sequence[Column], by: Sequence[str] = ()) -> DataFrame:
    """Aggregates per period together with the payoffs of the period."""
    keys = [PERIOD, *by]
    if "prepaidFlagFirst" in panel.columns:
        first = total("prepaidFlagFirst").alias("numberNewPrepaidLoans")
        return panel.groupBy(*keys).agg(*aggregates, first)
    base = panel.groupBy(*keys).agg(*aggregates)
    payoffs = new_prepayments(panel, by).select(
        *[F.col(k).alias(f"_{k}") for k in keys], F.col("new_prepaid").alias("numberNewPrepaidLoans")
    )
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    met = base.join(payoffs, same, "left").drop(*[f"_{k}" for k in keys])
    return met.withColumn("numberNewPrepaidLoans", F.coalesce("numberNewPrepaidLoans", F.lit(0)))


def cumulative_measures(months: DataFrame, series: Sequence[str] = ()) -> DataFrame:
    """Running sum of every measure, over a table of one row per period."""
    return running_totals(months, measure_columns(months), series, PERIOD)


def cumulative_amounts_long(months: DataFrame, series: Sequence[str] = ()) -> DataFrame:
    """Running sums of the amounts in long form."""
    running = cumulative_measures(months, series)
    return to_long(running, [*series, PERIOD], columns_containing(running, "amount"))


def principal_interest_charge_off(months: DataFrame, series: Sequence[str] = ()) -> DataFrame:
    """The three collection series in long form."""
    return to_long(months.select(*series, PERIOD, *COMPONENTS), [*series, PERIOD])


def balance_by_month(months: DataFrame) -> DataFrame:
    """Original against outstanding balance."""
    return months.select(
        PERIOD, "chargedoffPrincipalAmount", "reportingPeriodActualEndBalanceAmount", "originalLoanAmount"
    )


def charge_off_to_date(raw: DataFrame, text: str = "Charged off to date: $") -> DataFrame:
    """Charge-off total of the text panel as value and, in whole cents, as report line beginning with ``text``."""
    value = raw.agg(total(to_number(F.col("chargedoffPrincipalAmount"))).alias("value"))
    return value.withColumn("line", report_line(text, significant(F.round("value", 2))))


def value_source_records(panel: DataFrame, as_of=None) -> DataFrame:
    """Loans per source of vehicle value in one month; ``98`` and missing are one source.

    Codes are counted before they are labelled, so the label is worked out once
    per code and not once per loan.
    """
    chosen = panel if as_of is None else panel.where(F.col(PERIOD) == F.lit(as_of).cast("date"))
    codes = chosen.groupBy("vehicleValueSourceCode").agg(F.count(F.lit(1)).alias("n"))
    label = code_label("vehicleValueSourceCode", VALUE_SOURCE, VALUE_SOURCE_MISSING)
    return (
        codes.groupBy(label.alias("vehicleValueSourceCode"))
        .agg(F.sum("n").alias("records"))
        .withColumn("records_text", thousands("records"))
    )


def vehicle_value_dispersion(panel: DataFrame, as_of=None, source: str = "3", more_than: int = 30) -> DataFrame:
    """Standard deviation of vehicle value per make and model with enough records."""
    chosen = panel.where(F.col("vehicleValueSourceCode") == F.lit(source))
    if as_of is not None:
        chosen = chosen.where(F.col(PERIOD) == F.lit(as_of).cast("date"))
    return (
        chosen.groupBy("vehicleManufacturerName", "vehicleModelName")
        .agg(F.count(F.lit(1)).alias("records"), F.stddev_samp("vehicleValueAmount").alias("stdev"))
        .where(F.col("records") > more_than)
    )


def most_dispersed_vehicles(dispersion: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` most dispersed make-models with ties, labelled and placed on the axis."""
    top = top_with_ties(dispersion, "stdev", n)
    named = top.withColumn("vehicleMakeModel", paste("vehicleManufacturerName", "vehicleModelName", sep=" "))
    return with_axis_position(named, "stdev")
