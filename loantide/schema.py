"""Columns and code tables of the loan-month panel."""

from __future__ import annotations

from pyspark.sql import types as T

LOAN = "assetNumber"
PERIOD = "reportingPeriodEndingDate"
SERIES = "series_id"

# Measure columns of the public asset-level disclosure for auto loans.
AMOUNTS = (
    "originalLoanAmount",
    "vehicleValueAmount",
    "reportingPeriodBeginningLoanBalanceAmount",
    "nextReportingPeriodPaymentAmountDue",
    "otherAssessedUncollectedServicerFeeAmount",
    "scheduledInterestAmount",
    "scheduledPrincipalAmount",
    "otherPrincipalAdjustmentAmount",
    "reportingPeriodActualEndBalanceAmount",
    "reportingPeriodScheduledPaymentAmount",
    "totalActualAmountPaid",
    "actualInterestCollectedAmount",
    "actualPrincipalCollectedAmount",
    "actualOtherCollectedAmount",
    "chargedoffPrincipalAmount",
    "recoveredAmount",
    "repossessedProceedsAmount",
)
PERCENTAGES = (
    "originalInterestRatePercentage",
    "paymentToIncomePercentage",
    "reportingPeriodInterestRatePercentage",
    "nextInterestRatePercentage",
    "servicingFeePercentage",
)
OTHER_MEASURES = ("remainingTermToMaturityNumber", "obligorCreditScore")
DATES = ("reportingPeriodBeginningDate", PERIOD, "interestPaidThroughDate")
CODES = (
    "zeroBalanceCode",
    "obligorEmploymentVerificationCode",
    "obligorIncomeVerificationLevelCode",
    "vehicleValueSourceCode",
    "vehicleManufacturerName",
    "vehicleModelName",
)

# Code tables of the same disclosure.
ZERO_BALANCE = {
    1: "Prepaid or Matured",
    2: "Third-Party Sale",
    3: "Repurchased or Replaced",
    4: "Charged-Off",
}
ZERO_BALANCE_MISSING = "Active"
VALUE_SOURCE = {1: "Invoice Price", 2: "MSRP", 3: "Kelley Blue Book", 98: "Other"}
VALUE_SOURCE_MISSING = "Other"
INCOME_VERIFICATION = {
    "2": "Stated, Not Verified",
    "3": "Stated, Verified",
    "4": "Stated, Level-4 Verified",
}

# Filing index columns as the archive's download names them.
FILING_INDEX_COLUMNS = (
    "Form type",
    "Form description",
    "Filing date",
    "Reporting date",
    "Act",
    "Film number(s)",
    "File number(s)",
    "Accession number",
    "Size",
    "Filings URL",
)


def text_schema(columns) -> T.StructType:
    """All-string schema: codes such as ``01`` must survive until they are compared."""
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def loan_record_schema() -> T.StructType:
    return text_schema((LOAN, *DATES, *AMOUNTS, *PERCENTAGES, *OTHER_MEASURES, *CODES))
