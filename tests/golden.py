"""Published monthly table of one deal.

Fixed values: month end, outstanding balance, charged-off principal, mean
recovery, mean repossession proceeds (None where missing).
"""

MONTHS = (
    ("2022-10-31", 572052770.730005, 112861.55, None, None),
    ("2022-11-30", 686505911.280013, 43402.17, 3365.0, 3365.0),
    ("2022-12-31", 677584679.389996, 62748.79, 11743.125, 11743.125),
    ("2023-01-31", 668106553.849999, 327184.25, 12066.8875, None),
    ("2023-02-28", 654687274.100004, 2874111.84, 11090.1055737705, 1464.0),
    ("2023-03-31", 631043983.480003, 11296294.75, 9101.38593333333, 4646.0),
    ("2023-04-30", 610156857.849999, 10366252.26, 5509.02492929293, 17744.0),
    ("2023-05-31", 590197067.700004, 9004053.84, 5025.61757664234, 7576.23333333333),
    ("2023-06-30", 570372267.02, 8725133.63000001, 4734.89038011696, 6938.538),
    ("2023-07-31", 552343074.929998, 8026480.85, 3885.21558171745, 4923.0),
    ("2023-08-31", 534251819.410001, 7928227.04, 3870.34166253102, 4661.6025),
    ("2023-09-30", 517899905.609998, 8180567.15, 3935.06422972973, 1769.84),
    ("2023-10-31", 500152143.109999, 9085812.79000001, 3467.94407730673, 6764.48),
    ("2023-11-30", 483070760.579999, 9513521.35, 3513.82554069119, 4038.5),
    ("2023-12-31", 467072843.120001, 8392220.41999999, 3174.08103979461, 7087.5),
    ("2024-01-31", 450709627.210002, 9777817.70999999, 2931.46343183985, 7144.30333333333),
    ("2024-02-29", 435015701.299998, 8482050.26, 3170.03964803313, 4411.66666666667),
    ("2024-03-31", 419622936.360002, 7790764.11, 3175.44565858799, 696.305),
    ("2024-04-30", 405215242.750001, 7192921.85, 3165.26246406571, 2306.125),
)

# Results published for, or computed from, the table above.
GROWTH = -0.033532039955474414
CHARGE_OFF_RATE = 0.017421469511550776
TOTAL_MONTH_19 = 127182426.61
TOTAL_MONTH_36 = 216709056.1961453
BALANCE_MONTH_36 = 226919914.58401272
LAST_MONTH = "2025-09-30"
GROWTH_LINE = "Average Change in Outstanding Balance Amount (P12M): -3.35%"
SHARE_LINE = "Charge-Offs as a % of Outstanding Balance Amount (P12M): 1.74%"
TOTAL_LINE = "Cumulative Value 09/30/2025: $216,709,056"
LINE_TEXTS = {
    "growth_text": "Average Change in Outstanding Balance Amount (P12M): ",
    "share_text": "Charge-Offs as a % of Outstanding Balance Amount (P12M): ",
    "total_text": "Cumulative Value ",
}
RATE_LINE = "Charge Offs - % of Total Outstanding Balance Amount (P12M): 1.74214695115508%"


def table(spark):
    rows = [(d, b, c, r, p) for d, b, c, r, p in MONTHS]
    schema = (
        "day string, reportingPeriodActualEndBalanceAmount double, chargedoffPrincipalAmount double, "
        "recoveredAmount_mean double, repossessedProceedsAmount_mean double"
    )
    df = spark.createDataFrame(rows, schema)
    return df.selectExpr("cast(day as date) as reportingPeriodEndingDate", *df.columns[1:])
