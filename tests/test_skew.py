"""A third of all rows under one key, copies of one row, missing keys: right results and bounded tasks."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from loantide.operators import series
from loantide.plans import panel, reports
from loantide.schema import LOAN, PERIOD
from loantide.session import new_path
from loantide.sources import loan_records, storage

HOT, MONTHS = 4000, 24


@pytest.fixture(scope="module")
def skewed(spark):
    """Ordinary loans, one loan whose months repeat many times, and rows without a loan number."""
    base = spark.range(200).select(F.concat(F.lit("L"), "id").alias(LOAN), F.explode(F.sequence(F.lit(0), F.lit(MONTHS - 1))).alias("m"))
    hot = spark.range(HOT).select(F.lit("HOT").alias(LOAN), (F.col("id") % MONTHS).cast("int").alias("m"))
    missing = spark.range(500).select(F.lit(None).cast("string").alias(LOAN), (F.col("id") % MONTHS).cast("int").alias("m"))
    number = F.coalesce(F.substring(LOAN, 2, 9).try_cast("int"), F.lit(0))
    closes = F.when(F.col("m") >= 10 + number % 20, "1")
    return (
        base.unionByName(hot).unionByName(missing)
        .withColumn(PERIOD, F.last_day(F.add_months(F.lit(dt.date(2020, 1, 31)), F.col("m"))))
        .withColumn("zeroBalanceCode", closes)
        .withColumn("remainingTermToMaturityNumber", (F.lit(60) - F.col("m")).cast("double"))
        .drop("m").cache()
    )


def brute_force(rows):
    """Prior-month state per loan by plain loops."""
    state = {}
    for r in rows:
        state.setdefault(r[LOAN], {})[r[PERIOD]] = r.zeroBalanceCode is None and r.remainingTermToMaturityNumber > 1
    before = {}
    for loan, months in state.items():
        ordered = sorted(months)
        before[loan] = {b: months[a] for a, b in zip(ordered, ordered[1:])}
    return before


def test_flags_on_a_skewed_panel(skewed):
    rows = skewed.collect()
    before = brute_force(rows)
    flagged = panel.with_prepayment_flags(skewed).collect()
    assert len(flagged) == len(rows)
    for r in flagged:
        was = before[r[LOAN]].get(r[PERIOD])
        if r.zeroBalanceCode == "1":
            expected = None if was is None else int(was)
        else:
            expected = 0 if was is False else None
        assert r.prepaidFlagFirst == expected


def test_payoffs_on_a_skewed_panel(skewed):
    rows = skewed.collect()
    before, expected = brute_force(rows), {}
    for r in rows:
        hit = r.zeroBalanceCode == "1" and before[r[LOAN]].get(r[PERIOD]) is True
        expected[r[PERIOD]] = expected.get(r[PERIOD], 0) + hit
    assert {r[PERIOD]: r.new_prepaid for r in reports.new_prepayments(skewed).collect()} == expected


def test_window_partitions_are_bounded_by_the_calendar(skewed):
    """What the window orders per loan are its months, however many rows repeat them."""
    states = series.prior_states(skewed, panel.still_active(), "was", LOAN, PERIOD)
    assert states.groupBy(LOAN).count().agg(F.max("count")).first()[0] == MONTHS


def test_repeated_rows_meet_after_partial_aggregation(skewed):
    plan = series.prior_states(skewed, panel.still_active(), "was", LOAN, PERIOD)._jdf.queryExecution().executedPlan().toString()
    window = plan.index("Window")
    assert "partial_max" in plan[window:] and plan[window:].count("Exchange hashpartitioning") == 2


def test_snapshot_splits_a_large_month(spark, skewed):
    path = new_path(spark, "snapshot")
    storage.write_snapshot(skewed, path)
    back = storage.read_snapshot(spark, path)
    assert back.count() == skewed.count()
    plan = back.where(F.col(PERIOD) == F.lit(dt.date(2020, 3, 31)))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(reportingPeriodEndingDate" in plan


def test_one_large_file_is_split(spark, tmp_path):
    """One indented file, read in pieces smaller than itself, keeps every record whole."""
    records = "".join(f"  <assets>\n    <assetNumber>{i}</assetNumber>\n    <note>{'x' * (i % 50)}</note>\n  </assets>\n" for i in range(20000))
    (tmp_path / "big.xml").write_text(f'<?xml version="1.0"?>\n<assetData>\n{records}</assetData>\n')
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        df = loan_records.scan_loan_records(spark, str(tmp_path), schema=loan_records.record_schema(["assetNumber", "note"]))
        assert df.rdd.getNumPartitions() > 5
        rows = {int(r.assetNumber): r.note for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert rows == {i: ("x" * (i % 50)) or None for i in range(20000)}


def test_copies_of_one_loan_month_are_split_in_the_join(spark):
    """A third of all rows is one loan-month; the join splits its partition over tasks."""
    month = F.lit(dt.date(2020, 1, 31))
    rows = spark.range(60000, numPartitions=8).select(
        F.when(F.col("id") % 3 == 0, "HOT").otherwise(F.concat(F.lit("L"), F.col("id") % 5000)).alias(LOAN),
        F.when(F.col("id") % 3 == 0, month).otherwise(F.add_months(month, (F.col("id") % 24).cast("int"))).alias(PERIOD),
        F.lit(None).cast("string").alias("zeroBalanceCode"),
        F.lit(9.0).alias("remainingTermToMaturityNumber"),
        F.md5(F.col("id").cast("string")).alias("payload"),
    )
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        flagged = panel.with_prepayment_flags(rows)
        assert len(flagged.collect()) == 60000
        assert "skew=true" in flagged._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
