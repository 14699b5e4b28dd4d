import golden
import pytest
from pyspark.sql import functions as F

from loantide.forecast import arima, diagnostics, run_rate, smoothing
from loantide.plans import outlook
from loantide.schema import PERIOD
from loantide.session import new_path
from loantide.sources import storage


def test_trailing_rates(spark):
    ratios = run_rate.balance_ratios(golden.table(spark), [])
    row = run_rate.trailing_rates(ratios, []).first()
    assert row.growth_rate == pytest.approx(golden.GROWTH, rel=1e-12)
    assert row.charge_off_rate == pytest.approx(golden.CHARGE_OFF_RATE, rel=1e-12)


def test_run_rate_forecast(spark):
    forecast = run_rate.run_rate_forecast(golden.table(spark))
    totals = run_rate.charge_off_totals(forecast).first()
    assert totals.actual_total == pytest.approx(golden.TOTAL_MONTH_19, abs=0.005)
    assert totals.forecast_total == pytest.approx(golden.TOTAL_MONTH_36, rel=1e-12)
    assert str(totals.end_period) == golden.LAST_MONTH
    rows = forecast.orderBy(PERIOD).collect()
    assert len(rows) == 36
    assert rows[-1].reportingPeriodActualEndBalanceAmount == pytest.approx(golden.BALANCE_MONTH_36, rel=1e-12)
    assert rows[-1].cumulative_charge_off == pytest.approx(totals.forecast_total, rel=1e-12)
    assert [r.Period for r in rows] == ["Actual"] * 19 + ["Forecast"] * 17


def test_two_series_do_not_mix(spark):
    one = golden.table(spark).withColumn("series_id", F.lit("a"))
    both = one.unionByName(one.withColumn("series_id", F.lit("b")))
    totals = run_rate.charge_off_totals(run_rate.run_rate_forecast(both, ["series_id"]), ["series_id"])
    assert [r.forecast_total for r in totals.collect()] == pytest.approx([golden.TOTAL_MONTH_36] * 2, rel=1e-12)


def test_rate_line(spark):
    ratios = run_rate.balance_ratios(golden.table(spark), [])
    value = storage.plain_number(F.col("charge_off_rate") * 100)
    text = "Charge Offs - % of Total Outstanding Balance Amount (P12M): "
    line = run_rate.trailing_rates(ratios, []).select(storage.report_line(text, value, "%").alias("line"))
    assert line.first().line == golden.RATE_LINE


def test_report_lines(spark):
    row = outlook.run_rate_lines(golden.table(spark), **golden.LINE_TEXTS).first()
    assert row.growth_line == golden.GROWTH_LINE
    assert row.share_line == golden.SHARE_LINE
    assert row.total_line == golden.TOTAL_LINE


def test_export_writes_missing_as_na(spark):
    months = golden.table(spark)
    path = new_path(spark, "golden")
    storage.export_table(months, path)
    lines = [r.value for r in spark.read.text(path).collect()]
    assert sum(line.count(",NA") for line in lines) == 3
    back = storage.read_table(spark, path, months.schema)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, months.collect()))


def test_models_of_cumulative_charge_offs(spark):
    """A near-linear late path: both forecasts go on rising, and the intervals widen."""
    months = golden.table(spark).withColumn("series_id", F.lit("deal"))
    rows = outlook.model_forecasts(months, ["series_id"], 17).orderBy("method", "h").collect()
    assert len(rows) == 34
    for method in ("ARIMA", "ETS"):
        path = [r for r in rows if r.method == method]
        means = [r["mean"] for r in path]
        assert means == sorted(means) and means[0] > golden.TOTAL_MONTH_19
        assert all(r.lo95 < r.lo80 < r["mean"] < r.hi80 < r.hi95 for r in path)
        widths = [r.hi95 - r.lo95 for r in path]
        assert widths == sorted(widths)


def test_comparison_of_models(spark):
    months = golden.table(spark).withColumn("series_id", F.lit("deal"))
    table = {r.model: r for r in outlook.model_comparison(months, ["series_id"]).collect()}
    assert set(table) == {"arima", "ets"}
    for row in table.values():
        assert 0 < row.mae and row.mae**2 <= row.mse * (1 + 1e-9)


def test_selected_models_are_plausible(spark):
    months = golden.table(spark).withColumn("series_id", F.lit("deal"))
    arrays = outlook.cumulative_charge_off(months, ["series_id"])
    ets = smoothing.select_smoothing(arrays, ["series_id"]).first()
    assert ets.model in ("trend", "damped") and len(ets.residuals) == 19
    fit = arima.select_arima(arrays, ["series_id"], 3).first()
    assert fit.d >= 1 and fit.sigma2 > 0


def test_one_series_needs_no_key(spark):
    months = golden.table(spark)
    assert outlook.model_forecasts(months, [], 17).count() == 34
    arrays = outlook.cumulative_charge_off(months, [])
    for fits in (smoothing.select_smoothing(arrays, []), arima.select_arima(arrays, [], 1)):
        row = diagnostics.check_residuals(fits, []).first()
        assert row.freedom >= 3 and 0 <= row.p_value <= 1
    assert {r.model for r in outlook.model_comparison(months, [], 3).collect()} == {"arima", "ets"}
    components = months.withColumns(
        {"actualPrincipalCollectedAmount": F.lit(1.0), "actualInterestCollectedAmount": F.lit(2.0)}
    )
    smoothed = outlook.smoothed_components(components)
    assert smoothed.count() == 57 and smoothed.where("fitted is null").count() == 0
