"""Known answers of the forecasting operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loantide.forecast import arima, backtest, diagnostics, local_regression, smoothing
from loantide.forecast.series import as_arrays


def arrays(spark, **series):
    rows = [(k, int(t), float(v)) for k, vs in series.items() for t, v in enumerate(vs)]
    return as_arrays(spark.createDataFrame(rows, "s string, t int, v double"), ["s"], "t", "v")


def test_simple_smoothing_with_weight_one_repeats_the_last_value(spark):
    fit = smoothing.fixed_smoothing(arrays(spark, a=[3, 9, 4, 7]), smoothing.simple(1.0)).first()
    assert fit.level == pytest.approx(7) and fit.trend == 0


def test_a_straight_line_is_followed_exactly(spark):
    line = [5 + 2 * t for t in range(12)]
    fit = smoothing.select_smoothing(arrays(spark, a=line), ["s"]).first()
    assert fit.model == "trend" and fit.level == pytest.approx(27) and fit.trend == pytest.approx(2)
    steps = smoothing.smoothing_forecast(smoothing.select_smoothing(arrays(spark, a=line), ["s"]), ["s"], 3)
    assert [r["mean"] for r in steps.orderBy("h").collect()] == pytest.approx([29, 31, 33])


def test_a_constant_series_takes_the_simplest_model(spark):
    fit = smoothing.select_smoothing(arrays(spark, a=[4.0] * 10), ["s"]).first()
    assert fit.model == "simple" and fit.level == pytest.approx(4) and fit.sse == 0


def test_fold_and_batch_agree(spark):
    values = np.cumsum(np.random.default_rng(3).gamma(2.0, 50.0, 30))
    for spec in (smoothing.simple(0.3), smoothing.trend(0.4, 0.1), smoothing.damped(0.5, 0.2, 0.9)):
        series = arrays(spark, a=values)
        fold = smoothing.fixed_smoothing(series, spec).first()
        batch = smoothing.select_smoothing(series, ["s"], [spec]).first()
        assert (fold.level, fold.trend, fold.sse) == pytest.approx((batch.level, batch.trend, batch.sse), rel=1e-9)


def test_initial_states_are_least_squares(spark):
    values = np.random.default_rng(5).normal(0, 1, 25).cumsum()
    spec = smoothing.trend(0.3, 0.1)

    def sse(level, slope):
        total = 0.0
        for y in values:
            e = y - level - slope
            level, slope, total = level + slope + 0.3 * e, slope + 0.1 * e, total + e * e
        return total

    best = smoothing.fixed_smoothing(arrays(spark, a=values), spec).first().sse
    grid = [sse(a, b) for a in np.linspace(-3, 3, 61) for b in np.linspace(-2, 2, 41)]
    assert best <= min(grid) + 1e-9 and best == pytest.approx(min(grid), rel=0.05)


def test_interval_of_simple_smoothing(spark):
    series = arrays(spark, a=[1, 3, 2, 5, 4, 6])
    fits = smoothing.fixed_smoothing(series, smoothing.simple(0.5))
    fit, rows = fits.first(), smoothing.smoothing_forecast(fits, ["s"], 3).orderBy("h").collect()
    sigma = math.sqrt(fit.sse / (6 - 2))
    for row in rows:
        half = 1.959964 * sigma * math.sqrt(1 + (row.h - 1) * 0.25)
        assert row.hi95 - row["mean"] == pytest.approx(half)


def test_intervals_cover(spark):
    """About 80 % of simulated next values fall into the 80 % interval."""
    rng = np.random.default_rng(11)
    walks = {f"w{i}": 100 + rng.normal(0, 1, 41).cumsum() for i in range(200)}
    series = arrays(spark, **{k: v[:40] for k, v in walks.items()})
    for forecast in (
        smoothing.smoothing_forecast(smoothing.select_smoothing(series, ["s"]), ["s"], 1),
        arima.arima_forecast(arima.select_arima(series, ["s"], 1), ["s"]),
    ):
        hits = [r.lo80 <= walks[r.s][40] <= r.hi80 for r in forecast.collect()]
        assert 0.68 < np.mean(hits) < 0.92


def test_arima_of_an_autoregression(spark):
    rng, y = np.random.default_rng(3), [0.0]
    for _ in range(1999):
        y.append(0.7 * y[-1] + rng.normal())
    ar, ma, errors = arima.fit_arma(np.array(y) - np.mean(y), 1, 0)
    assert ar[0] == pytest.approx(0.7, abs=0.08) and not len(ma)
    assert arima.differences_needed(np.array(y)) == 0
    ar, ma, errors = arima.fit_arma(rng.normal(size=400), 0, 1)
    assert abs(ma[0]) < 0.15


def test_arma_weights_minimise_the_squared_error():
    rng = np.random.default_rng(2)
    e = rng.normal(size=300)
    x = e + 0.5 * np.concatenate([[0], e[:-1]])
    _, ma, errors = arima.fit_arma(x, 0, 1)
    assert ma[0] == pytest.approx(0.5, abs=0.12)

    def sse(theta):
        out = np.zeros(len(x))
        for t, v in enumerate(x):
            out[t] = v - (theta * out[t - 1] if t else 0.0)
        return out @ out

    assert errors @ errors <= min(sse(m) for m in np.linspace(-0.9, 0.9, 181)) + 1e-6


def test_differencing():
    rng = np.random.default_rng(4)
    assert arima.differences_needed(np.arange(40.0)) == 1
    assert arima.differences_needed(rng.normal(size=100)) == 0
    assert arima.differences_needed(np.full(20, 3.0)) == 0


def test_arima_of_a_line_goes_on(spark):
    fits = arima.select_arima(arrays(spark, a=[2.0 * t for t in range(20)]), ["s"], 3)
    assert [r["mean"] for r in arima.arima_forecast(fits, ["s"]).orderBy("h").collect()] == pytest.approx([40, 42, 44])


def test_short_series_are_forecast(spark):
    series = arrays(spark, a=[5], b=[5, 7], c=[5, 7, 6])
    for forecast in (
        smoothing.smoothing_forecast(smoothing.select_smoothing(series, ["s"]), ["s"], 2),
        arima.arima_forecast(arima.select_arima(series, ["s"], 2), ["s"]),
    ):
        means = {r.s: r["mean"] for r in forecast.where("h = 2").collect()}
        assert means["a"] == pytest.approx(5) and 5 <= means["b"] <= 9 and 5 <= means["c"] <= 8


def test_rolling_origin_by_hand(spark):
    rows = backtest.rolling_origin(arrays(spark, a=[1, 3, 6, 10]), ["s"], backtest.naive(), 2).collect()
    assert {(r.origin, r.h): r.error for r in rows} == {
        (1, 1): 2, (1, 2): 5, (2, 1): 3, (2, 2): 7, (3, 1): 4, (3, 2): None,
    }
    drift = backtest.rolling_origin(arrays(spark, a=[1, 3, 6, 10]), ["s"], backtest.drift(), 1)
    assert [r.error for r in drift.orderBy("origin").collect()] == pytest.approx([2, 1, 1.5])


def test_refitted_errors_equal_fits_of_each_prefix(spark):
    values = list(np.random.default_rng(8).gamma(2.0, 50.0, 14).cumsum())
    for forecaster, fit in (
        (backtest.smoothing(), lambda p: smoothing.smoothing_forecast(smoothing.select_smoothing(arrays(spark, a=p), ["s"]), ["s"], 1)),
        (backtest.arima(), lambda p: arima.arima_forecast(arima.select_arima(arrays(spark, a=p), ["s"], 1), ["s"])),
    ):
        errors = backtest.rolling_origin(arrays(spark, a=values), ["s"], forecaster, 1)
        got = {r.origin: r.error for r in errors.collect()}
        for origin in (6, 13):
            assert got[origin] == pytest.approx(values[origin] - fit(values[:origin]).first()["mean"], rel=1e-9)


def test_accuracy(spark):
    errors = spark.createDataFrame([("m", 1.0), ("m", -3.0), ("m", None)], "model string, error double")
    row = backtest.accuracy(errors).first()
    assert (row.mae, row.mse) == (2.0, 5.0)


def test_autocorrelation_and_test(spark):
    e = np.random.default_rng(6).normal(size=50)
    rows = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(e)], "s string, t int, residual double")
    acf = diagnostics.autocorrelation(rows, ["s"], 4)
    d = e - e.mean()
    expected = [d[k:] @ d[:-k] / (d @ d) for k in range(1, 5)]
    assert [r.acf for r in acf.orderBy("lag").collect()] == pytest.approx(expected)
    row = diagnostics.ljung_box(acf, ["s"], 1).first()
    assert row.q == pytest.approx(50 * 52 * sum(r * r / (50 - k) for k, r in enumerate(expected, 1)))
    assert row.freedom == 3 and 0 < row.p_value < 1


@pytest.mark.parametrize("x, k, p", [(3.841459, 1, 0.05), (5.991465, 2, 0.05), (18.307038, 10, 0.05), (6.251389, 3, 0.10)])
def test_chi_square_tail(x, k, p):
    assert diagnostics.upper_tail(x, k) == pytest.approx(p, abs=1e-6)


def test_local_regression_reproduces_a_quadratic(spark):
    rows = [("a", x, 3.0 + 2 * x - 0.5 * x * x) for x in range(0, 300, 30)]
    fits = local_regression.smooth(spark.createDataFrame(rows, "s string, x int, y double"), ["s"], "x", "y")
    for row in fits.collect():
        assert row.fitted == pytest.approx(row.y, rel=1e-6, abs=1e-6)


def test_local_regression_against_weighted_least_squares(spark):
    rng = np.random.default_rng(7)
    x, y = np.arange(0.0, 20.0), rng.normal(size=20)
    df = spark.createDataFrame([("a", int(a), float(b)) for a, b in zip(x, y)], "s string, x int, y double")
    got = {r.x: r.fitted for r in local_regression.smooth(df, ["s"], "x", "y").collect()}
    for x0 in x:
        d = np.abs(x - x0)
        h = np.sort(d)[14]
        w = np.where(d < h, (1 - (d / h) ** 3) ** 3, 0)
        coefficients = np.linalg.lstsq(np.vander(x - x0, 3) * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)[0]
        assert got[int(x0)] == pytest.approx(coefficients[-1], rel=1e-6, abs=1e-8)


def test_values_of_one_period_are_added_up(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 1, 3.0), ("a", 0, 1.0), ("a", 2, None)], "s string, t int, v double")
    assert as_arrays(df, ["s"], "t", "v").select(F.col("y")).first().y == [1.0, 5.0]


def test_residual_test_takes_as_many_lags_as_weights_ask_for(spark):
    rng = np.random.default_rng(1)
    noise = [float(v) for v in rng.normal(size=120)]
    fits = spark.createDataFrame([("a", 20, noise), ("b", 1, noise[:20]), ("c", 5, noise[:5])], "s string, parameters int, residuals array<double>")
    got = {r.s: r for r in diagnostics.check_residuals(fits, ["s"]).collect()}

    def expected(e, lags):
        d = np.array(e) - np.mean(e)
        r = [d[k:] @ d[:-k] / (d @ d) for k in range(1, lags + 1)]
        return len(e) * (len(e) + 2) * sum(x * x / (len(e) - k) for k, x in enumerate(r, 1))

    assert got["a"].freedom == 3 and got["a"].q == pytest.approx(expected(noise, 23)) and got["a"].p_value > 1e-4
    assert got["b"].freedom == 3 and got["b"].q == pytest.approx(expected(noise[:20], 4))
    assert (got["c"].q, got["c"].freedom, got["c"].p_value) == (None, None, None)


def test_months_a_series_lacks_are_filled(spark):
    import datetime as dt

    from loantide.forecast.series import with_every_month

    rows = [("a", 1, 1.0, 10.0), ("a", 2, 2.0, 30.0), ("a", 2, 3.0, 0.0), ("a", 6, 4.0, 70.0), ("b", 3, None, 1.0), (None, 3, 1.0, 1.0)]
    df = spark.createDataFrame([(s, dt.date(2024, m, 15), f, v) for s, m, f, v in rows], "s string, p date, f double, v double")
    got = sorted(map(tuple, with_every_month(df, ["s"], "p", ["f"], ["v"]).collect()), key=str)
    ends = {1: dt.date(2024, 1, 31), 2: dt.date(2024, 2, 29), 3: dt.date(2024, 3, 31), 4: dt.date(2024, 4, 30), 5: dt.date(2024, 5, 31), 6: dt.date(2024, 6, 30)}
    want = [("a", ends[1], 1.0, 10.0), ("a", ends[2], 5.0, 30.0), *[("a", ends[m], 0.0, 30.0) for m in (3, 4, 5)], ("a", ends[6], 4.0, 70.0)]
    assert got == sorted([*want, ("b", ends[3], None, 1.0), (None, ends[3], 1.0, 1.0)], key=str)


def test_run_rate_adds_up_rows_of_one_month(spark):
    import datetime as dt

    from loantide.forecast import run_rate

    days = [dt.date(2024, m, 28) for m in range(1, 13)]
    once = spark.createDataFrame([(d, 10.0 + i, 1000.0 - 10 * i) for i, d in enumerate(days)], f"{run_rate.PERIOD} date, {run_rate.CHARGE_OFF} double, {run_rate.BALANCE} double")
    often = spark.createDataFrame([(d, (10.0 + i) / 4, (1000.0 - 10 * i) / 4) for i, d in enumerate(days) for _ in range(4)], once.schema)
    order = lambda df: [tuple(r) for r in df.orderBy(run_rate.PERIOD).collect()]
    assert order(run_rate.run_rate_forecast(often, h=5)) == order(run_rate.run_rate_forecast(once, h=5))
    later = run_rate.run_rate_forecast(once, h=2, start=lambda last: F.date_add(last, 30))
    assert [r[0] for r in order(later)][-2:] == [dt.date(2025, 1, 27), dt.date(2025, 2, 27)]


def test_tasks_follow_the_cores(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2000")
    try:
        fits = arima.select_arima(arrays(spark, a=[1, 2, 4, 3, 6]), ["s"], 1)
        assert fits.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_batched_fits_equal_single_ones():
    """Series of different lengths share a batch without touching each other."""
    rng = np.random.default_rng(12)
    values = [50 + rng.normal(0, 1, n).cumsum() for n in (1, 2, 3, 5, 9, 17, 40, 83)] + [np.full(9, 2.0), np.arange(12.0) ** 2]
    whole = arima.fit_block(values, 4, 2, 2)
    for i, y in enumerate(values):
        one = arima.fit_block([y], 4, 2, 2).iloc[0]
        assert (one.p, one.d, one.q) == (whole.p[i], whole.d[i], whole.q[i])
        assert one["mean"] == pytest.approx(whole["mean"][i]) and one.variance == pytest.approx(whole.variance[i])
        assert one.residuals == pytest.approx(whole.residuals[i])


def test_orders_go_up_to_the_bound():
    rng, e = np.random.default_rng(5), np.random.default_rng(6).normal(size=600)
    y = np.zeros(600)
    for t in range(4, 600):
        y[t] = 0.8 * y[t - 4] + e[t]
    fit = arima.fit_block([y, rng.normal(size=600)], 1).iloc[0]
    assert fit.p == 4 and fit.ar[3] == pytest.approx(0.8, abs=0.08)
    assert (arima.fit_block([y], 1, max_order=2).iloc[0][["p", "q"]].sum()) <= 2


def test_short_series_are_not_differenced():
    assert arima.differences_needed(np.array([1.0, 2, 4, 8])) == 0
    assert arima.differences_needed(np.array([1.0, 2, 4, 8, 16, 32, 64, 128, 256])) > 0


def loess(x, y, x0, span=0.75):
    """Weights of the values in the fit at x0, by weighted least squares over all of them."""
    d = np.abs(x - x0)
    h = np.sort(d)[max(1, int(len(x) * span + 1e-5)) - 1]
    w = np.where(d < h, (1 - (d / h) ** 3) ** 3, 0)
    design = np.vander((x - x0) / h, 3, increasing=True)
    return np.linalg.solve(design.T @ (w[:, None] * design), design.T * w)[0]


def test_repeated_x_keep_their_weight_and_the_band_its_width(spark):
    rng = np.random.default_rng(15)
    x = np.array([0.0, 1, 2, 3, 4, *[5.0] * 7, 6, 7, 8, 9, 10, 11])
    y = rng.normal(size=len(x))
    df = spark.createDataFrame([("a", int(a), float(b)) for a, b in zip(x, y)] + [("a", None, 1.0), ("a", 3, None)], "s string, x int, y double")
    rows = {r.x: r for r in local_regression.smooth(df, ["s"], "x", "y").collect()}
    smoother = np.array([loess(x, y, a) for a in x])
    residuals = y - smoother @ y
    variance = residuals @ residuals / (len(x) - 2 * np.trace(smoother) + (smoother**2).sum())
    for a, weights in zip(x, smoother):
        row, se = rows[int(a)], np.sqrt(variance * weights @ weights)
        assert row.fitted == pytest.approx(weights @ y) and row.se == pytest.approx(se) and row.n == (7 if a == 5 else 1)
        assert (row.lo, row.hi) == pytest.approx((weights @ y - 1.959964 * se, weights @ y + 1.959964 * se))


def test_grid_of_a_quadratic(spark):
    """Any number of values at any x; the moments meet after partial aggregation."""
    df = spark.range(5000).select(F.lit("a").alias("s"), (F.sqrt("id") * 3).alias("x")).withColumn("y", 1 + 2 * F.col("x") - 0.1 * F.col("x") ** 2)
    grid = local_regression.smooth_on_grid(df, ["s"], "x", "y", 30)
    rows = grid.collect()
    assert len(rows) == 30 and all(r.fitted == pytest.approx(1 + 2 * r.x - 0.1 * r.x**2, abs=1e-5) for r in rows)
    assert "partial_sum" in grid._jdf.queryExecution().executedPlan().toString()


def test_refinement_only_improves(spark):
    rng = np.random.default_rng(21)
    series = {f"s{i}": 50 + rng.normal(0.3 * (i % 3), 1, n).cumsum() for i, n in enumerate((1, 2, 4, 5, 7, 9, 20, 40, 60, 83))}
    held = arrays(spark, **series)
    coarse = {r.s: r for r in smoothing.select_smoothing(held, ["s"], refine=0).collect()}
    fine = {r.s: r for r in smoothing.select_smoothing(held, ["s"]).collect()}
    assert all(fine[k].aicc <= coarse[k].aicc + 1e-12 for k in series if len(series[k]) > 4)
    assert sum(fine[k].aicc < coarse[k].aicc - 1e-6 for k in series) >= 4
    for k, row in fine.items():
        assert len(row.residuals) == len(series[k]) and 0 < row.alpha < 1 and row.beta <= row.alpha
        assert sum(e * e for e in row.residuals) == pytest.approx(row.sse, rel=1e-6, abs=1e-9)


def test_prefixes_share_their_recursions():
    """Fits of all prefixes from one pass equal those of each prefix alone, refinement included."""
    import pandas as pd

    rng = np.random.default_rng(31)
    values = [50 + rng.normal(0.3 * (i % 3), 1, n).cumsum() for i, n in enumerate((1, 2, 5, 9, 24, 40))] + [np.full(9, 3.0), np.arange(10.0)]
    grid = smoothing.default_grid()
    for refine in (0, 3):
        for y, fits in zip(values, smoothing.fit_prefixes(values, grid, refine, block=3)):
            assert list(fits["n"]) == list(range(1, len(y) + 1))
            alone = smoothing._fit_all(pd.Series([y[:n] for n in range(1, len(y) + 1)]), grid, refine)
            assert list(fits["model"]) == list(alone["model"])
            for column in ("alpha", "beta", "phi", "level", "trend", "sse", "aicc"):
                assert list(fits[column].astype(float)) == pytest.approx(list(alone[column].astype(float)), rel=1e-12, abs=1e-12), column


def arma_density(x, ar, ma, mean, sigma2):
    """Log density of the multivariate normal whose covariances are those of the process, from its long moving-average form."""
    psi = np.zeros(4000)
    for k in range(len(psi)):
        psi[k] = (k == 0) + (ma[k - 1] if 0 < k <= len(ma) else 0) + sum(a * psi[k - i] for i, a in enumerate(ar, 1) if k >= i)
    n = len(x)
    gamma = np.array([psi[: len(psi) - k] @ psi[k:] for k in range(n)])
    cov = sigma2 * gamma[np.abs(np.subtract.outer(np.arange(n), np.arange(n)))]
    e = x - mean
    return -0.5 * (n * np.log(2 * np.pi) + np.linalg.slogdet(cov)[1] + e @ np.linalg.solve(cov, e))


@pytest.mark.parametrize("ar, ma", [((), ()), ((0.6,), ()), ((), (0.5,)), ((0.5,), (-0.4,)), ((1.1, -0.3), (0.4, 0.2)), ((), (0.3, -0.2, 0.1)), ((0.2, 0.1, -0.5), ())])
def test_exact_likelihood_equals_the_normal_density(spark, ar, ma):
    from loantide.forecast.likelihood import Filtered

    x = np.random.default_rng(4).normal(2, 3, 14)
    for with_mean in (True, False):
        found = Filtered(np.stack([x, x[::-1] + 1], axis=1), np.array([ar, ar]), np.array([ma, ma]), np.array([with_mean] * 2))
        for j, own in enumerate((x, x[::-1] + 1)):
            exact = arma_density(own, ar, ma, found.mean[j], found.sigma2[j])
            assert found.log_likelihood[j] == pytest.approx(exact, rel=1e-9)
            for other in (found.sigma2[j] * 1.01, found.sigma2[j] * 0.99):
                assert arma_density(own, ar, ma, found.mean[j], other) < exact
            if with_mean:
                assert max(arma_density(own, ar, ma, found.mean[j] + m, found.sigma2[j]) for m in (-0.01, 0.01)) < exact
    row = arima.exact_likelihood(arrays(spark, a=np.cumsum(x), b=[1.0]), ["s"], list(ar), list(ma), d=1).orderBy("s").collect()
    alone = Filtered(x[1:, None], np.array([ar]), np.array([ma]), np.array([True]))
    assert row[0].log_likelihood == pytest.approx(alone.log_likelihood[0]) and row[1].log_likelihood is None


def test_free_numbers_map_inside_the_circle_and_back():
    from loantide.forecast.likelihood import free_of, weights_of

    free = np.random.default_rng(2).uniform(-2, 2, (200, 4))
    weights = weights_of(free)
    assert free_of(weights) == pytest.approx(free, rel=1e-6, abs=1e-6)
    for w in weights:
        assert np.abs(np.roots(np.concatenate([[1.0], -w]))).max() < 1


def test_exact_fits_find_the_weights_and_improve_on_conditional_ones():
    from loantide.forecast.likelihood import Filtered

    e = np.random.default_rng(11).normal(size=400)
    y = np.zeros(400)
    for t in range(1, 400):
        y[t] = 0.7 * y[t - 1] + e[t] + 0.4 * e[t - 1]
    short = y[:30] + 5
    fits = arima.fit_block_exactly([y, short], 6, 2, 2, 3)
    assert (fits.p[0], fits.d[0]) == (1, 0) and fits.ar[0][0] == pytest.approx(0.7, abs=0.1) and fits.ma[0][0] == pytest.approx(0.4, abs=0.12)
    for series, order in ((y, (1, 1)), (short, (1, 1)), (short, (2, 1))):
        x = series[:, None]
        ar, ma, _ = arima.fit_arma_batch(x - x.mean(), *order)
        conditional = Filtered(x, ar, ma, np.array([True])).log_likelihood[0]
        a, m, found = arima.maximised(x, ar, ma, np.array([True]))
        assert found.log_likelihood[0] >= conditional
        for i in range(sum(order)):  # no weight can be moved to advantage
            for move in (-1e-3, 1e-3):
                own = np.concatenate([a, m], axis=1)
                own[0, i] += move
                assert Filtered(x, own[:, : order[0]], own[:, order[0] :], np.array([True])).log_likelihood[0] <= found.log_likelihood[0] + 1e-6
    # A random walk repeats its last value; its intervals grow with the root of the step.
    walk = np.cumsum(np.random.default_rng(3).normal(size=60))
    row = arima.fit_block_exactly([walk], 4, 0, 0, 0).iloc[0]
    steps = row.sigma2 * np.arange(1, 5)
    assert row.d == 1 and row.variance == pytest.approx(steps) and row["mean"] == pytest.approx(walk[-1] + row.constant * np.arange(1, 5))


def test_exact_fits_of_short_and_constant_series(spark):
    held = arrays(spark, a=[5], b=[1, 2], c=[2.0] * 9, d=[1, 4, 2, 8, 5, 7, 1, 3, 9, 4, 6], e=[3, 3, 3])
    rows = {r.s: r for r in arima.select_arima(held, ["s"], 3, 1, 1, 2, method="exact").collect()}
    assert len(rows) == 5 and all(len(r["mean"]) == 3 and all(np.isfinite(r["mean"])) for r in rows.values())
    assert rows["a"]["mean"] == [5, 5, 5] and rows["c"]["mean"] == [2, 2, 2]
