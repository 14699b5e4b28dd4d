"""Seasonal models: known answers, brute force and short series."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from loantide.forecast import arima, seasonal
from loantide.forecast.likelihood import Filtered
from loantide.operators.series import with_position

SCHEMA = "k string, last_period date, y array<double>"


def frame(spark, **series):
    day = datetime.date(2020, 12, 31)
    return spark.createDataFrame([(k, day, [float(v) for v in y]) for k, y in series.items()], SCHEMA)


def simulated(n, season=12, ma=-0.4, sma=-0.6, seed=3):
    """Sums of seasonal sums of a product moving average."""
    e = np.random.default_rng(seed).normal(0, 1, n + season + 1)
    theta = np.convolve([1, ma], np.r_[1, np.zeros(season - 1), sma])
    w = np.convolve(e, theta)[: len(e)][season + 1 :]
    y = np.zeros(n + season)
    step = np.cumsum(w)
    for t in range(n):
        y[t + season] = y[t] + step[t]
    return y[season:] + 10 * np.sin(np.arange(n) * 2 * np.pi / season)


def test_products_are_those_of_polynomials():
    ar, sar = np.array([[0.5, -0.2]]), np.array([[0.3, 0.1]])
    whole = np.convolve(np.r_[1, -ar[0]], [1, 0, 0, 0, -0.3, 0, 0, 0, -0.1])
    assert np.allclose(seasonal.product(ar, sar, 4)[0], -whole[1:])
    # Short weights may reach beyond a season.
    whole = np.convolve([1, -0.5, 0.2, -0.1], [1, 0, -0.3])
    assert np.allclose(seasonal.product(np.array([[0.5, -0.2, 0.1]]), np.array([[0.3]]), 2)[0], -whole[1:])


@pytest.mark.parametrize("p,q,sp,sq", [(1, 1, 1, 1), (2, 0, 1, 0), (0, 2, 0, 2), (3, 0, 0, 1), (0, 0, 0, 0)])
def test_errors_follow_the_recursion(p, q, sp, sq):
    rng = np.random.default_rng(p + 10 * q)
    x, weights, order = rng.normal(size=(30, 1)), rng.uniform(-0.4, 0.4, (1, p + q + sp + sq)), seasonal._Order(p, q, sp, sq, 4)
    ar, ma = (a[0] for a in order.products(weights))
    e = np.zeros(30)
    for t in range(30):
        e[t] = x[t, 0] - sum(ar[i] * x[t - 1 - i, 0] for i in range(min(t, len(ar)))) - sum(ma[j] * e[t - 1 - j] for j in range(min(t, len(ma))))
    assert np.allclose(order.errors(x, weights)[:, 0], e)
    # Slopes against differences.
    if order.k:
        slopes = order.slopes(x, order.errors(x, weights), weights)
        for i in range(order.k):
            move = np.zeros_like(weights)
            move[0, i] = 1e-6
            moved = (order.errors(x, weights - move) - order.errors(x, weights + move)) / 2e-6
            assert np.allclose(slopes[:, :, i], moved, atol=1e-6)


def test_without_seasonal_weights_it_is_the_plain_fit():
    x = np.random.default_rng(1).normal(size=(80, 3))
    weights, errors = seasonal.fit_batch(x, seasonal._Order(1, 1, 0, 0, 12))
    ar, ma, plain = arima.fit_arma_batch(x, 1, 1)
    assert np.allclose(weights, np.concatenate([ar, ma], axis=1)) and np.allclose(errors, plain)


def test_strength():
    rng = np.random.default_rng(5)
    wave = np.tile(rng.normal(size=12), 8)
    assert seasonal.season_strength(wave + np.arange(96.0), 12) > 0.999
    assert seasonal.season_strength(rng.normal(size=240), 12) < 0.3
    assert seasonal.season_strength(np.tile(rng.normal(size=7), 5), 7) > 0.999
    # Too few seasons, no variance, lines, no season at all.
    for y, m in ((wave[:35], 12), (np.full(60, 3.0), 12), (np.arange(60.0) * 1e6, 12), (wave, 1), (np.zeros(0), 12)):
        assert seasonal.season_strength(y, m) == 0


@pytest.mark.parametrize("method", ["conditional", "exact"])
def test_weights_and_differences_of_a_simulated_series_are_found(method):
    y = simulated(400)
    got = seasonal.fit_block([y], 12, 12, 0, 1, 0, 1, method=method).iloc[0]
    assert (got.d, got.sd, got.q, got.sq) == (1, 1, 1, 1)
    assert abs(got.ma[0] + 0.4) < 0.12 and abs(got.sma[0] + 0.6) < 0.12 and abs(got.sigma2 - 1) < 0.2


def test_season_is_found_in_an_autoregression():
    rng = np.random.default_rng(8)
    y = np.zeros(500)
    for t in range(500):
        y[t] = rng.normal() + (0.5 * y[t - 4] if t >= 4 else 0)
    got = seasonal.fit_block([y], 4, 4, 0, 0, 1, 0).iloc[0]
    assert (got.d, got.sd, got.sp) == (0, 0, 1) and abs(got.sar[0] - 0.5) < 0.1


def test_exact_weights_have_the_greater_likelihood():
    y = simulated(90, seed=11)
    w = seasonal.differenced(y, 1, 1, 12)[:, None]
    order = seasonal._Order(0, 1, 0, 1, 12)
    start, _ = seasonal.fit_batch(w, order)
    none = np.array([False])
    best, found = seasonal.fit_exactly(w, order, start, none)
    assert found.log_likelihood[0] >= Filtered(w, *order.products(start), none).log_likelihood[0]
    for move in np.vstack([np.eye(2), -np.eye(2)]) * 0.02:
        assert Filtered(w, *order.products(best + move), none).log_likelihood[0] <= found.log_likelihood[0] + 1e-6
    # The density of the moving average, written out.
    n, ma = len(w), np.r_[1, order.products(best)[1][0]]
    covariance = sum(np.eye(n, k=j) * (ma[: len(ma) - abs(j)] @ ma[abs(j) :]) for j in range(-13, 14)) * found.sigma2[0]
    density = -0.5 * (n * np.log(2 * np.pi) + np.linalg.slogdet(covariance)[1] + w[:, 0] @ np.linalg.solve(covariance, w[:, 0]))
    assert abs(density - found.log_likelihood[0]) < 1e-6


def test_forecasts_undo_both_differences():
    # A pattern on a line goes on without error.
    y = np.tile([5.0, 1.0, -2.0, 7.0], 10) + 3.0 * np.arange(40)
    got = seasonal.fit_block([y], 9, 4).iloc[0]
    assert got.sd == 1 and np.allclose(got["mean"], np.tile([5.0, 1.0, -2.0, 7.0], 3)[:9] + 3.0 * np.arange(40, 49))
    # Squared error weights of seasonal and plain random walks.
    assert np.allclose(seasonal._growth(np.zeros(0), np.zeros(0), 0, 1, 4, 9), [1, 1, 1, 1, 2, 2, 2, 2, 3])
    assert np.allclose(seasonal._growth(np.zeros(0), np.zeros(0), 1, 0, 4, 5), [1, 2, 3, 4, 5])


def test_blocks_do_not_mix_series():
    values = [simulated(80, seed=1), simulated(50, seed=2), np.arange(6.0), simulated(120, seed=3)]
    together = seasonal.fit_block(values, 6, 12, 1, 1, 1, 1)
    for i, y in enumerate(values):
        alone = seasonal.fit_block([y], 6, 12, 1, 1, 1, 1).iloc[0]
        row = together.iloc[i]
        assert (row.p, row.d, row.q, row.sp, row.sd, row.sq) == (alone.p, alone.d, alone.q, alone.sp, alone.sd, alone.sq)
        assert np.allclose(row["mean"], alone["mean"], rtol=1e-6) and np.allclose(row["variance"], alone["variance"], rtol=1e-6)


@pytest.mark.parametrize("method", ["conditional", "exact"])
def test_short_and_constant_series(spark, method):
    given = frame(spark, one=[4], two=[1, 3], few=[1, 2, 4, 3], constant=[7] * 50, zero=[0] * 50, line=range(50))
    fits = seasonal.select_seasonal_arima(given, ["k"], 3, 12, method=method)
    got = {r.k: r for r in fits.collect()}
    assert list(got["one"].mean) == [4, 4, 4] and list(got["two"].mean) == [3, 3, 3]
    assert np.allclose(got["constant"].mean, 7) and np.allclose(got["zero"].mean, 0) and np.allclose(got["line"].mean, [50, 51, 52])
    assert all(r.sd == 0 and r.season == 12 for r in got.values())
    steps = seasonal.seasonal_arima_forecast(fits, ["k"]).where("k = 'line'").orderBy("h").collect()
    assert steps[0].model.endswith("[12]") and [r.h for r in steps] == [1, 2, 3] and steps[0].lo95 <= steps[0].lo80 <= steps[0].mean
    assert seasonal.select_seasonal_arima(given.limit(0), ["k"], 3).count() == 0


def test_the_last_season_is_repeated(spark):
    given = frame(spark, long=[1, 2, 3, 5, 2, 4, 4, 6], short=[1, 9], empty=[])
    rows = seasonal.seasonal_naive(given, ["k"], 6, 4).orderBy("k", "h").collect()
    long = [r for r in rows if r.k == "long"]
    assert [r.mean for r in long] == [2, 4, 4, 6, 2, 4]
    square = (1 + 4 + 1 + 1) / 4
    assert np.allclose([r.hi95 - r.mean for r in long], 1.959964 * np.sqrt(np.array([1, 1, 1, 1, 2, 2]) * square))
    short = [r for r in rows if r.k == "short"]
    assert [r.mean for r in short] == [9] * 6 and short[0].lo80 is None
    assert len(rows) == 12


def test_seasonal_steps_and_errors(spark):
    panel = spark.createDataFrame([("a", i, float(i * i)) for i in range(8)], "k string, p int, v double")
    steps = with_position(panel, ["k"], "p").withColumn("step", seasonal.seasonal_step("v", ["k"], "p", 4)).orderBy("p").collect()
    assert [r.step for r in steps] == [None] * 4 + [16, 24, 32, 40]
    given = frame(spark, a=[i * i for i in range(8)], gone=[1, 2, 3])
    got = {r.k: r.residuals for r in seasonal.seasonal_errors(given, ["k"], ar=[0.5], sd=1, season=4).collect()}
    assert got["a"] == [16, 16, 20, 24] and got["gone"] == []


def test_strength_column(spark):
    wave = [float(v) for v in np.tile([0, 5, 1, -6], 6)]
    got = {r.k: r for r in seasonal.with_season_strength(frame(spark, wave=wave, short=[1, 2]), ["k"], 4).select(F.col("*")).collect()}
    assert got["wave"].differenced and not got["short"].differenced and got["short"].strength == 0
    with pytest.raises(ValueError):
        seasonal.select_seasonal_arima(frame(spark, a=[1]), ["k"], 2, 1)
