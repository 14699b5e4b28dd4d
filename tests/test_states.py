"""State-space smoothing: recursions by hand, forms recovered, intervals."""

import datetime

import numpy as np
import pytest

from loantide.forecast import states
from loantide.forecast.states import FORMS, Form

SCHEMA = "k string, last_period date, y array<double>"
WAVE = np.array([0.7, 1.3, 1.1, 0.9])


def frame(spark, **series):
    day = datetime.date(2020, 12, 31)
    return spark.createDataFrame([(k, day, [float(v) for v in y]) for k, y in series.items()], SCHEMA)


def simulated(form, weights, level, trend, seasons, sigma, n, seed):
    """A path of the form itself, by the published table of recursions, one kind of error and season at a time."""
    rng = np.random.default_rng(seed)
    alpha, beta, gamma, phi = weights
    ring, out = list(seasons), []
    for _ in range(n):
        q, s, z = level + phi * trend, ring.pop(0), rng.normal(0, sigma)
        if form.season == "M":
            mean = q * s
        else:
            mean = q + s
        if form.error == "A":
            out.append(mean + z)
            if form.season == "M":
                level, trend, s = q + alpha * z / s, phi * trend + beta * z / s, s + gamma * z / q
            else:
                level, trend, s = q + alpha * z, phi * trend + beta * z, s + gamma * z
        else:
            out.append(mean * (1 + z))
            if form.season == "M":
                level, trend, s = q * (1 + alpha * z), phi * trend + beta * q * z, s * (1 + gamma * z)
            else:
                level, trend, s = q + alpha * mean * z, phi * trend + beta * mean * z, s + gamma * mean * z
        ring.append(s)
    return np.array(out), (level, trend, ring)


@pytest.mark.parametrize("form", FORMS + [Form("A", "Ad", "M")], ids=lambda f: f.name)
def test_recursion_returns_the_errors_it_was_made_from(form):
    weights = np.array([0.4, 0.1 * (form.trend != "N"), 0.2 * (form.season != "N"), 0.9 if form.trend == "Ad" else 1.0])
    seasons = {"N": [0.0], "A": list(WAVE * 10 - 10), "M": list(WAVE)}[form.season]
    sigma = 0.03 if form.error == "M" else 1.0
    trend = 0.5 if form.trend != "N" else 0.0
    y, last = simulated(form, weights, 100.0, trend, seasons, sigma, 25, 4)
    got = states.follow(y[:, None], form, weights[None], np.array([[100.0, trend, *seasons]]))
    z = np.random.default_rng(4).normal(0, sigma, 25)
    assert got.allowed[0] and np.allclose(states.relative(y[:, None], got.means, form)[:, 0], z)
    assert np.allclose(got.level, last[0]) and np.allclose(got.trend, last[1]) and np.allclose(got.seasons[0], last[2])


def test_likelihood_is_the_density_of_the_values():
    form, y = Form("M", "N", "N"), np.array([[10.0], [11.0], [9.5], [10.5], [12.0]])
    found = states.follow(y, form, np.array([[0.3, 0.0, 0.0, 1.0]]), np.array([[10.0, 0.0, 0.0]]))
    sd = np.sqrt((((y - found.means) / found.means) ** 2).mean()) * found.means
    density = (-0.5 * np.log(2 * np.pi) - np.log(sd) - (y - found.means) ** 2 / (2 * sd * sd)).sum()
    assert np.allclose(states.log_likelihood(y, found, form), density)


@pytest.mark.parametrize(
    "form,weights,sigma",
    [
        (Form("M", "A", "M"), (0.3, 0.05, 0.1, 1.0), 0.02),
        (Form("A", "N", "A"), (0.3, 0.0, 0.2, 1.0), 2.0),
        (Form("M", "N", "N"), (0.5, 0.0, 0.0, 1.0), 0.1),
    ],
    ids=lambda v: v.name if isinstance(v, Form) else "",
)
def test_season_and_weights_of_a_simulated_series_are_found(form, weights, sigma):
    trend = 1.0 if form.trend != "N" else 0.0
    seasons = {"N": [0.0], "A": list(WAVE * 20 - 20), "M": list(WAVE)}[form.season]
    y, _ = simulated(form, weights, 100.0, trend, seasons, sigma, 240, 9)
    chosen = states.fit_block([y], [1], 4, 4).iloc[0]
    assert chosen.model.endswith(f"{form.season})")
    own = states.fit_block([y], [1], 4, 4, [form]).iloc[0]
    assert abs(own.alpha - weights[0]) < 0.15 and abs(np.sqrt(own.sigma2) - sigma) < 0.15 * sigma
    # The search ends no lower than at the weights and states the series was made from.
    true = states.follow(y[:, None], form, np.array([weights]), np.array([[100.0, trend, *seasons]]))
    assert own.log_likelihood >= states.log_likelihood(y[:, None], true, form)[0] - 0.5
    assert chosen.aicc <= own.aicc + 1e-9


def test_multiplied_errors_are_told_from_added_ones():
    grows = 10 * np.exp(np.linspace(0, 3, 120)) * (1 + np.random.default_rng(2).normal(0, 0.05, 120))
    assert states.fit_block([grows], [1], 2).iloc[0].model.startswith("ets(M")
    level = 100 + np.random.default_rng(3).normal(0, 1, 120)
    assert ",N,N)" in states.fit_block([level - 100], [1], 2).iloc[0].model


@pytest.mark.parametrize("form", [f for f in FORMS if not f.positive], ids=lambda f: f.name)
def test_simulated_intervals_meet_the_closed_ones(form):
    y, _ = simulated(form, (0.4, 0.1 * (form.trend != "N"), 0.2 * (form.season != "N"), 1.0), 100.0, 0.0, [1, -1, 2, -2] if form.season == "A" else [0], 2.0, 60, 6)
    closed = states.fit_block([y], [7], 9, 4, [form]).iloc[0]
    paths = states.fit_block([y], [7], 9, 4, [form], paths=40_000, simulate=True).iloc[0]
    width = closed.hi95 - closed.lo95
    for c in states.INTERVALS:
        assert (np.abs(closed[c] - paths[c]) < 0.02 * width).all()


def test_intervals_of_multiplied_errors():
    # One step ahead the error is normal about the mean, so the cut is known.
    y, _ = simulated(Form("M", "N", "M"), (0.3, 0.0, 0.1, 1.0), 100.0, 0.0, list(WAVE), 0.05, 80, 12)
    got = states.fit_block([y], [3], 6, 4, [Form("M", "N", "M")], paths=60_000).iloc[0]
    assert abs(got.hi95[0] / got["mean"][0] - 1 - 1.959964 * np.sqrt(got.sigma2)) < 0.01 * 1.96 * np.sqrt(got.sigma2) * 3
    assert (got.lo95 < got.lo80).all() and (got.lo80 < got["mean"]).all() and (got["mean"] < got.hi80).all() and (got.hi80 < got.hi95).all()


def test_simulation_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(1)
    given = frame(spark, **{f"s{i}": np.abs(50 + rng.normal(0, 5, 30)) for i in range(6)})
    form = [Form("M", "N", "N")]
    one = states.states_forecast(states.select_states(given.repartition(1), ["k"], 5, forms=form), ["k"])
    many = states.states_forecast(states.select_states(given.repartition(7, "k"), ["k"], 5, forms=form), ["k"])
    order = lambda df: sorted(tuple(r) for r in df.drop("last_period").collect())
    a, b = order(one), order(many)
    assert [r[:3] for r in a] == [r[:3] for r in b] and np.allclose([r[3:] for r in a], [r[3:] for r in b], rtol=1e-6)
    assert len({r[4] for r in a if r[2] == 1}) == 6


def test_short_zero_and_negative_series(spark):
    given = frame(spark, one=[4], few=[1, 2, 4], zero=[0] * 40, constant=[7] * 40, falls=np.arange(40.0)[::-1] - 20, some=[0, 5, 3, 6, 2, 8, 1, 4])
    fits = states.select_states(given, ["k"], 3, 4)
    got = {r.k: r for r in fits.collect()}
    assert got["one"].model == got["few"].model == "naive" and list(got["few"].mean) == [4, 4, 4] and list(got["one"].hi95) == [4, 4, 4]
    assert np.allclose(got["zero"].mean, 0) and np.allclose(got["constant"].mean, 7, rtol=1e-4)
    assert np.allclose(got["falls"].mean, [-21, -22, -23], atol=0.05)
    # A value of zero or less rules the multiplied parts out.
    assert all(got[k].model == "naive" or "M" not in got[k].model for k in ("zero", "falls", "some"))
    assert states.states_forecast(fits, ["k"]).count() == 18
    assert states.select_states(given.limit(0), ["k"], 3).count() == 0


def test_fixed_weights_leave_short_series_empty(spark):
    form = Form("M", "A", "M")
    given = frame(spark, a=[10, 20, 12, 22], short=[1, 2, 3], zero=[0] * 8)
    got = {r.k: r for r in states.fixed_states(given, ["k"], form, 0.5, 0.1, 0.2, season=2).collect()}
    assert got["short"].level is None and got["zero"].level is None and got["a"].model == "ets(M,A,M)"
    # Two steps by hand: level 15, trend 1, seasons 2/3 and 4/3.
    level, trend, ring = 15.0, 1.0, [10 / 15, 20 / 15]
    for v in (10, 20, 12, 22):
        q, s = level + trend, ring.pop(0)
        e = v / (q * s) - 1
        level, trend = q * (1 + 0.5 * e), trend + 0.1 * q * e
        ring.append(s * (1 + 0.2 * e))
    assert np.allclose([got["a"].level, got["a"].trend, *got["a"].seasons], [level, trend, *ring])
