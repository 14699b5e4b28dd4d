"""Exponential smoothing in state-space form, with additive or multiplicative errors and seasons.

Hyndman, Koehler, Ord & Snyder 2008. Written in raw errors the states of both kinds of error move alike, so one recursion serves all forms and only
likelihood and intervals differ. Weights and initial states are searched together by quasi-Newton steps for all series of
one length at once. Where no closed form of the intervals exists, paths are simulated with counter-based random numbers.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .likelihood import lowest
from .series import Z80, Z95, fitted_once, spread

RESULT = (
    "model string, alpha double, beta double, gamma double, phi double, level double, trend double, seasons array<double>, "
    "parameters int, sigma2 double, log_likelihood double, aicc double"
)
INTERVALS = ("mean", "lo80", "hi80", "lo95", "hi95")
FIT_SCHEMA = RESULT + "".join(f", {c} array<double>" for c in INTERVALS)


class Form(NamedTuple):
    """Error A or M, trend N, A or Ad, season N, A or M."""

    error: str
    trend: str
    season: str

    @property
    def name(self) -> str:
        return f"ets({self.error},{self.trend},{self.season})"

    @property
    def weights(self) -> int:
        """Number of smoothing weights, the damping included."""
        return 1 + (self.trend != "N") + (self.season != "N") + (self.trend == "Ad")

    def states(self, season: int) -> int:
        """Number of free initial states."""
        return 1 + (self.trend != "N") + (season - 1 if self.season != "N" else 0)

    @property
    def positive(self) -> bool:
        return "M" in (self.error, self.season)


#: All forms but those that add errors to a multiplied season, whose variance has no lower bound.
FORMS = [Form(e, t, s) for s in "NAM" for t in ("N", "A", "Ad") for e in "AM" if (e, s) != ("A", "M")]


class Followed(NamedTuple):
    """One-step means (steps x series), last states, and whether all stayed where the form allows."""

    means: np.ndarray
    level: np.ndarray
    trend: np.ndarray
    seasons: np.ndarray
    allowed: np.ndarray


def follow(y: np.ndarray, form: Form, weights: np.ndarray, start: np.ndarray) -> Followed:
    """Run the recursion over ``y`` (steps x series).

    ``weights`` has rows alpha, beta, gamma, phi; ``start`` level, trend and the seasons before the first value, oldest first. The last
    seasons come back oldest first too.
    """
    alpha, beta, gamma, phi = weights.T
    level, trend, seasons = start[:, 0], start[:, 1], start[:, 2:].T.copy()
    means, allowed = np.empty_like(y), np.ones(y.shape[1], bool)
    with np.errstate(all="ignore"):
        for t in range(len(y)):
            at = t % len(seasons)
            s, q = seasons[at], level + phi * trend
            if form.season == "M":
                means[t] = q * s
                e = y[t] - means[t]
                allowed &= (q > 0) & (s > 0)
                short, seasons[at] = e / s, s + gamma * e / q
            else:
                means[t] = q + s if form.season == "A" else q
                short = e = y[t] - means[t]
                if form.season == "A":
                    seasons[at] = s + gamma * e
            if form.error == "M":
                allowed &= means[t] > 0
            level, trend = q + alpha * short, phi * trend + beta * short
        allowed &= np.isfinite(means).all(axis=0) & np.isfinite(level)
    turn = len(y) % len(seasons)
    return Followed(means, level, trend, np.roll(seasons, -turn, axis=0).T, allowed)


def relative(y: np.ndarray, means: np.ndarray, form: Form) -> np.ndarray:
    """Errors as the form takes them."""
    return (y - means) / means if form.error == "M" else y - means


def log_likelihood(y: np.ndarray, found: Followed, form: Form) -> np.ndarray:
    """Gaussian log-likelihood with the variance profiled out; minus infinity where the states left their range."""
    n = len(y)
    with np.errstate(all="ignore"):
        e = relative(y, found.means, form)
        size = (y * y).sum(axis=0) if form.error == "A" else np.full(y.shape[1], float(n))
        variance = np.maximum((e * e).sum(axis=0), 1e-20 * (1e-300 + size)) / n
        out = -0.5 * n * (np.log(2 * np.pi * variance) + 1)
        if form.error == "M":
            out = out - np.log(found.means).sum(axis=0)
    return np.where(found.allowed & np.isfinite(out), out, -np.inf)


def first_states(y: np.ndarray, form: Form, season: int) -> np.ndarray:
    """Level, trend and seasons by the plain rule, for series x (2 + seasons).

    With a season: mean of the first one, the step to the mean of the second by period, and the first season's values against its
    mean. Without: the first value and the first step.
    """
    if form.season == "N":
        level, seasons = y[0], np.zeros((1, y.shape[1]))
        step = y[1] - y[0]
    else:
        level = y[:season].mean(axis=0)
        step = (y[season : 2 * season].mean(axis=0) - level) / season
        seasons = y[:season] / np.where(level != 0, level, 1.0) if form.season == "M" else y[:season] - level
    return np.vstack([level, step if form.trend != "N" else np.zeros_like(level), seasons]).T


class _Search:
    """Free numbers of a form, and the weights and states they stand for."""

    def __init__(self, y: np.ndarray, form: Form, season: int) -> None:
        self.y, self.form, self.season = y, form, season if form.season != "N" else 1
        self.start = first_states(y, form, season)
        spread_ = np.maximum(y.std(axis=0), 1e-3 * np.abs(y).mean(axis=0) + 1e-12)
        steps = np.maximum(np.diff(y, axis=0).std(axis=0), 1e-3 * spread_)
        unit = spread_ / np.maximum(np.abs(y).mean(axis=0), 1e-12) if form.season == "M" else spread_
        # The last season makes up for the others.
        kinds = [steps] + ([steps / 4] if form.trend != "N" else []) + [unit / 4] * (self.season - 1)
        self.scale = np.stack(kinds, axis=1)

    def weights(self, u: np.ndarray) -> np.ndarray:
        share = 1.0 / (1.0 + np.exp(-np.clip(u[:, : self.form.weights], -30, 30)))
        alpha = 1e-4 + (1 - 2e-4) * share[:, 0]
        beta, gamma, phi, at = np.zeros_like(alpha), np.zeros_like(alpha), np.ones_like(alpha), 1
        if self.form.trend != "N":
            beta, at = alpha * share[:, at], at + 1
        if self.form.season != "N":
            gamma, at = (1 - alpha) * share[:, at], at + 1
        if self.form.trend == "Ad":
            phi = 0.8 + 0.18 * share[:, at]
        return np.stack([alpha, beta, gamma, phi], axis=1)

    def states(self, u: np.ndarray, rows: np.ndarray) -> np.ndarray:
        out, moved = self.start[rows].copy(), u[:, self.form.weights :] * self.scale[rows]
        trend = self.form.trend != "N"
        out[:, : 1 + trend] += moved[:, : 1 + trend]
        if self.season > 1:
            out[:, 2:-1] += moved[:, 1 + trend :]
            out[:, -1] -= moved[:, 1 + trend :].sum(axis=1)
        return out

    def at(self, u: np.ndarray, rows: np.ndarray) -> Followed:
        return follow(self.y[:, rows], self.form, self.weights(u), self.states(u, rows))

    def loss(self, u: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return -log_likelihood(self.y[:, rows], self.at(u, rows), self.form)

    def best(self) -> np.ndarray:
        """Free numbers of greatest likelihood, searched from the best of a few weights."""
        rows = np.arange(self.y.shape[1])
        k, w = self.scale.shape[1] + self.form.weights, self.form.weights
        # Share of the level, then of trend and season beneath it, then the damping.
        starts = [[a, b, b, 1.0][:w] for a in (-2.0, 0.0, 2.0) for b in (-3.0, -1.0)]
        trial = np.zeros((len(rows), len(starts), k))
        trial[:, :, :w] = np.array(starts)
        values = self.loss(trial.reshape(-1, k), np.repeat(rows, len(starts))).reshape(len(rows), -1)
        return lowest(self.loss, trial[rows, values.argmin(axis=1)], 1.0 / len(self.y))


def _ahead(form: Form, weights: np.ndarray, level, trend, seasons: np.ndarray, h: int, shocks: np.ndarray | None = None) -> np.ndarray:
    """The next ``h`` values (h x paths) of one series, without errors or with the given ones (h x paths)."""
    alpha, beta, gamma, phi = weights
    paths = 1 if shocks is None else shocks.shape[1]
    level, trend, seasons = np.full(paths, level), np.full(paths, trend), np.repeat(seasons[:, None], paths, axis=1)
    out = np.empty((h, paths))
    with np.errstate(all="ignore"):
        for t in range(h):
            at = t % len(seasons)
            s, q = seasons[at].copy(), level + phi * trend
            mean = q * s if form.season == "M" else (q + s if form.season == "A" else q)
            e = 0.0 if shocks is None else shocks[t] * (mean if form.error == "M" else 1.0)
            out[t] = mean + e
            short = e / s if form.season == "M" else e
            if form.season != "N":
                seasons[at] = s + gamma * (e / q if form.season == "M" else e)
            level, trend = q + alpha * short, phi * trend + beta * short
    return out


def _closed(form: Form, weights: np.ndarray, season: int, h: int) -> np.ndarray:
    """Variance of the next ``h`` values by that of an error, of a form that only adds."""
    alpha, beta, gamma, phi = weights
    j = np.arange(1, h)
    c = alpha + beta * np.cumsum(phi**j) + (gamma * (j % season == 0) if form.season != "N" else 0.0)
    return np.r_[1.0, 1.0 + np.cumsum(c * c)]


def _intervals(form, weights, level, trend, seasons, sigma2: float, season: int, h: int, paths: int, seed: int, simulate: bool) -> dict:
    mean = _ahead(form, weights, level, trend, seasons, h)[:, 0]
    if not (simulate or form.positive):
        sd = np.sqrt(sigma2 * _closed(form, weights, season, h))
        return {"mean": mean, "lo80": mean - Z80 * sd, "hi80": mean + Z80 * sd, "lo95": mean - Z95 * sd, "hi95": mean + Z95 * sd}
    draws = np.random.Generator(np.random.Philox(key=seed & (2**64 - 1))).normal(0.0, np.sqrt(sigma2), (h, paths))
    if form.error == "M":
        # A value below zero is none that the form can have.
        draws = np.maximum(draws, -0.999999)
    values = np.nan_to_num(_ahead(form, weights, level, trend, seasons, h, draws), nan=0.0)
    cuts = np.quantile(values, [0.1, 0.9, 0.025, 0.975], axis=1)
    return dict(zip(INTERVALS, (mean, *cuts)))


def _short(y: np.ndarray, h: int) -> dict:
    """A series too short for any form repeats its last value; its steps, if it has any, give the variance."""
    sigma2 = float((np.diff(y) ** 2).mean()) if len(y) > 1 else 0.0
    sd, mean = np.sqrt(sigma2 * np.arange(1, h + 1)), np.full(h, y[-1])
    return {
        "model": "naive", "alpha": 1.0, "level": y[-1], "trend": 0.0, "seasons": [], "parameters": 0, "sigma2": sigma2, "mean": mean,
        "lo80": mean - Z80 * sd, "hi80": mean + Z80 * sd, "lo95": mean - Z95 * sd, "hi95": mean + Z95 * sd,
    }


def fit_block(
    values: list[np.ndarray], seeds: list[int], h: int, season: int = 1, forms: list[Form] = FORMS, paths: int = 2000, simulate: bool = False
) -> pd.DataFrame:
    """The form of least AICc for each of many series, with forecasts and 80/95 % intervals.

    A form needs more values than parameters (weights, initial states, variance) and one; a season needs two full ones, and multiplied parts
    need positive values. Forms that only add have closed intervals, unless ``simulate`` asks for paths.
    """
    best, found = np.full(len(values), np.inf), [_short(y, h) for y in values]
    lengths = np.array([len(y) for y in values])
    for n in np.unique(lengths):
        same = np.flatnonzero(lengths == n)
        y = np.stack([values[i] for i in same], axis=1)
        for form in forms:
            k = form.weights + form.states(season) + 1
            if n <= k + 1 or (form.season != "N" and (season < 2 or n < 2 * season)):
                continue
            able = np.flatnonzero((y > 0).all(axis=0) | (not form.positive))
            if not len(able):
                continue
            search = _Search(y[:, able], form, season)
            u, rows = search.best(), np.arange(len(able))
            ran, weights = search.at(u, rows), search.weights(u)
            likely = log_likelihood(search.y, ran, form)
            aicc = -2 * likely + 2 * k + 2 * k * (k + 1) / (n - k - 1)
            errors = relative(search.y, ran.means, form)
            for j in np.flatnonzero(aicc < best[same[able]] - 1e-9):
                i = same[able[j]]
                best[i] = aicc[j]
                sigma2 = float(errors[:, j] @ errors[:, j]) / (n - k + 1)
                last = (ran.level[j], ran.trend[j], ran.seasons[j])
                found[i] = {
                    "model": form.name, "alpha": weights[j, 0], "beta": weights[j, 1], "gamma": weights[j, 2], "phi": weights[j, 3],
                    "level": last[0], "trend": last[1], "seasons": last[2] if form.season != "N" else [], "parameters": k, "sigma2": sigma2,
                    "log_likelihood": likely[j], "aicc": aicc[j],
                    **_intervals(form, weights[j], *last, sigma2, season, h, paths, seeds[i], simulate),
                }
    return pd.DataFrame(found, columns=[f.split()[0] for f in FIT_SCHEMA.split(", ")])


def select_states(
    df: DataFrame, keys: list[str], h: int, season: int = 1, forms: list[Form] = FORMS, paths: int = 2000, seed: int = 42,
    simulate: bool = False, block: int = 500,
) -> DataFrame:
    """Fit the array column ``y`` of every series; see :func:`fit_block`.

    Random numbers are counted from a hash of the series' key and ``seed``, so simulated intervals do not depend on partitions.
    """

    @F.pandas_udf(FIT_SCHEMA)
    def fit(values: pd.Series, seeds: pd.Series) -> pd.DataFrame:
        parts = [
            fit_block(
                [np.asarray(v, float) for v in values.iloc[at : at + block]], [int(s) for s in seeds.iloc[at : at + block]],
                h, season, forms, paths, simulate,
            )
            for at in range(0, len(values), block)
        ]
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=[f.split()[0] for f in FIT_SCHEMA.split(", ")])

    own = F.xxhash64(*keys, F.lit(seed))
    return spread(df, *keys, per_core=1).withColumn("_fit", fitted_once(fit)("y", own)).select(*df.columns, "_fit.*")


def states_forecast(fits: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and 80/95 % intervals, one row per step."""
    steps = fits.select(*keys, "last_period", "model", F.posexplode(F.arrays_zip(*INTERVALS)).alias("pos", "col"))
    return steps.withColumn("h", F.col("pos") + 1).select(*keys, "last_period", "model", "h", *[F.col(f"col.{c}").alias(c) for c in INTERVALS])


def fixed_states(df: DataFrame, keys: list[str], form: Form, alpha: float, beta: float = 0.0, gamma: float = 0.0, phi: float = 1.0, season: int = 1) -> DataFrame:
    """Last states, variance of the errors and log-likelihood of the array column ``y`` under given weights, started by :func:`first_states`.

    Series shorter than two values or two seasons, and those that leave the range of the form, give NULLs.
    """
    weights = np.array([[alpha, beta, gamma, phi]])

    @F.pandas_udf("level double, trend double, seasons array<double>, sigma2 double, log_likelihood double")
    def run(values: pd.Series) -> pd.DataFrame:
        rows = []
        for v in values:
            y = np.asarray(v, float)[:, None]
            if len(y) < (2 * season if form.season != "N" else 2):
                rows.append((None,) * 5)
                continue
            found = follow(y, form, weights, first_states(y, form, season))
            likely = log_likelihood(y, found, form)[0]
            if not np.isfinite(likely):
                rows.append((None,) * 5)
                continue
            errors = relative(y, found.means, form)
            seasons = found.seasons[0] if form.season != "N" else []
            rows.append((found.level[0], found.trend[0], seasons, float((errors**2).mean()), likely))
        return pd.DataFrame(rows, columns=["level", "trend", "seasons", "sigma2", "log_likelihood"])

    return spread(df, *keys, per_core=1).withColumn("_fit", fitted_once(run)("y")).select(*df.columns, F.lit(form.name).alias("model"), "_fit.*")
