"""Exponential smoothing: simple, trended and damped, with additive errors.

All three are one recursion: level and trend move by ``alpha`` and ``beta``
times the one-step error, and the trend is damped by ``phi`` (0 switches it
off, 1 keeps it whole). The error is linear in the initial level and trend, so
these are found by least squares in the same pass: the recursion runs on the
data from a zero state and on zero data from each unit state.
(Hyndman, Koehler, Snyder & Grose 2002.)
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.parsing import ratio
from .series import fitted_once, spread, with_intervals


# Pairs of runs (data, unit level, unit trend) whose error products are summed.
PRODUCTS = ("yy", "yl", "yb", "ll", "lb", "bb")


class Smoothing(NamedTuple):
    model: str
    alpha: float
    beta: float
    phi: float

    @property
    def parameters(self) -> int:
        """Smoothing weights and initial states, without the error variance."""
        return {"simple": 2, "trend": 4, "damped": 5}[self.model]


def simple(alpha: float) -> Smoothing:
    return Smoothing("simple", alpha, 0.0, 0.0)


def trend(alpha: float, beta: float) -> Smoothing:
    return Smoothing("trend", alpha, beta, 1.0)


def damped(alpha: float, beta: float, phi: float) -> Smoothing:
    return Smoothing("damped", alpha, beta, phi)


def default_grid() -> list[Smoothing]:
    """Candidate weights with beta below alpha."""
    alphas = [round(0.05 + 0.1 * i, 2) for i in range(10)] + [0.99]
    shares = (0.05, 0.2, 0.4, 0.6, 0.8)
    slopes = [(a, round(a * s, 4)) for a in alphas for s in shares]
    return (
        [simple(a) for a in alphas]
        + [trend(a, b) for a, b in slopes]
        + [damped(a, b, phi) for phi in (0.8, 0.87, 0.93, 0.98) for a, b in slopes]
    )


def fixed_smoothing(df: DataFrame, spec: Smoothing) -> DataFrame:
    """Fit given weights to the array column ``y``: final ``level`` and ``trend``, ``sse``, ``n``.

    A fold over the array inside the JVM.
    """
    alpha, beta, phi = spec.alpha, spec.beta, spec.phi
    zero, one = F.lit(0.0), F.lit(1.0)
    start = {"l_y": zero, "b_y": zero, "l_l": one, "b_l": zero, "l_b": zero, "b_b": one}
    start |= {f"s_{p}": zero for p in PRODUCTS}

    def step(state: Column, y: Column) -> Column:
        errors, moved = {}, []
        for run in "ylb":
            expected = state[f"l_{run}"] + F.lit(phi) * state[f"b_{run}"]
            errors[run] = (y if run == "y" else zero) - expected
            moved.append((expected + F.lit(alpha) * errors[run]).alias(f"l_{run}"))
            moved.append((F.lit(phi) * state[f"b_{run}"] + F.lit(beta) * errors[run]).alias(f"b_{run}"))
        sums = [(state[f"s_{p}"] + errors[p[0]] * errors[p[1]]).alias(f"s_{p}") for p in PRODUCTS]
        return F.struct(*moved, *sums)

    shifted = F.transform("y", lambda v: v - F.get("y", F.lit(0)))
    state = F.aggregate(shifted, F.struct(*[v.alias(k) for k, v in start.items()]), step)
    fitted = df.withColumn("_s", state)

    def s(name: str) -> Column:
        return F.col(f"_s.{name}")

    if spec.model == "simple":
        level0, trend0 = -s("s_yl") / s("s_ll"), zero
    else:
        det = s("s_ll") * s("s_bb") - s("s_lb") * s("s_lb")
        level0 = F.try_divide(s("s_yb") * s("s_lb") - s("s_yl") * s("s_bb"), det)
        trend0 = F.try_divide(s("s_yl") * s("s_lb") - s("s_yb") * s("s_ll"), det)
    solved = fitted.withColumns({"_l0": level0, "_b0": trend0})
    return solved.withColumns(
        {
            "level": F.get("y", F.lit(0)) + s("l_y") + F.col("_l0") * s("l_l") + F.col("_b0") * s("l_b"),
            "trend": s("b_y") + F.col("_l0") * s("b_l") + F.col("_b0") * s("b_b"),
            "sse": F.greatest(zero, s("s_yy") + F.col("_l0") * s("s_yl") + F.col("_b0") * s("s_yb")),
            "n": F.size("y"),
            **{k: F.lit(v) for k, v in spec._asdict().items()},
            "parameters": F.lit(spec.parameters),
        }
    ).drop("_s", "_l0", "_b0")


FIT_SCHEMA = (
    "model string, alpha double, beta double, phi double, parameters int, n int, "
    "level double, trend double, sse double, aicc double, residuals array<double>"
)


# Halves of these steps, and halves again, refine alpha, the share beta / alpha, and phi.
STEPS = (0.05, 0.1, 0.03)
BOUNDS = ((0.01, 0.99), (0.01, 0.99), (0.8, 0.98))


def _steps(y: np.ndarray, sizes: np.ndarray, grid: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """States and error products of every series under every candidate, after each step.

    ``y`` is series x steps, padded; a series past its end keeps its state. ``grid`` holds alpha, beta and phi, as
    (1 or series) x candidates x 3. Yields states [2, 3, series, candidates] and products [6, series, candidates], which the
    next step overwrites. What stands after a step is the fit of the series up to there.
    """
    rows, candidates = len(y), grid.shape[1]
    states = np.zeros((2, 3, rows, candidates))
    level, slope = states
    level[1], slope[2] = 1.0, 1.0
    products = np.zeros((6, rows, candidates))
    for t in range(y.shape[1]):
        live = t < sizes
        alpha, beta, phi = np.moveaxis(grid if len(grid) == 1 else grid[live], 2, 0)
        expected = level[:, live] + phi * slope[:, live]
        errors = -expected
        errors[0] += y[live, t, None]
        level[:, live] = expected + alpha * errors
        slope[:, live] = phi * slope[:, live] + beta * errors
        for i, (a, b) in enumerate(((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))):
            products[i, live] += errors[a] * errors[b]
        yield states, products


def _choose(y: np.ndarray, sizes: np.ndarray, first: np.ndarray, grid: np.ndarray, models: np.ndarray) -> pd.DataFrame:
    """Best candidate per series by AICc; ``y`` is relative to ``first``. See :func:`_judged`."""
    *_, last = _steps(y, sizes, grid)
    return _judged(*last, sizes, first, grid, models)


def _judged(
    states: np.ndarray, products: np.ndarray, sizes: np.ndarray, first: np.ndarray, grid: np.ndarray, models: np.ndarray
) -> pd.DataFrame:
    """Best candidate per series by AICc, earliest first among equals, from states and products after ``sizes`` steps.

    ``grid`` and ``models`` have a row per series, or one for all. A series too short for any candidate gets the quickest
    simple one, which nearly repeats its last value.
    """
    yy, yl, yb, ll, lb, bb = products
    flat = models == "simple"
    size = np.select([flat, models == "trend"], [2, 4], 5)
    with np.errstate(divide="ignore", invalid="ignore"):
        det = ll * bb - lb * lb
        level0 = np.where(flat, -yl / ll, (yb * lb - yl * bb) / det)
        trend0 = np.where(flat, 0.0, (yl * lb - yb * ll) / det)
        sse = np.maximum(0.0, yy + level0 * yl + trend0 * yb)
        k = size + 1
        n = sizes[:, None]
        usable = (n - k - 1 > 0) & np.isfinite(sse)
        sse = np.where(sse <= 1e-12 * np.maximum(yy, 1e-300), 0.0, sse)
        aicc = n * np.log(sse) + 2 * k + 2 * k * (k + 1) / (n - k - 1)
    aicc = np.where(usable, aicc, np.inf)
    quickest = np.where(flat, grid[..., 0], -1.0).argmax(axis=1)
    best = np.where(usable.any(axis=1), aicc.argmin(axis=1), quickest)
    pick = np.arange(len(sizes)), best
    l0, b0 = np.nan_to_num(level0[pick]), np.nan_to_num(trend0[pick])
    level, slope = (
        base + s[0][pick] + l0 * s[1][pick] + b0 * s[2][pick] for base, s in zip((first, 0.0), states)
    )
    row = np.arange(len(sizes)) if len(grid) > 1 else np.zeros(len(sizes), int)
    alpha, beta, phi = grid[row, best].T
    return pd.DataFrame(
        {
            "model": models[row, best], "alpha": alpha, "beta": beta, "phi": phi,
            "parameters": np.broadcast_to(size, grid.shape[:2])[row, best], "n": sizes, "level": level, "trend": slope,
            "sse": sse[pick], "aicc": aicc[pick], "start_level": l0, "start_trend": b0,
        }
    )


def _around(fits: pd.DataFrame, halving: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidates around each series' own: one step of alpha, share and phi either way, where the model has them."""
    alpha, beta, phi = (fits[c].to_numpy()[:, None] for c in ("alpha", "beta", "phi"))
    model = fits["model"].to_numpy()[:, None]
    moves = np.array(np.meshgrid([-1, 0, 1], [-1, 0, 1], [-1, 0, 1], indexing="ij")).reshape(3, -1) / 2**halving
    near = [
        np.clip(value + move * step, *bounds)
        for value, move, step, bounds in zip((alpha, beta / alpha, phi), moves, STEPS, BOUNDS)
    ]
    a = near[0]
    b = np.where(model == "simple", 0.0, a * near[1])
    f = np.where(model == "damped", near[2], phi)
    return np.stack([a, b, f], axis=2), np.broadcast_to(model, a.shape)


def _residuals(y: np.ndarray, fits: pd.DataFrame) -> np.ndarray:
    """One-step errors of every series (rows of ``y``, padded) under its own model."""
    alpha, beta, phi, level, slope = (fits[c].to_numpy() for c in ("alpha", "beta", "phi", "start_level", "start_trend"))
    out = np.empty_like(y)
    for t in range(y.shape[1]):
        expected = level + phi * slope
        out[:, t] = y[:, t] - expected
        level, slope = expected + alpha * out[:, t], phi * slope + beta * out[:, t]
    return out


def _refined(near: pd.DataFrame, fit: pd.DataFrame) -> pd.DataFrame:
    """The better of both choices; a series too short for any candidate, or fitted without error, keeps its first one."""
    return near.where(np.isfinite(fit["aicc"]) & (near["aicc"] <= fit["aicc"]), fit)


def _padded(values: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Series as rows relative to their first values, their lengths, and these values."""
    part = [np.asarray(v, dtype=float) for v in values]
    sizes = np.array([len(v) for v in part])
    padded = np.zeros((len(part), sizes.max(initial=1)))
    for row, v in zip(padded, part):
        row[: len(v)] = v - v[0]
    return padded, sizes, np.array([v[0] for v in part])


def _fit_all(values: pd.Series, grid: list[Smoothing], refine: int = 0, block: int = 500) -> pd.DataFrame:
    """Fits of a batch of arrays, some hundred series at a time."""
    weights, models = _as_arrays(grid)
    fits = []
    for begin in range(0, len(values), block):
        padded, sizes, first = _padded(list(values.iloc[begin : begin + block]))
        fit = _choose(padded, sizes, first, weights, models)
        for halving in range(1, refine + 1):
            fit = _refined(_choose(padded, sizes, first, *_around(fit, halving)), fit)
        fit["residuals"] = [r[:n] for r, n in zip(_residuals(padded, fit), sizes)]
        fits.append(fit.drop(columns=["start_level", "start_trend"]))
    return pd.concat(fits, ignore_index=True)


def _as_arrays(grid: list[Smoothing]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([[g[1:] for g in grid]]), np.array([[g.model for g in grid]], dtype=object)


def fit_prefixes(values: list, grid: list[Smoothing], refine: int = 0, block: int = 100) -> list[pd.DataFrame]:
    """For each array the fits of all its prefixes, one row per length from 1 on, as if each were fitted alone.

    Prefixes share their recursions: the states after a step are the fit of the prefix that ends there, so a candidate runs over a series once
    for all prefixes that try it. Neighbouring prefixes mostly choose alike, so refinement too runs once per distinct choice.
    """
    weights, models = _as_arrays(grid)
    out = []
    for begin in range(0, len(values), block):
        padded, sizes, first = _padded(values[begin : begin + block])
        series = np.repeat(np.arange(len(sizes)), sizes)
        length = np.concatenate([np.arange(1, n + 1) for n in sizes])
        steps = []
        for t, (states, products) in enumerate(_steps(padded, sizes, weights), 1):
            live = np.flatnonzero(sizes >= t)
            found = _judged(states[:, :, live], products[:, live], np.full(len(live), t), first[live], weights, models)
            steps.append(found.assign(series=live))
        fit = pd.concat(steps, ignore_index=True).sort_values(["series", "n"], kind="stable", ignore_index=True)
        for halving in range(1, refine + 1):
            choice = fit.groupby(["series", "model", "alpha", "beta", "phi"], sort=False)
            run = choice.ngroup().to_numpy()
            heads = choice.head(1)
            own = heads["series"].to_numpy()
            around, kinds = _around(heads, halving)
            # A run ends with the longest prefix that made its choice.
            until = np.zeros(len(own), int)
            np.maximum.at(until, run, length)
            at_step = pd.Series(np.arange(len(fit))).groupby(length).indices
            near = []
            for t, (states, products) in enumerate(_steps(padded[own], until, around), 1):
                wanted = at_step.get(t)
                if wanted is not None:
                    rows = run[wanted]
                    candidates, names = around[rows], kinds[rows]
                    if len(rows) == 1:  # a single row of candidates counts as one for all, which is the same
                        candidates, names = candidates[:1], names[:1]
                    found = _judged(states[:, :, rows], products[:, rows], np.full(len(rows), t), first[own[rows]], candidates, names)
                    near.append(found.assign(series=series[wanted]).set_index(wanted))
            near = pd.concat(near).sort_index()
            fit = _refined(near[fit.columns], fit)
        out += [part.drop(columns="series").reset_index(drop=True) for _, part in fit.groupby("series")]
    return out


def select_smoothing(
    df: DataFrame, keys: list[str], grid: Iterable[Smoothing] | None = None, refine: int | None = None
) -> DataFrame:
    """Fit the array column ``y`` by the candidate of least AICc.

    The best cell of the grid is refined ``refine`` times: the candidates one step around the last choice are tried, with
    steps that halve each time, and AICc never grows. By default the own grid is refined three times, a given one
    not at all. Trying a grid in a JVM fold costs one interpreted step per candidate and
    month; arrays over the grid and over a batch of series share that cost.
    """
    candidates = list(grid or default_grid())
    passes = (0 if grid else 3) if refine is None else refine

    @F.pandas_udf(FIT_SCHEMA)
    def fit(y: pd.Series) -> pd.DataFrame:
        return _fit_all(y, candidates, passes)

    return spread(df, *keys).withColumn("_fit", fitted_once(fit)("y")).select(*df.columns, "_fit.*")


def smoothing_forecast(fits: DataFrame, keys: list[str], h: int) -> DataFrame:
    """Mean and 80/95 % intervals for 1..h steps after the end of each fitted series."""
    steps = fits.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(h))))
    phi, k = F.col("phi"), F.col("h")

    def damping(j: Column) -> Column:
        """phi + phi^2 + ... + phi^j."""
        return F.when(phi == 1.0, j.cast("double")).otherwise(ratio(phi * (1 - F.pow(phi, j)), 1 - phi))

    mean = F.col("level") + damping(k) * F.col("trend")
    earlier = F.sequence(F.lit(0), k - 1)

    def squared_weight(total: Column, j: Column) -> Column:
        weight = F.col("alpha") + F.col("beta") * damping(j)
        return total + F.when(j > 0, weight * weight).otherwise(1.0)

    factor = F.aggregate(earlier, F.lit(0.0), squared_weight)
    sigma2 = F.when(F.col("n") > F.col("parameters"), ratio(F.col("sse"), F.col("n") - F.col("parameters")))
    return with_intervals(steps, mean, sigma2 * factor).select(
        *keys, "last_period", "model", "h", "mean", "lo80", "hi80", "lo95", "hi95"
    )
