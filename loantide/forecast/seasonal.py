"""Seasonal ARIMA models, the strength of a season, and the forecast that repeats the last one.

A model multiplies short polynomials by polynomials in the season's lag (Box & Jenkins 1970). A season is differenced where it is strong
beside the remainder of a classical decomposition (Wang, Smith & Hyndman 2006), then levels by the KPSS test. Orders are chosen by
AICc of conditional least squares; the chosen ones can be fitted again by exact likelihood.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import arima
from .arima import _inside, _lagged, differences_needed, gauss_newton
from .likelihood import Filtered, free_of, lowest, weights_of
from .series import fitted_once, spread, with_intervals

# Fixed value: strength above which a season is differenced.
STRONG = 0.64

FIT_SCHEMA = (
    "p int, d int, q int, sp int, sd int, sq int, season int, constant double, ar array<double>, ma array<double>, sar array<double>, "
    "sma array<double>, parameters int, sigma2 double, aicc double, residuals array<double>, mean array<double>, variance array<double>"
)


def season_strength(y: np.ndarray, season: int) -> float:
    """Share of the detrended variance that the season explains, 0 to 1.

    The trend is the centred moving average of one season (of two for an even one), the season the mean of what remains by position. Fewer than
    three seasons say nothing and give 0, as does a series without variance around its trend.
    """
    n = len(y)
    if season < 2 or n < 3 * season:
        return 0.0
    weights = np.ones(season) if season % 2 else np.r_[0.5, np.ones(season - 1), 0.5]
    half = season // 2
    rest = y[half : n - half] - np.convolve(y, weights / season, "valid")
    place = np.arange(half, n - half) % season
    means = np.bincount(place, rest, season) / np.bincount(place, minlength=season)
    left, whole = rest - means[place], rest - rest.mean()
    total = float(whole @ whole)
    # Rounding alone is no variance.
    return max(0.0, 1.0 - float(left @ left) / total) if total > 1e-18 * float(y @ y) else 0.0


def seasonal_differences_needed(y: np.ndarray, season: int) -> int:
    return int(season_strength(y, season) > STRONG)


def differenced(y: np.ndarray, d: int, sd: int, season: int) -> np.ndarray:
    for _ in range(sd):
        y = y[season:] - y[:-season]
    return np.diff(y, d)


def product(short: np.ndarray, long: np.ndarray, season: int) -> np.ndarray:
    """Weights w with 1 - w1 B - ... = (1 - short1 B - ...)(1 - long1 B^season - ...), row by row."""
    a, b = short.shape[1], long.shape[1]
    out = np.zeros((len(short), a + b * season))
    out[:, :a] = short
    for j in range(1, b + 1):
        out[:, j * season - 1] += long[:, j - 1]
        out[:, j * season : j * season + a] -= short * long[:, j - 1 : j]
    return out


def _times(x: np.ndarray, weights: np.ndarray, lag: int) -> np.ndarray:
    """``x`` (steps x series) times 1 - w1 B^lag - ..., values before the start being zero."""
    out = x.copy()
    for j in range(1, weights.shape[1] + 1):
        out -= weights[:, j - 1] * _lagged(x, j * lag)
    return out


def _over(x: np.ndarray, weights: np.ndarray, lag: int) -> np.ndarray:
    """``x`` (steps x series) over 1 + w1 B^lag + ..., ``lag`` steps at a time."""
    out = x.copy()
    for at in range(lag, len(x) if weights.shape[1] else 0, lag):
        stretch = out[at : at + lag]
        for j in range(1, min(weights.shape[1], at // lag) + 1):
            stretch -= weights[:, j - 1] * out[at - j * lag : at - j * lag + len(stretch)]
    return out


class _Order:
    """Numbers of weights, and where each kind stands in a row of all of them."""

    def __init__(self, p: int, q: int, sp: int, sq: int, season: int) -> None:
        self.p, self.q, self.sp, self.sq, self.season = p, q, sp, sq, season
        self.k = p + sp + q + sq

    def split(self, w: np.ndarray) -> list[np.ndarray]:
        """Short and seasonal autoregression, short and seasonal moving average."""
        return np.split(w, np.cumsum([self.p, self.sp, self.q]), axis=1)

    def errors(self, x: np.ndarray, w: np.ndarray) -> np.ndarray:
        ar, sar, ma, sma = self.split(w)
        return _over(_over(_times(_times(x, ar, 1), sar, self.season), ma, 1), sma, self.season)

    def products(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ar, sar, ma, sma = self.split(w)
        return product(ar, sar, self.season), -product(-ma, -sma, self.season)

    def inside(self, w: np.ndarray) -> np.ndarray:
        ar, sar, ma, sma = self.split(w)
        return _inside(ar) & _inside(sar) & _inside(-ma) & _inside(-sma)

    def slopes(self, x: np.ndarray, errors: np.ndarray, w: np.ndarray) -> np.ndarray:
        ar, sar, ma, sma = self.split(w)
        m = self.season
        apart = _over(_over(x, ma, 1), sma, m)
        short, long = _times(apart, sar, m), _times(apart, ar, 1)
        shocks, seasonal = _over(errors, ma, 1), _over(errors, sma, m)
        return np.stack(
            [_lagged(short, i) for i in range(1, self.p + 1)] + [_lagged(long, i * m) for i in range(1, self.sp + 1)]
            + [_lagged(shocks, j) for j in range(1, self.q + 1)] + [_lagged(seasonal, j * m) for j in range(1, self.sq + 1)],
            axis=2,
        )

    def free(self, w: np.ndarray) -> np.ndarray:
        ar, sar, ma, sma = self.split(w)
        return np.concatenate([free_of(ar), free_of(sar), free_of(-ma), free_of(-sma)], axis=1)

    def weights(self, u: np.ndarray) -> np.ndarray:
        ar, sar, ma, sma = self.split(u)
        return np.concatenate([weights_of(ar), weights_of(sar), -weights_of(ma), -weights_of(sma)], axis=1)


def fit_batch(x: np.ndarray, order: _Order) -> tuple[np.ndarray, np.ndarray]:
    """Weights (series x k) and errors of centred series (steps x series) by conditional least squares, padded in front with zeros."""
    return gauss_newton(
        x, order.k, lambda rows, now, w: order.slopes(x[:, rows], now, w), lambda rows, w: order.errors(x[:, rows], w), order.inside
    )


def fit_exactly(x: np.ndarray, order: _Order, weights: np.ndarray, with_mean: np.ndarray) -> tuple[np.ndarray, Filtered]:
    """Weights of greatest exact likelihood near the given ones, for series of one length."""

    def at(u: np.ndarray, rows: np.ndarray) -> Filtered:
        return Filtered(x[:, rows], *order.products(order.weights(u)), with_mean[rows])

    def loss(u: np.ndarray, rows: np.ndarray) -> np.ndarray:
        found = at(u, rows).log_likelihood
        return np.where(np.isfinite(found), -found, np.inf)

    u = lowest(loss, order.free(weights), 1.0 / max(1, len(x)))
    return order.weights(u), at(u, np.arange(x.shape[1]))


def _path(w: np.ndarray, errors: np.ndarray, centre: float, ar: np.ndarray, ma: np.ndarray, h: int) -> np.ndarray:
    """Means of the next ``h`` differenced values."""
    x = np.concatenate([np.zeros(len(ar)), w - centre, np.zeros(h)])
    e = np.concatenate([np.zeros(len(ma)), errors, np.zeros(h)])
    for t in range(h, 0, -1):
        x[-t] = ar @ x[len(x) - t - len(ar) : len(x) - t][::-1] + ma @ e[len(e) - t - len(ma) : len(e) - t][::-1]
    return x[len(x) - h :] + centre


def _undone(y: np.ndarray, path: np.ndarray, d: int, sd: int, season: int) -> np.ndarray:
    """Means of the values from means of their differences."""
    inner = differenced(y, 0, sd, season)
    for level in range(d - 1, -1, -1):
        path = np.diff(inner, level)[-1] + np.cumsum(path)
    for _ in range(sd):
        whole = np.concatenate([y[-season:], path])
        for k in range(len(path)):
            whole[season + k] += whole[k]
        path = whole[season:]
    return path


def _growth(ar: np.ndarray, ma: np.ndarray, d: int, sd: int, season: int, h: int) -> np.ndarray:
    """Cumulated squared weights of the errors in the next ``h`` values."""
    poly = np.r_[1.0, -ar]
    for _ in range(d):
        poly = np.convolve(poly, [1.0, -1.0])
    for _ in range(sd):
        poly = np.convolve(poly, np.r_[1.0, np.zeros(season - 1), -1.0])
    weights = np.zeros(h)
    for k in range(h):
        back = min(k, len(poly) - 1)
        own = 1.0 if k == 0 else (ma[k - 1] if k <= len(ma) else 0.0)
        weights[k] = own - poly[1 : back + 1] @ weights[k - back : k][::-1]
    return np.cumsum(weights**2)


def fit_block(
    values: list[np.ndarray], h: int, season: int, max_p: int = 2, max_q: int = 2, max_sp: int = 1, max_sq: int = 1, max_order: int = 4,
    method: str = "conditional",
) -> pd.DataFrame:
    """Best seasonal models of many series and their h-step forecasts.

    All orders up to the bounds are tried, with a constant where at most one difference is taken in all. An order needs more than max(3, parameters + 2)
    differenced values, a seasonal weight as many more as it looks back. A series too short for any is a random walk, a single value repeats
    itself, as in :func:`.arima.fit_block`. With ``method`` exact the order found is fitted again by exact likelihood, which then gives mean, variance and AICc.
    """
    rows = len(values)
    sd = np.array([seasonal_differences_needed(y, season) for y in values], int)
    d = np.array([differences_needed(differenced(y, 0, s, season)) for y, s in zip(values, sd)], int)
    parts = [differenced(y, a, b, season) for y, a, b in zip(values, d, sd)]
    n = np.array([len(w) for w in parts])
    longest = int(n.max())
    held = np.zeros((longest, rows))
    for i, w in enumerate(parts):
        held[longest - len(w) :, i] = w
    live = np.arange(longest)[:, None] >= longest - n
    mean = held.sum(axis=0) / np.maximum(n, 1)
    power = np.einsum("ts,ts->s", held, held)
    best, chosen = np.full(rows, np.inf), [None] * rows
    for constant in (True, False):
        x = np.where(live, held - mean, 0.0) if constant else held
        for sp in range(max_sp + 1):
            for sq in range(max_sq + 1):
                for p in range(max_p + 1):
                    for q in range(max_q + 1):
                        k = p + q + sp + sq + constant + 1
                        if p + q + sp + sq > max_order:
                            continue
                        able = np.flatnonzero((n > max(3, k + 1) + season * max(sp, sq)) & ((d + sd < 2) | (not constant)))
                        if not len(able):
                            continue
                        order = _Order(p, q, sp, sq, season)
                        weights, errors = fit_batch(x[:, able], order)
                        m = n[able]
                        sse = np.maximum(np.einsum("ts,ts->s", errors, errors), 1e-20 * (1.0 + power[able]))
                        aicc = m * np.log(sse / m) + 2 * k + 2 * k * (k + 1) / (m - k - 1)
                        for j in np.flatnonzero(aicc < best[able] - 1e-9):
                            i = able[j]
                            best[i], chosen[i] = aicc[j], (order, constant, weights[j], errors[longest - n[i] :, j])
    exact = _refitted(parts, chosen) if method == "exact" else {}
    return pd.DataFrame(
        [
            _short(values[i], h, season) if chosen[i] is None
            else _fitted(values[i], parts[i], int(d[i]), int(sd[i]), h, mean[i], best[i], *chosen[i], exact.get(i))
            for i in range(rows)
        ],
        columns=[f.split()[0] for f in FIT_SCHEMA.split(", ")],
    )


def _refitted(parts: list[np.ndarray], chosen: list) -> dict[int, tuple]:
    """Weights, mean, variance, log-likelihood, errors and filter position by series; those of one order and length are filtered together."""
    groups: dict[tuple, list[int]] = {}
    for i, found in enumerate(chosen):
        if found is not None and np.any(parts[i] - parts[i].mean()):
            order, constant = found[:2]
            groups.setdefault((len(parts[i]), order.p, order.q, order.sp, order.sq, constant), []).append(i)
    out = {}
    for (_, *_, constant), same in groups.items():
        order = chosen[same[0]][0]
        x = np.stack([parts[i] for i in same], axis=1)
        weights, found = fit_exactly(x, order, np.stack([chosen[i][2] for i in same]), np.full(len(same), constant))
        for j, i in enumerate(same):
            if np.isfinite(found.log_likelihood[j]):
                out[i] = (weights[j], found, j)
    return out


def _fitted(y, w, d, sd, h, mean, aicc, order, constant, weights, errors, exact) -> dict:
    parameters = order.k + constant
    if exact is None:
        centre = float(mean) if constant else 0.0
        sigma2 = float(errors @ errors) / max(1, len(w) - parameters)
    else:
        weights, found, j = exact
        centre, sigma2, errors = found.mean[j], found.sigma2[j], found.errors[:, j]
        k = parameters + 1
        aicc = -2 * found.log_likelihood[j] + 2 * k + 2 * k * (k + 1) / (len(w) - k - 1)
    ar, ma = (a[0] for a in order.products(weights[None]))
    path = _path(w, errors, centre, ar, ma, h) if exact is None else found.path(h)[j]
    parts = [a[0] for a in order.split(weights[None])]
    return {
        "p": order.p, "d": d, "q": order.q, "sp": order.sp, "sd": sd, "sq": order.sq, "season": order.season, "constant": centre,
        "ar": parts[0], "sar": parts[1], "ma": parts[2], "sma": parts[3], "parameters": parameters, "sigma2": sigma2, "aicc": aicc,
        "residuals": errors, "mean": _undone(y, path, d, sd, order.season), "variance": sigma2 * _growth(ar, ma, d, sd, order.season, h),
    }


def _short(y: np.ndarray, h: int, season: int) -> dict:
    row = arima.fit_block([y], h, 0, 0, 0).to_dict("records")[0]
    return row | {"sp": 0, "sd": 0, "sq": 0, "season": season, "sar": [], "sma": []}


def select_seasonal_arima(
    df: DataFrame, keys: list[str], h: int, season: int = 12, max_p: int = 2, max_q: int = 2, max_sp: int = 1, max_sq: int = 1,
    max_order: int = 4, method: str = "conditional", block: int = 500,
) -> DataFrame:
    """Fit the array column ``y`` of every series, with forecast arrays ``mean`` and ``variance``; see :func:`fit_block`.

    ``season`` is the number of periods that make up one. Series are shared over all cores and fitted in Arrow batches.
    """
    if season < 2:
        raise ValueError("a season has two periods or more")

    @F.pandas_udf(FIT_SCHEMA)
    def fit(values: pd.Series) -> pd.DataFrame:
        found = [
            fit_block([np.asarray(v, float) for v in values.iloc[at : at + block]], h, season, max_p, max_q, max_sp, max_sq, max_order, method)
            for at in range(0, len(values), block)
        ]
        return pd.concat(found, ignore_index=True) if found else pd.DataFrame(columns=[f.split()[0] for f in FIT_SCHEMA.split(", ")])

    return spread(df, *keys, per_core=1).withColumn("_fit", fitted_once(fit)("y")).select(*df.columns, "_fit.*")


def seasonal_arima_forecast(fits: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and 80/95 % intervals, one row per step."""
    name = F.format_string("arima(%d,%d,%d)(%d,%d,%d)[%d]", "p", "d", "q", "sp", "sd", "sq", "season").alias("model")
    steps = fits.select(*keys, "last_period", name, F.posexplode(F.arrays_zip("mean", "variance")))
    steps = steps.withColumn("h", F.col("pos") + 1)
    return with_intervals(steps, F.col("col.mean"), F.col("col.variance")).drop("pos", "col")


def with_season_strength(df: DataFrame, keys: list[str], season: int = 12) -> DataFrame:
    """``strength`` of the season in the array column ``y`` and whether it is to be ``differenced``; see :func:`season_strength`."""

    @F.pandas_udf("double")
    def strength(values: pd.Series) -> pd.Series:
        return pd.Series([season_strength(np.asarray(v, float), season) for v in values], dtype=float)

    found = spread(df, *keys, per_core=1).withColumn("strength", fitted_once(strength)("y"))
    return found.withColumn("differenced", F.col("strength") > STRONG)


def seasonal_errors(
    df: DataFrame, keys: list[str], ar: Sequence[float] = (), sar: Sequence[float] = (), ma: Sequence[float] = (), sma: Sequence[float] = (),
    d: int = 0, sd: int = 0, season: int = 12,
) -> DataFrame:
    """One-step errors of the array column ``y`` under given weights, as array ``residuals`` of the differenced values, those before the first being zero.

    A series that the differences use up has an empty array.
    """
    order = _Order(len(ar), len(ma), len(sar), len(sma), season)
    weights = np.array([[*ar, *sar, *ma, *sma]], float)

    @F.pandas_udf("array<double>")
    def run(values: pd.Series) -> pd.Series:
        parts = [differenced(np.asarray(y, float), d, sd, season) for y in values]
        return pd.Series([order.errors(w[:, None], weights)[:, 0] for w in parts])

    return spread(df, *keys, per_core=1).withColumn("residuals", fitted_once(run)("y"))


def seasonal_step(value: str, series: Sequence[str], period: str, season: int = 12) -> Column:
    """``value`` less that of one season before in the series, NULL in the first season."""
    order = Window.partitionBy(*series).orderBy(period)
    return F.col(value) - F.lag(value, season).over(order)


def seasonal_naive(df: DataFrame, keys: list[str], h: int, season: int = 12) -> DataFrame:
    """The last season of the array column ``y`` repeated, with 80/95 % intervals, one row per step.

    The variance is the mean square of the seasonal steps, once per season begun. Series shorter than a season repeat
    their last value; those without a seasonal step have no interval.
    """
    n, step = F.size("y"), F.col("h")
    span = F.when(n >= season, F.lit(season)).otherwise(F.lit(1))
    squares = F.aggregate(
        F.sequence(F.lit(season + 1), n),
        F.lit(0.0),
        lambda a, t: a + F.pow(F.element_at("y", t.cast("int")) - F.element_at("y", (t - season).cast("int")), F.lit(2)),
    )
    known = df.where(n > 0).select(*keys, "last_period", "y", F.when(n > season, squares / (n - season)).alias("_square"))
    steps = known.select("*", F.explode(F.sequence(F.lit(1), F.lit(h))).alias("h"))
    mean = F.element_at("y", (n - span + 1 + F.pmod(step - 1, span)).cast("int"))
    variance = F.col("_square") * (F.floor((step - 1) / season) + 1)
    return with_intervals(steps, mean, variance).drop("y", "_square")
