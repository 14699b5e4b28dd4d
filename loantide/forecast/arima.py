"""ARIMA with order selection, fitted by conditional least squares or exact likelihood.

Differences by the KPSS level test, orders by AICc over a small grid (Hyndman & Khandakar 2008). Conditional weights come
by Gauss-Newton on the one-step errors; values before the start count as zero after centring, so all orders share one
sample. Exact ones start there and maximise the likelihood of :mod:`.likelihood`.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .likelihood import Filtered, maximised
from .series import fitted_once, spread, with_intervals

# Fixed value: 5 % point of the KPSS statistic around a level.
KPSS_LEVEL_5 = 0.463

FIT_SCHEMA = (
    "p int, d int, q int, constant double, ar array<double>, ma array<double>, parameters int, "
    "sigma2 double, aicc double, residuals array<double>, mean array<double>, variance array<double>"
)


def kpss(x: np.ndarray) -> float:
    """KPSS statistic around a level, with Bartlett weights."""
    n = len(x)
    e = x - x.mean()
    lags = int(3 * np.sqrt(n) / 13)
    variance = e @ e / n
    for j in range(1, lags + 1):
        variance += 2 * (1 - j / (lags + 1)) * (e[j:] @ e[:-j]) / n
    return float((np.cumsum(e) ** 2).sum() / (n * n * variance)) if variance > 0 else 0.0


def differences_needed(y: np.ndarray, at_most: int = 2) -> int:
    """Differences until the KPSS test accepts a level.

    The statistic says nothing about four values or fewer, so a series is not differenced once it is that short;
    a constant one never is.
    """
    d = 0
    while d < at_most and len(y) > 4 and np.ptp(y) > 0 and kpss(y) > KPSS_LEVEL_5:
        y, d = np.diff(y), d + 1
    return d


def _lagged(x: np.ndarray, k: int) -> np.ndarray:
    """Rows of ``x`` (steps x series) moved on by k steps."""
    out = np.zeros_like(x)
    out[k:] = x[: max(0, len(x) - k)]
    return out


def _filter(x: np.ndarray, ma: np.ndarray) -> np.ndarray:
    """``x`` (steps x series x any) over the moving-average polynomials ``ma`` (series x q), step by step for all series."""
    if not ma.shape[1]:
        return x
    out, weights = x.copy(), ma.reshape(ma.shape[:1] + (1,) * (x.ndim - 2) + ma.shape[1:])
    for t in range(1, len(x)):
        for j in range(1, min(t, ma.shape[1]) + 1):
            out[t] -= weights[..., j - 1] * out[t - j]
    return out


def _errors(past: np.ndarray, ar: np.ndarray, ma: np.ndarray) -> np.ndarray:
    """One-step errors (steps x series); ``past`` (lags x steps x series) holds the series and its lags."""
    return _filter(past[0] - np.einsum("its,si->ts", past[1:], ar), ma)


def _inside(weights: np.ndarray) -> np.ndarray:
    """Which rows 1 - w1 z - w2 z^2 ... keep their roots outside the unit circle.

    Steps the order down; every partial weight met on the way must be below one.
    """
    weights, inside = weights.copy(), np.ones(len(weights), bool)
    while weights.shape[1]:
        last, weights = weights[:, -1:], weights[:, :-1]
        inside &= np.abs(last[:, 0]) < 0.99
        safe = np.where(np.abs(last) < 0.99, last, 0.0)
        weights = (weights + safe * weights[:, ::-1]) / (1.0 - safe * safe)
    return inside


def gauss_newton(errors: np.ndarray, k: int, design, errors_at, inside, steps: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Weights (series x k, from zeros) and errors (steps x series) of least squares, with halved steps for all series at once.

    ``design(rows, errors, weights)`` gives the negated slopes (steps x rows x k), ``errors_at(rows, weights)`` the errors, ``inside(weights)``
    says which weights may be taken.
    """
    params, errors = np.zeros((errors.shape[1], k)), errors.copy()
    before = np.einsum("ts,ts->s", errors, errors)
    active = np.flatnonzero(before > 0) if k else np.zeros(0, int)
    for _ in range(steps):
        if not len(active):
            break
        now, own = errors[:, active], params[active]
        slopes = design(active, now, own)
        gram = np.einsum("tsi,tsj->sij", slopes, slopes)
        edge = np.arange(k)
        diagonal = gram[:, edge, edge]
        gram[:, edge, edge] = np.where(diagonal > 0, diagonal * (1 + 1e-10), 1.0) + 1e-12 * diagonal.max(axis=1, keepdims=True)
        move = np.linalg.solve(gram, np.einsum("tsi,ts->si", slopes, now)[..., None])[..., 0]
        last, open_ = before[active], np.arange(len(active))
        # The whole step first; where it does not improve, all halvings side by side, of which the longest that does counts.
        for halvings in (np.ones(1), 0.5 ** np.arange(1, 8)):
            trial = own[open_, None] + move[open_, None] * halvings[:, None]
            trial = trial.reshape(-1, k)
            tried = np.repeat(open_, len(halvings))
            fine = np.flatnonzero(inside(trial) & np.isfinite(trial).all(axis=1))
            trial, tried = trial[fine], tried[fine]
            after = errors_at(active[tried], trial)
            squares = np.einsum("ts,ts->s", after, after)
            better = np.flatnonzero(squares < before[active[tried]])
            moved, first = np.unique(tried[better], return_index=True)
            taken, done = better[first], active[moved]
            params[done], errors[:, done], before[done] = trial[taken], after[:, taken], squares[taken]
            left = np.ones(len(active), bool)
            left[moved] = False
            open_ = open_[left[open_]]
            if not len(open_):
                break
        active = active[last - before[active] > 1e-8 * last]
    return params, errors


def fit_arma_batch(x: np.ndarray, p: int, q: int, steps: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights and errors of centred series (steps x series), by Gauss-Newton.

    Shorter series stand at the end of their column with zeros before, which is what values before a start count as.
    """
    past = np.stack([_lagged(x, i) for i in range(p + 1)])

    def design(rows: np.ndarray, now: np.ndarray, own: np.ndarray) -> np.ndarray:
        slopes = [past[i][:, rows] for i in range(1, p + 1)] + [_lagged(now, j) for j in range(1, q + 1)]
        return _filter(np.stack(slopes, axis=2), own[:, p:])

    params, errors = gauss_newton(
        x, p + q, design,
        lambda rows, w: _errors(past[:, :, rows], w[:, :p], w[:, p:]),
        lambda w: _inside(w[:, :p]) & _inside(-w[:, p:]),
        steps,
    )
    return params[:, :p], params[:, p:], errors


def fit_arma(x: np.ndarray, p: int, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for one series."""
    ar, ma, errors = fit_arma_batch(np.asarray(x, float)[:, None], p, q)
    return ar[0], ma[0], errors[:, 0]


def _project(ends: np.ndarray, d: np.ndarray, centre: np.ndarray, ar: np.ndarray, ma: np.ndarray, x: np.ndarray, errors: np.ndarray, h: int):
    """Mean paths and cumulated squared error weights (series x h); ``ends`` holds the last value after 0, 1 and 2 differences."""
    rows, p, q = len(d), ar.shape[1], ma.shape[1]
    x = np.concatenate([np.zeros((p, rows)), x, np.zeros((h, rows))])
    e = np.concatenate([np.zeros((q, rows)), errors, np.zeros((h, rows))])
    for t in range(len(x) - h, len(x)):
        x[t] = sum((ar[:, i - 1] * x[t - i] for i in range(1, p + 1)), np.zeros(rows))
        s = len(e) - len(x) + t
        x[t] += sum((ma[:, j - 1] * e[s - j] for j in range(1, q + 1)), np.zeros(rows))
    path = x[len(x) - h :].T + centre[:, None]
    poly = np.concatenate([np.ones((rows, 1)), -ar, np.zeros((rows, 2))], axis=1)
    for level in (1, 0):
        needed = (d > level)[:, None]
        path = np.where(needed, ends[:, level, None] + np.cumsum(path, axis=1), path)
        poly = np.where(needed, poly - np.concatenate([np.zeros((rows, 1)), poly[:, :-1]], axis=1), poly)
    weights = np.zeros((rows, h))
    for k in range(h):
        own = np.ones(rows) if k == 0 else (ma[:, k - 1] if k <= q else np.zeros(rows))
        back = range(1, min(k, poly.shape[1] - 1) + 1)
        weights[:, k] = own - sum((poly[:, i] * weights[:, k - i] for i in back), np.zeros(rows))
    return path, np.cumsum(weights**2, axis=1)


def fit_block(values: list[np.ndarray], h: int, max_p: int = 5, max_q: int = 5, max_order: int = 5) -> pd.DataFrame:
    """Best models of many series and their h-step forecasts.

    Orders are those up to ``max_p`` and ``max_q`` with p + q up to ``max_order``; a constant is tried below two
    differences. An order needs more than max(3, parameters + 2) differenced values; a series too short for any is a
    random walk, a single value repeats itself.
    """
    rows = len(values)
    d = np.array([differences_needed(y) for y in values])
    parts = [np.diff(y, k) for y, k in zip(values, d)]
    n = np.array([len(w) for w in parts])
    longest = int(n.max())
    held = np.zeros((longest, rows))
    for i, w in enumerate(parts):
        held[longest - len(w) :, i] = w
    live = np.arange(longest)[:, None] >= longest - n
    mean = held.sum(axis=0) / n
    power = np.einsum("ts,ts->s", held, held)
    best = {
        "aicc": np.full(rows, np.inf), "p": np.zeros(rows, int), "q": np.zeros(rows, int), "constant": np.zeros(rows, bool),
        "ar": np.zeros((rows, max_p)), "ma": np.zeros((rows, max_q)), "errors": np.zeros((longest, rows)),
    }
    for constant in (True, False):
        x = np.where(live, held - mean, 0.0) if constant else held
        for p in range(max_p + 1):
            for q in range(min(max_q, max_order - p) + 1):
                k = p + q + constant + 1
                able = np.flatnonzero((n > max(3, k + 1)) & ((d < 2) | (not constant)))
                if not len(able):
                    continue
                ar, ma, errors = fit_arma_batch(x[:, able], p, q)
                m = n[able]
                sse = np.maximum(np.einsum("ts,ts->s", errors, errors), 1e-20 * (1.0 + power[able]))
                aicc = m * np.log(sse / m) + 2 * k + 2 * k * (k + 1) / (m - k - 1)
                won = aicc < np.where(np.isinf(best["aicc"][able]), np.inf, best["aicc"][able] - 1e-9)
                to = able[won]
                best["aicc"][to], best["p"][to], best["q"][to], best["constant"][to] = aicc[won], p, q, constant
                best["ar"][to], best["ma"][to] = 0.0, 0.0
                best["ar"][to, :p], best["ma"][to, :q], best["errors"][:, to] = ar[won], ma[won], errors[:, won]
    # Too short for any order: one difference, or none of a single value.
    for i in np.flatnonzero(np.isinf(best["aicc"])):
        d[i] = min(1, len(values[i]) - 1)
        w = np.diff(values[i], d[i])
        n[i] = len(w)
        best["errors"][:, i] = 0.0
        if d[i]:
            grown = max(longest, len(w))
            if grown > longest:
                pad = ((grown - longest, 0), (0, 0))
                held, best["errors"], longest = np.pad(held, pad), np.pad(best["errors"], pad), grown
            held[:, i] = 0.0
            held[longest - len(w) :, i] = best["errors"][longest - len(w) :, i] = w
    single = np.array([len(y) == 1 for y in values])
    centre = np.where(single, [y[0] for y in values], np.where(best["constant"], mean, 0.0))
    ends = np.array([[np.diff(y, k)[-1] if len(y) > k else 0.0 for k in (0, 1)] for y in values])
    live = np.arange(longest)[:, None] >= longest - n
    path, growth = _project(ends, d, centre, best["ar"], best["ma"], np.where(live, held - centre, 0.0), best["errors"], h)
    parameters = best["p"] + best["q"] + best["constant"]
    sigma2 = np.einsum("ts,ts->s", best["errors"], best["errors"]) / np.maximum(1, n - parameters)
    return pd.DataFrame(
        {
            "p": best["p"], "d": d, "q": best["q"], "constant": centre,
            "ar": [a[:k] for a, k in zip(best["ar"], best["p"])], "ma": [m[:k] for m, k in zip(best["ma"], best["q"])],
            "parameters": parameters, "sigma2": sigma2, "aicc": best["aicc"],
            "residuals": [best["errors"][longest - k :, i] for i, k in enumerate(n)],
            "mean": list(path), "variance": list(sigma2[:, None] * growth),
        }
    )


def fit_block_exactly(values: list[np.ndarray], h: int, max_p: int = 5, max_q: int = 5, max_order: int = 5) -> pd.DataFrame:
    """Like :func:`fit_block`, with weights, mean, variance and AICc of the exact likelihood.

    Series of one differenced length are filtered together. The rule for short series is the same; those too short for any order are fitted as
    there.
    """
    rows = len(values)
    d = np.array([differences_needed(y) for y in values])
    parts = [np.diff(y, k) for y, k in zip(values, d)]
    out = fit_block(values, h, max_p, max_q, max_order)
    best, chosen = np.full(rows, np.inf), {}
    n = np.array([len(w) for w in parts])
    for length in np.unique(n):
        same = np.flatnonzero(n == length)
        x = np.stack([parts[i] for i in same], axis=1)
        for constant in (True, False):
            centred = x - x.mean(axis=0) if constant else x
            for p in range(max_p + 1):
                for q in range(min(max_q, max_order - p) + 1):
                    k = p + q + constant + 1
                    able = np.flatnonzero((length > max(3, k + 1)) & ((d[same] < 2) | (not constant)) & ((x * x).sum(axis=0) > 0))
                    if not len(able):
                        continue
                    ar, ma, _ = fit_arma_batch(centred[:, able], p, q)
                    ar, ma, found = maximised(x[:, able], ar, ma, np.full(len(able), constant))
                    aicc = -2 * found.log_likelihood + 2 * k + 2 * k * (k + 1) / (length - k - 1)
                    path = found.path(h)
                    for j in np.flatnonzero(np.isfinite(aicc) & (aicc < best[same[able]] - 1e-9)):
                        i = same[able[j]]
                        best[i] = aicc[j]
                        mean, variance = _integrated(values[i], int(d[i]), path[j], ar[j], ma[j], found.sigma2[j])
                        chosen[i] = {
                            "p": p, "q": q, "constant": found.mean[j], "ar": ar[j], "ma": ma[j], "parameters": p + q + constant,
                            "sigma2": found.sigma2[j], "aicc": aicc[j], "residuals": found.errors[:, j], "mean": mean, "variance": variance,
                        }
    rows = out.to_dict("records")
    return pd.DataFrame([row | chosen.get(i, {}) for i, row in enumerate(rows)], columns=out.columns)


def _integrated(y: np.ndarray, d: int, path: np.ndarray, ar: np.ndarray, ma: np.ndarray, sigma2: float) -> tuple[np.ndarray, np.ndarray]:
    """Means and variances of the values from means of their differences."""
    ends = np.array([[np.diff(y, k)[-1] if len(y) > k else 0.0 for k in (0, 1)]])
    nothing = np.zeros((1, 1))
    _, growth = _project(ends, np.array([d]), np.zeros(1), ar[None], ma[None], nothing, nothing, len(path))
    for level in range(d - 1, -1, -1):
        path = ends[0, level] + np.cumsum(path)
    return path, sigma2 * growth[0]


def exact_likelihood(df: DataFrame, keys: list[str], ar: list[float], ma: list[float], d: int = 0, mean: bool = True) -> DataFrame:
    """Exact log-likelihood of the array column ``y``, differenced ``d`` times, under given weights: n, constant, sigma2, log_likelihood.

    The mean (0 if ``mean`` is false) and variance are those of greatest likelihood. Series with fewer than two differenced values give NULLs.
    """

    @F.pandas_udf("n int, constant double, sigma2 double, log_likelihood double")
    def run(values: pd.Series) -> pd.DataFrame:
        rows = []
        for y in values:
            x = np.diff(np.asarray(y, float), d)
            if len(x) < 2:
                rows.append((len(x), None, None, None))
                continue
            found = Filtered(x[:, None], np.array([ar], float), np.array([ma], float), np.array([mean]))
            rows.append((len(x), found.mean[0], found.sigma2[0], found.log_likelihood[0]))
        return pd.DataFrame(rows, columns=["n", "constant", "sigma2", "log_likelihood"])

    return spread(df, *keys, per_core=1).withColumn("_fit", fitted_once(run)("y")).select(*df.columns, "_fit.*")


#: How weights are found.
METHODS = {"conditional": fit_block, "exact": fit_block_exactly}


def fit_all(
    values: pd.Series, h: int, max_p: int = 5, max_q: int = 5, max_order: int = 5, block: int = 500, method: str = "conditional"
) -> pd.DataFrame:
    """Fits of a batch of arrays, some hundred series at a time."""
    parts = [
        METHODS[method]([np.asarray(v, dtype=float) for v in values.iloc[at : at + block]], h, max_p, max_q, max_order)
        for at in range(0, len(values), block)
    ]
    return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=[f.split()[0] for f in FIT_SCHEMA.split(", ")])


def select_arima(
    df: DataFrame, keys: list[str], h: int, max_p: int = 5, max_q: int = 5, max_order: int = 5, method: str = "conditional"
) -> DataFrame:
    """Fit the array column ``y`` of every series, with forecast arrays ``mean`` and ``variance``; see :func:`fit_block`.

    ``method`` is ``conditional`` (least squares) or ``exact`` (likelihood).
    """

    @F.pandas_udf(FIT_SCHEMA)
    def fit(y: pd.Series) -> pd.DataFrame:
        return fit_all(y, h, max_p, max_q, max_order, method=method)

    return spread(df, *keys, per_core=1).withColumn("_fit", fitted_once(fit)("y")).select(*df.columns, "_fit.*")


def arima_forecast(fits: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and 80/95 % intervals, one row per step."""
    name = F.format_string("arima(%d,%d,%d)", "p", "d", "q").alias("model")
    steps = fits.select(*keys, "last_period", name, F.posexplode(F.arrays_zip("mean", "variance")))
    steps = steps.withColumn("h", F.col("pos") + 1)
    return with_intervals(steps, F.col("col.mean"), F.col("col.variance")).drop("pos", "col")
