"""Exact Gaussian likelihood of ARMA models by a Kalman filter, for many series at once.

The state holds the next value and what is already known of those after it (Harvey 1989, ch. 3; Gardner, Harvey & Phillips 1980). It starts from its stationary
distribution, so no value before the first is assumed; a differenced series has the likelihood of its differences, which is that of a diffuse
start. The error variance and, where asked for, the mean are profiled out: the filter is linear, so it runs on the values and on ones side by side.
"""

from __future__ import annotations

import numpy as np


def weights_of(free: np.ndarray) -> np.ndarray:
    """Weights w of 1 - w1 z - w2 z^2 ... with all roots outside the unit circle, from any real numbers, row by row.

    Hyperbolic tangents are taken as partial autocorrelations and stepped up (Monahan 1984).
    """
    out = np.zeros_like(free)
    for k in range(free.shape[1]):
        last = np.tanh(free[:, k : k + 1])
        out[:, :k] = out[:, :k] - last * out[:, :k][:, ::-1]
        out[:, k : k + 1] = last
    return out


def free_of(weights: np.ndarray) -> np.ndarray:
    """The inverse of :func:`weights_of`; weights on or beyond the circle are drawn inside first."""
    weights, free = weights.copy(), np.zeros_like(weights)
    for k in range(weights.shape[1] - 1, -1, -1):
        last = np.clip(weights[:, k : k + 1], -0.985, 0.985)
        free[:, k : k + 1] = np.arctanh(last)
        weights[:, :k] = (weights[:, :k] + last * weights[:, :k][:, ::-1]) / (1 - last * last)
    return free


def _moved(x: np.ndarray, ar: np.ndarray) -> np.ndarray:
    """The transition applied to the rows of ``x`` (series x states x any)."""
    out = ar[:, :, None] * x[:, :1]
    out[:, :-1] += x[:, 1:]
    return out


def stationary(ar: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """Covariance P = T P T' + R R' of the state, by doubling: each step squares the transition."""
    states = ar.shape[1]
    power = np.zeros((len(ar), states, states))
    power[:, :, 0] = ar
    power[:, np.arange(states - 1), np.arange(1, states)] = 1.0
    total = noise[:, :, None] * noise[:, None, :]
    for _ in range(40):
        more = power @ total @ power.transpose(0, 2, 1)
        total = total + more
        power = power @ power
        if np.abs(more).max(initial=0.0) <= 1e-15 * np.abs(total).max(initial=1.0):
            break
    return total


class Filtered:
    """Log-likelihood, variance, mean, one-step errors (steps x series) with their relative variances, and the last predicted state."""

    def __init__(self, x: np.ndarray, ar: np.ndarray, ma: np.ndarray, with_mean: np.ndarray) -> None:
        """``x`` is steps x series of one length; ``ar`` and ``ma`` have a row per series; ``with_mean`` says which means are estimated."""
        steps, series = x.shape
        states = max(ar.shape[1], ma.shape[1] + 1)
        phi = np.zeros((series, states))
        phi[:, : ar.shape[1]] = ar
        noise = np.zeros((series, states))
        noise[:, 0], noise[:, 1 : 1 + ma.shape[1]] = 1.0, ma
        spread = noise[:, :, None] * noise[:, None, :]
        p, a = stationary(phi, noise), np.zeros((series, states, 2))
        errors, variances = np.empty((steps, series, 2)), np.empty((steps, series))
        steady = False
        for t in range(steps):
            f = p[:, 0, 0]
            variances[t] = f
            errors[t, :, 0], errors[t, :, 1] = x[t], 1.0
            errors[t] -= a[:, 0]
            if not steady:
                gain = p[:, :, 0] / f[:, None]
            a = _moved(a + gain[:, :, None] * errors[t][:, None, :], phi)
            if not steady:
                held = p - gain[:, :, None] * p[:, :1]
                after = _moved(_moved(held, phi).transpose(0, 2, 1), phi) + spread
                steady = bool(np.abs(after - p).max(initial=0.0) < 1e-14)
                p = after
        own, ones = errors[..., 0], errors[..., 1]
        self.mean = np.where(with_mean, (own * ones / variances).sum(axis=0) / (ones * ones / variances).sum(axis=0), 0.0)
        self.errors, self.variances = own - self.mean * ones, variances
        self.state = a[..., 0] - self.mean[:, None] * a[..., 1]
        self.phi = phi
        squares = (self.errors**2 / variances).sum(axis=0)
        scale = np.maximum((x * x).sum(axis=0), 1e-300)
        self.sigma2 = np.maximum(squares, 1e-20 * scale) / steps
        self.log_likelihood = -0.5 * (steps * (np.log(2 * np.pi * self.sigma2) + 1) + np.log(variances).sum(axis=0))

    def path(self, h: int) -> np.ndarray:
        """Means of the next ``h`` values (series x h)."""
        out, state = np.empty((len(self.phi), h)), self.state[:, :, None]
        for k in range(h):
            out[:, k] = state[:, 0, 0] + self.mean
            state = _moved(state, self.phi)
        return out


def maximised(
    x: np.ndarray, ar: np.ndarray, ma: np.ndarray, with_mean: np.ndarray, steps: int = 40
) -> tuple[np.ndarray, np.ndarray, Filtered]:
    """Weights of greatest likelihood near the given ones, and the filter at them, for all series at once.

    The search runs on unbounded numbers that :func:`weights_of` maps inside the circle.
    """
    p = ar.shape[1]

    def loss(u: np.ndarray, rows: np.ndarray) -> np.ndarray:
        found = Filtered(x[:, rows], weights_of(u[:, :p]), -weights_of(u[:, p:]), with_mean[rows]).log_likelihood
        return np.where(np.isfinite(found), -found, np.inf)

    u = lowest(loss, np.concatenate([free_of(ar), free_of(-ma)], axis=1), 1.0 / max(1, len(x)), steps)
    ar, ma = weights_of(u[:, :p]), -weights_of(u[:, p:])
    return ar, ma, Filtered(x, ar, ma, with_mean)


def lowest(loss, u: np.ndarray, scale: float, steps: int = 40) -> np.ndarray:
    """Numbers near ``u`` (series x k) of lowest ``loss(numbers, rows)``, for all series at once.

    Quasi-Newton steps (BFGS), the first ones of size ``scale`` times the slope; slopes by central differences, whole and halved steps tried side
    by side. A step is taken only where it improves.
    """
    u = u.copy()
    series, k = u.shape
    if k:
        value = loss(u, np.arange(series))
        curve = np.broadcast_to(np.eye(k) * scale, (series, k, k)).copy()
        slope = _slopes(loss, u, np.arange(series))
        active = np.arange(series)
        for _ in range(steps):
            if not len(active):
                break
            move = -(curve[active] @ slope[active][:, :, None])[:, :, 0]
            move *= np.minimum(1.0, 1.0 / np.maximum(np.abs(move).max(axis=1, keepdims=True), 1e-300))
            halves = 0.5 ** np.arange(8)
            trial = u[active, None] + move[:, None] * halves[:, None]
            values = loss(trial.reshape(-1, k), np.repeat(active, 8)).reshape(-1, 8)
            better = values < value[active, None] - 1e-12
            won = better.any(axis=1)
            pick = better.argmax(axis=1)
            rows = active[won]
            step = move[won] * halves[pick[won]][:, None]
            gained = value[rows] - values[won, pick[won]]
            u[rows], value[rows] = u[rows] + step, values[won, pick[won]]
            after = _slopes(loss, u[rows], rows) if len(rows) else slope[rows]
            change = after - slope[rows]
            slope[rows] = after
            along = np.einsum("si,si->s", step, change)
            for i in np.flatnonzero(along > 1e-12):
                s, g, r = step[i], change[i], rows[i]
                left = np.eye(k) - np.outer(s, g) / along[i]
                curve[r] = left @ curve[r] @ left.T + np.outer(s, s) / along[i]
            active = rows[gained > 1e-9 * (1.0 + np.abs(value[rows]))]
    return u


def _slopes(loss, u: np.ndarray, rows: np.ndarray, width: float = 1e-5) -> np.ndarray:
    k = u.shape[1]
    moves = np.concatenate([np.eye(k), -np.eye(k)]) * width
    values = loss((u[:, None] + moves).reshape(-1, k), np.repeat(rows, 2 * k)).reshape(-1, 2, k)
    with np.errstate(invalid="ignore"):
        return np.nan_to_num((values[:, 0] - values[:, 1]) / (2 * width), nan=0.0, posinf=0.0, neginf=0.0)
