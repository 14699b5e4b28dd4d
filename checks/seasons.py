"""Seasonal models of monthly charge-offs and balances, one series per vehicle brand; a season is a year."""

from __future__ import annotations

from pyspark.sql import functions as F

from loantide.forecast import seasonal, states
from loantide.forecast.series import as_arrays
from loantide.operators.series import with_position
from loantide.schema import PERIOD

from .forecasts import B, BALANCE, CHARGED, MONTH, P, arrays, series_sql
from .panel import BRAND, monthly, monthly_sql
from .registry import check, rounded, rounded_means

YEAR = 12
FLOWS = f"""flows AS (
  SELECT {B}, {P}, CAST(row_number() OVER w AS INTEGER) AS t, {CHARGED} AS y, count(*) OVER (PARTITION BY {B}) AS n
  FROM monthly WINDOW w AS (PARTITION BY {B} ORDER BY {P})
)"""


def flows(spark, sf):
    return as_arrays(monthly(spark, sf, BRAND), [BRAND], PERIOD, CHARGED)


@check(
    monthly_sql(B), FLOWS,
    sql=f"""SELECT {B}, {MONTH}, t, CAST((t - 1) // {YEAR} + 1 AS INTEGER) AS cycle, CAST((t - 1) % {YEAR} + 1 AS INTEGER) AS position,
            round(y - lag(y, {YEAR}) OVER (PARTITION BY {B} ORDER BY {P}), 2) + 0.0 AS step FROM flows""",
)
def u03_season_positions(spark, sf):
    """Cycle and position within it, and the step from one season to the next."""
    months = with_position(monthly(spark, sf, BRAND), [BRAND], PERIOD)
    step = F.round(seasonal.seasonal_step(CHARGED, [BRAND], PERIOD, YEAR), 2) + F.lit(0.0)
    cycle, position = F.floor((F.col("t") - 1) / YEAR) + 1, F.pmod(F.col("t") - 1, F.lit(YEAR)) + 1
    return months.select(BRAND, PERIOD, "t", cycle.cast("int").alias("cycle"), position.cast("int").alias("position"), step.alias("step"))


@check(
    monthly_sql(B), FLOWS,
    f"""trended AS (
  SELECT *, (sum(y) OVER (w ROWS BETWEEN {YEAR // 2 - 1} PRECEDING AND {YEAR // 2 - 1} FOLLOWING)
             + (lag(y, {YEAR // 2}) OVER w + lead(y, {YEAR // 2}) OVER w) / 2) / {YEAR} AS trend
  FROM flows WINDOW w AS (PARTITION BY {B} ORDER BY t)
),
rest AS (SELECT {B}, t, y - trend AS e FROM trended WHERE trend IS NOT NULL),
apart AS (
  SELECT {B}, e - avg(e) OVER (PARTITION BY {B}, (t - 1) % {YEAR}) AS remainder, e - avg(e) OVER (PARTITION BY {B}) AS whole FROM rest
),
shares AS (SELECT {B}, sum(remainder * remainder) AS part, sum(whole * whole) AS total FROM apart GROUP BY 1),
lengths AS (SELECT {B}, count(*) AS n, sum(y * y) AS power FROM flows GROUP BY 1),
strengths AS (
  SELECT {B}, n, CASE WHEN n >= {3 * YEAR} AND total > 1e-18 * power THEN greatest(0, 1 - part / total) ELSE 0 END AS strength
  FROM lengths LEFT JOIN shares USING ({B})
)""",
    sql=f"""SELECT {B}, CAST(n AS INTEGER) AS n, round(CAST(strength AS DOUBLE), 6) + 0.0 AS strength, strength > {seasonal.STRONG} AS differenced
            FROM strengths""",
)
def f02_season_strength(spark, sf):
    found = seasonal.with_season_strength(flows(spark, sf), [BRAND], YEAR)
    return rounded(found.select(BRAND, F.size("y").alias("n"), "strength", "differenced"), 6, "strength")


WEIGHTS = {"ar": 0.5, "sar": 0.3, "ma": 0.4, "sma": -0.6}
# The errors so far travel along as a list, newest last; a value before the first counts as zero.
RECURSION = f"""
twice AS (
  SELECT {B}, t, x - lag(x) OVER (PARTITION BY {B} ORDER BY t) AS x
  FROM (SELECT {B}, t, y - lag(y, {YEAR}) OVER (PARTITION BY {B} ORDER BY t) AS x FROM series)
),
lagged AS (
  SELECT {B}, t, x, coalesce(lag(x) OVER w, 0) AS x1, coalesce(lag(x, {YEAR}) OVER w, 0) AS x12, coalesce(lag(x, {YEAR + 1}) OVER w, 0) AS x13
  FROM (SELECT {B}, CAST(t - {YEAR + 1} AS INTEGER) AS t, x FROM twice WHERE x IS NOT NULL) WINDOW w AS (PARTITION BY {B} ORDER BY t)
),
driven AS (SELECT {B}, t, x - {WEIGHTS["ar"]} * x1 - {WEIGHTS["sar"]} * x12 + {WEIGHTS["ar"] * WEIGHTS["sar"]} * x13 AS u FROM lagged),
fold AS (
  SELECT DISTINCT {B}, 0 AS t, list_transform(range({YEAR + 1}), lambda i: CAST(0 AS DOUBLE)) AS e FROM driven
  UNION ALL
  SELECT f.{B}, f.t + 1, list_append(f.e, u - CAST({WEIGHTS["ma"]} AS DOUBLE) * f.e[-1] - CAST({WEIGHTS["sma"]} AS DOUBLE) * f.e[-{YEAR}]
                                          - CAST({WEIGHTS["ma"] * WEIGHTS["sma"]} AS DOUBLE) * f.e[-{YEAR + 1}])
  FROM fold f JOIN driven d ON d.{B} = f.{B} AND d.t = f.t + 1
),
ended AS (SELECT * FROM fold WHERE t > 0 QUALIFY row_number() OVER (PARTITION BY {B} ORDER BY t DESC) = 1)"""


@check(
    series_sql(), RECURSION,
    sql=f"""SELECT {B}, CAST(t AS INTEGER) AS n, round(sqrt(list_sum(list_transform(e, lambda v: v * v)) / t), 3) + 0.0 AS spread,
            round(e[-1], 3) + 0.0 AS last FROM ended""",
)
def f02_seasonal_errors(spark, sf):
    """One-step errors of arima(1,1,1)(1,1,1) under fixed weights: their spread and the last one."""
    found = seasonal.seasonal_errors(arrays(spark, sf), [BRAND], **{k: [v] for k, v in WEIGHTS.items()}, d=1, sd=1, season=YEAR)
    n = F.size("residuals")
    squares = F.aggregate("residuals", F.lit(0.0), lambda a, e: a + e * e)
    found = found.where(n > 0).select(BRAND, n.alias("n"), F.sqrt(squares / n).alias("spread"), F.element_at("residuals", -1).alias("last"))
    return rounded(found, 3, "spread", "last")


def _models(spark, sf, method):
    fits = seasonal.select_seasonal_arima(arrays(spark, sf), [BRAND], 17, YEAR, max_order=3, method=method)
    return rounded(fits.select(BRAND, "p", "d", "q", "sp", "sd", "sq", "parameters", "sigma2", "aicc"), 4, "sigma2", "aicc")


@check()
def f02_seasonal_arima_with_selection(spark, sf):
    """No twin: the weights come from an iterative search; the errors under given weights have one (f02_seasonal_errors)."""
    return _models(spark, sf, "conditional")


@check()
def f02_seasonal_arima_by_exact_likelihood(spark, sf):
    """No twin: as above."""
    return _models(spark, sf, "exact")


@check(
    monthly_sql(B), FLOWS,
    f"""squares AS (
  SELECT {B}, max(n) AS n, max({P}) AS last_period, avg(step * step) AS square
  FROM (SELECT *, y - lag(y, {YEAR}) OVER (PARTITION BY {B} ORDER BY t) AS step FROM flows) GROUP BY 1
),
steps AS (
  SELECT s.{B}, last_period, CAST(h AS INTEGER) AS h, y AS mean, sqrt(square * ((h - 1) // {YEAR} + 1)) AS spread
  FROM squares s CROSS JOIN (SELECT unnest(range(1, 18)) AS h)
  JOIN flows f ON f.{B} = s.{B} AND f.t = CASE WHEN s.n >= {YEAR} THEN s.n - {YEAR} + 1 + (h - 1) % {YEAR} ELSE s.n END
)""",
    sql=f"""SELECT {B}, CAST(last_period AS VARCHAR) AS last_period, h, round(mean, 2) + 0.0 AS mean,
            round(spread * 1.281552 + 1e-6, 2) + 0.0 AS half80, round(spread * 1.959964 + 1e-6, 2) + 0.0 AS half95 FROM steps""",
)
def f03_seasonal_naive_forecast(spark, sf):
    steps = seasonal.seasonal_naive(flows(spark, sf), [BRAND], 17, YEAR)
    half = {f"half{k}": F.col(f"hi{k}") - F.col("mean") for k in (80, 95)}
    found = rounded_means(steps.withColumns(half), 2, *half, nudge=1e-6)
    return rounded(found.select(BRAND, "last_period", "h", "mean", *half), 2, "mean")


@check()
def f03_seasonal_arima_forecast(spark, sf):
    """No twin: see the fit."""
    fits = seasonal.select_seasonal_arima(arrays(spark, sf), [BRAND], 17, YEAR, max_order=3)
    return rounded(seasonal.seasonal_arima_forecast(fits, [BRAND]), 2, "mean", "lo80", "hi80", "lo95", "hi95")


# Balances are positive wherever a brand has loans, so parts may be multiplied.
BALANCES = f"""balances AS (
  SELECT {B}, {P}, CAST(row_number() OVER w AS INTEGER) AS t, {BALANCE} AS y, count(*) OVER (PARTITION BY {B}) AS n
  FROM monthly WINDOW w AS (PARTITION BY {B} ORDER BY {P})
)"""
HOLT_WINTERS = {"alpha": 0.4, "beta": 0.05, "gamma": 0.2, "phi": 0.95}


def balances(spark, sf):
    return as_arrays(monthly(spark, sf, BRAND), [BRAND], PERIOD, BALANCE)


def holt_winters_sql() -> str:
    """CTE ``ended``: last states of the multiplied errors, damped trend and multiplied season under fixed weights."""
    a, b, g, f = (f"CAST({HOLT_WINTERS[k]} AS DOUBLE)" for k in ("alpha", "beta", "gamma", "phi"))
    return f"""
firsts AS (
  SELECT {B}, avg(y) FILTER (t <= {YEAR}) AS level, avg(y) FILTER (t > {YEAR} AND t <= {2 * YEAR}) AS second,
         list(y ORDER BY t) FILTER (t <= {YEAR}) AS season
  FROM balances WHERE n >= {2 * YEAR} GROUP BY 1
),
fold AS (
  SELECT {B}, 0 AS t, level AS l, (second - level) / {YEAR} AS b, list_transform(season, lambda v: v / level) AS s, true AS fine,
         CAST(0 AS DOUBLE) AS squares, CAST(0 AS DOUBLE) AS logs
  FROM firsts WHERE level <> 0
  UNION ALL
  SELECT {B}, t + 1, q + {a} * e / s1, {f} * b + {b} * e / s1, list_append(s[2:], s1 + {g} * e / q), fine AND q > 0 AND s1 > 0,
         squares + (e / (q * s1)) * (e / (q * s1)), logs + ln(greatest(q * s1, 1e-300))
  FROM (SELECT *, y - q * s1 AS e FROM (
    SELECT f.*, f.l + {f} * f.b AS q, f.s[1] AS s1, m.y FROM fold f JOIN balances m ON m.{B} = f.{B} AND m.t = f.t + 1))
),
ended AS (SELECT * FROM fold WHERE t > 0 QUALIFY row_number() OVER (PARTITION BY {B} ORDER BY t DESC) = 1)"""


@check(
    monthly_sql(B), BALANCES, holt_winters_sql(),
    sql=f"""SELECT {B}, 'ets(M,Ad,M)' AS model, round(l, 2) + 0.0 AS level, round(b, 2) + 0.0 AS trend, round(s[1], 6) + 0.0 AS next_season,
            round(sqrt(squares / t), 6) + 0.0 AS spread, round(-0.5 * t * (ln(2 * pi() * squares / t) + 1) - logs, 4) + 0.0 AS log_likelihood
            FROM ended WHERE fine""",
)
def f01_multiplied_smoothing_with_fixed_weights(spark, sf):
    """Of monthly balances; brands with less than two years, or whose states turn negative, are left out."""
    found = states.fixed_states(balances(spark, sf), [BRAND], states.Form("M", "Ad", "M"), **HOLT_WINTERS, season=YEAR).where("level IS NOT NULL")
    found = found.select(
        BRAND, "model", "level", "trend", F.element_at("seasons", 1).alias("next_season"), F.sqrt("sigma2").alias("spread"), "log_likelihood"
    )
    return rounded(rounded(rounded(found, 2, "level", "trend"), 6, "next_season", "spread"), 4, "log_likelihood")


@check()
def f01_state_space_selection(spark, sf):
    """No twin: weights and states come from an iterative search; the recursion has one (f01_multiplied_smoothing_with_fixed_weights)."""
    fits = states.select_states(balances(spark, sf), [BRAND], 17, YEAR)
    return rounded(fits.select(BRAND, "model", "parameters", "alpha", "beta", "gamma", "phi", "aicc"), 4, "alpha", "beta", "gamma", "phi", "aicc")


@check()
def f03_state_space_forecast(spark, sf):
    """No twin: see the fit. Of cumulative charge-offs; intervals of multiplied errors or seasons are simulated."""
    forecast = states.states_forecast(states.select_states(arrays(spark, sf), [BRAND], 17, YEAR), [BRAND])
    return rounded(forecast, 2, "mean", "lo80", "hi80", "lo95", "hi95")
