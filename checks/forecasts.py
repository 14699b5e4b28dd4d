"""Forecasts of monthly charge-offs, one series per vehicle brand or type."""

from __future__ import annotations

from pyspark.sql import functions as F

from loantide.forecast import arima, backtest, diagnostics, local_regression, run_rate, smoothing
from loantide.forecast.series import as_arrays, with_every_month
from loantide.operators.columns import stack_by_name
from loantide.operators.series import running_total
from loantide.plans import outlook, reports
from loantide.schema import PERIOD

from .panel import BRAND, monthly, monthly_sql
from .registry import check, rounded, rounded_means

P = "reportingPeriodEndingDate"
B = "vehicleManufacturerName"
TYPE = "vehicleModelName"
CHARGED = "chargedoffPrincipalAmount"
BALANCE = "reportingPeriodActualEndBalanceAmount"
MONTH = f"CAST({P} AS VARCHAR) AS {P}"


def cumulative(spark, sf, key=BRAND):
    """Cumulative charge-offs per series, in exact cents."""
    months = monthly(spark, sf, key)
    return months.select(key, PERIOD, F.round(running_total(CHARGED, [key], PERIOD), 2).alias("y"))


def arrays(spark, sf, key=BRAND):
    return as_arrays(cumulative(spark, sf, key), [key], PERIOD, "y")


def series_sql(key: str = B) -> str:
    """CTE ``series``: position ``t`` and value ``y`` of the same."""
    return f"""{monthly_sql(key)},
series AS (
  SELECT {key}, {P}, CAST(row_number() OVER w AS INTEGER) AS t, round(sum({CHARGED}) OVER w, 2) AS y
  FROM monthly WINDOW w AS (PARTITION BY {key} ORDER BY {P} ROWS UNBOUNDED PRECEDING)
)"""


def fold_sql(grid: list[smoothing.Smoothing], key: str = B) -> str:
    """CTE ``solved``: states and squared error of every candidate after every month."""
    values = ", ".join(
        f"({i}, '{g.model}', CAST({g.alpha!r} AS DOUBLE), CAST({g.beta!r} AS DOUBLE), CAST({g.phi!r} AS DOUBLE), {g.parameters})"
        for i, g in enumerate(grid)
    )
    zero, one = "CAST(0 AS DOUBLE)", "CAST(1 AS DOUBLE)"
    return f"""
grid(id, model, alpha, beta, phi, parameters) AS (VALUES {values}),
first_value AS (SELECT {key}, y AS y1 FROM series WHERE t = 1),
fold AS (
  SELECT f.{key}, g.*, f.y1, 0 AS t, {zero} AS l_y, {zero} AS b_y, {one} AS l_l, {zero} AS b_l, {zero} AS l_b, {one} AS b_b,
         {zero} AS s_yy, {zero} AS s_yl, {zero} AS s_yb, {zero} AS s_ll, {zero} AS s_lb, {zero} AS s_bb
  FROM first_value f CROSS JOIN grid g
  UNION ALL
  SELECT {key}, id, model, alpha, beta, phi, parameters, y1, t + 1,
         x_y + alpha * e_y, phi * b_y + beta * e_y, x_l + alpha * e_l, phi * b_l + beta * e_l, x_b + alpha * e_b, phi * b_b + beta * e_b,
         s_yy + e_y * e_y, s_yl + e_y * e_l, s_yb + e_y * e_b, s_ll + e_l * e_l, s_lb + e_l * e_b, s_bb + e_b * e_b
  FROM (SELECT *, (y - y1) - x_y AS e_y, 0 - x_l AS e_l, 0 - x_b AS e_b
        FROM (SELECT f.*, s.y, f.l_y + f.phi * f.b_y AS x_y, f.l_l + f.phi * f.b_l AS x_l, f.l_b + f.phi * f.b_b AS x_b
              FROM fold f JOIN series s ON s.{key} = f.{key} AND s.t = f.t + 1))
),
solved AS (
  SELECT *, y1 + l_y + l0 * l_l + b0 * l_b AS level, b_y + l0 * b_l + b0 * b_b AS trend,
         greatest(0, s_yy + l0 * s_yl + b0 * s_yb) AS sse
  FROM (SELECT *, CASE WHEN model = 'simple' THEN -s_yl / s_ll
                       ELSE (s_yb * s_lb - s_yl * s_bb) / nullif(s_ll * s_bb - s_lb * s_lb, 0) END AS l0,
               CASE WHEN model = 'simple' THEN 0
                    ELSE (s_yl * s_lb - s_yb * s_ll) / nullif(s_ll * s_bb - s_lb * s_lb, 0) END AS b0
        FROM fold WHERE t > 0)
),
lengths AS (SELECT {key} AS skey, max(t) AS n, max({P}) AS last_period FROM series GROUP BY 1)"""


FIXED = [smoothing.simple(0.5), smoothing.trend(0.5, 0.1), smoothing.damped(0.5, 0.1, 0.9)]


@check(
    series_sql(), fold_sql(FIXED),
    sql=f"""SELECT {B}, model, CAST(n AS INTEGER) AS n, round(level, 4) + 0.0 AS level, round(trend, 4) + 0.0 AS trend,
            round(sqrt(sse / n), 4) + 0.0 AS rmse FROM solved JOIN lengths ON skey = {B} AND n = t""",
)
def f01_smoothing_with_fixed_weights(spark, sf):
    series = arrays(spark, sf)
    fits = stack_by_name(*[smoothing.fixed_smoothing(series, spec) for spec in FIXED])
    fits = fits.withColumn("rmse", F.sqrt(F.col("sse") / F.col("n")))
    return rounded(fits.select(BRAND, "model", "n", "level", "trend", "rmse"), 4, "level", "trend", "rmse")


SELECTED = f"""
selected0 AS (
  SELECT * FROM (SELECT *, n * ln(sse) + 2 * (parameters + 1) + CAST(2 * (parameters + 1) * (parameters + 2) AS DOUBLE)
                        / (n - (parameters + 1) - 1) AS aicc
                 FROM solved JOIN lengths ON skey = {B} AND n = t)
  QUALIFY row_number() OVER (PARTITION BY {B} ORDER BY aicc, id) = 1
)"""
REFINED = 3


def _clamped(value: str, move: str, step: float, bounds: tuple[float, float], halving: int) -> str:
    return f"least(greatest({value} + {move} / CAST({2**halving} AS DOUBLE) * CAST({step!r} AS DOUBLE), CAST({bounds[0]!r} AS DOUBLE)), CAST({bounds[1]!r} AS DOUBLE))"


def refined_sql(halving: int) -> str:
    """CTE ``selected<halving>``: the best of the candidates a step around each of the choices before."""
    r, before = halving, halving - 1
    names = ("alpha", "beta / alpha", "phi")
    moved = [_clamped(n, m, s, b, r) for n, m, s, b in zip(names, ("i", "j", "k"), smoothing.STEPS, smoothing.BOUNDS)]
    zero, one = "CAST(0 AS DOUBLE)", "CAST(1 AS DOUBLE)"
    return f"""
near{r} AS (
  SELECT {B}, row_number() OVER (PARTITION BY {B} ORDER BY i, j, k) AS id, model, a AS alpha, CASE model WHEN 'simple' THEN 0 ELSE a * share END AS beta,
         f AS phi, parameters
  FROM (SELECT {B}, model, parameters, i, j, k, {moved[0]} AS a, {moved[1]} AS share, CASE model WHEN 'damped' THEN {moved[2]} ELSE phi END AS f
        FROM selected{before} CROSS JOIN (SELECT unnest([-1, 0, 1]) AS i) CROSS JOIN (SELECT unnest([-1, 0, 1]) AS j) CROSS JOIN (SELECT unnest([-1, 0, 1]) AS k))
),
refold{r} AS (
  SELECT g.{B}, id, model, alpha, beta, phi, parameters, f.y1, 0 AS t, {zero} AS l_y, {zero} AS b_y, {one} AS l_l, {zero} AS b_l, {zero} AS l_b, {one} AS b_b,
         {zero} AS s_yy, {zero} AS s_yl, {zero} AS s_yb, {zero} AS s_ll, {zero} AS s_lb, {zero} AS s_bb
  FROM near{r} g JOIN first_value f ON f.{B} = g.{B}
  UNION ALL
  SELECT {B}, id, model, alpha, beta, phi, parameters, y1, t + 1,
         x_y + alpha * e_y, phi * b_y + beta * e_y, x_l + alpha * e_l, phi * b_l + beta * e_l, x_b + alpha * e_b, phi * b_b + beta * e_b,
         s_yy + e_y * e_y, s_yl + e_y * e_l, s_yb + e_y * e_b, s_ll + e_l * e_l, s_lb + e_l * e_b, s_bb + e_b * e_b
  FROM (SELECT *, (y - y1) - x_y AS e_y, 0 - x_l AS e_l, 0 - x_b AS e_b
        FROM (SELECT f.*, s.y, f.l_y + f.phi * f.b_y AS x_y, f.l_l + f.phi * f.b_l AS x_l, f.l_b + f.phi * f.b_b AS x_b
              FROM refold{r} f JOIN series s ON s.{B} = f.{B} AND s.t = f.t + 1))
),
selected{r} AS (
  SELECT * FROM (
    SELECT *, n * ln(sse) + 2 * (parameters + 1) + CAST(2 * (parameters + 1) * (parameters + 2) AS DOUBLE) / (n - (parameters + 1) - 1) AS aicc
    FROM (SELECT *, y1 + l_y + l0 * l_l + b0 * l_b AS level, b_y + l0 * b_l + b0 * b_b AS trend, greatest(0, s_yy + l0 * s_yl + b0 * s_yb) AS sse
          FROM (SELECT *, CASE WHEN model = 'simple' THEN -s_yl / s_ll
                               ELSE (s_yb * s_lb - s_yl * s_bb) / nullif(s_ll * s_bb - s_lb * s_lb, 0) END AS l0,
                       CASE WHEN model = 'simple' THEN 0 ELSE (s_yl * s_lb - s_yb * s_ll) / nullif(s_ll * s_bb - s_lb * s_lb, 0) END AS b0
                FROM refold{r} JOIN lengths ON skey = {B} AND n = t)))
  QUALIFY row_number() OVER (PARTITION BY {B} ORDER BY aicc, id) = 1
)"""


CHOSEN = (
    SELECTED,
    *[refined_sql(r) for r in range(1, REFINED + 1)],
    f"selected AS (SELECT * FROM selected{REFINED})",
)


@check(
    series_sql(), fold_sql(smoothing.default_grid()), *CHOSEN,
    sql=f"""SELECT {B}, model, round(alpha, 6) AS alpha, round(beta, 6) AS beta, round(phi, 6) AS phi, round(level, 4) + 0.0 AS level, round(trend, 4) + 0.0 AS trend,
            round(aicc, 4) + 0.0 AS aicc FROM selected""",
)
def f01_smoothing_with_selection(spark, sf):
    fits = smoothing.select_smoothing(arrays(spark, sf), [BRAND])
    chosen = fits.select(BRAND, "model", "alpha", "beta", "phi", "level", "trend", "aicc")
    return rounded(rounded(chosen, 4, "level", "trend", "aicc"), 6, "alpha", "beta", "phi")


@check()
def f02_arima_with_selection(spark, sf):
    """No twin: the weights come from an iterative search."""
    fits = arima.select_arima(arrays(spark, sf), [BRAND], 17)
    return rounded(fits.select(BRAND, "p", "d", "q", "parameters", "sigma2", "aicc"), 4, "sigma2", "aicc")


ARMA = {"ar(1)": (0.5, 0.0), "arma(1,1)": (0.5, 0.3), "ma(1)": (0.0, 0.4)}
# The filter with two states, on values and on ones; the state's covariance starts in its closed form.
FILTER = f"""
weights(model, f, m) AS (VALUES {", ".join(f"('{k}', CAST({f} AS DOUBLE), CAST({m} AS DOUBLE))" for k, (f, m) in ARMA.items())}),
steps AS (
  SELECT {B}, t - 1 AS t, x FROM (SELECT {B}, t, y - lag(y) OVER (PARTITION BY {B} ORDER BY t) AS x FROM series) WHERE x IS NOT NULL
),
fold AS (
  SELECT {B}, model, f, m, 0 AS t, CAST(0 AS DOUBLE) AS a0, CAST(0 AS DOUBLE) AS a1, CAST(0 AS DOUBLE) AS o0, CAST(0 AS DOUBLE) AS o1,
         (1 + 2 * f * m + m * m) / (1 - f * f) AS p00, m AS p01, m * m AS p11,
         CAST(0 AS DOUBLE) AS yy, CAST(0 AS DOUBLE) AS yo, CAST(0 AS DOUBLE) AS oo, CAST(0 AS DOUBLE) AS logs
  FROM (SELECT DISTINCT {B} FROM steps) CROSS JOIN weights
  UNION ALL
  SELECT {B}, model, f, m, t + 1, f * (a0 + v) + a1 + k1 * v, CAST(0 AS DOUBLE), f * (o0 + w) + o1 + k1 * w, CAST(0 AS DOUBLE),
         q11 + 1, m, m * m, yy + v * v / p00, yo + v * w / p00, oo + w * w / p00, logs + ln(p00)
  FROM (SELECT *, x - a0 AS v, 1 - o0 AS w, p01 / p00 AS k1, p11 - p01 * p01 / p00 AS q11
        FROM (SELECT g.*, s.x FROM fold g JOIN steps s ON s.{B} = g.{B} AND s.t = g.t + 1))
),
ended AS (SELECT * FROM fold WHERE t > 1 QUALIFY row_number() OVER (PARTITION BY {B}, model ORDER BY t DESC) = 1)"""


@check(
    series_sql(), FILTER,
    sql=f"""SELECT {B}, model, CAST(t AS INTEGER) AS n, round(yo / oo, 3) + 0.0 AS constant, round((yy - yo * yo / oo) / t / 1000, 3) + 0.0 AS sigma2,
            round(-0.5 * (t * (ln(2 * pi() * (yy - yo * yo / oo) / t) + 1) + logs), 5) + 0.0 AS log_likelihood FROM ended""",
)
def f02_exact_likelihood(spark, sf):
    """Of the monthly steps, under fixed weights, with mean and variance of greatest likelihood."""
    series = arrays(spark, sf)
    found = stack_by_name(*[
        arima.exact_likelihood(series, [BRAND], [f], [m], d=1).withColumn("model", F.lit(name)) for name, (f, m) in ARMA.items()
    ])
    found = found.where("n > 1").select(BRAND, "model", "n", "constant", (F.col("sigma2") / 1000).alias("sigma2"), "log_likelihood")
    return rounded(rounded(found, 3, "constant", "sigma2"), 5, "log_likelihood")


@check()
def f02_arima_by_exact_likelihood(spark, sf):
    """No twin: the weights come from an iterative search; the filter has one (f02_exact_likelihood)."""
    fits = arima.select_arima(arrays(spark, sf), [BRAND], 17, max_p=2, max_q=2, max_order=3, method="exact")
    return rounded(fits.select(BRAND, "p", "d", "q", "parameters", "sigma2", "aicc"), 4, "sigma2", "aicc")


@check(
    series_sql(), fold_sql(FIXED),
    f"""steps AS (
  SELECT s.*, n, last_period, CAST(h AS INTEGER) AS h,
         level + list_sum(list_transform(range(1, h + 1), lambda j: pow(phi, j))) * trend AS mean,
         sqrt(sse / (n - parameters) * (1 + coalesce(list_sum(list_transform(range(1, h),
           lambda j: pow(alpha + beta * list_sum(list_transform(range(1, j + 1), lambda i: pow(phi, i))), 2))), 0))) AS spread
  FROM solved s JOIN lengths ON skey = {B} AND n = t CROSS JOIN (SELECT unnest(range(1, 18)) AS h)
)""",
    sql=f"""SELECT {B}, CAST(last_period AS VARCHAR) AS last_period, model, h, round(mean, 2) + 0.0 AS mean,
            round(mean - 1.281552 * spread, 2) + 0.0 AS lo80, round(mean + 1.281552 * spread, 2) + 0.0 AS hi80,
            round(mean - 1.959964 * spread, 2) + 0.0 AS lo95, round(mean + 1.959964 * spread, 2) + 0.0 AS hi95 FROM steps""",
)
def f03_forecast_with_intervals(spark, sf):
    series = arrays(spark, sf)
    fits = stack_by_name(*[smoothing.fixed_smoothing(series, spec) for spec in FIXED])
    return rounded(smoothing.smoothing_forecast(fits, [BRAND], 17), 2, "mean", "lo80", "hi80", "lo95", "hi95")


@check()
def f03_arima_forecast_with_intervals(spark, sf):
    """No twin: see the fit."""
    forecast = arima.arima_forecast(arima.select_arima(arrays(spark, sf), [BRAND], 17), [BRAND])
    return rounded(forecast, 2, "mean", "lo80", "hi80", "lo95", "hi95")


SIMPLE = [smoothing.simple(0.5)]
CV_ERRORS = f"""
origins AS (
  SELECT s.{B}, s.t AS origin, s.y AS last, f.y1 AS first, v.level
  FROM series s JOIN first_value f ON f.{B} = s.{B} JOIN solved v ON v.{B} = s.{B} AND v.t = s.t
  JOIN lengths ON skey = s.{B} WHERE s.t < n
),
forecasts AS (
  SELECT *, last AS value, 'naive' AS model FROM origins CROSS JOIN (SELECT unnest(range(1, 18)) AS h)
  UNION ALL
  SELECT *, last + h * coalesce((last - first) / nullif(origin - 1, 0), 0), 'drift' FROM origins CROSS JOIN (SELECT unnest(range(1, 18)) AS h)
  UNION ALL
  SELECT *, level, 'simple' FROM origins CROSS JOIN (SELECT unnest(range(1, 18)) AS h)
),
errors AS (
  SELECT f.{B}, model, origin, CAST(h AS INTEGER) AS h, y - value AS error
  FROM forecasts f LEFT JOIN series s ON s.{B} = f.{B} AND s.t = f.origin + f.h
)"""


def _errors(spark, sf):
    series = arrays(spark, sf)
    models = (backtest.naive(), backtest.drift(), backtest.smoothing(SIMPLE, "simple"))
    return stack_by_name(*[backtest.rolling_origin(series, [BRAND], m, 17) for m in models])


@check(
    series_sql(), fold_sql(SIMPLE), CV_ERRORS,
    sql=f"SELECT {B}, model, origin, h, error FROM errors",
)
def f04_rolling_origin_errors(spark, sf):
    return _errors(spark, sf)


@check()
def f04_rolling_origin_errors_of_selected_models(spark, sf):
    """No twin: orders and weights are chosen anew at each origin."""
    series = arrays(spark, sf)
    models = (backtest.smoothing(), backtest.arima())
    return rounded(stack_by_name(*[backtest.rolling_origin(series, [BRAND], m, 17) for m in models]), 2, "error")


RUN_RATE = f"""
ratios AS (
  SELECT {TYPE}, {P}, {CHARGED}, {BALANCE}, {CHARGED} / nullif({BALANCE}, 0) AS charge_off_share,
         {BALANCE} / nullif(lag({BALANCE}) OVER w, 0) - 1 AS balance_growth_mom,
         row_number() OVER (PARTITION BY {TYPE} ORDER BY {P} DESC) AS recency
  FROM monthly WINDOW w AS (PARTITION BY {TYPE} ORDER BY {P})
),
rates AS (
  SELECT {TYPE}, avg(balance_growth_mom) FILTER (recency <= 12) AS g, avg(charge_off_share) FILTER (recency <= 12) AS c,
         arg_max({BALANCE}, {P}) AS b, CAST(max({P}) + INTERVAL 1 MONTH AS DATE) AS start
  FROM ratios GROUP BY 1
),
combined AS (
  SELECT {TYPE}, {P}, {CHARGED}, {BALANCE}, charge_off_share, balance_growth_mom, 'Actual' AS Period FROM ratios
  UNION ALL
  SELECT {TYPE}, CAST(date_trunc('month', start) + to_months(CAST(k - 1 AS INTEGER)) AS DATE) + CAST(day(start) - 1 AS INTEGER),
         b * pow(1 + g, k) * c, b * pow(1 + g, k), NULL, NULL, 'Forecast' FROM rates CROSS JOIN (SELECT unnest(range(1, 18)) AS k)
)"""


@check(
    monthly_sql(TYPE), RUN_RATE,
    sql=f"""SELECT {TYPE}, {MONTH}, Period, round({CHARGED}, 2) + 0.0 AS {CHARGED}, round({BALANCE}, 2) + 0.0 AS {BALANCE},
            round(charge_off_share, 8) + 0.0 AS charge_off_share, round(balance_growth_mom, 8) + 0.0 AS balance_growth_mom,
            round(sum({CHARGED}) OVER (PARTITION BY {TYPE} ORDER BY {P} ROWS UNBOUNDED PRECEDING), 2) + 0.0 AS cumulative_charge_off
            FROM combined""",
)
def f05_run_rate_forecast(spark, sf):
    forecast = run_rate.run_rate_forecast(monthly(spark, sf, TYPE), [TYPE])
    forecast = rounded(forecast, 2, CHARGED, BALANCE, "cumulative_charge_off")
    return rounded(forecast, 8, "charge_off_share", "balance_growth_mom")


@check(
    series_sql(), fold_sql(SIMPLE), CV_ERRORS,
    sql="SELECT model, round(avg(abs(error)), 3) + 0.0 AS mae, round(avg(error * error) / 1000000, 3) + 0.0 AS mse FROM errors GROUP BY 1",
)
def f06_forecast_accuracy(spark, sf):
    table = backtest.accuracy(_errors(spark, sf)).withColumn("mse", F.col("mse") / 1000000)
    return rounded(table, 3, "mae", "mse")


LAGS = 10
ACF = f"""
centred AS (SELECT {B}, {P}, {CHARGED} - avg({CHARGED}) OVER (PARTITION BY {B}) AS e FROM monthly),
lagged AS (
  SELECT *, {", ".join(f"e * lag(e, {k}) OVER w AS p{k}" for k in range(1, LAGS + 1))}
  FROM centred WINDOW w AS (PARTITION BY {B} ORDER BY {P})
),
acf AS (
  SELECT {B}, n, CAST(lag AS INTEGER) AS lag, acf FROM (
    SELECT {B}, count(*) AS n, unnest(range(1, {LAGS + 1})) AS lag,
           unnest([{", ".join(f"coalesce(sum(p{k}), 0) / nullif(sum(e * e), 0)" for k in range(1, LAGS + 1))}]) AS acf
    FROM lagged GROUP BY {B})
)"""


@check(monthly_sql(B), ACF, sql=f"SELECT {B}, n, lag, round(acf, 6) + 0.0 AS acf FROM acf")
def f07_residual_autocorrelation(spark, sf):
    """Of the monthly steps, the residuals of repeating the cumulative value."""
    return rounded(diagnostics.autocorrelation(monthly(spark, sf, BRAND), [BRAND], LAGS, PERIOD, CHARGED), 6, "acf")


@check(
    monthly_sql(B), ACF,
    sql=f"""SELECT {B}, round(q, 6) + 0.0 AS q, {LAGS} AS freedom, round(exp(-q / 2) * (1 + q / 2 + pow(q / 2, 2) / 2
            + pow(q / 2, 3) / 6 + pow(q / 2, 4) / 24), 6) + 0.0 AS p_value
            FROM (SELECT {B}, sum(n * (n + 2) * acf * acf / (n - lag)) AS q FROM acf GROUP BY 1)""",
)
def f07_ljung_box_test(spark, sf):
    acf = diagnostics.autocorrelation(monthly(spark, sf, BRAND), [BRAND], LAGS, PERIOD, CHARGED)
    return rounded(diagnostics.ljung_box(acf, [BRAND]), 6, "q", "p_value")


@check()
def f07_residual_test_of_fitted_models(spark, sf):
    """No twin: residuals come from the selected models."""
    fits = stack_by_name(
        smoothing.select_smoothing(arrays(spark, sf), [BRAND]).select(BRAND, F.lit("ets").alias("model"), "parameters", "residuals"),
        arima.select_arima(arrays(spark, sf), [BRAND], 1).select(BRAND, F.lit("arima").alias("model"), "parameters", "residuals"),
    )
    return rounded(diagnostics.check_residuals(fits, [BRAND, "model"]), 6, "q", "p_value")


def loess_sql(source: str, *keys: str) -> str:
    """CTE ``smoothed``: fitted value at every x of each series of the source (keys, x, y)."""
    k = ", ".join(f"a.{c}" for c in keys)
    same = " AND ".join(f"a.{c} = b.{c}" for c in keys)
    return f"""
placed AS (SELECT *, count(*) OVER (PARTITION BY {", ".join(keys)}) AS n FROM {source}),
pairs AS (
  SELECT {k}, a.x, a.y, a.n, b.x - a.x AS dx, b.y AS near_y,
         row_number() OVER (PARTITION BY {k}, a.x ORDER BY abs(b.x - a.x)) AS near
  FROM placed a JOIN placed b ON {same}
),
banded AS (
  SELECT *, max(CASE WHEN near = CAST(floor(n * 0.75 + 0.00001) AS INTEGER) THEN abs(dx) END)
            OVER (PARTITION BY {", ".join(keys)}, x) AS band FROM pairs
),
weighted AS (
  SELECT *, dx / CAST(band AS DOUBLE) AS u, pow(1 - pow(abs(dx / CAST(band AS DOUBLE)), 3), 3) AS w FROM banded WHERE abs(dx) < band
),
moments AS (
  SELECT {", ".join(keys)}, x, y, n, sum(w) AS s0, sum(w * u) AS s1, sum(w * u * u) AS s2, sum(w * u * u * u) AS s3,
         sum(w * u * u * u * u) AS s4, sum(w * near_y) AS t0, sum(w * u * near_y) AS t1, sum(w * u * u * near_y) AS t2,
         sum(w * w) AS q0, sum(w * w * u) AS q1, sum(w * w * u * u) AS q2, sum(w * w * u * u * u) AS q3, sum(w * w * u * u * u * u) AS q4
  FROM weighted GROUP BY {", ".join(keys)}, x, y, n
),
inverted AS (
  SELECT *, (s2 * s4 - s3 * s3) / whole AS a, (s2 * s3 - s1 * s4) / whole AS b, (s1 * s3 - s2 * s2) / whole AS c
  FROM (SELECT *, nullif(s0 * (s2 * s4 - s3 * s3) + s1 * (s2 * s3 - s1 * s4) + s2 * (s1 * s3 - s2 * s2), 0) AS whole FROM moments)
),
fits AS (
  SELECT *, a * t0 + b * t1 + c * t2 AS fitted,
         a * a * q0 + 2 * a * b * q1 + (2 * a * c + b * b) * q2 + 2 * b * c * q3 + c * c * q4 AS squares FROM inverted
),
smoothed AS (
  SELECT *, sqrt(sum(pow(y - fitted, 2)) OVER s / (n - 2 * sum(a) OVER s + sum(squares) OVER s) * squares) AS se
  FROM fits WINDOW s AS (PARTITION BY {", ".join(keys)})
)"""


DAYS = f"CAST(date_diff('day', DATE '1970-01-01', {P}) AS INTEGER)"


@check(
    monthly_sql(B), f"placed_source AS (SELECT {B}, {DAYS} AS x, {CHARGED} AS y FROM monthly)", loess_sql("placed_source", B),
    sql=f"""SELECT {B}, x, y, CAST(1 AS BIGINT) AS n, round(fitted, 3) + 0.0 AS fitted, round(se, 3) + 0.0 AS se,
            round(fitted - 1.959964 * se, 3) + 0.0 AS lo, round(fitted + 1.959964 * se, 3) + 0.0 AS hi FROM smoothed""",
)
def f08_local_regression(spark, sf):
    months = monthly(spark, sf, BRAND).select(BRAND, F.unix_date(PERIOD).alias("x"), F.col(CHARGED).alias("y"))
    return rounded(local_regression.smooth(months, [BRAND], "x", "y"), 3, "fitted", "se", "lo", "hi")


GRID = 40


@check(
    monthly_sql(B),
    f"""points AS (
  SELECT {B}, {DAYS} AS x, {CHARGED} AS y, min({DAYS}) OVER (PARTITION BY {B}) AS low, max({DAYS}) OVER (PARTITION BY {B}) AS high FROM monthly
),
near AS (
  SELECT {B}, low, (high - low) / CAST({GRID - 1} AS DOUBLE) AS step, g, y,
         ((x - low) / ((high - low) / CAST({GRID - 1} AS DOUBLE)) - g) / {0.25 * (GRID - 1)} AS u
  FROM points CROSS JOIN (SELECT unnest(range(0, {GRID})) AS g)
),
sums AS (
  SELECT {B}, low, step, g, sum(w) AS s0, sum(w * u) AS s1, sum(w * u * u) AS s2, sum(w * u * u * u) AS s3, sum(w * u * u * u * u) AS s4,
         sum(w * y) AS t0, sum(w * u * y) AS t1, sum(w * u * u * y) AS t2
  FROM (SELECT *, pow(1 - pow(abs(u), 3), 3) AS w FROM near WHERE abs(u) < 1) GROUP BY ALL
)""",
    sql=f"""SELECT {B}, round(low + g * step, 4) + 0.0 AS x, round((t0 * (s2 * s4 - s3 * s3) + t1 * (s2 * s3 - s1 * s4) + t2 * (s1 * s3 - s2 * s2))
            / (s0 * (s2 * s4 - s3 * s3) + s1 * (s2 * s3 - s1 * s4) + s2 * (s1 * s3 - s2 * s2)), 2) + 0.0 AS fitted FROM sums""",
)
def f08_local_regression_on_a_grid(spark, sf):
    months = monthly(spark, sf, BRAND).select(BRAND, F.unix_date(PERIOD).alias("x"), F.col(CHARGED).alias("y"))
    return rounded(rounded(local_regression.smooth_on_grid(months, [BRAND], "x", "y", GRID), 4, "x"), 2, "fitted")


COMPONENTS = ", ".join(f"'{c}'" for c in reports.COMPONENTS)


@check(
    monthly_sql(B),
    f"""long AS (SELECT {B}, {DAYS} AS x, unnest([{COMPONENTS}]) AS name, unnest([{", ".join(reports.COMPONENTS)}]) AS y FROM monthly)""",
    loess_sql("long", B, "name"),
    sql=f"""SELECT {B}, name, CAST(DATE '1970-01-01' + x AS VARCHAR) AS {P}, y AS value, round(fitted, 3) + 0.0 AS fitted,
            round(fitted - 1.959964 * se, 3) + 0.0 AS lo, round(fitted + 1.959964 * se, 3) + 0.0 AS hi,
            '$' || format('{{:,}}', CAST(round_even(y * 0.001, 0) AS BIGINT)) AS label FROM smoothed""",
)
def r10_principal_interest_charge_off(spark, sf):
    return rounded(outlook.smoothed_components(monthly(spark, sf, BRAND), [BRAND]), 3, "fitted", "lo", "hi")


def filled_sql(kept: str = "true") -> tuple[str, str]:
    """CTE ``series`` of the months kept, with the months that a series then lacks: nothing was charged off in them."""
    return (
        monthly_sql(B),
        f"""kept AS (SELECT {B}, {P}, {CHARGED} FROM monthly WHERE {kept}),
spans AS (SELECT {B}, date_trunc('month', min({P})) AS a, date_trunc('month', max({P})) AS b FROM kept GROUP BY 1),
months AS (SELECT {B}, last_day(CAST(unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS DATE)) AS {P} FROM spans),
series AS (
  SELECT m.{B}, m.{P}, CAST(row_number() OVER w AS INTEGER) AS t, round(sum(coalesce(k.{CHARGED}, 0)) OVER w, 2) AS y
  FROM months m LEFT JOIN kept k ON k.{B} = m.{B} AND k.{P} = m.{P}
  WINDOW w AS (PARTITION BY m.{B} ORDER BY m.{P} ROWS UNBOUNDED PRECEDING)
)""",
    )


STEPS = f"""steps AS (
  SELECT s.*, last_period, CAST(h AS INTEGER) AS h,
         level + list_sum(list_transform(range(1, h + 1), lambda j: pow(phi, j))) * trend AS mean,
         sqrt(sse / (n - parameters) * (1 + coalesce(list_sum(list_transform(range(1, h),
           lambda j: pow(alpha + beta * list_sum(list_transform(range(1, j + 1), lambda i: pow(phi, i))), 2))), 0))) AS spread
  FROM selected s CROSS JOIN (SELECT unnest(range(1, 18)) AS h)
)"""
BANDS = ", ".join(
    f"round(mean {sign} {z} * spread, 2) + 0.0 AS {name}"
    for sign, z, name in (("-", 1.281552, "lo80"), ("+", 1.281552, "hi80"), ("-", 1.959964, "lo95"), ("+", 1.959964, "hi95"))
)


@check(
    *filled_sql(), fold_sql(smoothing.default_grid()), *CHOSEN, STEPS,
    sql=f"""SELECT {B}, CAST(last_period AS VARCHAR) AS last_period, model, h, round(mean, 2) + 0.0 AS mean, {BANDS},
            CAST(last_day(CAST(last_period + to_months(h) AS DATE)) AS VARCHAR) AS {P}, 'ETS' AS method FROM steps""",
)
def r13_smoothing_forecasts(spark, sf):
    forecasts = outlook.smoothing_forecasts(monthly(spark, sf, BRAND), [BRAND])
    return rounded(forecasts, 2, "mean", "lo80", "hi80", "lo95", "hi95")


# The choice made anew after every month; a series too short for any candidate takes the quickest simple one.
AT_ORIGINS = f"""
judged AS (
  SELECT *, CASE WHEN t - parameters - 2 <= 0 THEN NULL WHEN sse <= 1e-12 * greatest(s_yy, 1e-300) THEN '-infinity'::DOUBLE
              ELSE t * ln(sse) + 2 * (parameters + 1) + CAST(2 * (parameters + 1) * (parameters + 2) AS DOUBLE) / (t - parameters - 2) END AS aicc
  FROM solved
),
at_origins0 AS (
  SELECT {B}, t, model, parameters, alpha, beta, phi, level, trend, aicc FROM judged
  QUALIFY row_number() OVER (PARTITION BY {B}, t ORDER BY aicc NULLS LAST, CASE WHEN aicc IS NULL THEN (CASE WHEN model = 'simple' THEN -alpha ELSE 0 END) END, id) = 1
)"""


def refined_at_origins_sql(halving: int) -> str:
    """CTE ``at_origins<halving>``: after every month the best of the candidates a step around the choice made there before.

    The candidates around one choice run over the series once, whichever months made it.
    """
    r, before = halving, halving - 1
    names = ("a0", "b0 / a0", "f0")
    moved = [_clamped(n, m, s, b, r) for n, m, s, b in zip(names, ("i", "j", "k"), smoothing.STEPS, smoothing.BOUNDS)]
    zero, one = "CAST(0 AS DOUBLE)", "CAST(1 AS DOUBLE)"
    return f"""
around{r} AS (
  SELECT {B}, model, parameters, a0, b0, f0, row_number() OVER (PARTITION BY {B}, model, a0, b0, f0 ORDER BY i, j, k) AS id, a AS alpha,
         CASE model WHEN 'simple' THEN 0 ELSE a * share END AS beta, f AS phi
  FROM (SELECT *, {moved[0]} AS a, {moved[1]} AS share, CASE model WHEN 'damped' THEN {moved[2]} ELSE f0 END AS f
        FROM (SELECT DISTINCT {B}, model, parameters, alpha AS a0, beta AS b0, phi AS f0 FROM at_origins{before})
        CROSS JOIN (SELECT unnest([-1, 0, 1]) AS i) CROSS JOIN (SELECT unnest([-1, 0, 1]) AS j) CROSS JOIN (SELECT unnest([-1, 0, 1]) AS k))
),
again{r} AS (
  SELECT g.{B}, model, parameters, a0, b0, f0, id, alpha, beta, phi, f.y1, 0 AS t, {zero} AS l_y, {zero} AS b_y, {one} AS l_l, {zero} AS b_l, {zero} AS l_b, {one} AS b_b,
         {zero} AS s_yy, {zero} AS s_yl, {zero} AS s_yb, {zero} AS s_ll, {zero} AS s_lb, {zero} AS s_bb
  FROM around{r} g JOIN first_value f ON f.{B} = g.{B}
  UNION ALL
  SELECT {B}, model, parameters, a0, b0, f0, id, alpha, beta, phi, y1, t + 1,
         x_y + alpha * e_y, phi * b_y + beta * e_y, x_l + alpha * e_l, phi * b_l + beta * e_l, x_b + alpha * e_b, phi * b_b + beta * e_b,
         s_yy + e_y * e_y, s_yl + e_y * e_l, s_yb + e_y * e_b, s_ll + e_l * e_l, s_lb + e_l * e_b, s_bb + e_b * e_b
  FROM (SELECT *, (y - y1) - x_y AS e_y, 0 - x_l AS e_l, 0 - x_b AS e_b
        FROM (SELECT f.*, s.y, f.l_y + f.phi * f.b_y AS x_y, f.l_l + f.phi * f.b_l AS x_l, f.l_b + f.phi * f.b_b AS x_b
              FROM again{r} f JOIN series s ON s.{B} = f.{B} AND s.t = f.t + 1))
),
near_origin{r} AS (
  SELECT o.{B}, o.t, g.model, g.parameters, g.alpha, g.beta, g.phi, g.level, g.trend, o.aicc AS before,
         CASE WHEN g.sse <= 1e-12 * greatest(s_yy, 1e-300) THEN '-infinity'::DOUBLE
              ELSE o.t * ln(g.sse) + 2 * (g.parameters + 1) + CAST(2 * (g.parameters + 1) * (g.parameters + 2) AS DOUBLE) / (o.t - g.parameters - 2) END AS aicc, id
  FROM at_origins{before} o
  JOIN (SELECT *, y1 + l_y + l0 * l_l + b0_ * l_b AS level, b_y + l0 * b_l + b0_ * b_b AS trend, greatest(0, s_yy + l0 * s_yl + b0_ * s_yb) AS sse
        FROM (SELECT *, CASE WHEN model = 'simple' THEN -s_yl / s_ll
                             ELSE (s_yb * s_lb - s_yl * s_bb) / nullif(s_ll * s_bb - s_lb * s_lb, 0) END AS l0,
                     CASE WHEN model = 'simple' THEN 0 ELSE (s_yl * s_lb - s_yb * s_ll) / nullif(s_ll * s_bb - s_lb * s_lb, 0) END AS b0_
              FROM again{r} WHERE t > 0)) g
    ON g.{B} = o.{B} AND g.t = o.t AND g.model = o.model AND g.a0 = o.alpha AND g.b0 = o.beta AND g.f0 = o.phi
  WHERE o.aicc IS NOT NULL AND isfinite(o.aicc)
),
better{r} AS (
  SELECT * FROM near_origin{r} QUALIFY row_number() OVER (PARTITION BY {B}, t ORDER BY aicc, id) = 1
),
at_origins{r} AS (
  SELECT o.{B}, o.t, coalesce(n.model, o.model) AS model, coalesce(n.parameters, o.parameters) AS parameters, coalesce(n.alpha, o.alpha) AS alpha,
         coalesce(n.beta, o.beta) AS beta, coalesce(n.phi, o.phi) AS phi, coalesce(n.level, o.level) AS level, coalesce(n.trend, o.trend) AS trend,
         coalesce(n.aicc, o.aicc) AS aicc
  FROM at_origins{before} o LEFT JOIN better{r} n ON n.{B} = o.{B} AND n.t = o.t AND n.aicc <= o.aicc
)"""


ERRORS_AT_ORIGINS = f"""
at_origins AS (SELECT * FROM at_origins{REFINED}),
errors AS (
  SELECT o.{B}, o.t AS origin, CAST(h AS INTEGER) AS h,
         s.y - (level + list_sum(list_transform(range(1, h + 1), lambda j: pow(phi, j))) * trend) AS error
  FROM at_origins o JOIN lengths ON skey = o.{B} CROSS JOIN (SELECT unnest(range(1, 18)) AS h)
  LEFT JOIN series s ON s.{B} = o.{B} AND s.t = o.t + h WHERE o.t < n
)"""


@check(
    series_sql(), fold_sql(smoothing.default_grid()), AT_ORIGINS, *[refined_at_origins_sql(r) for r in range(1, REFINED + 1)], ERRORS_AT_ORIGINS,
    sql=f"SELECT {B}, 'ets' AS model, round(avg(abs(error)), 2) + 0.0 AS mae, round(avg(error * error) / 1000000, 2) + 0.0 AS mse FROM errors GROUP BY {B}",
)
def r13_smoothing_comparison(spark, sf):
    """Cross-validation with the weights chosen and refined anew at every origin."""
    errors = backtest.rolling_origin(arrays(spark, sf), [BRAND], backtest.smoothing(), 17)
    table = backtest.accuracy(errors, [BRAND, "model"]).withColumn("mse", F.col("mse") / 1000000)
    return rounded(table, 2, "mae", "mse")


@check(
    *filled_sql(f"NOT (month({P}) IN (5, 6) AND {B} LIKE '%1')"),
    fold_sql([smoothing.trend(0.5, 0.1)]),
    sql=f"""SELECT {B}, CAST(h AS INTEGER) AS h, CAST(last_day(CAST(last_period + to_months(CAST(h AS INTEGER)) AS DATE)) AS VARCHAR) AS {P},
            round(level + h * trend, 2) + 0.0 AS mean FROM solved JOIN lengths ON skey = {B} AND n = t
            CROSS JOIN (SELECT unnest(range(1, 18)) AS h)""",
)
def f03_dated_forecast_of_series_with_gaps(spark, sf):
    """A flow is 0 in a month without rows, so step h is the same month for every series."""
    months = monthly(spark, sf, BRAND).where(f"NOT (month({P}) IN (5, 6) AND {B} LIKE '%1')")
    every = with_every_month(months, [BRAND], PERIOD, flows=[CHARGED])
    running = every.select(BRAND, PERIOD, F.round(running_total(CHARGED, [BRAND], PERIOD), 2).alias("y"))
    fits = smoothing.fixed_smoothing(as_arrays(running, [BRAND], PERIOD, "y"), smoothing.trend(0.5, 0.1))
    forecast = outlook.dated(smoothing.smoothing_forecast(fits, [BRAND], 17))
    return rounded(forecast.select(BRAND, "h", PERIOD, "mean"), 2, "mean")


# Orders (0..2, d, 0) by window sums: level test, differences, and normal equations with zeros before the start.
def _level_test(level: int) -> str:
    """CTEs for the level test of the series after so many differences: statistic, length and whether it moves."""
    return f"""
centred{level} AS (
  SELECT *, y - avg(y) OVER (PARTITION BY {B}) AS e, count(*) OVER (PARTITION BY {B}) AS n FROM diff{level}
),
run{level} AS (
  SELECT *, sum(e) OVER w AS s, {", ".join(f"coalesce(lag(e, {j}) OVER w, 0) AS e{j}" for j in range(1, 6))}
  FROM centred{level} WINDOW w AS (PARTITION BY {B} ORDER BY t ROWS UNBOUNDED PRECEDING)
),
test{level} AS (
  SELECT {B}, n > 4 AND spread > 0 AND variance > 0 AND squares / (n * n * variance) > 0.463 AS moves FROM (
    SELECT {B}, n, max(y) - min(y) AS spread, sum(s * s) AS squares, sum(e * e) / n
           + {" + ".join(f"CASE WHEN {j} <= lags THEN 2 * (1 - {j} / CAST(lags + 1 AS DOUBLE)) * sum(e * e{j}) / n ELSE 0 END" for j in range(1, 6))} AS variance
    FROM (SELECT *, CAST(floor(3 * sqrt(n) / 13) AS INTEGER) AS lags FROM run{level}) GROUP BY {B}, n, lags)
)"""


AUTOREGRESSION = f"""
diff0 AS (SELECT {B}, t, y FROM series),
diff1 AS (SELECT * FROM (SELECT {B}, t, y - lag(y) OVER (PARTITION BY {B} ORDER BY t) AS y FROM diff0) WHERE y IS NOT NULL),
diff2 AS (SELECT * FROM (SELECT {B}, t, y - lag(y) OVER (PARTITION BY {B} ORDER BY t) AS y FROM diff1) WHERE y IS NOT NULL),
{_level_test(0).strip()},
{_level_test(1).strip()},
needed AS (
  SELECT a.{B}, CASE WHEN NOT a.moves THEN 0 WHEN NOT coalesce(b.moves, false) THEN 1 ELSE 2 END AS d
  FROM test0 a LEFT JOIN test1 b ON b.{B} = a.{B}
),
w AS (
  SELECT f.{B}, f.d, t, y, avg(y) OVER (PARTITION BY f.{B}) AS mean
  FROM (SELECT {B}, t, y, 0 AS d FROM diff0 UNION ALL SELECT {B}, t, y, 1 FROM diff1 UNION ALL SELECT {B}, t, y, 2 FROM diff2) f
  JOIN needed n ON n.{B} = f.{B} AND n.d = f.d
),
x AS (
  SELECT {B}, d, t, c, c * mean AS centre, y - c * mean AS x0
  FROM w CROSS JOIN (SELECT unnest([1, 0]) AS c) WHERE d < 2 OR c = 0
),
lagged AS (
  SELECT *, coalesce(lag(x0) OVER o, 0) AS x1, coalesce(lag(x0, 2) OVER o, 0) AS x2,
         row_number() OVER (PARTITION BY {B}, c ORDER BY t DESC) AS back
  FROM x WINDOW o AS (PARTITION BY {B}, c ORDER BY t)
),
sums AS (
  SELECT {B}, d, c, centre, count(*) AS n, sum(x0 * x0) AS c00, sum(x0 * x1) AS c01, sum(x0 * x2) AS c02, sum(x1 * x1) AS c11,
         sum(x1 * x2) AS c12, sum(x2 * x2) AS c22, max(CASE WHEN back = 1 THEN x0 END) AS last1, coalesce(max(CASE WHEN back = 2 THEN x0 END), 0) AS last2
  FROM lagged GROUP BY ALL
),
orders AS (
  SELECT *, CASE p WHEN 1 THEN c01 / c11 WHEN 2 THEN (c01 * c22 - c02 * c12) / (c11 * c22 - c12 * c12) ELSE 0 END AS a1,
         CASE p WHEN 2 THEN (c02 * c11 - c01 * c12) / (c11 * c22 - c12 * c12) ELSE 0 END AS a2
  FROM sums CROSS JOIN (SELECT unnest([0, 1, 2]) AS p) WHERE n > greatest(3, p + c + 2)
),
selected_ar AS (
  SELECT *, sse / (n - p - c) AS sigma2 FROM (
    SELECT *, n * ln(sse / n) + 2 * (p + c + 1) + 2 * (p + c + 1) * (p + c + 2) / CAST(n - p - c - 2 AS DOUBLE) AS aicc
    FROM (SELECT *, c00 - a1 * c01 - a2 * c02 AS sse FROM orders))
  QUALIFY row_number() OVER (PARTITION BY {B} ORDER BY aicc, c DESC, p) = 1
)"""


@check(
    series_sql(), AUTOREGRESSION,
    sql=f"""SELECT {B}, CAST(p AS INTEGER) AS p, CAST(d AS INTEGER) AS d, CAST(p + c AS INTEGER) AS parameters,
            round(sigma2 / 1000, 2) + 0.0 AS sigma2, round(aicc, 3) + 0.0 AS aicc FROM selected_ar""",
)
def f02_autoregression_with_selection(spark, sf):
    fits = arima.select_arima(arrays(spark, sf), [BRAND], 17, max_p=2, max_q=0)
    chosen = fits.select(BRAND, "p", "d", "parameters", (F.col("sigma2") / 1000).alias("sigma2"), "aicc")
    return rounded(rounded(chosen, 2, "sigma2"), 3, "aicc")


@check(
    series_sql(), AUTOREGRESSION,
    f"""ends AS (
  SELECT {B}, max(y) FILTER (back = 1) AS y1, max(y) FILTER (back = 1) - max(y) FILTER (back = 2) AS step
  FROM (SELECT *, row_number() OVER (PARTITION BY {B} ORDER BY t DESC) AS back FROM series) GROUP BY 1
),
fold AS (
  SELECT {B}, 0 AS h, last1 AS x1, last2 AS x2, CAST(0 AS DOUBLE) AS path, y1 AS level, step, CAST(1 AS DOUBLE) AS q1, CAST(0 AS DOUBLE) AS q2,
         CAST(0 AS DOUBLE) AS q3, CAST(0 AS DOUBLE) AS q4, CAST(0 AS DOUBLE) AS grown, d, centre, a1, a2, sigma2, p
  FROM selected_ar JOIN ends USING ({B})
  UNION ALL
  SELECT {B}, h + 1, x, x1, x + centre, CASE d WHEN 0 THEN x + centre WHEN 1 THEN level + x + centre ELSE level + step + x + centre END,
         step + x + centre, f1 * q1 + f2 * q2 + f3 * q3 + f4 * q4, q1, q2, q3, grown + q1 * q1, d, centre, a1, a2, sigma2, p
  FROM (SELECT *, a1 * x1 + a2 * x2 AS x, a1 + d AS f1, CASE d WHEN 0 THEN a2 WHEN 1 THEN a2 - a1 ELSE a2 - 2 * a1 - 1 END AS f2,
               CASE d WHEN 0 THEN 0 WHEN 1 THEN -a2 ELSE a1 - 2 * a2 END AS f3, CASE d WHEN 2 THEN a2 ELSE 0 END AS f4
        FROM fold WHERE h < 17)
)""",
    sql=f"""SELECT {B}, CAST((SELECT max({P}) FROM series s WHERE s.{B} = fold.{B}) AS VARCHAR) AS last_period,
            'arima(' || p || ',' || d || ',0)' AS model, CAST(h AS INTEGER) AS h, round(level + 1e-6, 2) + 0.0 AS mean,
            round(sqrt(sigma2 * grown) + 1e-6, 2) + 0.0 AS spread FROM fold WHERE h > 0""",
)
def f03_autoregression_forecast(spark, sf):
    forecast = arima.arima_forecast(arima.select_arima(arrays(spark, sf), [BRAND], 17, max_p=2, max_q=0), [BRAND])
    spread = (F.col("hi80") - F.col("mean")) / 1.281552
    # Random walks with a drift of half cents end on ties; both engines are nudged off them by more than their sums differ.
    return rounded_means(forecast.select(BRAND, "last_period", "model", "h", "mean", spread.alias("spread")), 2, "mean", "spread", nudge=1e-6)


@check()
def r13_model_forecast_and_comparison(spark, sf):
    """No twin: contains the ARIMA fits."""
    return rounded(outlook.model_comparison(monthly(spark, sf, BRAND), [BRAND]), 2, "mae", "mse")


@check()
def r13_model_forecasts(spark, sf):
    """No twin: contains the ARIMA fits."""
    return rounded(outlook.model_forecasts(monthly(spark, sf, BRAND), [BRAND]), 2, "mean", "lo80", "hi80", "lo95", "hi95")


@check(
    monthly_sql(TYPE), RUN_RATE,
    sql=f"""SELECT {TYPE}, round(coalesce(sum({CHARGED}) FILTER (Period = 'Actual'), 0), 2) + 0.0 AS actual_total,
            round(sum({CHARGED}), 2) + 0.0 AS forecast_total, CAST(max({P}) AS VARCHAR) AS end_period FROM combined GROUP BY 1""",
)
def r14_charge_off_totals(spark, sf):
    forecast = run_rate.run_rate_forecast(monthly(spark, sf, TYPE), [TYPE])
    return rounded(run_rate.charge_off_totals(forecast, [TYPE]), 2, "actual_total", "forecast_total")


def _percent(c: str) -> str:
    return f"regexp_replace(regexp_replace(format('{{:.2f}}', round({c} * 100, 2) + 0.0), '0+$', ''), '\\.$', '') || '%'"


@check(
    monthly_sql(TYPE), RUN_RATE,
    f"ends AS (SELECT {TYPE}, sum({CHARGED}) AS total, max({P}) AS finish FROM combined GROUP BY 1)",
    sql=f"""SELECT r.{TYPE}, 'Balance growth, trailing mean: ' || {_percent("g")} AS growth_line,
            'Charge-off share of balance, trailing mean: ' || {_percent("c")} AS share_line,
            'Charged off by ' || strftime(finish, '%m/%d/%Y') || ': $' || CASE WHEN total >= 1000000
              THEN format('{{:,}}', CAST(round(total, 0) AS BIGINT)) ELSE regexp_replace(format('{{:,.1f}}', total), '\\.0$', '') END AS total_line
            FROM rates r JOIN ends e ON e.{TYPE} = r.{TYPE}""",
)
def r14_report_lines(spark, sf):
    return outlook.run_rate_lines(monthly(spark, sf, TYPE), [TYPE])
