"""Local quadratic regression with tricube weights (Cleveland 1979)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .series import Z95, spread

MOMENTS = ("s0", "s1", "s2", "s3", "s4", "t0", "t1", "t2", "q0", "q1", "q2", "q3", "q4")


def _parts(w: Column, u: Column, y: Column, c: Column) -> dict[str, Column]:
    """What one point of c values adds to the moments; w is its weight, u its scaled distance."""
    own = {"s0": w * c, "t0": w * c * y, "q0": w * w * c}
    for i in range(1, 5):
        own[f"s{i}"] = own[f"s{i - 1}"] * u
        own[f"q{i}"] = own[f"q{i - 1}"] * u
    own["t1"], own["t2"] = own["t0"] * u, own["t0"] * u * u
    return own


def _tricube(u: Column) -> Column:
    near = 1 - F.abs(u) * F.abs(u) * F.abs(u)
    return near * near * near


def _solution(m: dict[str, Column]) -> tuple[Column, Column, Column]:
    """Fitted value, sum of squared weights of the values in it, and weight of a value at the point itself."""
    minors = (m["s2"] * m["s4"] - m["s3"] * m["s3"], m["s2"] * m["s3"] - m["s1"] * m["s4"], m["s1"] * m["s3"] - m["s2"] * m["s2"])
    whole = m["s0"] * minors[0] + m["s1"] * minors[1] + m["s2"] * minors[2]
    a, b, c = (F.try_divide(part, whole) for part in minors)
    squares = a * a * m["q0"] + 2 * a * b * m["q1"] + (2 * a * c + b * b) * m["q2"] + 2 * b * c * m["q3"] + c * c * m["q4"]
    return a * m["t0"] + b * m["t1"] + c * m["t2"], squares, a


def smooth(df: DataFrame, keys: Sequence[str], x: str, y: str, span: float = 0.75) -> DataFrame:
    """Fit at every x of each series over the nearest ``span`` of its values: ``n``, mean ``y``, ``fitted``, ``se``, ``lo``, ``hi``.

    Meant for month series: each is one array of its distinct x, so points meet without pairing rows, and the work of a
    series grows with their square. Values that share an x count as often as they occur, in the weights and in the span. For an x
    without such a bound use :func:`smooth_on_grid`. Distances are scaled by the local bandwidth, which keeps the 3x3 system well
    scaled. The band is 1.96 standard errors wide on each side; the residual variance is the squared residuals over
    n - 2 tr(L) + tr(LL'), L being the matrix that smooths. Rows without x or y are left out.
    """
    points = F.array_sort(F.collect_list(F.struct(F.col(x).alias("x"), F.col("_y").alias("y"), F.col("_n").alias("c"), F.col("_ss").alias("ss"))))
    value = F.col(y).cast("double")
    averaged = (
        df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(*keys, x)
        .agg(F.avg(value).alias("_y"), F.count(F.lit(1)).alias("_n"), (F.var_pop(value) * F.count(F.lit(1))).alias("_ss"))
    )
    whole = spread(averaged.groupBy(*keys).agg(points.alias("_points"), F.sum("_n").alias("_total")), *keys)
    nearest = F.greatest(F.lit(1), F.floor(F.col("_total") * F.lit(span) + 1e-5))
    series = F.col("_points")

    def bandwidth(p: Column) -> Column:
        """Least distance within which the nearest values lie."""
        by_distance = F.array_sort(F.transform(series, lambda s: F.struct(F.abs(s.x - p.x).cast("double").alias("d"), s.c.alias("c"))))
        start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(0.0).alias("d"))
        step = lambda at, s: F.struct((at.seen + s.c).alias("seen"), F.when(at.seen < nearest, s.d).otherwise(at.d).alias("d"))
        return F.aggregate(by_distance, start, step).d

    def moments(p: Column) -> Column:
        scaled = F.transform(series, lambda s: F.struct(F.try_divide(s.x - p.x, p.h).alias("u"), s.y.alias("y"), s.c.alias("c")))
        near = F.filter(scaled, lambda s: F.abs(s.u) < 1)
        zero = F.struct(*[F.lit(0.0).alias(m) for m in MOMENTS])

        def add(total: Column, s: Column) -> Column:
            own = _parts(_tricube(s.u), s.u, s.y, s.c)
            return F.struct(*[(total[m] + own[m]).alias(m) for m in MOMENTS])

        return F.aggregate(near, zero, add)

    located = F.transform(series, lambda p: F.struct(p.x, p.y, p.c, p.ss, bandwidth(p).alias("h")))
    fits = whole.withColumn("_located", located).withColumn(
        "_fits", F.transform("_located", lambda p: F.struct(p.x.alias("x"), p.y.alias("y"), p.c.alias("n"), p.ss.alias("ss"), moments(p).alias("m")))
    )
    # The outer form keeps the optimizer from testing the array's size by fitting it a second time.
    rows = fits.select(*keys, "_total", F.inline_outer("_fits"))
    fitted, squares, own = _solution({name: F.col(f"m.{name}") for name in MOMENTS})
    solved = rows.select(
        *keys, "_total", F.col("x").alias(x), F.col("y").alias(y), "n", "ss", fitted.alias("fitted"), squares.alias("_squares"), own.alias("_own")
    )
    per = Window.partitionBy(*keys)
    rss = F.sum(F.col("ss") + F.col("n") * F.pow(F.col(y) - F.col("fitted"), F.lit(2))).over(per)
    freedom = F.col("_total") - 2 * F.sum(F.col("n") * F.col("_own")).over(per) + F.sum(F.col("n") * F.col("_squares")).over(per)
    se = F.when(freedom > 1e-9, F.sqrt(rss / freedom * F.col("_squares")))
    return solved.withColumn("se", se).select(
        *keys, x, y, "n", "fitted", "se", (F.col("fitted") - Z95 * F.col("se")).alias("lo"), (F.col("fitted") + Z95 * F.col("se")).alias("hi")
    )


def smooth_on_grid(df: DataFrame, keys: Sequence[str], x: str, y: str, size: int = 80, reach: float = 0.25) -> DataFrame:
    """Fit at ``size`` equally spaced x per series, over the values within ``reach`` of its range on either side.

    Work is linear in the rows: each adds its moments to the grid points in reach, summed up on the map side, so neither the
    number of values nor of distinct x of a series is bounded. Rows without x or y are left out; a series of a single x has a
    grid of that one, without a fit.
    """
    if not keys:
        return smooth_on_grid(df.withColumn("_all", F.lit(1)), ["_all"], x, y, size, reach).drop("_all")
    value = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_v"))
    ends = value.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.min("_x").alias("_low"), F.max("_x").alias("_high"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    placed = value.join(ends, same)
    step = (F.col("_high") - F.col("_low")) / (size - 1)
    at = F.coalesce(F.try_divide(F.col("_x") - F.col("_low"), step), F.lit(0.0))
    around = reach * (size - 1)
    reached = F.sequence(F.greatest(F.ceil(at - around), F.lit(0)).cast("int"), F.least(F.floor(at + around), F.lit(size - 1)).cast("int"))
    rows = placed.select(*keys, "_low", step.alias("_step"), "_v", at.alias("_at"), F.explode(reached).alias("_g"))
    u = (F.col("_at") - F.col("_g")) / around
    own = _parts(_tricube(u), u, F.col("_v"), F.lit(1.0))
    sums = rows.where(F.abs(u) < 1).groupBy(*keys, "_low", "_step", "_g").agg(*[F.sum(own[m]).alias(m) for m in MOMENTS])
    fitted = _solution({m: F.col(m) for m in MOMENTS})[0]
    return sums.where("_step > 0 OR _g = 0").select(*keys, (F.col("_low") + F.col("_g") * F.col("_step")).alias(x), fitted.alias("fitted"))
