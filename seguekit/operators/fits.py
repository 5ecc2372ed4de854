"""Filter sweeps y = a (1 - exp(-b x)) + c fitted to many curves at once, and their reconstruction."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The rate b lies between these.
LOW, HIGH = 0.01, 50.0


def _moments(u: Column, y: str = "y") -> Column:
    return F.struct(F.sum(u).alias("u"), F.sum(u * u).alias("uu"), F.sum(u * F.col(y)).alias("uy"))


def _fitted(m: Column, b: Column) -> Column:
    """The line for one rate from its sums ``m``, with what it is chosen by in front."""
    n, sy, syy = F.col("n"), F.col("sy"), F.col("syy")
    suu, suy = m["uu"] - m["u"] * m["u"] / n, m["uy"] - m["u"] * sy / n
    a = F.coalesce(F.try_divide(suy, suu), F.lit(0.0))
    r2 = F.coalesce(F.try_divide(a * suy, syy - sy * sy / n), F.lit(0.0))
    return F.struct(F.round(r2, 9).alias("__order"), (-b).alias("__minus"), a.alias("a"), b.alias("b"), ((sy - a * m["u"]) / n).alias("c"), r2.alias("r2"))


def sweep_fit(points: DataFrame, key: str, rounds: int = 5, grid: int = 13) -> DataFrame:
    """(key, kind, a, b, c, r2, rmse, n) for curves (key, x, y), x from 0 to 1.

    For a given rate the curve is linear in a and c, so least squares needs five sums. A round sums them for ``grid`` rates of
    each curve in one aggregate (no row is multiplied), takes the best and narrows the rates to its neighbours: the
    spacing shrinks (grid - 1) / 2 times a round. Under 3 points or without spread a curve is constant. Of equal fits (nine decimals) the lower rate.
    """
    span = math.log(HIGH) - math.log(LOW)
    whole = points.groupBy(key).agg(F.count("*").alias("n"), F.sum("y").alias("sy"), F.sum(F.col("y") * F.col("y")).alias("syy"), F.var_pop("y").alias("v"))
    centre, half = F.lit(math.log(LOW) + span / 2), span / 2
    best = whole.select(key, centre.alias("__lb"))
    for _ in range(rounds):
        rates = [F.exp(F.greatest(F.lit(math.log(LOW)), F.least(F.lit(math.log(HIGH)), F.col("__lb") + (2 * g / (grid - 1) - 1) * half))) for g in range(grid)]
        near = points.join(best.select(key, F.array(*rates).alias("__b")), key)
        u = [1 - F.exp(-F.col("__b")[g] * F.col("x")) for g in range(grid)]
        sums = near.groupBy(key).agg(F.first("__b").alias("__b"), F.array(*(_moments(x) for x in u)).alias("__m")).join(whole, key)
        top = F.array_max(F.zip_with("__m", "__b", _fitted))
        best = sums.select(key, "n", "v", "sy", "syy", top.alias("__f")).withColumn("__lb", F.log(F.col("__f.b")))
        half = half * 2 / (grid - 1)
    flat = (F.col("n") < 3) | (F.col("v") <= 1e-12)
    pick = lambda x, y: F.when(flat, y).otherwise(x)
    error = F.sqrt(F.greatest(F.lit(0.0), (1 - F.col("__f.r2")) * F.col("v")))
    return best.select(key, pick(F.lit("filter_sweep"), F.lit("constant")).alias("kind"), *(pick(F.col(f"__f.{c}"), F.lit(0.0)).alias(c) for c in "ab"), pick(F.col("__f.c"), F.col("sy") / F.col("n")).alias("c"), pick(F.col("__f.r2"), F.lit(0.0)).alias("r2"), pick(error, F.lit(0.0)).alias("rmse"), "n")


def reconstruct(points: DataFrame, fits: DataFrame, key: str) -> DataFrame:
    """``points`` with ``fitted``, for fits (key, kind, a, b, c) of any kind."""
    x, a, b, c = F.col("x"), F.col("__fit.a"), F.col("__fit.b"), F.col("__fit.c")
    shapes = {"filter_sweep": a * (1 - F.exp(-b * x)) + c, "exponential": a * F.exp(-b * x) + c, "linear": a * x + c, "logarithmic": a * F.log1p(b * x) + c}
    y = F.coalesce(*(F.when(F.col("__fit.kind") == k, s) for k, s in shapes.items()), c)
    return points.join(fits.select(F.col(key).alias("__key"), F.struct("kind", "a", "b", "c").alias("__fit")), F.col(key) == F.col("__key")).select(*points.columns, y.alias("fitted"))
