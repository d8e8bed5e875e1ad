"""Least squares per series on trend, weekday and season, in column expressions.

A row's terms x and value y make the products of X'X, X'y and y'y; those that are not 0 are exploded and added up per series and
place (map-side combined, so a long series is no hot group). ``solve`` eliminates the p x p system inside the row: an
``aggregate`` over the pivots of a ``transform``. There is no driver loop and no Python worker; a model is one row per
series.

Terms of a day: 1, the share of the span gone by, six weekday marks (Monday to Saturday), and HARMONICS sine and cosine
waves of a year, which are 0 if the span is shorter than two years (they could not be told from a trend). A small ridge on
all but the level keeps systems of short or uniform series solvable.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HARMONICS = 2
YEAR = 365.25
SEASON_DAYS = 730
RIDGE = 1e-6
N_TERMS = 2 + 6 + 2 * HARMONICS
WIDE = N_TERMS + 1  # terms and value


def with_terms(rows: DataFrame, first: Column, last: Column) -> DataFrame:
    """``rows`` with X, the terms of their day D, for a model of the days from ``first`` to ``last`` (may be subqueries)."""
    span = F.greatest(F.datediff("_HI", "_LO"), F.lit(1)).cast("double")
    season = F.when(F.datediff("_HI", "_LO") >= SEASON_DAYS, 1.0).otherwise(0.0)
    turn = F.unix_date("D") * (2 * math.pi / YEAR)
    terms = [F.lit(1.0), F.datediff("D", "_LO") / span, *[F.when(F.dayofweek("D") == d, 1.0).otherwise(0.0) for d in range(2, 8)],
             *[season * f(turn * k) for k in range(1, HARMONICS + 1) for f in (F.sin, F.cos)]]
    return rows.select("*", first.alias("_LO"), last.alias("_HI")).withColumn("X", F.array(*terms)).drop("_LO", "_HI")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)


def leverage(x: Column, inv: Column) -> Column:
    """x' (X'X)^-1 x."""
    return F.aggregate(F.zip_with(inv, x, lambda row, v: v * dot(row, x)), F.lit(0.0), lambda s, v: s + v)


def normal_equations(rows: DataFrame, by: str, y: str, where: Column | None = None) -> DataFrame:
    """(by, N, S): S maps place i * WIDE + j, i <= j, to the sum of z_i z_j over the rows that ``where`` holds for, z = x and
    then y. Sums of 0 are missing."""
    z = F.concat("X", F.array(F.col(y).cast("double")))
    products = F.flatten(F.transform(z, lambda u, i: F.transform(
        F.slice(z, i + 1, F.lit(WIDE) - i), lambda v, j: F.struct((i * WIDE + i + j).alias("P"), (u * v).alias("V")))))
    products = F.filter(products, lambda p: p["V"] != 0)
    return (rows.select(by, F.explode(products if where is None else F.when(where, products)).alias("Z")).select(by, "Z.P", "Z.V")
                .groupBy(by, "P").agg(F.sum("V").alias("V"))
                .groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct("P", "V"))).alias("S"))
                .withColumn("N", F.col("S")[0]))


def solve(s: Column) -> Column:
    """[X'X + ridge | X'y | 1] reduced by Gauss-Jordan: row i is unit vector i, coefficient i, row i of the inverse."""
    def at(i: Column, j: Column) -> Column:
        return F.coalesce(F.try_element_at(s, F.least(i, j) * WIDE + F.greatest(i, j)), F.lit(0.0)) + F.when((i == j) & (i > 0), RIDGE).otherwise(0.0)

    places, wide = F.sequence(F.lit(0), F.lit(N_TERMS - 1)), F.sequence(F.lit(0), F.lit(N_TERMS))
    start = F.transform(places, lambda i: F.concat(F.transform(wide, lambda j: at(i, j)),
                                                   F.transform(places, lambda j: F.when(i == j, 1.0).otherwise(0.0))))

    def eliminate(m: Column, k: Column) -> Column:
        pivots = F.element_at(m, k + 1)
        pivot = F.element_at(pivots, k + 1)
        return F.transform(m, lambda row, i: F.when(i == k, F.transform(row, lambda v: v / pivot)).otherwise(
            F.zip_with(row, pivots, lambda v, w: v - F.element_at(row, k + 1) * w / pivot)))

    return F.aggregate(places, start, eliminate)


def fit(rows: DataFrame, by: str, y: str, where: Column | None = None) -> DataFrame:
    """One row per series of rows (by, X, y) that ``where`` holds for: N rows, B coefficients, C inverse of X'X, V residual
    variance."""
    m = normal_equations(rows, by, y, where).withColumn("M", solve(F.col("S")))
    b = F.transform("M", lambda row: F.element_at(row, WIDE))
    c = F.transform("M", lambda row: F.slice(row, WIDE + 1, N_TERMS))
    m = m.select(by, "N", "S", b.alias("B"), c.alias("C"))
    place = lambda i: F.coalesce(F.try_element_at("S", i), F.lit(0.0))
    xy = F.transform(F.sequence(F.lit(0), F.lit(N_TERMS - 1)), lambda i: place(i * WIDE + N_TERMS))
    # y'y - b'X'y less what the ridge keeps back
    left = place(F.lit(N_TERMS * WIDE + N_TERMS)) - dot(F.col("B"), xy) - RIDGE * (dot(F.col("B"), F.col("B")) - F.col("B")[0] * F.col("B")[0])
    return m.select(by, "N", "B", "C", (F.greatest(left, F.lit(0.0)) / F.greatest(F.col("N") - N_TERMS, F.lit(1.0))).alias("V"))
