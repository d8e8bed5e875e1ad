"""Weighted band lookup (W3 running sum + J5 band join + J6 first band).

Given a small table of categories with weights, each input row carrying a
value in [0, total weight) gets the category whose cumulative band
``lo < v <= hi`` holds it. The bands are a per-category table; the fact side
is never windowed or sorted.

``assign_band`` compares every value with every band, for a handful of bands. ``lookup_band`` is an equi-join: a band stands
in every bucket of ``width`` that it meets, a value in one, and only bands of the value's bucket are compared. With the mean
band's width as the bucket's, the bands take at most two rows a band and one, however their widths are spread; neither side need
be small. ``running_bands`` makes the bands of a table of any size, by distributed running totals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from carelake.operators.numbering import running_total


def cumulative_bands(weights: DataFrame, key: str, weight: str, order: str | None = None) -> DataFrame:
    """(key, lo, hi) with hi = running sum of weight in ``order``."""
    w = Window.orderBy(order or key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (weights.select(key, weight, *( [order] if order and order != key else []))
                   .withColumn("hi", F.sum(weight).over(w))
                   .withColumn("lo", F.col("hi") - F.col(weight))
                   .select(key, "lo", "hi"))


def assign_band(df: DataFrame, value_col: str, bands: DataFrame, key: str, out_col: str | None = None) -> DataFrame:
    """Left-join each row to the band holding ``value_col``. Bands are
    contiguous and non-overlapping, so at most one matches (the reference's
    NOT EXISTS "first band" rule is the ``lo`` bound)."""
    b = bands.withColumnRenamed(key, out_col or key)
    cond = (F.col(value_col) > b["lo"]) & (F.col(value_col) <= b["hi"])
    return df.join(b, cond, "left").drop("lo", "hi")


def running_bands(weights: DataFrame, key: str, weight: str) -> DataFrame:
    """(key, lo, hi) in the order of ``key``, as ``cumulative_bands``; no task holds the table."""
    total = running_total(weights.select(key, weight), [F.col(key).asc()], weight, "hi")
    return total.select(key, (F.col("hi") - F.coalesce(weight, F.lit(0))).cast("decimal(38,6)").alias("lo"), "hi")


def lookup_band(df: DataFrame, value_col: str, bands: DataFrame, key: str, out_col: str | None = None) -> DataFrame:
    """Left-join each row to the band with ``lo < value <= hi``, by buckets. Bands don't overlap, so at most one holds a value
    (J6); empty bands (lo = hi) hold nothing; null values and values outside have no band."""
    b = bands.where("lo < hi").select(F.col(key).alias("_key"), "lo", "hi")
    wide = b.agg(F.struct(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count(F.lit(1)).alias("n"))).scalar()
    start = wide.getField("lo")
    width = F.greatest((wide.getField("hi") - start).cast("double") / F.greatest(wide.getField("n"), F.lit(1)), F.lit(1e-9))
    bucket = lambda v: F.floor((v - start).cast("double") / width)
    b = b.withColumn("_bucket", F.explode(F.sequence(bucket(F.col("lo")), bucket(F.col("hi")))))
    rows = df.withColumn("_v", F.col(value_col)).withColumn("_bucket", bucket(F.col(value_col)))
    hit = (rows["_bucket"] == b["_bucket"]) & (F.col("_v") > F.col("lo")) & (F.col("_v") <= F.col("hi"))
    out = rows.join(b, hit, "left").drop("_bucket", "_v", "lo", "hi")
    return out.withColumnRenamed("_key", out_col or key)
