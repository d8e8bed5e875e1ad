"""J4: "calendar day within a stay" without a range join.

The reference joins a date spine to encounters on
``d BETWEEN admit AND COALESCE(discharge, d)`` inside a window [lo, hi].
Spark plans such a non-equi join as a broadcast nested loop join (every day x
every stay). The same rows come from clipping each stay to the window and
exploding ``sequence(start, end)``: a narrow, per-row operation whose output
is exactly the sum of stay days in the window, with no shuffle and no pairs.

Where only sums per day are wanted, ``daily_levels`` needs two rows per stay
instead of one per day: changes on the first day and after the last are added
up per day, and a running sum over the days of a group gives the levels.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def clip_stays(df: DataFrame, start_col: str, end_col: str, lo: dt.date, hi: dt.date) -> DataFrame:
    """``df`` with the stay's first and last day inside [lo, hi] as ``_s`` and
    ``_e``; rows without such a day are left out. A null end is an open stay."""
    lo_c, hi_c = F.lit(lo), F.lit(hi)
    s = F.greatest(F.col(start_col).cast("date"), lo_c)
    e = F.least(F.coalesce(F.col(end_col).cast("date"), hi_c), hi_c)
    return df.withColumn("_s", s).withColumn("_e", e).where(F.col("_s") <= F.col("_e"))


def merge_stays(stays: DataFrame, keys: list[str]) -> DataFrame:
    """Clipped stays -> (keys, _s, _e) without overlaps per ``keys``: a stay
    loaded twice, or in overlapping parts, covers each of its days once."""
    w = Window.partitionBy(*keys).orderBy("_s", "_e")
    so_far = F.max("_e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = stays.select(*keys, "_s", "_e").distinct().withColumn(
        "_new", F.when(F.col("_s") <= so_far, 0).otherwise(1))
    parts = marked.withColumn("_part", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return parts.groupBy(*keys, "_part").agg(F.min("_s").alias("_s"), F.max("_e").alias("_e")).drop("_part")


def changes(stays: DataFrame, keys: list[str], levels: dict) -> DataFrame:
    """Two rows per clipped stay: ``levels`` (name -> Column) come on its
    first day and go the day after its last."""
    days = F.array(F.struct(F.col("_s").alias("_day"), F.lit(1).alias("_sign")),
                   F.struct(F.date_add("_e", 1).alias("_day"), F.lit(-1).alias("_sign")))
    x = stays.select(*keys, *[c.alias(n) for n, c in levels.items()], F.explode(days).alias("_x"))
    return x.select(*keys, F.col("_x._day").alias("_day"),
                    *[F.when(F.col("_x._sign") == 1, F.col(n)).otherwise(-F.col(n)).alias(n) for n in levels])


def daily_levels(events: DataFrame, keys: list[str], levels: list[str], out_col: str = "DAY") -> DataFrame:
    """Running sums of ``levels`` per day and group, for every day on which
    the first of them is positive. The window runs over one row per group and
    day with a change; days between changes come from a bounded sequence."""
    w = Window.partitionBy(*keys).orderBy("_day")
    daily = events.groupBy(*keys, "_day").agg(*[F.sum(c).alias(c) for c in levels])
    run = daily.select(*keys, "_day", F.lead("_day").over(w).alias("_next"),
                       *[F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias(c) for c in levels])
    run = run.where(F.col(levels[0]) > 0)
    return run.withColumn(out_col, F.explode(F.sequence("_day", F.date_sub("_next", 1), F.expr("INTERVAL 1 DAY")))) \
              .select(*keys, out_col, *levels)


def expand_stay_days(df: DataFrame, start_col: str, end_col: str, lo: dt.date, hi: dt.date,
                     out_col: str = "DAY") -> DataFrame:
    """One output row per (input row, day) with ``lo <= day <= hi`` and
    ``start <= day <= coalesce(end, hi)``.

    A null end means an open stay (runs to ``hi``). Rows whose end precedes
    their start produce nothing: the ``s <= e`` guard matters because Spark's
    ``sequence`` counts *down* when start > end.
    """
    return (clip_stays(df, start_col, end_col, lo, hi)
              .withColumn(out_col, F.explode(F.sequence(F.col("_s"), F.col("_e"), F.expr("INTERVAL 1 DAY"))))
              .drop("_s", "_e"))
