"""L1 forecast and L2 anomaly detection on daily multi-series data.

The reference calls closed model services; only their inputs and outputs are
visible. These are published, SQL-checkable statistics: least squares on
trend, weekday and yearly waves (``regression``), with a prediction interval
from the residual variance for the forecast and with quantiles of the past
residuals for the anomalies. The simpler weekday profile (mean and sample
standard deviation per series and day of week) is kept beside them.

Scale: the input is already aggregated to one row per (series, day), so it
grows with days x series, not with the fact table. The forecast's zero days
come from ``explode(sequence)`` per series key (no cross join), and every step
is a groupBy, window or equi-join Spark distributes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from carelake.functions.stats import normal_cdf
from carelake.operators import regression as R

Z95 = 1.96


def _daily(df: DataFrame, series: str, ts: str, y: str, extra: list[str]) -> DataFrame:
    return (df.groupBy(F.col(series).alias("SERIES"), F.col(ts).cast("date").alias("D"))
              .agg(F.sum(y).alias("Y"), *[F.sum(c).alias(c) for c in extra]))


def _dense(daily: DataFrame, lo, hi, extra: list[str], keys: DataFrame | None = None) -> DataFrame:
    keys = keys if keys is not None else daily.select("SERIES").distinct()
    days = keys.select("SERIES", F.explode(F.sequence(lo, hi)).alias("D"))
    return (days.join(daily, ["SERIES", "D"], "left")
                .fillna(0, subset=["Y"]).fillna(0.0, subset=extra)
                .withColumn("DOW", F.dayofweek("D")))


def _profile(dense: DataFrame) -> DataFrame:
    return dense.groupBy("SERIES", "DOW").agg(F.avg("Y").alias("MU"),
                                              F.coalesce(F.stddev_samp("Y"), F.lit(0.0)).alias("SD"))


def weekday_forecast(df: DataFrame, series: str, ts: str, y: str, horizon: int, z: float = Z95) -> DataFrame:
    """(SERIES, TS, FORECAST, LOWER, UPPER) for ``horizon`` days after the
    newest observation, from the whole history (zero-filled)."""
    daily = _daily(df, series, ts, y, [])
    span = daily.agg(F.struct(F.min("D").alias("LO"), F.max("D").alias("HI"))).scalar()
    oldest, newest = span.getField("LO"), span.getField("HI")
    keys = daily.select("SERIES").distinct()
    prof = _profile(_dense(daily, oldest, newest, [], keys))
    fut = (keys.select("SERIES", F.explode(F.sequence(F.date_add(newest, 1), F.date_add(newest, horizon))).alias("D"))
               .withColumn("DOW", F.dayofweek("D")))
    out = fut.join(prof, ["SERIES", "DOW"], "left")
    return out.select("SERIES", F.col("D").cast("timestamp_ntz").alias("TS"),
                      F.col("MU").alias("FORECAST"),
                      (F.col("MU") - z * F.col("SD")).alias("LOWER"),
                      (F.col("MU") + z * F.col("SD")).alias("UPPER"))


def weekday_anomalies(df: DataFrame, series: str, ts: str, y: str, eval_months: int,
                      extra: list[str] | None = None, z: float = Z95) -> DataFrame:
    """Fit the weekday profile on the rows before ``max - eval_months`` and
    score the others: (SERIES, TS, EXPECTED, LOWER, UPPER, IS_ANOMALY,
    PERCENTILE, Y, *extra), one row per row of the evaluation side.

    The profile is a window over the daily rows that only averages those
    before the cut, so the input is aggregated once; only the newest day is
    found apart (a scan of the date column). A series that has no row for a
    weekday before the cut has no expectation there (nulls)."""
    extra = extra or []
    daily = _daily(df, series, ts, y, extra).withColumn("DOW", F.dayofweek("D"))
    cut = F.add_months(df.select(F.max(F.col(ts).cast("date"))).scalar(), -eval_months)
    past = F.when(F.col("D") < cut, F.col("Y"))
    w = Window.partitionBy("SERIES", "DOW")
    fitted = daily.withColumn("MU", F.avg(past).over(w)).withColumn(
        "SD", F.when(F.col("MU").isNotNull(), F.coalesce(F.stddev_samp(past).over(w), F.lit(0.0))))
    lo, hi = F.col("MU") - z * F.col("SD"), F.col("MU") + z * F.col("SD")
    zscore = F.when(F.col("SD") > 0, (F.col("Y") - F.col("MU")) / F.col("SD"))
    return fitted.where(F.col("D") >= cut).select(
        "SERIES", F.col("D").cast("timestamp_ntz").alias("TS"),
        F.col("MU").alias("EXPECTED"), lo.alias("LOWER"), hi.alias("UPPER"),
        ((F.col("Y") < lo) | (F.col("Y") > hi)).alias("IS_ANOMALY"),
        normal_cdf(zscore).alias("PERCENTILE"), "Y", *extra)


def seasonal_forecast(df: DataFrame, series: str, ts: str, y: str, horizon: int, z: float = Z95) -> DataFrame:
    """(SERIES, TS, FORECAST, LOWER, UPPER) for ``horizon`` days after the newest observation, from the whole history
    (days without a row count 0)."""
    daily = _daily(df, series, ts, y, [])
    span = daily.agg(F.struct(F.min("D").alias("LO"), F.max("D").alias("HI"))).scalar()
    lo, hi = span.getField("LO"), span.getField("HI")
    model = R.fit(R.with_terms(_dense(daily, lo, hi, []), lo, hi), "SERIES", "Y")
    days = R.with_terms(model.withColumn("D", F.explode(F.sequence(F.date_add(hi, 1), F.date_add(hi, horizon)))), lo, hi)
    out = days.select("SERIES", F.col("D").cast("timestamp_ntz").alias("TS"), R.dot(F.col("B"), F.col("X")).alias("FORECAST"),
                      (z * F.sqrt(F.col("V") * (1 + R.leverage(F.col("X"), F.col("C"))))).alias("E"))
    return out.select("SERIES", "TS", "FORECAST", (F.col("FORECAST") - F.col("E")).alias("LOWER"),
                      (F.col("FORECAST") + F.col("E")).alias("UPPER"))


def quantile_anomalies(df: DataFrame, series: str, ts: str, y: str, eval_months: int,
                       extra: list[str] | None = None, alarm: float = 0.05) -> DataFrame:
    """Fit trend, weekday and season on the rows before ``max - eval_months``; of the others, those beyond the
    ``alarm / 2`` and ``1 - alarm / 2`` quantiles of the past residuals are anomalies: (SERIES, TS, EXPECTED, LOWER, UPPER,
    IS_ANOMALY, PERCENTILE, Y, *extra), one row per row of the evaluation side. No curve is assumed: the quantiles and
    the percentile (share of past residuals below, ties half) are those of the residuals, to six decimals.

    A series' window holds its daily rows, so it is bounded by the days of history. A series with fewer than twice as many
    past rows as the model has terms has no expectation (nulls). The model's own error is not in the quantiles, which
    shows where noise ends sharply: exponential noise alarms a point more often than ``alarm`` after four years of history."""
    extra = extra or []
    daily = _daily(df, series, ts, y, extra)
    span = df.agg(F.struct(F.min(F.col(ts).cast("date")).alias("LO"), F.max(F.col(ts).cast("date")).alias("HI"))).scalar()
    cut = F.add_months(span.getField("HI"), -eval_months)
    past = F.col("D") < cut
    daily = R.with_terms(daily, span.getField("LO"), cut)
    model = R.fit(daily, "SERIES", "Y", past).where(F.col("N") >= 2 * R.N_TERMS).select("SERIES", "B")
    fitted = daily.join(model, "SERIES", "left").select("SERIES", "D", "Y", *extra, past.cast("long").alias("PAST"),
                                                        R.dot(F.col("B"), F.col("X")).alias("EXPECTED"))
    whole = Window.partitionBy("SERIES")
    upto = whole.orderBy("R").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    alike = Window.partitionBy("SERIES", "R")
    bounds = F.percentile(F.when(F.col("PAST") == 1, F.col("R")), F.array(F.lit(alarm / 2), F.lit(1 - alarm / 2))).over(whole)
    out = fitted.withColumn("R", F.round(F.col("Y") - F.col("EXPECTED"), 6)).select(
        "*", bounds.alias("Q"), ((F.sum("PAST").over(upto) - F.sum("PAST").over(alike) / 2)
                                 / F.nullif(F.sum("PAST").over(whole), F.lit(0))).alias("P"))
    lo, hi = F.col("EXPECTED") + F.col("Q")[0], F.col("EXPECTED") + F.col("Q")[1]
    return out.where(F.col("PAST") == 0).select(
        "SERIES", F.col("D").cast("timestamp_ntz").alias("TS"), "EXPECTED", lo.alias("LOWER"), hi.alias("UPPER"),
        ((F.col("R") < F.col("Q")[0]) | (F.col("R") > F.col("Q")[1])).alias("IS_ANOMALY"),
        F.when(F.col("EXPECTED").isNotNull(), F.col("P")).alias("PERCENTILE"), "Y", *extra)
