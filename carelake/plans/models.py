"""Prediction tables (L1-L5) and the queries that read them (Q6, Q14, Q15,
Q48, Q50-Q52, Q56-Q58, VQ9, VQ10, K1-K4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelake.operators import control_chart, drivers, pivot, timeseries
from carelake.plans import dashboards as Qd
from carelake.plans import features as V
from carelake.sources.adapter import SPECIALTIES, Tables

A, D = F.asc_nulls_last, F.desc_nulls_first


def materializable(fn):
    """Read the written prediction table when the refresh pipeline made one."""
    def wrapper(t: Tables) -> DataFrame:
        got = t.materialized.get(fn.__name__)
        return got if got is not None else fn(t)
    wrapper.__name__, wrapper.__doc__ = fn.__name__, fn.__doc__
    return wrapper


def _run_ts(t: Tables):
    # CURRENT_TIMESTAMP stand-in: the run's as-of date, so reruns are equal.
    return F.lit(t.profile.as_of.isoformat()).cast("timestamp_ntz")


@materializable
def pred_encounter_volume(t: Tables) -> DataFrame:
    """L1: 90-day forecast of daily encounters per type."""
    f = timeseries.seasonal_forecast(V.daily_encounter_volume(t), "ENCOUNTER_TYPE", "TS", "ENCOUNTER_COUNT",
                                    t.profile.forecast_days)
    return f.select(F.col("SERIES").alias("ENCOUNTER_TYPE"), F.col("TS").alias("FORECAST_DATE"),
                    F.round("FORECAST", 0).alias("FORECAST_COUNT"), F.round("LOWER", 0).alias("LOWER_BOUND"),
                    F.round("UPPER", 0).alias("UPPER_BOUND"), _run_ts(t).alias("MODEL_RUN_TS"))


@materializable
def pred_denial_anomalies(t: Tables) -> DataFrame:
    """L2: anomalies in daily denials per category over the last months."""
    a = timeseries.quantile_anomalies(V.daily_denial_volume(t), "DENIAL_CATEGORY", "TS", "DENIAL_COUNT",
                                      t.profile.eval_months, extra=["DENIED_CHARGES"])
    return a.select(F.col("SERIES").alias("DENIAL_CATEGORY"), "TS",
                    F.round("EXPECTED", 0).alias("EXPECTED_COUNT"), F.round("LOWER", 0).alias("LOWER_BOUND"),
                    F.round("UPPER", 0).alias("UPPER_BOUND"), "IS_ANOMALY",
                    F.round("PERCENTILE", 4).alias("PERCENTILE"),
                    F.col("Y").cast("long").alias("ACTUAL_COUNT"),
                    F.round("DENIED_CHARGES", 2).alias("ACTUAL_CHARGES"),
                    _run_ts(t).alias("MODEL_RUN_TS"))


@materializable
def pred_readmission_drivers(t: Tables) -> DataFrame:
    """L3."""
    return drivers.segment_drivers(V.readmission_drivers_input(t), "READMIT_METRIC", "LABEL",
                                   V.READMISSION_DIMS).withColumn("MODEL_RUN_TS", _run_ts(t))


@materializable
def pred_leakage_drivers(t: Tables) -> DataFrame:
    """L4."""
    return drivers.segment_drivers(V.leakage_drivers_input(t), "LEAKAGE_METRIC", "LABEL",
                                   V.LEAKAGE_DIMS).withColumn("MODEL_RUN_TS", _run_ts(t))


PREDICTION_TABLES = {
    "PRED_ENCOUNTER_VOLUME": pred_encounter_volume,
    "PRED_DENIAL_ANOMALIES": pred_denial_anomalies,
    "PRED_READMISSION_DRIVERS": pred_readmission_drivers,
    "PRED_LEAKAGE_DRIVERS": pred_leakage_drivers,
}


def prediction_inventory(t: Tables) -> DataFrame:
    """O7 for the prediction schema: (TABLE_NAME, ROW_COUNT) via UNION ALL."""
    parts = [fn(t).agg(F.count(F.lit(1)).alias("ROW_COUNT")).select(F.lit(name).alias("TABLE_NAME"), "ROW_COUNT")
             for name, fn in PREDICTION_TABLES.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---------------------------------------------------------------- queries over predictions
def q06_dash_predictions(t):
    return prediction_inventory(t).agg(F.sum("ROW_COUNT").cast("long").alias("N"))


def q14_dash_forecast(t):
    return (pred_encounter_volume(t).select("ENCOUNTER_TYPE", "FORECAST_DATE", "FORECAST_COUNT")
            .orderBy(A("ENCOUNTER_TYPE"), A("FORECAST_DATE")))


def q15_dash_anomalies(t):
    return (pred_denial_anomalies(t).select("TS", "ACTUAL_COUNT", "EXPECTED_COUNT", "IS_ANOMALY", "DENIAL_CATEGORY")
            .orderBy(A("TS"), A("DENIAL_CATEGORY")))


def q48_pred_forecast(t):
    return (pred_encounter_volume(t)
            .select("ENCOUNTER_TYPE", "FORECAST_DATE", "FORECAST_COUNT", "LOWER_BOUND", "UPPER_BOUND")
            .orderBy(A("ENCOUNTER_TYPE"), A("FORECAST_DATE")))


def q50_pred_anomalies(t):
    return (pred_denial_anomalies(t)
            .select("TS", "ACTUAL_COUNT", "EXPECTED_COUNT", "LOWER_BOUND", "UPPER_BOUND", "IS_ANOMALY",
                    "DENIAL_CATEGORY")
            .orderBy(A("TS"), A("DENIAL_CATEGORY")))


def _top_drivers(df: DataFrame, k: int | None) -> DataFrame:
    d = df.where(F.col("CONTRIBUTOR") != drivers.OVERALL)
    d = d.orderBy(D(F.abs("RELATIVE_CONTRIBUTION")), A("CONTRIBUTOR"))
    return d.limit(k) if k else d


def q51_pred_readmit_drivers(t):
    return _top_drivers(pred_readmission_drivers(t), 10).select("CONTRIBUTOR", "RELATIVE_CONTRIBUTION", "GROWTH_RATE")


def q52_pred_leakage_drivers(t):
    return _top_drivers(pred_leakage_drivers(t), 10).select("CONTRIBUTOR", "RELATIVE_CONTRIBUTION", "GROWTH_RATE")


def q56_ops_predictions(t):
    return pred_encounter_volume(t).agg(F.count(F.lit(1)).alias("N"))


def q57_ops_anomalies(t):
    return pred_denial_anomalies(t).agg(F.count(F.lit(1)).alias("N"))


def q58_ops_pred_tables(t):
    return prediction_inventory(t).orderBy(A("TABLE_NAME"))


def vq09_encounter_forecast(t):
    return (pred_encounter_volume(t)
            .select("ENCOUNTER_TYPE", F.col("FORECAST_DATE").cast("date").alias("FORECAST_DATE"),
                    F.round("FORECAST_COUNT", 0).alias("FORECAST_COUNT"), F.round("LOWER_BOUND", 0).alias("LOWER_BOUND"),
                    F.round("UPPER_BOUND", 0).alias("UPPER_BOUND"))
            .orderBy(A("ENCOUNTER_TYPE"), A("FORECAST_DATE")))


def vq10_denial_anomalies(t):
    return (pred_denial_anomalies(t).where(F.col("IS_ANOMALY") == True)  # noqa: E712
            .select("DENIAL_CATEGORY", F.col("TS").cast("date").alias("ANOMALY_DATE"), "ACTUAL_COUNT",
                    F.round("EXPECTED_COUNT", 0).alias("EXPECTED_COUNT"), "IS_ANOMALY")
            .orderBy(A("ANOMALY_DATE"), A("DENIAL_CATEGORY")))


# ---------------------------------------------------------------- client-side analytics
def k1_readmit_control_chart(t):
    return control_chart.p_chart(Qd.q25_readmit_fs_control(t))


def k2_readmit_facility_specialty_matrix(t):
    return pivot.pivot_matrix(Qd.q22_readmit_fs_heatmap(t), ["FACILITY_NAME"], "SPECIALTY", "RATE", SPECIALTIES)


def k3_or_block_weekday_matrix(t):
    return pivot.pivot_matrix(Qd.q32_or_heatmap(t), ["BLOCK_NAME"], "DOW", "UTIL", pivot.WEEKDAYS)


def k4_forecast_overlay(t):
    """Actual and forecast daily encounters per type in one series (kind column)."""
    act = Qd.q49_pred_actuals(t).select("ENCOUNTER_TYPE", F.col("DT").alias("DT"),
                                        F.col("CNT").cast("double").alias("VALUE"), F.lit("actual").alias("KIND"))
    fc = pred_encounter_volume(t).select("ENCOUNTER_TYPE", F.col("FORECAST_DATE").cast("date").alias("DT"),
                                         F.col("FORECAST_COUNT").alias("VALUE"), F.lit("forecast").alias("KIND"))
    return act.unionByName(fc)


def k5_anomaly_count(t):
    return pred_denial_anomalies(t).agg(F.count_if(F.col("IS_ANOMALY")).cast("long").alias("ANOMALIES"))


def l1_pred_encounter_volume(t):
    return pred_encounter_volume(t)


def l2_pred_denial_anomalies(t):
    return pred_denial_anomalies(t)


def l3_pred_readmission_drivers(t):
    return pred_readmission_drivers(t)


def l4_pred_leakage_drivers(t):
    return pred_leakage_drivers(t)


def v1_daily_encounter_volume(t):
    return V.daily_encounter_volume(t)


def v2_daily_denial_volume(t):
    return V.daily_denial_volume(t).withColumn("DENIED_CHARGES", F.round("DENIED_CHARGES", 2))


def v3_readmission_drivers_input(t):
    return V.readmission_drivers_input(t)


def v4_leakage_drivers_input(t):
    return V.leakage_drivers_input(t)


def v5_denial_train_eval_sizes(t):
    """V5: rows on each side of the evaluation split."""
    v2 = V.daily_denial_volume(t)
    train, ev = V.split_recent(v2, "TS", t.profile.eval_months)
    return (train.agg(F.count(F.lit(1)).alias("ROWS")).select(F.lit("TRAIN").alias("PART"), "ROWS")
            .unionByName(ev.agg(F.count(F.lit(1)).alias("ROWS")).select(F.lit("EVAL").alias("PART"), "ROWS")))


import re  # noqa: E402

QUERIES = {name: fn for name, fn in dict(globals()).items()
           if callable(fn) and re.match(r"^(v?q\d\d|k\d|l\d|v\d)_", name)}
