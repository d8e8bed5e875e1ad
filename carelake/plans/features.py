"""Feature views V1-V5 (model inputs)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelake.functions import compat as C

from carelake.sources.adapter import Tables


def daily_encounter_volume(t: Tables) -> DataFrame:
    """V1: (TS, ENCOUNTER_TYPE, ENCOUNTER_COUNT)."""
    e = t.get("fct_encounter")
    return (e.groupBy("ADMIT_DATE", "ENCOUNTER_TYPE").agg(F.count(F.lit(1)).alias("ENCOUNTER_COUNT"))
             .select(F.col("ADMIT_DATE").cast("timestamp_ntz").alias("TS"), "ENCOUNTER_TYPE", "ENCOUNTER_COUNT"))


def daily_denial_volume(t: Tables, mart: DataFrame | None = None) -> DataFrame:
    """V2: (TS, DENIAL_CATEGORY, DENIAL_COUNT, DENIED_CHARGES). The charge sum
    is added because the anomaly output reports it (SURVEY §8 item 1)."""
    d = mart if mart is not None else t.mart("mart_denials_revcycle")
    return (d.groupBy("SERVICE_DATE", "DENIAL_CATEGORY")
             .agg(F.count(F.lit(1)).alias("DENIAL_COUNT"), C.exact_sum("CHARGE_AMT").alias("DENIED_CHARGES"))
             .select(F.col("SERVICE_DATE").cast("timestamp_ntz").alias("TS"), "DENIAL_CATEGORY",
                     "DENIAL_COUNT", "DENIED_CHARGES"))


def _age_bucket(age):
    return (F.when(age < 18, "PEDIATRIC").when(age < 40, "YOUNG_ADULT").when(age < 65, "ADULT")
             .when(age < 80, "SENIOR").otherwise("ELDERLY"))


def _hcc_bucket(h):
    return (F.when(h.isNull(), "UNKNOWN").when(h < 0.5, "LOW").when(h < 1.0, "MODERATE")
             .when(h < 2.0, "HIGH").otherwise("VERY_HIGH"))


READMISSION_DIMS = ["DRG_CODE", "PAYER_TYPE", "PATIENT_GENDER", "AGE_BUCKET", "HCC_BUCKET", "DEPT_NAME",
                    "ENCOUNTER_TYPE", "IS_LONG_STAY", "FACILITY_NAME", "DISCHARGE_DISPOSITION"]
LEAKAGE_DIMS = ["REFERRED_TO_SPECIALTY", "REFERRING_SPECIALTY", "PATIENT_PAYER_TYPE", "ZIP_PREFIX",
                "IS_HIGH_VALUE", "FACILITY_NAME", "STATUS"]


def readmission_drivers_input(t: Tables, mart: DataFrame | None = None, months: int | None = None) -> DataFrame:
    """V3: one row per IP/OBS encounter; LABEL = admit month within the last
    ``months`` months of the mart (scalar subquery, J9)."""
    m = mart if mart is not None else t.mart("mart_readmission_los")
    k = months if months is not None else t.profile.label_months
    newest = m.select(F.max("ADMIT_MONTH")).scalar()
    return m.select(
        F.when(F.col("READMIT_30_FLAG"), 1).otherwise(0).alias("READMIT_METRIC"),
        "DRG_CODE", "PAYER_TYPE", "PATIENT_GENDER",
        _age_bucket(F.col("PATIENT_AGE")).alias("AGE_BUCKET"),
        _hcc_bucket(F.col("HCC_SCORE")).alias("HCC_BUCKET"),
        "DEPT_NAME", "ENCOUNTER_TYPE",
        F.col("IS_LONG_STAY").cast("string").alias("IS_LONG_STAY"),
        "FACILITY_NAME", "DISCHARGE_DISPOSITION",
        (F.col("ADMIT_MONTH") >= F.add_months(newest, -k)).alias("LABEL"),
    )


def leakage_drivers_input(t: Tables, mart: DataFrame | None = None, months: int | None = None) -> DataFrame:
    """V4: one row per referral; LABEL = referral in the last ``months`` months."""
    m = mart if mart is not None else t.mart("mart_patient_leakage")
    k = months if months is not None else t.profile.label_months
    newest = m.select(F.max("REFERRAL_DATE")).scalar()
    return m.select(
        F.when(F.col("LEAKAGE_FLAG"), 1).otherwise(0).alias("LEAKAGE_METRIC"),
        "REFERRED_TO_SPECIALTY", "REFERRING_SPECIALTY", "PATIENT_PAYER_TYPE",
        F.substring("PATIENT_ZIP", 1, 3).alias("ZIP_PREFIX"),
        F.col("IS_HIGH_VALUE").cast("string").alias("IS_HIGH_VALUE"),
        "FACILITY_NAME", "STATUS",
        (F.col("REFERRAL_DATE") >= F.add_months(newest, -k)).alias("LABEL"),
    )


def split_recent(df: DataFrame, ts_col: str, months: int) -> tuple[DataFrame, DataFrame]:
    """V5: (train, evaluation) split at ``max(ts) - months``."""
    cut = F.add_months(df.select(F.max(F.col(ts_col).cast("date"))).scalar(), -months)
    d = F.col(ts_col).cast("date")
    return df.where(d < cut), df.where(d >= cut)
