"""Mart properties on the driver tables (SURVEY §5 (3))."""

from pyspark.sql import functions as F

from carelake.plans import marts as M
from carelake.plans import quality


def test_mart_row_counts_follow_driving_facts(tables):
    enc = tables.get("fct_encounter")
    ipobs = enc.where(F.col("ENCOUNTER_TYPE").isin(M.IP_OBS)).count()
    assert M.readmission_los(tables).count() == ipobs  # no orphans in test data: inner joins keep all
    assert M.patient_leakage(tables).count() == tables.get("fct_referral").count()
    assert M.or_capacity(tables).count() == tables.get("fct_or_case").count()
    denied = tables.get("fct_claim_line").where("DENIED_FLAG").count()
    assert M.denials_revcycle(tables).count() == denied


def test_declared_keys_unique_except_documented_staffing_grain(tables):
    rows = {r.TABLE_NAME: r for r in quality.QUERIES["d14_key_uniqueness"](tables).collect()}
    for name in ("MART_PATIENT_LEAKAGE", "MART_READMISSION_LOS", "MART_OR_CAPACITY", "MART_DENIALS_REVCYCLE",
                 "MART_FINANCIAL_PERFORMANCE"):
        assert rows[name].RESULT == "PASS", name
    assert tables.get("fct_claim_line").select("CLAIM_LINE_SK").distinct().count() == \
        tables.get("fct_claim_line").count()


def test_rates_in_range(tables):
    r = M.readmission_los(tables).agg(F.min("LOS_INDEX"), F.max(F.col("IS_LONG_STAY").cast("int"))).first()
    assert r[0] >= 0
    u = M.or_capacity(tables).agg(F.min("UTILIZATION_PCT"), F.max("UTILIZATION_PCT")).first()
    assert 0 <= u[0] <= u[1]
    s = M.staffing_quality(tables).agg(F.min("READMIT_RATE"), F.max("READMIT_RATE"), F.max("AGENCY_PCT")).first()
    assert 0 <= s[0] <= s[1] <= 1 and s[2] <= 1
    lk = M.patient_leakage(tables)
    assert lk.where(~F.col("LEAKAGE_FLAG") & (F.col("LOST_REVENUE") != 0)).count() == 0


def test_staffing_discharges_equal_direct_count(tables):
    m = M.staffing_quality(tables).select("DEPT_ID", "SHIFT_DATE", "DISCHARGES").distinct()
    enc = tables.get("fct_encounter").where(F.col("ENCOUNTER_TYPE").isin(M.IP_OBS) & F.col("DISCHARGE_DATE").isNotNull())
    direct = enc.groupBy("DEPT_ID", F.col("DISCHARGE_DATE").alias("SHIFT_DATE")).count()
    j = m.join(direct, ["DEPT_ID", "SHIFT_DATE"], "left").where(F.coalesce("count", F.lit(0)) != F.col("DISCHARGES"))
    assert j.count() == 0


def test_quality_band_edges(spark):
    from carelake.plans.quality import _band
    df = spark.createDataFrame([(2.9,), (3.0,), (5.0,), (25.0,), (30.0,), (30.1,), (None,)], "v double")
    got = [r.b for r in df.select(_band("METRIC_READMISSION_RATE", F.col("v")).alias("b")).collect()]
    assert got == ["FAIL", "WARN", "PASS", "PASS", "WARN", "FAIL", "FAIL"]
