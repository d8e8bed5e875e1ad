"""Literal-row tests for the dialect traps and the null branches
listed in FIXTURES §B."""

import datetime as dt

from pyspark.sql import functions as F

from carelake.functions import compat as C
from carelake.plans import marts as M
from tests import fakes
from tests.fakes import FakeTables

D = dt.date
TS = dt.datetime


def _dims(spark):
    return {
        "dim_patient": spark.createDataFrame([
            (1, "MRN-1", "Ann", "Lee", D(2000, 12, 31), "F", "123-45-6789", "(555) 555-1234", "a@x.org", "12345",
             "PAY-001", None, True)], fakes.PATIENT),
        "dim_provider": spark.createDataFrame([
            (10, "1", "Bo", "Chu", None, "Cardiology"), (11, "2", "Cy", "Dee", "MD", "Oncology")], fakes.PROVIDER),
        "dim_payer": spark.createDataFrame([
            (1, "PAY-001", "Medicare", "MEDICARE", None), (2, "PAY-002", "Plan", "COMMERCIAL", 30)], fakes.PAYER),
        "dim_drg": spark.createDataFrame([(0, "001", "DRG 001", "MDC 1", 1.0, None),
                                          (1, "002", "DRG 002", "MDC 1", 1.2, 2.0)], fakes.DRG),
        "dim_department": spark.createDataFrame([("DEPT-001", "Med", "INPATIENT", "FAC-001")], fakes.DEPT),
        "dim_facility": spark.createDataFrame([("FAC-001", "Main")], fakes.FAC),
        "dim_procedure": spark.createDataFrame([(5, "CPT5", "knee", "SURG")], fakes.PROC),
        "dim_diagnosis": spark.createDataFrame([(1, "ICD-001", "dx")], fakes.DX),
    }


def _enc(eid, **kw):
    base = dict(ENCOUNTER_ID=eid, PATIENT_SK=1, PROVIDER_SK=10, PAYER_SK=1, DRG_SK=1, ENCOUNTER_TYPE="INPATIENT",
                ADMIT_DATE=D(2001, 1, 1), DISCHARGE_DATE=D(2001, 1, 3), DISCHARGE_DISPOSITION="HOME", LOS_DAYS=2,
                EXPECTED_LOS=2.0, TOTAL_CHARGES=100.0, TOTAL_COST=60.0, TOTAL_PAYMENTS=70.0, READMIT_30_FLAG=False,
                NET_REVENUE=10.0, DEPT_ID="DEPT-001", FACILITY_ID="FAC-001")
    base.update(kw)
    return tuple(base[c.split()[0]] for c in fakes.ENCOUNTER.split(", "))


def test_null_credential_nulls_display_name_and_optional_dims(spark):
    frames = _dims(spark)
    frames["fct_encounter"] = spark.createDataFrame([
        _enc("E1"),
        _enc("E2", PROVIDER_SK=None, DRG_SK=None, PAYER_SK=None),
        _enc("E3", ENCOUNTER_TYPE="ED"),
    ], fakes.ENCOUNTER)
    t = FakeTables(spark, frames)
    rows = {r.ENCOUNTER_ID: r for r in M.readmission_los(t).collect()}
    assert set(rows) == {"E1", "E2"}            # ED filtered, orphan dims kept (left joins)
    assert rows["E1"].ATTENDING_PROVIDER is None  # null credential -> null concat
    assert rows["E2"].DRG_CODE is None and rows["E2"].PAYER_TYPE is None
    assert rows["E1"].PATIENT_AGE == 1           # year boundaries, not whole years


def test_los_index_uses_unrounded_ratio_and_zero_guards(spark):
    frames = _dims(spark)
    frames["dim_drg"] = spark.createDataFrame([(0, "001", "x", "m", 1.0, None)], fakes.DRG)
    frames["fct_encounter"] = spark.createDataFrame([
        _enc("A", DRG_SK=0, LOS_DAYS=376, EXPECTED_LOS=250.0),   # 1.504 -> index 1.5, still long stay
        _enc("B", DRG_SK=0, LOS_DAYS=3, EXPECTED_LOS=0.0),       # expected 0 -> null index, not long
        _enc("C", DRG_SK=0, LOS_DAYS=0, EXPECTED_LOS=None),      # null expected; los 0 -> cost per day = cost
    ], fakes.ENCOUNTER)
    rows = {r.ENCOUNTER_ID: r for r in M.readmission_los(FakeTables(spark, frames)).collect()}
    assert rows["A"].LOS_INDEX == 1.5 and rows["A"].IS_LONG_STAY is True
    assert rows["B"].LOS_INDEX is None and rows["B"].IS_LONG_STAY is False
    assert rows["C"].LOS_INDEX is None and rows["C"].COST_PER_DAY == 60.0


def test_or_capacity_delay_utilization_overtime(spark):
    frames = _dims(spark)
    base = dict(ENCOUNTER_ID="E1", SURGEON_SK=10, OR_ROOM_ID="OR-1", PRIMARY_CPT_SK=5, CASE_DATE=D(2001, 1, 1),
                BLOCK_NAME="A", TURNOVER_MINUTES=10.0, FIRST_CASE_ON_TIME=True, PRIME_TIME_FLAG=True,
                CASE_CLASS="ELECTIVE", ASA_CLASS="I", FACILITY_ID="FAC-001")
    cols = [c.split()[0] for c in fakes.OR_CASE.split(", ")]

    def row(cid, sched, start, end, block, minutes):
        d = dict(base, CASE_ID=cid, SCHEDULED_START=sched, ACTUAL_START=start, ACTUAL_END=end,
                 BLOCK_MINUTES=block, CASE_MINUTES=minutes)
        return tuple(d[c] for c in cols)

    frames["fct_or_case"] = spark.createDataFrame([
        row("late", TS(2001, 1, 1, 0, 0, 59), TS(2001, 1, 1, 0, 1, 0), TS(2001, 1, 1, 16, 59), 240.0, 120.0),
        row("early", TS(2001, 1, 1, 8, 0), TS(2001, 1, 1, 7, 55), TS(2001, 1, 1, 17, 0), 0.0, 120.0),
        row("open", TS(2001, 1, 1, 8, 0), TS(2001, 1, 1, 8, 0), None, 240.0, 200.0),
    ], fakes.OR_CASE)
    rows = {r.CASE_ID: r for r in M.or_capacity(FakeTables(spark, frames)).collect()}
    assert rows["late"].DELAY_MINUTES == 1           # one minute boundary crossed
    assert rows["early"].DELAY_MINUTES == -5
    assert rows["late"].UTILIZATION_PCT == 0.5 and rows["late"].IS_UNDERUTILIZED is True
    assert rows["early"].UTILIZATION_PCT is None and rows["early"].IS_UNDERUTILIZED is False
    assert rows["late"].IS_OVERTIME is False and rows["early"].IS_OVERTIME is True
    assert rows["open"].IS_OVERTIME is False
    assert rows["late"].CASE_DAY_OF_WEEK == "Mon"


def test_denials_filing_and_categories(spark):
    frames = _dims(spark)
    cols = [c.split()[0] for c in fakes.CLAIM.split(", ")]

    def row(sk, reason, status, payer, filing, denied=True):
        d = dict(CLAIM_LINE_SK=sk, CLAIM_ID=f"C{sk}", LINE_NUMBER=1, ENCOUNTER_ID="E1", PATIENT_SK=1, PAYER_SK=payer,
                 PROVIDER_SK=11, DX_SK=1, PROC_SK=5, SERVICE_DATE=D(2001, 1, 1), CHARGE_AMT=1000.0,
                 ALLOWED_AMT=900.0, DENIED_FLAG=denied, DENIAL_REASON=reason, CLAIM_STATUS=status, FILING_DATE=filing)
        return tuple(d[c] for c in cols)

    frames["fct_claim_line"] = spark.createDataFrame([
        row(1, "ELIGIBILITY", "DENIED", 1, D(2001, 1, 10)),      # payer with null limit -> not timely
        row(2, "SOMETHING_NEW", "APPEALED", 2, D(2001, 1, 31)),  # unknown reason; day 30 of 30 -> timely
        row(3, "CODING_ERROR", "SUBMITTED", 2, None),            # null filing date -> not timely
        row(4, "CODING_ERROR", "DENIED", 2, D(2001, 1, 2), denied=False),
    ], fakes.CLAIM)
    rows = {r.CLAIM_LINE_SK: r for r in M.denials_revcycle(FakeTables(spark, frames)).collect()}
    assert set(rows) == {1, 2, 3}
    assert rows[1].IS_TIMELY_FILED is False and rows[1].DENIAL_CATEGORY == "ELIGIBILITY & ENROLLMENT"
    assert rows[1].ESTIMATED_RECOVERY == 300.0 and rows[1].APPEAL_OUTCOME == "NOT_APPEALED"
    assert rows[2].DENIAL_CATEGORY == "OTHER" and rows[2].ESTIMATED_RECOVERY == 200.0
    assert rows[2].IS_TIMELY_FILED is True and rows[2].APPEAL_OUTCOME in ("WON", "LOST")
    assert rows[3].IS_TIMELY_FILED is False and rows[3].APPEAL_OUTCOME == "PENDING"
    assert rows[1].PROVIDER_NAME == "Cy Dee"  # no credential in this mart


def test_staffing_zero_discharges_gives_null_rate(spark):
    frames = _dims(spark)
    frames["fct_labor_hour"] = spark.createDataFrame([
        ("EMP-1", D(2001, 1, 2), 8.0, 2.0, True, 360.0, "DEPT-001", "FAC-001"),
        ("EMP-2", D(2001, 1, 2), 8.0, 0.0, False, 360.0, "DEPT-001", "FAC-001"),
        ("EMP-1", D(2001, 1, 5), 8.0, 0.0, False, 360.0, "DEPT-001", "FAC-001"),
    ], fakes.LABOR)
    frames["fct_encounter"] = spark.createDataFrame([_enc("E1")], fakes.ENCOUNTER)  # stay 1..3 Jan
    rows = {r.SHIFT_DATE: r for r in M.staffing_quality(FakeTables(spark, frames)).collect()}
    d2, d5 = rows[D(2001, 1, 2)], rows[D(2001, 1, 5)]
    assert d2.PATIENT_CENSUS == 1 and d2.STAFF_COUNT == 2 and d2.AGENCY_STAFF_COUNT == 1
    assert d2.DISCHARGES == 0 and d2.READMIT_RATE is None          # null, not 0
    assert d2.HRS_PER_PATIENT == 16.0 and d2.IS_UNDERSTAFFED is False
    assert d5.PATIENT_CENSUS == 0 and d5.HRS_PER_PATIENT is None and d5.IS_UNDERSTAFFED is False
    assert d2.OT_PCT == 0.125 and d2.HIGH_OT_FLAG is False


def test_financial_null_department_and_zero_revenue(spark):
    frames = _dims(spark)
    frames["fct_gl_transaction"] = spark.createDataFrame([
        (2001, 1, 100.0, "LABOR", "DEPT-001", "FAC-001"),
        (2001, 1, 50.0, "SUPPLIES", "DEPT-001", "FAC-001"),
        (2001, 1, 999.0, "REVENUE", None, "FAC-001"),     # null department dropped
    ], fakes.GL)
    frames["fct_encounter"] = spark.createDataFrame([_enc("E1", DISCHARGE_DATE=D(2001, 1, 3))], fakes.ENCOUNTER)
    r = M.financial_performance(FakeTables(spark, frames)).collect()
    assert len(r) == 1
    r = r[0]
    assert r.TOTAL_REVENUE == 0.0 and r.OPERATING_MARGIN is None and r.IS_NEGATIVE_MARGIN is True
    assert r.DISCHARGES == 1 and r.CMI_ADJUSTED_DISCHARGES == 1.2 and r.COST_PER_DISCHARGE == 150.0
    assert r.LABOR_PCT == round(100 / 150, 3) and r.PERIOD_DATE == D(2001, 1, 1)


def test_compat_helpers(spark):
    df = spark.createDataFrame([(D(2024, 1, 31), D(2024, 12, 25))], "a date, b date")
    r = df.select(C.month_start("a").alias("m"), C.quarter_label("b").alias("q"), C.dow_sunday0("a").alias("w"),
                  C.date_key("b").alias("k"), C.day_abbrev("a").alias("dn"), C.month_abbrev("b").alias("mn"),
                  C.safe_div(F.lit(1), F.lit(0)).alias("z")).first()
    assert (r.m, r.q, r.w, r.k, r.dn, r.mn, r.z) == (D(2024, 1, 1), "2024-Q4", 3, 20241225, "Wed", "Dec", None)
    b = spark.createDataFrame([("CLM-1",)], "x string").select(C.hash_bucket_100("x").alias("h")).first().h
    assert 0 <= b < 100
