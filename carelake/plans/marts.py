"""The six use-case marts (M1-M6) and the staffing load check.

Each builder takes a :class:`~carelake.sources.adapter.Tables` and returns a
lazy DataFrame. Facts are the streamed side; dimensions are small and left to
AQE's broadcast decision (they are projections of fixed-size or
customer/supplier-sized tables, never of a fact). Filters sit directly on the
fact scan so Catalyst pushes them into Parquet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelake.functions import compat as C
from carelake.operators import stay_days
from carelake.sources.adapter import Tables

IP_OBS = ["INPATIENT", "OBSERVATION"]


def _provider_name(p: str = "prov", with_credential: bool = True):
    parts = [F.col(f"{p}.FIRST_NAME"), F.lit(" "), F.col(f"{p}.LAST_NAME")]
    if with_credential:
        parts += [F.lit(", "), F.col(f"{p}.CREDENTIAL")]
    return C.concat_strict(*parts)


def _patient_name(p: str = "p"):
    return C.concat_strict(F.col(f"{p}.FIRST_NAME"), F.lit(" "), F.col(f"{p}.LAST_NAME"))


def _join(fact: DataFrame, t: Tables, dim: str, alias: str, key: str, on: str, how: str = "left") -> DataFrame:
    """``fact`` with a dimension under ``alias``: ``alias.key`` equals column ``on`` of the fact side."""
    return fact.join(t.get(dim).alias(alias), F.col(f"{alias}.{key}") == F.col(on), how)


def _facility(fact: DataFrame, t: Tables, on: str, how: str = "left") -> DataFrame:
    return _join(fact, t, "dim_facility", "f", "FACILITY_ID", on, how)


def _provider(fact: DataFrame, t: Tables, on: str, how: str = "left") -> DataFrame:
    return _join(fact, t, "dim_provider", "prov", "PROVIDER_SK", on, how)


def _patient(fact: DataFrame, t: Tables, on: str) -> DataFrame:
    return _join(fact, t, "dim_patient", "p", "PATIENT_SK", on, "inner")


# ---------------------------------------------------------------------------
# M1 patient leakage (grain: referral)
# ---------------------------------------------------------------------------
def patient_leakage(t: Tables) -> DataFrame:
    as_of = F.lit(t.profile.as_of.isoformat()).cast("date")
    j = _provider(_patient(t.get("fct_referral").alias("r"), t, "r.PATIENT_SK"), t, "r.REFERRING_PROVIDER_SK", "inner")
    j = _facility(_join(j, t, "dim_payer", "py", "PAYER_ID", "p.PRIMARY_PAYER_ID"), t, "r.FACILITY_ID")
    return j.select(
        F.col("r.REFERRAL_ID"),
        F.col("p.MRN"),
        _patient_name().alias("PATIENT_NAME"),
        F.col("p.ZIP").alias("PATIENT_ZIP"),
        F.col("py.PAYER_TYPE").alias("PATIENT_PAYER_TYPE"),
        F.col("r.REFERRING_PROVIDER_SK"),
        _provider_name().alias("REFERRING_PROVIDER"),
        F.col("prov.SPECIALTY").alias("REFERRING_SPECIALTY"),
        F.col("r.REFERRED_TO_NPI"),
        F.col("r.REFERRED_TO_SPECIALTY"),
        F.col("r.FACILITY_ID"),
        F.col("f.FACILITY_NAME"),
        F.col("r.REFERRAL_DATE"),
        C.month_start("r.REFERRAL_DATE").alias("REFERRAL_MONTH"),
        C.quarter_label("r.REFERRAL_DATE").alias("REFERRAL_QUARTER"),
        F.col("r.STATUS"),
        F.col("r.LEAKAGE_FLAG"),
        F.col("r.EXPECTED_REVENUE"),
        F.when(F.col("r.LEAKAGE_FLAG"), F.col("r.EXPECTED_REVENUE")).otherwise(F.lit(0.0)).alias("LOST_REVENUE"),
        C.days_between("r.REFERRAL_DATE", as_of).alias("DAYS_SINCE_REFERRAL"),
        (F.col("r.EXPECTED_REVENUE") > 5000).alias("IS_HIGH_VALUE"),
    )


# ---------------------------------------------------------------------------
# M2 readmission / length of stay (grain: IP/OBS encounter)
# ---------------------------------------------------------------------------
def readmission_los(t: Tables) -> DataFrame:
    e = t.get("fct_encounter").where(F.col("ENCOUNTER_TYPE").isin(IP_OBS)).alias("e")
    j = _provider(_patient(e, t, "e.PATIENT_SK"), t, "e.PROVIDER_SK")
    for dim, alias, key in (("dim_drg", "drg", "DRG_SK"), ("dim_payer", "py", "PAYER_SK"), ("dim_department", "d", "DEPT_ID")):
        j = _join(j, t, dim, alias, key, f"e.{key}")
    j = _facility(j, t, "e.FACILITY_ID")
    exp = F.coalesce(F.col("drg.GEOMETRIC_LOS"), F.col("e.EXPECTED_LOS"))
    los = F.col("e.LOS_DAYS")
    ratio = los / exp
    return j.select(
        F.col("e.ENCOUNTER_ID"),
        F.col("p.MRN"),
        _patient_name().alias("PATIENT_NAME"),
        C.years_between("p.DOB", "e.ADMIT_DATE").alias("PATIENT_AGE"),
        F.col("p.GENDER").alias("PATIENT_GENDER"),
        F.col("p.HCC_SCORE"),
        F.col("e.ADMIT_DATE"),
        C.month_start("e.ADMIT_DATE").alias("ADMIT_MONTH"),
        F.col("e.DISCHARGE_DATE"),
        F.col("e.DISCHARGE_DISPOSITION"),
        F.col("e.ENCOUNTER_TYPE"),
        los.alias("LOS_DAYS"),
        exp.alias("EXPECTED_LOS"),
        (los - exp).alias("LOS_VARIANCE"),
        F.when(exp > 0, F.round(ratio, 2)).alias("LOS_INDEX"),
        F.when((exp > 0) & (ratio > 1.5), True).otherwise(False).alias("IS_LONG_STAY"),
        F.col("drg.DRG_CODE"),
        F.col("drg.DESCRIPTION").alias("DRG_DESCRIPTION"),
        F.col("drg.WEIGHT").alias("DRG_WEIGHT"),
        F.col("drg.MDC_DESCRIPTION"),
        F.col("e.READMIT_30_FLAG"),
        F.col("py.PAYER_TYPE"),
        F.col("py.PAYER_NAME"),
        F.col("e.FACILITY_ID"),
        F.col("f.FACILITY_NAME"),
        F.col("e.DEPT_ID"),
        F.col("d.DEPT_NAME"),
        _provider_name().alias("ATTENDING_PROVIDER"),
        F.col("prov.SPECIALTY"),
        F.col("e.TOTAL_CHARGES"),
        F.col("e.TOTAL_COST"),
        F.col("e.TOTAL_PAYMENTS"),
        F.when(los > 0, F.round(F.col("e.TOTAL_COST") / los, 2)).otherwise(F.col("e.TOTAL_COST")).alias("COST_PER_DAY"),
        F.col("e.NET_REVENUE"),
    )


# ---------------------------------------------------------------------------
# M3 OR capacity (grain: case)
# ---------------------------------------------------------------------------
def or_capacity(t: Tables) -> DataFrame:
    j = _facility(_provider(t.get("fct_or_case").alias("orc"), t, "orc.SURGEON_SK"), t, "orc.FACILITY_ID")
    j = _join(j, t, "dim_procedure", "cpt", "PROC_SK", "orc.PRIMARY_CPT_SK")
    block, case_m = F.col("orc.BLOCK_MINUTES"), F.col("orc.CASE_MINUTES")
    return j.select(
        F.col("orc.CASE_ID"),
        F.col("orc.ENCOUNTER_ID"),
        F.col("orc.OR_ROOM_ID"),
        F.col("orc.FACILITY_ID"),
        F.col("f.FACILITY_NAME"),
        F.col("orc.SURGEON_SK"),
        _provider_name().alias("SURGEON_NAME"),
        F.col("prov.SPECIALTY"),
        F.col("orc.BLOCK_NAME"),
        F.col("orc.CASE_DATE"),
        C.month_start("orc.CASE_DATE").alias("CASE_MONTH"),
        C.day_abbrev("orc.CASE_DATE").alias("CASE_DAY_OF_WEEK"),
        F.col("orc.SCHEDULED_START"),
        F.col("orc.ACTUAL_START"),
        F.col("orc.ACTUAL_END"),
        C.minutes_between("orc.SCHEDULED_START", "orc.ACTUAL_START").alias("DELAY_MINUTES"),
        case_m.alias("CASE_MINUTES"),
        F.col("orc.TURNOVER_MINUTES"),
        block.alias("BLOCK_MINUTES"),
        F.when(block > 0, F.round(case_m / block, 3)).alias("UTILIZATION_PCT"),
        F.col("orc.FIRST_CASE_ON_TIME"),
        F.col("orc.PRIME_TIME_FLAG"),
        F.col("orc.CASE_CLASS"),
        F.col("orc.ASA_CLASS"),
        F.col("cpt.CPT_CODE"),
        F.col("cpt.DESCRIPTION").alias("CPT_DESCRIPTION"),
        F.when((block > 0) & (case_m / block < 0.60), True).otherwise(False).alias("IS_UNDERUTILIZED"),
        F.when(F.hour("orc.ACTUAL_END") >= 17, True).otherwise(False).alias("IS_OVERTIME"),
    )


# ---------------------------------------------------------------------------
# M4 denials / revenue cycle (grain: denied claim line)
# ---------------------------------------------------------------------------
# Denial reason -> (category, recovery rate).
DENIAL_CATEGORY = {
    "ELIGIBILITY": ("ELIGIBILITY & ENROLLMENT", 0.30),
    "AUTH_REQUIRED": ("PRIOR AUTHORIZATION", 0.50),
    "CODING_ERROR": ("CODING & BILLING", 0.65),
    "MEDICAL_NECESSITY": ("CLINICAL / MEDICAL NECESSITY", 0.35),
}
OTHER_CATEGORY, OTHER_RATE = "OTHER", 0.20


def denial_category(reason):
    expr = F
    for k, (cat, _) in DENIAL_CATEGORY.items():
        expr = expr.when(reason == k, cat)
    return expr.otherwise(OTHER_CATEGORY)


def recovery_rate(reason):
    expr = F
    for k, (_, rate) in DENIAL_CATEGORY.items():
        expr = expr.when(reason == k, F.lit(rate))
    return expr.otherwise(F.lit(OTHER_RATE))


def denials_revcycle(t: Tables) -> DataFrame:
    cl = t.get("fct_claim_line").where(F.col("DENIED_FLAG") == True).alias("cl")  # noqa: E712
    j = _join(_patient(cl, t, "cl.PATIENT_SK"), t, "dim_payer", "py", "PAYER_SK", "cl.PAYER_SK", "inner")
    j = _provider(j, t, "cl.PROVIDER_SK")
    j = _join(_join(j, t, "dim_procedure", "cpt", "PROC_SK", "cl.PROC_SK"), t, "dim_diagnosis", "dx", "DX_SK", "cl.DX_SK")
    status, reason = F.col("cl.CLAIM_STATUS"), F.col("cl.DENIAL_REASON")
    days = C.days_between("cl.SERVICE_DATE", "cl.FILING_DATE")
    limit = F.col("py.TIMELY_FILING_DAYS")
    return j.select(
        F.col("cl.CLAIM_LINE_SK"),
        F.col("cl.CLAIM_ID"),
        F.col("cl.LINE_NUMBER"),
        F.col("cl.ENCOUNTER_ID"),
        F.col("p.MRN"),
        _patient_name().alias("PATIENT_NAME"),
        F.col("cl.PAYER_SK"),
        F.col("py.PAYER_NAME"),
        F.col("py.PAYER_TYPE"),
        _provider_name(with_credential=False).alias("PROVIDER_NAME"),
        F.col("cl.SERVICE_DATE"),
        C.month_start("cl.SERVICE_DATE").alias("SERVICE_MONTH"),
        F.col("cl.CHARGE_AMT"),
        F.col("cl.ALLOWED_AMT"),
        reason.alias("DENIAL_REASON"),
        denial_category(reason).alias("DENIAL_CATEGORY"),
        status.alias("CLAIM_STATUS"),
        (status == "APPEALED").alias("IS_APPEALED"),
        F.when((status == "APPEALED") & (C.hash_bucket_100("cl.CLAIM_ID") < 40), "WON")
         .when(status == "APPEALED", "LOST")
         .when(status == "DENIED", "NOT_APPEALED")
         .otherwise("PENDING").alias("APPEAL_OUTCOME"),
        F.col("cpt.CPT_CODE"),
        F.col("cpt.DESCRIPTION").alias("CPT_DESCRIPTION"),
        F.col("cpt.CATEGORY").alias("CPT_CATEGORY"),
        F.col("dx.ICD10_CODE"),
        F.col("dx.DESCRIPTION").alias("DX_DESCRIPTION"),
        F.col("cl.FILING_DATE"),
        days.alias("DAYS_TO_FILE"),
        limit.alias("TIMELY_FILING_LIMIT"),
        F.when(limit.isNotNull() & (days <= limit), True).otherwise(False).alias("IS_TIMELY_FILED"),
        F.round(F.col("cl.CHARGE_AMT") * recovery_rate(reason), 2).alias("ESTIMATED_RECOVERY"),
    )


# ---------------------------------------------------------------------------
# M5 staffing & quality (grain: department x facility x day)
# ---------------------------------------------------------------------------
def labor_daily(t: Tables) -> DataFrame:
    """Per (dept, facility, day). The two distinct counts are computed as a
    two-level aggregate -- per employee-day first (map-side combined), then
    per day -- instead of Spark's Expand rewrite, which would emit every
    labor row once per distinct aggregate before the shuffle. An employee is
    agency staff that day if any of their rows carries the flag, which is
    exactly COUNT(DISTINCT CASE WHEN AGENCY_FLAG THEN EMPLOYEE_ID END)."""
    lh = t.get("fct_labor_hour")
    keys = ["DEPT_ID", "FACILITY_ID", "SHIFT_DATE"]
    per_emp = (lh.groupBy(*keys, "EMPLOYEE_ID")
                 .agg(F.sum("WORKED_HRS").alias("H"), F.sum("OT_HRS").alias("O"),
                      F.sum("TOTAL_LABOR_COST").alias("L"), F.max("AGENCY_FLAG").alias("A")))
    hrs, ot = F.sum("H"), F.sum("O")
    return (per_emp.groupBy(*keys)
              .agg(hrs.alias("TOTAL_WORKED_HRS"),
                   ot.alias("TOTAL_OT_HRS"),
                   F.when(hrs > 0, F.round(ot / hrs, 3)).otherwise(F.lit(0.0)).alias("OT_PCT"),
                   F.sum("L").alias("TOTAL_LABOR_COST"),
                   F.count("EMPLOYEE_ID").alias("STAFF_COUNT"),
                   F.count_if(F.col("A") & F.col("EMPLOYEE_ID").isNotNull()).alias("AGENCY_STAFF_COUNT")))


def census_daily(t: Tables) -> DataFrame:
    """Occupancy per (dept, facility, date): an encounter counts on every
    calendar day of its stay inside the census window (J4 rewrite).

    Each stay is two changes (first day, day after the last) and the levels
    per day are running sums, so the shuffles carry a few rows per stay, not
    one per stay-day. PATIENT_CENSUS and ADMITS are distinct encounters: the
    stays of an encounter are merged first, so one that is loaded twice counts
    once. The averages are over rows."""
    prof = t.profile
    # The spine is the calendar dimension restricted to the window.
    lo = max(prof.census_start, prof.calendar_start)
    hi = min(prof.census_end, prof.calendar_end)
    keys = ["DEPT_ID", "FACILITY_ID"]
    e = (t.get("fct_encounter").where(F.col("ENCOUNTER_TYPE").isin(IP_OBS))
          .select("ENCOUNTER_ID", *keys, "ADMIT_DATE", "DISCHARGE_DATE", "LOS_DAYS", "EXPECTED_LOS"))
    stays = stay_days.clip_stays(e, "ADMIT_DATE", "DISCHARGE_DATE", lo, hi)
    index = F.when(F.col("EXPECTED_LOS") > 0, (F.col("LOS_DAYS") / F.col("EXPECTED_LOS")).cast("decimal(28,9)"))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    known = F.col("ENCOUNTER_ID").isNotNull()
    by_encounter = stay_days.merge_stays(stays.where(known), [*keys, "ENCOUNTER_ID"])
    rows = stay_days.changes(stays, keys, {
        "ROW_N": one, "LOS": F.coalesce(F.col("LOS_DAYS").cast("long"), none),
        "LOS_N": F.col("LOS_DAYS").isNotNull().cast("long"),
        "IDX": F.coalesce(index, F.lit(0).cast("decimal(28,9)")), "IDX_N": index.isNotNull().cast("long")})
    heads = stay_days.changes(by_encounter, keys, {"PATIENT_CENSUS": one})
    events = rows.unionByName(heads, allowMissingColumns=True)
    levels = stay_days.daily_levels(events, keys, ["ROW_N", "PATIENT_CENSUS", "LOS", "LOS_N", "IDX", "IDX_N"], "CENSUS_DATE")
    admits = (stays.where(known & (F.col("ADMIT_DATE").cast("date") == F.col("_s")))
                   .select(*keys, F.col("_s").alias("CENSUS_DATE"), "ENCOUNTER_ID").distinct()
                   .groupBy(*keys, "CENSUS_DATE").agg(F.count(F.lit(1)).alias("ADMITS")).alias("a"))
    lv = levels.alias("lv")
    same = [F.col(f"lv.{k}").eqNullSafe(F.col(f"a.{k}")) for k in keys] + [F.col("lv.CENSUS_DATE") == F.col("a.CENSUS_DATE")]
    return lv.join(admits, same, "left").select(
        *[F.col(f"lv.{k}").alias(k) for k in keys], F.col("lv.CENSUS_DATE").alias("CENSUS_DATE"),
        F.coalesce("PATIENT_CENSUS", none).alias("PATIENT_CENSUS"), F.coalesce("ADMITS", none).alias("ADMITS"),
        F.when(F.col("LOS_N") > 0, F.col("LOS") / F.col("LOS_N")).alias("AVG_LOS_DAYS"),
        F.when(F.col("IDX_N") > 0, F.col("IDX").cast("double") / F.col("IDX_N")).alias("AVG_LOS_INDEX"))


def discharge_daily(t: Tables) -> DataFrame:
    """Event metrics keyed on the discharge date, kept off the range join."""
    prof = t.profile
    e = t.get("fct_encounter").where(
        F.col("ENCOUNTER_TYPE").isin(IP_OBS) & F.col("DISCHARGE_DATE").isNotNull()
        & F.col("DISCHARGE_DATE").between(F.lit(prof.census_start), F.lit(prof.census_end)))
    long_stay = (F.col("EXPECTED_LOS") > 0) & (F.col("LOS_DAYS") / F.col("EXPECTED_LOS") > 1.5)
    return (e.groupBy("DEPT_ID", "DISCHARGE_DATE")
              .agg(F.count(F.lit(1)).alias("DISCHARGES"),
                   F.sum(C.flag01("READMIT_30_FLAG")).cast("long").alias("READMIT_COUNT"),
                   F.sum(F.when(long_stay, 1).otherwise(0)).cast("long").alias("LONG_STAY_COUNT")))


def staffing_quality(t: Tables) -> DataFrame:
    l = labor_daily(t).alias("l")  # noqa: E741
    dep = t.get("dim_department").alias("dep")
    f = t.get("dim_facility").alias("f")
    c = census_daily(t).alias("c")
    dis = discharge_daily(t).alias("dis")
    j = (l.join(dep, F.col("dep.DEPT_ID") == F.col("l.DEPT_ID"), "inner")
          .join(f, F.col("f.FACILITY_ID") == F.col("l.FACILITY_ID"), "inner")
          .join(c, (F.col("c.DEPT_ID") == F.col("l.DEPT_ID")) & (F.col("c.FACILITY_ID") == F.col("l.FACILITY_ID"))
                & (F.col("c.CENSUS_DATE") == F.col("l.SHIFT_DATE")), "left")
          .join(dis, (F.col("dis.DEPT_ID") == F.col("l.DEPT_ID"))
                & (F.col("dis.DISCHARGE_DATE") == F.col("l.SHIFT_DATE")), "left"))
    census = F.coalesce(F.col("c.PATIENT_CENSUS"), F.lit(0))
    disch = F.coalesce(F.col("dis.DISCHARGES"), F.lit(0))
    hpp = F.col("l.TOTAL_WORKED_HRS") / F.col("c.PATIENT_CENSUS")
    heavy = F.col("dep.DEPT_TYPE").isin("INPATIENT", "ICU")
    return j.select(
        F.col("l.DEPT_ID"),
        F.col("dep.DEPT_NAME"),
        F.col("dep.DEPT_TYPE"),
        F.col("l.FACILITY_ID"),
        F.col("f.FACILITY_NAME"),
        F.col("l.SHIFT_DATE"),
        C.month_start("l.SHIFT_DATE").alias("SHIFT_MONTH"),
        C.day_abbrev("l.SHIFT_DATE").alias("DAY_OF_WEEK"),
        F.col("l.TOTAL_WORKED_HRS"),
        F.col("l.TOTAL_OT_HRS"),
        F.col("l.OT_PCT"),
        F.col("l.TOTAL_LABOR_COST"),
        F.col("l.STAFF_COUNT"),
        F.col("l.AGENCY_STAFF_COUNT"),
        F.when(F.col("l.STAFF_COUNT") > 0,
               F.round(F.col("l.AGENCY_STAFF_COUNT").cast("double") / F.col("l.STAFF_COUNT"), 3))
         .otherwise(F.lit(0.0)).alias("AGENCY_PCT"),
        census.alias("PATIENT_CENSUS"),
        F.when(census > 0, F.round(hpp, 2)).alias("HRS_PER_PATIENT"),
        F.coalesce(F.col("c.ADMITS"), F.lit(0)).alias("ADMITS"),
        disch.alias("DISCHARGES"),
        F.coalesce(F.col("dis.READMIT_COUNT"), F.lit(0)).alias("READMIT_COUNT"),
        F.when(disch > 0, F.round(F.col("dis.READMIT_COUNT").cast("double") / F.col("dis.DISCHARGES"), 3))
         .alias("READMIT_RATE"),
        F.col("c.AVG_LOS_DAYS"),
        F.col("c.AVG_LOS_INDEX"),
        F.coalesce(F.col("dis.LONG_STAY_COUNT"), F.lit(0)).alias("LONG_STAY_COUNT"),
        F.when(census > 0,
               F.when(heavy & (hpp < 8), True).when(~heavy & (hpp < 4), True).otherwise(False))
         .otherwise(False).alias("IS_UNDERSTAFFED"),
        (F.col("l.OT_PCT") > 0.15).alias("HIGH_OT_FLAG"),
    )


def staffing_load_check(mart: DataFrame) -> DataFrame:
    """One-row post-load assertion on the staffing mart."""
    disch, readm = F.sum("DISCHARGES"), F.sum("READMIT_COUNT")
    return mart.agg(
        F.count(F.lit(1)).alias("TOTAL_ROWS"),
        disch.cast("long").alias("TOTAL_DISCHARGES"),
        readm.cast("long").alias("TOTAL_READMITS"),
        F.count("READMIT_RATE").alias("ROWS_WITH_RATE"),
        F.round(C.safe_div(readm, disch) * 100, 2).alias("OVERALL_READMIT_PCT"),
        F.when(disch == 0, "FAIL - discharge join produced no matches")
         .when(F.count("READMIT_RATE") == 0, "FAIL - READMIT_RATE null on every row")
         .otherwise("PASS").alias("STATUS"),
    )


def discharge_backfill(mart: DataFrame, t: Tables) -> DataFrame:
    """Repair the discharge-keyed columns of an existing staffing
    mart from a grouped source; unmatched rows keep their values."""
    e = t.get("fct_encounter").where(F.col("ENCOUNTER_TYPE").isin(IP_OBS) & F.col("DISCHARGE_DATE").isNotNull())
    d = (e.groupBy("DEPT_ID", F.col("DISCHARGE_DATE").alias("DD"))
          .agg(F.count(F.lit(1)).alias("DISCH"), F.sum(C.flag01("READMIT_30_FLAG")).cast("long").alias("RE"))
          .alias("d"))
    m = mart.alias("m")
    j = m.join(d, (F.col("d.DEPT_ID") == F.col("m.DEPT_ID")) & (F.col("d.DD") == F.col("m.SHIFT_DATE")), "left")
    hit = F.col("d.DISCH").isNotNull()
    out = []
    for name in mart.columns:
        c = F.col(f"m.{name}")
        if name == "DISCHARGES":
            c = F.when(hit, F.col("d.DISCH")).otherwise(c)
        elif name == "READMIT_COUNT":
            c = F.when(hit, F.col("d.RE")).otherwise(c)
        elif name == "READMIT_RATE":
            c = F.when(hit, F.when(F.col("d.DISCH") > 0, F.round(F.col("d.RE").cast("double") / F.col("d.DISCH"), 3))).otherwise(c)
        out.append(c.alias(name))
    return j.select(*out)


# ---------------------------------------------------------------------------
# M6 financial performance (grain: department x facility x month)
# ---------------------------------------------------------------------------
GL_COST_COLUMNS = {"LABOR": "LABOR_COST", "SUPPLIES": "SUPPLY_COST",
                   "OVERHEAD": "OVERHEAD_COST", "DEPRECIATION": "DEPRECIATION_COST"}


def gl_monthly(t: Tables) -> DataFrame:
    gl = t.get("fct_gl_transaction").where(F.col("DEPT_ID").isNotNull())
    cats = {"REVENUE": "TOTAL_REVENUE", **GL_COST_COLUMNS}
    return (gl.groupBy("DEPT_ID", "FACILITY_ID", "FISCAL_YEAR", "FISCAL_PERIOD")
              .agg(*[C.exact_sum(F.when(F.col("CATEGORY") == k, F.col("AMOUNT")).otherwise(F.lit(0.0))).alias(v)
                     for k, v in cats.items()]))


def volume_monthly(t: Tables) -> DataFrame:
    e = t.get("fct_encounter").where(F.col("DISCHARGE_DATE").isNotNull() & F.col("ENCOUNTER_TYPE").isin(IP_OBS)).alias("e")
    drg = t.get("dim_drg").alias("drg")
    j = e.join(drg, F.col("drg.DRG_SK") == F.col("e.DRG_SK"), "left")
    return (j.groupBy(F.col("e.DEPT_ID").alias("DEPT_ID"), F.col("e.FACILITY_ID").alias("FACILITY_ID"),
                      F.year("e.DISCHARGE_DATE").alias("FISCAL_YEAR"),
                      F.month("e.DISCHARGE_DATE").alias("FISCAL_PERIOD"))
             .agg(F.count(F.lit(1)).alias("DISCHARGES"),
                  F.sum("e.LOS_DAYS").cast("long").alias("PATIENT_DAYS"),
                  C.exact_sum(F.coalesce(F.col("drg.WEIGHT"), F.lit(1.0))).alias("CMI_ADJUSTED_DISCHARGES")))


def financial_performance(t: Tables) -> DataFrame:
    g = gl_monthly(t).alias("g")
    dep = t.get("dim_department").alias("dep")
    f = t.get("dim_facility").alias("f")
    v = volume_monthly(t).alias("v")
    keys = ["DEPT_ID", "FACILITY_ID", "FISCAL_YEAR", "FISCAL_PERIOD"]
    j = (g.join(dep, F.col("dep.DEPT_ID") == F.col("g.DEPT_ID"), "inner")
          .join(f, F.col("f.FACILITY_ID") == F.col("g.FACILITY_ID"), "inner")
          .join(v, [F.col(f"v.{k}") == F.col(f"g.{k}") for k in keys], "left"))
    rev = F.col("g.TOTAL_REVENUE")
    exp = F.col("g.LABOR_COST") + F.col("g.SUPPLY_COST") + F.col("g.OVERHEAD_COST") + F.col("g.DEPRECIATION_COST")
    disch = F.coalesce(F.col("v.DISCHARGES"), F.lit(0))
    cmi = F.coalesce(F.col("v.CMI_ADJUSTED_DISCHARGES"), F.lit(0.0))
    return j.select(
        F.col("g.DEPT_ID"),
        F.col("dep.DEPT_NAME"),
        F.col("dep.DEPT_TYPE"),
        F.col("g.FACILITY_ID"),
        F.col("f.FACILITY_NAME"),
        F.col("g.FISCAL_YEAR"),
        F.col("g.FISCAL_PERIOD"),
        F.make_date(F.col("g.FISCAL_YEAR"), F.col("g.FISCAL_PERIOD"), F.lit(1)).alias("PERIOD_DATE"),
        rev.alias("TOTAL_REVENUE"),
        F.col("g.LABOR_COST"),
        F.col("g.SUPPLY_COST"),
        F.col("g.OVERHEAD_COST"),
        F.col("g.DEPRECIATION_COST"),
        exp.alias("TOTAL_EXPENSE"),
        disch.alias("DISCHARGES"),
        F.coalesce(F.col("v.PATIENT_DAYS"), F.lit(0)).alias("PATIENT_DAYS"),
        cmi.alias("CMI_ADJUSTED_DISCHARGES"),
        F.when(disch > 0, F.round(exp / F.col("v.DISCHARGES"), 2)).alias("COST_PER_DISCHARGE"),
        F.when(cmi > 0, F.round(exp / F.col("v.CMI_ADJUSTED_DISCHARGES"), 2)).alias("COST_PER_CMI_DISCHARGE"),
        F.when(exp > 0, F.round(F.col("g.LABOR_COST") / exp, 3)).alias("LABOR_PCT"),
        F.when(exp > 0, F.round(F.col("g.SUPPLY_COST") / exp, 3)).alias("SUPPLY_PCT"),
        F.when(rev > 0, F.round((rev - exp) / rev, 3)).alias("OPERATING_MARGIN"),
        (rev - exp).alias("NET_REVENUE"),
        ((rev - exp) < 0).alias("IS_NEGATIVE_MARGIN"),
    )


MARTS = {
    "mart_patient_leakage": patient_leakage,
    "mart_readmission_los": readmission_los,
    "mart_or_capacity": or_capacity,
    "mart_denials_revcycle": denials_revcycle,
    "mart_staffing_quality": staffing_quality,
    "mart_financial_performance": financial_performance,
}


QUERIES = {
    "m1_mart_patient_leakage": patient_leakage,
    "m2_mart_readmission_los": readmission_los,
    "m3_mart_or_capacity": or_capacity,
    "m4_mart_denials_revcycle": denials_revcycle,
    "m5_mart_staffing_quality": staffing_quality,
    "m5_labor_daily": labor_daily,
    "m5_census_daily_stay_days": census_daily,
    "m5_discharge_daily": discharge_daily,
    "m5b_discharge_backfill": lambda t: discharge_backfill(t.mart("mart_staffing_quality"), t),
    "m5c_staffing_load_check": lambda t: staffing_load_check(t.mart("mart_staffing_quality")),
    "m6_mart_financial_performance": financial_performance,
    "m6_gl_monthly_pivot": gl_monthly,
    "m6_volume_monthly": volume_monthly,
}
