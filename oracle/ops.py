"""Oracle SQL for governance, quality checks and alerts."""

from __future__ import annotations

from carelake.config import TESTDATA as P

EXTRA_CTES: dict[str, str] = {}
Q: dict[str, str] = {}

# ---------------------------------------------------------------- governance
# role -> the roles that are active in its session
SESSIONS = {
    "ADMIN": ["ADMIN", "ENGINEER", "ANALYST", "CLINICIAN", "FINANCE", "EXEC"], "ENGINEER": ["ENGINEER"], "ANALYST": ["ANALYST"],
    "CLINICIAN": ["CLINICIAN"], "FINANCE": ["FINANCE"], "EXEC": ["EXEC"],
}
SEES_ALL_ROWS = ["ADMIN", "ENGINEER"]
ROW_KEYS = {"fct_encounter": "DEPT_ID", "fct_labor_hour": "DEPT_ID", "fct_or_case": "FACILITY_ID"}
_fin_depts = ", ".join(f"('FINANCE', 'DEPT-{d:03}')" for d in (4, 5, 11, 19, 24))
_fin_facs = ", ".join(f"('FINANCE', 'FAC-{f:03}')" for f in (1, 2, 3))
_all_roles = "('CLINICIAN'), ('ANALYST'), ('EXEC')"
EXTRA_CTES["role_dept_access"] = (
    f"SELECT r.ROLE_NAME, d.DEPT_ID FROM dim_department d CROSS JOIN (VALUES {_all_roles}) r(ROLE_NAME) "
    f"UNION ALL SELECT * FROM (VALUES {_fin_depts}) v(ROLE_NAME, DEPT_ID)")
EXTRA_CTES["role_facility_access"] = (
    f"SELECT r.ROLE_NAME, f.FACILITY_ID FROM dim_facility f CROSS JOIN (VALUES {_all_roles}) r(ROLE_NAME) "
    f"UNION ALL SELECT * FROM (VALUES {_fin_facs}) v(ROLE_NAME, FACILITY_ID)")


def _in(role: str, *wanted: str) -> bool:
    return any(w in SESSIONS[role] for w in wanted)


def _masked(role: str) -> str:
    full = _in(role, "ADMIN", "CLINICIAN", "ENGINEER")
    name = "{c}" if full else "'PATIENT_' || left(sha256({c}), 8)"
    if _in(role, "ADMIN"):
        ssn = "SSN"
    elif _in(role, "CLINICIAN", "ENGINEER"):
        ssn = "'XXX-XX-' || right(SSN, 4)"
    else:
        ssn = "'***-**-****'"
    if full:
        phone = "PHONE"
    elif _in(role, "ANALYST"):
        phone = "'(***) ***-' || right(PHONE, 4)"
    else:
        phone = "'**********'"
    cols = [
        ("MRN", "MRN" if full else "'***MRN***'"),
        ("FIRST_NAME", name.format(c="FIRST_NAME")),
        ("LAST_NAME", name.format(c="LAST_NAME")),
        ("DOB", "DOB" if full else "make_date(year(DOB), 1, 1)"),
        ("SSN", ssn),
        ("PHONE", phone),
        ("EMAIL", "EMAIL" if full else "'****@' || split_part(EMAIL, '@', 2)"),
        ("GENDER", "GENDER"),
        ("HCC_SCORE", "HCC_SCORE"),
    ]
    return ", ".join(f"{e} AS {n}" for n, e in cols)


for _r in SESSIONS:
    Q[f"q59_phi_demo_patients_{_r.lower()}"] = (
        f"SELECT {_masked(_r)} FROM (SELECT * FROM dim_patient WHERE IS_ACTIVE = TRUE ORDER BY PATIENT_SK LIMIT 25)")


def _visible(table: str) -> str:
    key = ROW_KEYS[table]
    amap = "role_dept_access" if key == "DEPT_ID" else "role_facility_access"
    parts = []
    for r in SESSIONS:
        if r in SEES_ALL_ROWS:
            parts.append(f"SELECT '{r}' AS ROLE_NAME, count(*) AS VISIBLE_ROWS FROM {table}")
        else:
            roles = ", ".join(f"'{x}'" for x in SESSIONS[r])
            parts.append(f"SELECT '{r}' AS ROLE_NAME, count(*) AS VISIBLE_ROWS FROM {table} t WHERE EXISTS "
                         f"(SELECT 1 FROM {amap} a WHERE a.{key} = t.{key} AND a.ROLE_NAME IN ({roles}))")
    return " UNION ALL ".join(parts)


Q["g08_encounter_rows_by_role"] = _visible("fct_encounter")
Q["g08_labor_rows_by_role"] = _visible("fct_labor_hour")
Q["g09_or_case_rows_by_role"] = _visible("fct_or_case")
Q["g10_role_dept_access"] = "SELECT * FROM role_dept_access"
Q["g10_role_facility_access"] = "SELECT * FROM role_facility_access"

# ---------------------------------------------------------------- quality
# pass from, to; warn from, to
BANDS = {"METRIC_READMISSION_RATE": (5, 25, 3, 30), "METRIC_LEAKAGE_RATE": (5, 30, 2, 40), "METRIC_OR_UTILIZATION": (60, 95, 40, 100)}
KEYS = {"MART_PATIENT_LEAKAGE": ["REFERRAL_ID"], "MART_READMISSION_LOS": ["ENCOUNTER_ID"], "MART_OR_CAPACITY": ["CASE_ID"],
        "MART_DENIALS_REVCYCLE": ["CLAIM_LINE_SK"], "MART_STAFFING_QUALITY": ["DEPT_ID", "SHIFT_DATE"],
        "MART_FINANCIAL_PERFORMANCE": ["DEPT_ID", "FISCAL_YEAR", "FISCAL_PERIOD"]}
MIN = P.row_minimums
FD = P.freshness_date.isoformat()


def _band(check: str, v: str) -> str:
    pl, ph, wl, wh = BANDS[check]
    return f"CASE WHEN {v} BETWEEN {pl} AND {ph} THEN 'PASS' WHEN {v} BETWEEN {wl} AND {wh} THEN 'WARN' ELSE 'FAIL' END"


def _checks(table, src, pk, noun, rate=None, fresh=None) -> str:
    m = MIN[table]
    q = [f"SELECT '{table}' AS TABLE_NAME, 'ROW_COUNT_MIN' AS CHECK_NAME, "
         f"CASE WHEN count(*) >= {m} THEN 'PASS' ELSE 'FAIL' END AS RESULT, '>= {m}' AS EXPECTED_VALUE, "
         f"CAST(count(*) AS VARCHAR) AS ACTUAL_VALUE, '{table} should have at least {m} {noun}' AS DETAILS FROM {src}",
         f"SELECT '{table}', 'NULL_PK_CHECK', CASE WHEN count_if({pk} IS NULL) = 0 THEN 'PASS' ELSE 'FAIL' END, '0', "
         f"CAST(count_if({pk} IS NULL) AS VARCHAR), '{pk} should never be NULL' FROM {src}"]
    if rate:
        check, expr = rate
        pl, ph, _, _ = BANDS[check]
        q.append(f"SELECT '{table}', '{check}', {_band(check, expr)}, '{pl}-{ph}%', "
                 f"CAST(round({expr}, 2) AS VARCHAR) || '%', '{check} should lie in {pl}-{ph}%' FROM {src}")
    if fresh:
        col, what = fresh
        q.append(f"SELECT '{table}', 'DATE_FRESHNESS', CASE WHEN max({col}) >= DATE '{FD}' THEN 'PASS' ELSE 'WARN' END, "
                 f"'>= {FD}', CAST(max({col}) AS VARCHAR), 'Most recent {what} should be recent' FROM {src}")
    return " UNION ALL ".join(q)


EXTRA_CTES["dq_checks"] = " UNION ALL ".join([
    _checks("MART_READMISSION_LOS", "m_readmit", "ENCOUNTER_ID", "IP/OBS encounters",
            ("METRIC_READMISSION_RATE", "avg(CASE WHEN READMIT_30_FLAG THEN 1 ELSE 0 END) * 100"),
            ("ADMIT_DATE", "admit date")),
    _checks("MART_PATIENT_LEAKAGE", "m_leak", "REFERRAL_ID", "referrals",
            ("METRIC_LEAKAGE_RATE", "avg(CASE WHEN LEAKAGE_FLAG THEN 1 ELSE 0 END) * 100"),
            ("REFERRAL_DATE", "referral date")),
    _checks("MART_OR_CAPACITY", "m_or", "CASE_ID", "cases", ("METRIC_OR_UTILIZATION", "avg(UTILIZATION_PCT) * 100")),
    _checks("MART_DENIALS_REVCYCLE", "m_den", "CLAIM_LINE_SK", "denied claim lines"),
])
_mart_src = {"MART_PATIENT_LEAKAGE": "m_leak", "MART_READMISSION_LOS": "m_readmit", "MART_OR_CAPACITY": "m_or",
             "MART_DENIALS_REVCYCLE": "m_den", "MART_STAFFING_QUALITY": "m_staff",
             "MART_FINANCIAL_PERFORMANCE": "m_fin"}
Q["d01_d13_data_quality_checks"] = "SELECT * FROM dq_checks"
Q["d14_key_uniqueness"] = " UNION ALL ".join(
    f"SELECT '{tb}' AS TABLE_NAME, 'PK_UNIQUE' AS CHECK_NAME, CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END AS RESULT, "
    f"'0' AS EXPECTED_VALUE, CAST(count(*) AS VARCHAR) AS ACTUAL_VALUE, "
    f"'duplicate keys on ({', '.join(keys)})' AS DETAILS "
    f"FROM (SELECT {', '.join(keys)} FROM {_mart_src[tb]} GROUP BY ALL HAVING count(*) > 1)"
    for tb, keys in KEYS.items())
Q["d15_quality_summary"] = (
    "SELECT PASS_COUNT, FAIL_COUNT, WARN_COUNT, "
    "'{\"pass\":' || PASS_COUNT || ',\"fail\":' || FAIL_COUNT || ',\"warn\":' || WARN_COUNT || '}' AS METADATA, "
    "'DQ checks complete. PASS: ' || PASS_COUNT || ', FAIL: ' || FAIL_COUNT || ', WARN: ' || WARN_COUNT AS SUMMARY "
    "FROM (SELECT CAST(count_if(RESULT = 'PASS') AS BIGINT) AS PASS_COUNT, CAST(count_if(RESULT = 'FAIL') AS BIGINT) AS FAIL_COUNT, "
    "CAST(count_if(RESULT = 'WARN') AS BIGINT) AS WARN_COUNT FROM dq_checks)")
Q["d16_latest_check_batch"] = (
    "WITH log AS (SELECT RESULT, TIMESTAMP '2002-01-01' - CASE TABLE_NAME WHEN 'MART_READMISSION_LOS' THEN INTERVAL 0 MINUTE "
    "WHEN 'MART_PATIENT_LEAKAGE' THEN INTERVAL 5 MINUTE WHEN 'MART_OR_CAPACITY' THEN INTERVAL 6 MINUTE ELSE INTERVAL 1 HOUR END AS ts "
    "FROM dq_checks) SELECT RESULT, count(*) AS N FROM log WHERE ts >= (SELECT max(ts) FROM log) - INTERVAL 5 MINUTE GROUP BY RESULT")

# ---------------------------------------------------------------- alerts
_rules = """('readmission_rate', 'HIGH_READMISSION_RATE', 'exceeds', 15.0::DOUBLE), ('avg_los', 'HIGH_AVG_LOS', 'exceeds', 5.0),
('or_utilization', 'LOW_OR_UTILIZATION', 'falls_below', 60.0), ('overtime_pct', 'HIGH_OVERTIME', 'exceeds', 10.0),
('denial_rate', 'HIGH_DENIAL_RATE', 'exceeds', 8.0), ('operating_margin', 'LOW_OPERATING_MARGIN', 'falls_below', 5.0)"""
EXTRA_CTES["alert_values"] = (
    "SELECT 'readmission_rate' AS METRIC, CAST(avg(CAST(READMIT_30_FLAG AS INTEGER)) * 100 AS DOUBLE) AS VALUE FROM m_readmit "
    "UNION ALL SELECT 'avg_los', CAST(avg(LOS_DAYS) AS DOUBLE) FROM m_readmit "
    "UNION ALL SELECT 'or_utilization', avg(UTILIZATION_PCT) FROM m_or "
    "UNION ALL SELECT 'overtime_pct', avg(OT_PCT) FROM m_staff "
    "UNION ALL SELECT 'denial_rate', CAST(sum(CASE WHEN CLAIM_STATUS = 'DENIED' THEN 1 ELSE 0 END) * 100.0 "
    "/ nullif(count(*), 0) AS DOUBLE) FROM m_den "
    "UNION ALL SELECT 'operating_margin', avg(OPERATING_MARGIN) * 100 FROM m_fin")
EXTRA_CTES["alert_eval"] = (
    "SELECT r.ALERT_NAME, r.METRIC, r.OPERATOR, r.THRESHOLD, round(v.VALUE, 6) AS VALUE, "
    "COALESCE(CASE WHEN r.OPERATOR = 'exceeds' THEN v.VALUE > r.THRESHOLD ELSE v.VALUE < r.THRESHOLD END, FALSE) AS FIRED "
    f"FROM (VALUES {_rules}) r(METRIC, ALERT_NAME, OPERATOR, THRESHOLD) LEFT JOIN alert_values v ON v.METRIC = r.METRIC")
Q["r1_r6_alert_evaluation"] = "SELECT * FROM alert_eval"
Q["r1_r6_alerts_fired"] = "SELECT * FROM alert_eval WHERE FIRED"
Q["r7_custom_condition"] = ("SELECT * FROM (SELECT round(sum(CHARGE_AMT) / 1e6, 2) AS VALUE FROM m_den) "
                            "WHERE VALUE > 1.0")

# ---------------------------------------------------------------- semantic layer
Q["x6_readmission_metrics_by_facility"] = (
    "SELECT FACILITY_NAME AS READMIT_FACILITY, "
    "round(avg(CASE WHEN READMIT_30_FLAG THEN 1 ELSE 0 END) * 100, 4) AS READMISSION_RATE, "
    "round(avg(LOS_INDEX), 4) AS AVG_LOS_INDEX, round(avg(CASE WHEN IS_LONG_STAY THEN 1 ELSE 0 END) * 100, 4) AS LONG_STAY_PCT, "
    "count(ENCOUNTER_ID) AS ENCOUNTER_COUNT FROM m_readmit GROUP BY 1")
Q["x6_denied_charges_by_readmit_payer"] = (
    "SELECT r.PAYER_TYPE AS READMIT_PAYER_TYPE, round(sum(d.CHARGE_AMT), 2) AS TOTAL_DENIED_CHARGES, "
    "count(d.CLAIM_LINE_SK) AS DENIED_CLAIM_COUNT, "
    "round(avg(CASE WHEN d.IS_APPEALED THEN 1 ELSE 0 END) * 100, 4) AS APPEAL_RATE "
    "FROM m_den d LEFT JOIN m_readmit r ON d.ENCOUNTER_ID = r.ENCOUNTER_ID GROUP BY 1")
Q["x6_denials_and_cases_by_readmit_payer"] = (
    "WITH line AS (SELECT r.PAYER_TYPE AS p, d.* FROM m_den d LEFT JOIN m_readmit r ON r.ENCOUNTER_ID = d.ENCOUNTER_ID), "
    "den AS (SELECT p, sum(CHARGE_AMT) AS charges, count(CLAIM_LINE_SK) AS claims FROM line GROUP BY p), "
    "ops AS (SELECT r.PAYER_TYPE AS p, count(o.CASE_ID) AS cases FROM m_or o LEFT JOIN m_readmit r ON r.ENCOUNTER_ID = o.ENCOUNTER_ID GROUP BY 1) "
    "SELECT coalesce(den.p, ops.p) AS READMIT_PAYER_TYPE, round(charges, 2) AS TOTAL_DENIED_CHARGES, claims AS DENIED_CLAIM_COUNT, "
    "cases AS CASE_COUNT FROM den FULL JOIN ops ON den.p IS NOT DISTINCT FROM ops.p")
Q["x6_cost_and_revenue_by_payer"] = (
    "SELECT PAYER_TYPE AS READMIT_PAYER_TYPE, round(avg(COST_PER_DAY), 4) AS AVG_COST_PER_DAY, "
    "round(sum(NET_REVENUE), 2) AS TOTAL_NET_REVENUE FROM m_readmit GROUP BY 1")
Q["x3_or_case_facts"] = ("SELECT CASE_ID, FACILITY_NAME AS OR_FACILITY, DELAY_MINUTES, CASE_MINUTES, TURNOVER_MINUTES, BLOCK_MINUTES, "
                         "UTILIZATION_PCT FROM m_or")
Q["x3_anomaly_facts"] = (
    "SELECT DENIAL_CATEGORY AS ANOMALY_CATEGORY, TS AS ANOMALY_DATE, EXPECTED_COUNT AS ANOM_EXPECTED_COUNT, "
    "ACTUAL_COUNT AS ANOM_ACTUAL_COUNT, ACTUAL_CHARGES AS ANOM_ACTUAL_CHARGES, PERCENTILE AS ANOM_PERCENTILE FROM pred_denial_anomalies")
Q["x6_timely_filing"] = (
    "SELECT round(avg(CASE WHEN IS_TIMELY_FILED THEN 1 ELSE 0 END) * 100, 4) AS TIMELY_FILING_PCT, "
    "count(CLAIM_LINE_SK) AS DENIED_CLAIM_COUNT FROM m_den")
Q["x6_leakage_metrics_by_specialty"] = (
    "SELECT REFERRING_SPECIALTY, round(avg(CASE WHEN LEAKAGE_FLAG THEN 1 ELSE 0 END) * 100, 4) AS LEAKAGE_RATE, "
    "round(sum(LOST_REVENUE), 2) AS TOTAL_LOST_REVENUE, count(REFERRAL_ID) AS REFERRAL_COUNT, "
    "CAST(sum(CASE WHEN LEAKAGE_FLAG AND IS_HIGH_VALUE THEN 1 ELSE 0 END) AS BIGINT) AS HIGH_VALUE_LEAK_COUNT "
    "FROM m_leak GROUP BY 1")
Q["x6_or_metrics_by_block"] = (
    "SELECT BLOCK_NAME, round(avg(UTILIZATION_PCT) * 100, 4) AS AVG_UTILIZATION, "
    "round(avg(CASE WHEN FIRST_CASE_ON_TIME THEN 1 ELSE 0 END) * 100, 4) AS FIRST_CASE_ON_TIME_PCT, "
    "round(avg(DELAY_MINUTES), 4) AS AVG_DELAY_MINUTES, count(CASE_ID) AS CASE_COUNT FROM m_or GROUP BY 1")

# ---------------------------------------------------------------- marts
Q["m1_mart_patient_leakage"] = "SELECT * FROM mart_patient_leakage"
Q["m2_mart_readmission_los"] = "SELECT * FROM mart_readmission_los"
Q["m3_mart_or_capacity"] = "SELECT * FROM mart_or_capacity"
Q["m4_mart_denials_revcycle"] = "SELECT * FROM mart_denials_revcycle"
Q["m5_mart_staffing_quality"] = "SELECT * FROM mart_staffing_quality"
Q["m5_labor_daily"] = "SELECT * FROM x_labor_daily"
Q["m5_census_daily_stay_days"] = "SELECT * FROM x_census_daily"
Q["m5_discharge_daily"] = "SELECT * FROM x_discharge_daily"
Q["m6_mart_financial_performance"] = "SELECT * FROM mart_financial_performance"
Q["m6_gl_monthly_pivot"] = "SELECT * FROM x_gl_monthly"
Q["m6_volume_monthly"] = "SELECT * FROM x_volume_monthly"
Q["m5c_staffing_load_check"] = (
    "SELECT count(*) AS TOTAL_ROWS, CAST(sum(DISCHARGES) AS BIGINT) AS TOTAL_DISCHARGES, "
    "CAST(sum(READMIT_COUNT) AS BIGINT) AS TOTAL_READMITS, count(READMIT_RATE) AS ROWS_WITH_RATE, "
    "round(sum(READMIT_COUNT) / nullif(sum(DISCHARGES), 0) * 100, 2) AS OVERALL_READMIT_PCT, "
    "CASE WHEN sum(DISCHARGES) = 0 THEN 'FAIL - discharge join produced no matches' "
    "WHEN count(READMIT_RATE) = 0 THEN 'FAIL - READMIT_RATE null on every row' ELSE 'PASS' END AS STATUS "
    "FROM m_staff")
Q["m5b_discharge_backfill"] = (
    "SELECT m.* REPLACE ("
    "CASE WHEN d.DISCH IS NOT NULL THEN d.DISCH ELSE m.DISCHARGES END AS DISCHARGES, "
    "CASE WHEN d.DISCH IS NOT NULL THEN d.RE ELSE m.READMIT_COUNT END AS READMIT_COUNT, "
    "CASE WHEN d.DISCH IS NOT NULL THEN (CASE WHEN d.DISCH > 0 THEN round(CAST(d.RE AS DOUBLE) / d.DISCH, 3) END) "
    "ELSE m.READMIT_RATE END AS READMIT_RATE) "
    "FROM m_staff m LEFT JOIN (SELECT DEPT_ID, DISCHARGE_DATE AS DD, count(*) AS DISCH, "
    "CAST(sum(CASE WHEN READMIT_30_FLAG THEN 1 ELSE 0 END) AS BIGINT) AS RE FROM fct_encounter "
    "WHERE ENCOUNTER_TYPE IN ('INPATIENT', 'OBSERVATION') AND DISCHARGE_DATE IS NOT NULL GROUP BY 1, 2) d "
    "ON d.DEPT_ID = m.DEPT_ID AND d.DD = m.SHIFT_DATE")
