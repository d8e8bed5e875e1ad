"""Oracle SQL for the filterable page queries."""

from __future__ import annotations

from typing import NamedTuple

from carelake.config import TESTDATA as P
from carelake.plans.filtered import PAGE_OF


class Page(NamedTuple):
    facility: str | None
    lists: dict
    start: str = "1996-01-01"
    end: str = "2000-12-31"


# what the registered page queries are asked for; no list, no condition
PAGES = {
    "provider360": Page("AMERICA", {}),
    "readmission": Page("AMERICA", {"ENCOUNTER_TYPE": ["INPATIENT"], "PAYER_TYPE": ["MEDICARE", "MEDICAID", "COMMERCIAL"]}),
    "leakage": Page("AMERICA", {"REFERRED_TO_SPECIALTY": ["Cardiology", "Oncology", "Neurology"]}),
    "or": Page("AMERICA", {"BLOCK_NAME": ["A", "B", "C"], "CASE_DAY_OF_WEEK": ["Mon", "Tue", "Wed", "Thu", "Fri"]}),
    "staffing": Page("AMERICA", {"DEPT_TYPE": ["INPATIENT", "ICU", "ED"]}),
    "finance": Page("AMERICA", {"FACILITY_NAME": ["AMERICA", "ASIA"]}),
    "denials": Page(None, {"PAYER_TYPE": ["MEDICARE", "COMMERCIAL"], "CPT_CATEGORY": ["ECONOMY", "PROMO"]}),
}


def where(f: Page, date_col: str, facility_col: str | None = "FACILITY_NAME") -> str:
    cs = [f"{date_col} BETWEEN DATE '{f.start}' AND DATE '{f.end}'"]
    if facility_col and f.facility is not None:
        cs.append(f"{facility_col} = '{f.facility}'")
    for c, vals in f.lists.items():
        cs.append(f"{c} IN (" + ", ".join(f"'{v}'" for v in vals) + ")")
    return " AND ".join(cs)


def rate(flag, d=1):
    return f"round(avg(CASE WHEN {flag} THEN 1 ELSE 0 END) * 100, {d})"


def fsum(flag):
    return f"CAST(sum(CASE WHEN {flag} THEN 1 ELSE 0 END) AS BIGINT)"


def _f(key):
    return PAGES[PAGE_OF[key]]


def rm(key):
    return f"(SELECT * FROM m_readmit WHERE {where(_f(key), 'ADMIT_DATE')})"


def lk(key):
    return f"(SELECT * FROM m_leak WHERE {where(_f(key), 'REFERRAL_DATE')})"


def orc(key):
    return f"(SELECT * FROM m_or WHERE {where(_f(key), 'CASE_DATE')})"


def st(key):
    return f"(SELECT * FROM m_staff WHERE {where(_f(key), 'SHIFT_DATE')} AND PATIENT_CENSUS > 0)"


def fn(key):
    return f"(SELECT * FROM m_fin WHERE {where(_f(key), 'PERIOD_DATE')})"


def dn(key):
    return f"(SELECT * FROM m_den WHERE {where(_f(key), 'SERVICE_DATE', None)})"


def enc(key):
    f = _f(key)
    fac = "" if f.facility is None else (
        f" AND FACILITY_ID IN (SELECT FACILITY_ID FROM dim_facility WHERE FACILITY_NAME = '{f.facility}')")
    return f"(SELECT * FROM fct_encounter WHERE {where(f, 'ADMIT_DATE', None)}{fac})"


UTIL = "round(avg(UTILIZATION_PCT) * 100, 1)"
RR = "round(avg(CASE WHEN READMIT_RATE IS NOT NULL THEN READMIT_RATE END) * 100, 1)"
MARGIN = "round((sum(TOTAL_REVENUE) - sum(TOTAL_EXPENSE)) / nullif(sum(TOTAL_REVENUE), 0) * 100, 1)"
DRV = ("SELECT CONTRIBUTOR, RELATIVE_CONTRIBUTION, GROWTH_RATE, METRIC_CONTROL, METRIC_TEST FROM {t} "
       "ORDER BY abs(RELATIVE_CONTRIBUTION) DESC NULLS FIRST, CONTRIBUTOR {lim}")

Q: dict[str, str] = {
    "f01_kpis": (
        f"SELECT 'ENCOUNTERS' AS KPI, CAST(count(*) AS DOUBLE) AS VALUE FROM {enc('f01')} "
        f"UNION ALL SELECT 'READMIT_RATE', {rate('READMIT_30_FLAG')} FROM {rm('f01')} "
        f"UNION ALL SELECT 'LEAKAGE_RATE', {rate('LEAKAGE_FLAG')} FROM {lk('f01')} "
        f"UNION ALL SELECT 'OR_UTIL', {UTIL} FROM {orc('f01')} "
        f"UNION ALL SELECT 'DENIED_AMT', round(sum(CHARGE_AMT), 0) FROM {dn('f01')} "
        "UNION ALL SELECT 'PREDICTION_ROWS', CAST(sum(ROW_COUNT) AS DOUBLE) FROM pred_inventory"),
    "f02_date_bounds": "SELECT min(ADMIT_DATE) AS MIN_DT, max(ADMIT_DATE) AS MAX_DT FROM m_readmit",
    "f03a_trend_encounters": (f"SELECT CAST(date_trunc('month', ADMIT_DATE) AS DATE) AS MONTH, count(*) AS ENCOUNTERS "
                              f"FROM {enc('f03')} GROUP BY 1 ORDER BY 1"),
    "f03b_trend_readmit": f"SELECT ADMIT_MONTH AS MONTH, {rate('READMIT_30_FLAG')} AS READMIT_RATE FROM {rm('f03')} GROUP BY 1 ORDER BY 1",
    "f03c_trend_leak": f"SELECT REFERRAL_MONTH AS MONTH, {rate('LEAKAGE_FLAG')} AS LEAK_RATE FROM {lk('f03')} GROUP BY 1 ORDER BY 1",
    "f04a_top_drg": (f"SELECT DRG_DESCRIPTION, count(*) AS N FROM {rm('f04')} WHERE READMIT_30_FLAG = TRUE "
                     "GROUP BY 1 ORDER BY 2 DESC NULLS FIRST, 1 ASC NULLS LAST LIMIT 1"),
    "f04b_top_spec": (f"SELECT REFERRED_TO_SPECIALTY, round(sum(LOST_REVENUE), 0) AS LOST FROM {lk('f04')} "
                      "WHERE LEAKAGE_FLAG = TRUE GROUP BY 1 ORDER BY 2 DESC NULLS FIRST, 1 ASC NULLS LAST LIMIT 1"),
    "f04c_low_block": f"SELECT BLOCK_NAME, {UTIL} AS UTIL FROM {orc('f04')} GROUP BY 1 ORDER BY 2 ASC NULLS LAST, 1 LIMIT 1",
    "f04d_top_cat": (f"SELECT DENIAL_CATEGORY, count(*) AS N FROM {dn('f04')} GROUP BY 1 "
                     "ORDER BY 2 DESC NULLS FIRST, 1 ASC NULLS LAST LIMIT 1"),
    "f05a_forecast": ("SELECT ENCOUNTER_TYPE, FORECAST_DATE, FORECAST_COUNT, LOWER_BOUND, UPPER_BOUND "
                      "FROM pred_encounter_volume ORDER BY 1, 2"),
    "f05b_anomalies": ("SELECT DENIAL_CATEGORY, TS, ACTUAL_COUNT, EXPECTED_COUNT, LOWER_BOUND, UPPER_BOUND, IS_ANOMALY "
                       "FROM pred_denial_anomalies ORDER BY 1, 2"),
    "f06_readmit_kpis": (f"SELECT {rate('READMIT_30_FLAG')} AS READMIT_RATE, round(avg(LOS_INDEX), 2) AS AVG_LOS_INDEX, "
                         f"{rate('IS_LONG_STAY')} AS LONG_STAY_PCT, round(avg(COST_PER_DAY), 0) AS AVG_CPD, "
                         f"count(*) AS TOTAL_ENC FROM {rm('f06')}"),
    "f07_readmit_trend": (f"SELECT ADMIT_MONTH AS MONTH, {rate('READMIT_30_FLAG')} AS READMIT_RATE, count(*) AS ENCOUNTERS "
                          f"FROM {rm('f07')} GROUP BY 1 ORDER BY 1"),
    "f08_los_histogram": f"SELECT LOS_DAYS, count(*) AS N FROM {rm('f08')} WHERE LOS_DAYS <= 30 GROUP BY 1 ORDER BY 1",
    "f09_top_drg": (f"SELECT DRG_DESCRIPTION, count(*) AS TOTAL, {fsum('READMIT_30_FLAG')} AS READMITS, "
                    f"{rate('READMIT_30_FLAG')} AS RATE FROM {rm('f09')} WHERE DRG_DESCRIPTION IS NOT NULL "
                    "GROUP BY 1 HAVING count(*) >= 50 ORDER BY RATE DESC NULLS FIRST, 1 LIMIT 10"),
    "f10_payer_readmit": (f"SELECT PAYER_TYPE, count(*) AS TOTAL, {rate('READMIT_30_FLAG')} AS RATE FROM {rm('f10')} "
                          "GROUP BY 1 ORDER BY RATE DESC NULLS FIRST, 1"),
    "f11_readmit_drivers": DRV.format(t="pred_readmission_drivers", lim="LIMIT 15"),
    "f12_encounter_detail": (
        "SELECT ENCOUNTER_ID, MRN, PATIENT_NAME, PATIENT_AGE, PATIENT_GENDER, ENCOUNTER_TYPE, ADMIT_DATE, "
        "DISCHARGE_DATE, LOS_DAYS, LOS_INDEX, IS_LONG_STAY, READMIT_30_FLAG, DRG_DESCRIPTION, PAYER_TYPE, "
        f"FACILITY_NAME, TOTAL_CHARGES, NET_REVENUE FROM {rm('f12')} ORDER BY ADMIT_DATE DESC NULLS FIRST, "
        "ENCOUNTER_ID LIMIT 500"),
    "f13_leakage_kpis": (f"SELECT {rate('LEAKAGE_FLAG')} AS LEAK_RATE, round(sum(LOST_REVENUE), 0) AS LOST_REV, "
                         f"{fsum('LEAKAGE_FLAG AND IS_HIGH_VALUE')} AS HV_LEAKED, count(*) AS TOTAL_REF FROM {lk('f13')}"),
    "f14_top_leaked_specialty": (f"SELECT REFERRED_TO_SPECIALTY, count(*) AS N FROM {lk('f14')} WHERE LEAKAGE_FLAG = TRUE "
                                 "GROUP BY 1 ORDER BY 2 DESC NULLS FIRST, 1 ASC NULLS LAST LIMIT 1"),
    "f15_leakage_trend": (f"SELECT REFERRAL_MONTH AS MONTH, {rate('LEAKAGE_FLAG')} AS LEAK_RATE, count(*) AS REFERRALS "
                          f"FROM {lk('f15')} GROUP BY 1 ORDER BY 1"),
    "f16_leakage_by_specialty": (
        f"SELECT REFERRED_TO_SPECIALTY AS SPECIALTY, count(*) AS TOTAL, {fsum('LEAKAGE_FLAG')} AS LEAKED, "
        f"{rate('LEAKAGE_FLAG')} AS RATE, round(sum(LOST_REVENUE), 0) AS LOST_REV FROM {lk('f16')} "
        "GROUP BY 1 ORDER BY LOST_REV DESC NULLS FIRST, 1 ASC NULLS LAST LIMIT 10"),
    "f17_lost_by_referring_specialty": (
        f"SELECT REFERRING_SPECIALTY AS SPECIALTY, round(sum(LOST_REVENUE), 0) AS LOST_REV, count(*) AS REFERRALS "
        f"FROM {lk('f17')} WHERE LEAKAGE_FLAG = TRUE GROUP BY 1 ORDER BY LOST_REV DESC NULLS FIRST, 1"),
    "f18_leakage_by_payer": (f"SELECT PATIENT_PAYER_TYPE AS PAYER, count(*) AS TOTAL, {fsum('LEAKAGE_FLAG')} AS LEAKED, "
                             f"{rate('LEAKAGE_FLAG')} AS RATE FROM {lk('f18')} GROUP BY 1 ORDER BY RATE DESC NULLS FIRST, 1"),
    "f19_leakage_drivers": DRV.format(t="pred_leakage_drivers", lim="LIMIT 15"),
    "f20_referral_detail": (
        "SELECT REFERRAL_ID, MRN, PATIENT_NAME, REFERRING_PROVIDER, REFERRING_SPECIALTY, REFERRED_TO_SPECIALTY, "
        "REFERRAL_DATE, STATUS, LEAKAGE_FLAG, IS_HIGH_VALUE, EXPECTED_REVENUE, LOST_REVENUE, FACILITY_NAME "
        f"FROM {lk('f20')} ORDER BY REFERRAL_DATE DESC NULLS FIRST, REFERRAL_ID LIMIT 500"),
    "f21_or_kpis": (f"SELECT {UTIL} AS AVG_UTIL, {rate('FIRST_CASE_ON_TIME')} AS FCOT_PCT, "
                    "round(avg(DELAY_MINUTES), 1) AS AVG_DELAY, count(*) AS TOTAL_CASES, "
                    f"round(avg(CASE_MINUTES), 0) AS AVG_CASE_MIN FROM {orc('f21')}"),
    "f22_block_weekday_matrix": (
        f"PIVOT (SELECT BLOCK_NAME, CASE_DAY_OF_WEEK AS DAY_OF_WEEK, {UTIL} AS UTIL FROM {orc('f22')} GROUP BY 1, 2) "
        "ON DAY_OF_WEEK IN ('Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun') USING avg(UTIL) GROUP BY BLOCK_NAME"),
    "f23_util_by_month_block": (f"SELECT CASE_MONTH AS MONTH, BLOCK_NAME, {UTIL} AS UTIL FROM {orc('f23')} "
                                "GROUP BY 1, 2 ORDER BY 1, 2"),
    "f24_delay_histogram": (f"SELECT DELAY_MINUTES, count(*) AS N FROM {orc('f24')} "
                            "WHERE DELAY_MINUTES > 0 AND DELAY_MINUTES <= 120 GROUP BY 1 ORDER BY 1"),
    "f25_top_surgeons": (f"SELECT SURGEON_NAME, SPECIALTY, count(*) AS CASES, {UTIL} AS AVG_UTIL, "
                         f"round(avg(CASE_MINUTES), 0) AS AVG_CASE_MIN FROM {orc('f25')} GROUP BY 1, 2 "
                         "ORDER BY CASES DESC NULLS FIRST, 1 ASC NULLS LAST, 2 ASC NULLS LAST LIMIT 10"),
    "f26_under_over_by_block": (
        f"SELECT BLOCK_NAME, {fsum('IS_UNDERUTILIZED')} AS UNDER, {fsum('IS_OVERTIME')} AS OVER, "
        f"count(*) - {fsum('IS_UNDERUTILIZED')} - {fsum('IS_OVERTIME')} AS NORMAL FROM {orc('f26')} "
        "GROUP BY 1 ORDER BY 1"),
    "f27_case_detail": (
        "SELECT CASE_ID, OR_ROOM_ID, FACILITY_NAME, SURGEON_NAME, SPECIALTY, BLOCK_NAME, CASE_DATE, CASE_DAY_OF_WEEK, "
        "DELAY_MINUTES, CASE_MINUTES, TURNOVER_MINUTES, round(UTILIZATION_PCT * 100, 1) AS UTIL_PCT, "
        "FIRST_CASE_ON_TIME, IS_UNDERUTILIZED, IS_OVERTIME, CPT_DESCRIPTION "
        f"FROM {orc('f27')} ORDER BY CASE_DATE DESC NULLS FIRST, CASE_ID LIMIT 500"),
    "f28_staffing_kpis": (
        "SELECT round(avg(HRS_PER_PATIENT), 1) AS AVG_HRS_PER_PATIENT, round(avg(OT_PCT) * 100, 1) AS AVG_OT_PCT, "
        "round(CAST(sum(CASE WHEN IS_UNDERSTAFFED THEN 1 ELSE 0 END) AS DOUBLE) / nullif(count(*), 0) * 100, 1) "
        "AS UNDERSTAFFED_DAY_PCT, "
        "round(avg(CASE WHEN IS_UNDERSTAFFED AND READMIT_RATE IS NOT NULL THEN READMIT_RATE END) * 100, 1) AS READMIT_UNDERSTAFFED, "
        "round(avg(CASE WHEN NOT IS_UNDERSTAFFED AND READMIT_RATE IS NOT NULL THEN READMIT_RATE END) * 100, 1) AS READMIT_ADEQUATE "
        f"FROM {st('f28')}"),
    "f29_staffing_trend": (f"SELECT SHIFT_MONTH AS MONTH, round(avg(HRS_PER_PATIENT), 1) AS HRS_PER_PATIENT, {RR} AS READMIT_RATE "
                           f"FROM {st('f29')} GROUP BY 1 ORDER BY 1"),
    "f30_staffing_scatter": (
        f"SELECT DEPT_NAME, DEPT_TYPE, round(avg(HRS_PER_PATIENT), 1) AS HRS_PER_PATIENT, {RR} AS READMIT_RATE, "
        f"CAST(sum(PATIENT_CENSUS) AS BIGINT) AS TOTAL_PATIENTS FROM {st('f30')} WHERE READMIT_RATE IS NOT NULL "
        "GROUP BY 1, 2 HAVING count(*) >= 30"),
    "f31_ot_by_department": (f"SELECT DEPT_NAME, round(avg(OT_PCT) * 100, 1) AS OT_PCT, {RR} AS READMIT_RATE "
                             f"FROM {st('f31')} GROUP BY 1 HAVING count(*) >= 30 ORDER BY OT_PCT DESC NULLS FIRST, 1 LIMIT 12"),
    "f32_department_weekday_matrix": (
        f"PIVOT (SELECT DAY_OF_WEEK, DEPT_NAME, round(avg(HRS_PER_PATIENT), 1) AS HRS_PER_PATIENT FROM {st('f32')} "
        "GROUP BY 1, 2 HAVING count(*) >= 5) ON DAY_OF_WEEK IN ('Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun') "
        "USING first(HRS_PER_PATIENT) GROUP BY DEPT_NAME"),
    "f33_department_day_detail": (
        "SELECT DEPT_NAME, FACILITY_NAME, SHIFT_DATE, DAY_OF_WEEK, STAFF_COUNT, TOTAL_WORKED_HRS, TOTAL_OT_HRS, "
        "round(OT_PCT * 100, 1) AS OT_PCT, PATIENT_CENSUS, HRS_PER_PATIENT, ADMITS, DISCHARGES, READMIT_COUNT, "
        "round(READMIT_RATE * 100, 1) AS READMIT_RATE_PCT, round(AVG_LOS_DAYS, 1) AS AVG_LOS, IS_UNDERSTAFFED, "
        f"HIGH_OT_FLAG FROM {st('f33')} ORDER BY SHIFT_DATE DESC NULLS FIRST, DEPT_NAME, FACILITY_ID LIMIT 500"),
    "f34_finance_kpis": (
        "SELECT round(sum(TOTAL_REVENUE) / 1e6, 1) AS REVENUE_M, round(sum(TOTAL_EXPENSE) / 1e6, 1) AS EXPENSE_M, "
        f"{MARGIN} AS MARGIN_PCT, round(avg(COST_PER_CMI_DISCHARGE), 0) AS AVG_COST_CMI, "
        f"round(avg(LABOR_PCT) * 100, 1) AS AVG_LABOR_PCT FROM {fn('f34')}"),
    "f35_finance_trend": (
        "SELECT PERIOD_DATE AS MONTH, round(sum(TOTAL_REVENUE) / 1e6, 2) AS REVENUE_M, "
        f"round(sum(TOTAL_EXPENSE) / 1e6, 2) AS EXPENSE_M, {MARGIN} AS MARGIN_PCT FROM {fn('f35')} GROUP BY 1 ORDER BY 1"),
    "f36_cost_breakdown": (
        "SELECT PERIOD_DATE AS MONTH, round(sum(LABOR_COST) / 1e6, 2) AS LABOR, round(sum(SUPPLY_COST) / 1e6, 2) AS SUPPLIES, "
        "round(sum(OVERHEAD_COST) / 1e6, 2) AS OVERHEAD, round(sum(DEPRECIATION_COST) / 1e6, 2) AS DEPRECIATION "
        f"FROM {fn('f36')} GROUP BY 1 ORDER BY 1"),
    "f37_department_cost": (
        "SELECT DEPT_NAME, round(avg(COST_PER_CMI_DISCHARGE), 0) AS COST_PER_CMI, "
        f"round(avg(OPERATING_MARGIN) * 100, 1) AS MARGIN_PCT FROM {fn('f37')} WHERE COST_PER_CMI_DISCHARGE IS NOT NULL "
        "GROUP BY 1 ORDER BY COST_PER_CMI DESC NULLS FIRST, 1 LIMIT 12"),
    "f38_facility_margin": (
        "SELECT FACILITY_NAME, round(sum(TOTAL_REVENUE) / 1e6, 1) AS REVENUE_M, round(sum(TOTAL_EXPENSE) / 1e6, 1) AS EXPENSE_M, "
        f"{MARGIN} AS MARGIN_PCT FROM {fn('f38')} GROUP BY 1 ORDER BY MARGIN_PCT DESC NULLS FIRST, 1"),
    "f39_department_month_detail": (
        "SELECT DEPT_NAME, FACILITY_NAME, PERIOD_DATE, round(TOTAL_REVENUE, 0) AS REVENUE, round(TOTAL_EXPENSE, 0) AS EXPENSE, "
        "round(NET_REVENUE, 0) AS NET_REVENUE, round(OPERATING_MARGIN * 100, 1) AS MARGIN_PCT, DISCHARGES, "
        "round(PATIENT_DAYS, 0) AS PATIENT_DAYS, round(COST_PER_DISCHARGE, 0) AS COST_PER_DC, "
        "round(COST_PER_CMI_DISCHARGE, 0) AS COST_PER_CMI_DC, round(LABOR_PCT * 100, 1) AS LABOR_PCT, "
        f"round(SUPPLY_PCT * 100, 1) AS SUPPLY_PCT FROM {fn('f39')} "
        "ORDER BY PERIOD_DATE DESC NULLS FIRST, DEPT_NAME, FACILITY_ID LIMIT 500"),
    "f40_denials_kpis": (
        f"SELECT round(sum(CHARGE_AMT), 0) AS TOTAL_DENIED, {rate('IS_APPEALED')} AS APPEAL_RATE, "
        "round(sum(ESTIMATED_RECOVERY), 0) AS EST_RECOVERY, round(avg(DAYS_TO_FILE), 1) AS AVG_DTF, "
        f"{rate('IS_TIMELY_FILED')} AS TIMELY_PCT, count(*) AS TOTAL_CLAIMS FROM {dn('f40')}"),
    "f41_denials_trend": (f"SELECT SERVICE_MONTH AS MONTH, DENIAL_CATEGORY, count(*) AS CLAIMS, "
                          f"round(sum(CHARGE_AMT), 0) AS CHARGES FROM {dn('f41')} GROUP BY 1, 2 ORDER BY 1, 2"),
    "f42_denials_by_category": (f"SELECT DENIAL_CATEGORY, count(*) AS CLAIMS, round(sum(CHARGE_AMT), 0) AS CHARGES "
                                f"FROM {dn('f42')} GROUP BY 1 ORDER BY CLAIMS DESC NULLS FIRST, 1"),
    "f43_top_cpt": (f"SELECT CPT_CODE || ' - ' || CPT_DESCRIPTION AS CPT_LABEL, count(*) AS CLAIMS, "
                    f"round(sum(CHARGE_AMT), 0) AS CHARGES FROM {dn('f43')} GROUP BY 1 "
                    "ORDER BY CHARGES DESC NULLS FIRST, 1 ASC NULLS LAST LIMIT 10"),
    "f44_timely_by_payer": (f"SELECT PAYER_TYPE, count(*) AS TOTAL, {rate('IS_TIMELY_FILED')} AS TIMELY_PCT, "
                            f"round(avg(DAYS_TO_FILE), 1) AS AVG_DTF FROM {dn('f44')} GROUP BY 1 "
                            "ORDER BY TIMELY_PCT ASC NULLS LAST, 1"),
    "f45_appeal_outcomes": (f"SELECT DENIAL_CATEGORY, APPEAL_OUTCOME, count(*) AS CLAIMS, round(sum(CHARGE_AMT), 0) AS CHARGES "
                            f"FROM {dn('f45')} WHERE IS_APPEALED = TRUE GROUP BY 1, 2 ORDER BY 1, 2"),
    "f46_anomaly_series": ("SELECT DENIAL_CATEGORY, TS, ACTUAL_COUNT, EXPECTED_COUNT, LOWER_BOUND, UPPER_BOUND, "
                           "IS_ANOMALY, ACTUAL_CHARGES FROM pred_denial_anomalies ORDER BY 1, 2"),
    "f47_claim_detail": (
        "SELECT CLAIM_ID, LINE_NUMBER, MRN, PATIENT_NAME, PAYER_NAME, PAYER_TYPE, SERVICE_DATE, DENIAL_CATEGORY, "
        "DENIAL_REASON, CHARGE_AMT, ALLOWED_AMT, IS_APPEALED, APPEAL_OUTCOME, CPT_CODE, CPT_DESCRIPTION, "
        f"DAYS_TO_FILE, IS_TIMELY_FILED, ESTIMATED_RECOVERY FROM {dn('f47')} "
        "ORDER BY SERVICE_DATE DESC NULLS FIRST, CLAIM_LINE_SK LIMIT 500"),
    "f48_prediction_tables": "SELECT TABLE_NAME, ROW_COUNT FROM pred_inventory ORDER BY 1",
    "f49_forecast_rounded": ("SELECT ENCOUNTER_TYPE, CAST(FORECAST_DATE AS DATE) AS FORECAST_DATE, "
                             "round(FORECAST_COUNT, 0) AS FORECAST_COUNT, round(LOWER_BOUND, 0) AS LOWER_BOUND, "
                             "round(UPPER_BOUND, 0) AS UPPER_BOUND FROM pred_encounter_volume ORDER BY 1, 2"),
    "f50_actuals_since": (f"SELECT ENCOUNTER_TYPE, CAST(TS AS DATE) AS DT, ENCOUNTER_COUNT AS ACTUAL FROM v1 "
                          f"WHERE TS >= TIMESTAMP '{P.recent_start} 00:00:00' ORDER BY 1, 2"),
    "f51_anomalies_with_percentile": (
        "SELECT DENIAL_CATEGORY, TS, ACTUAL_COUNT, EXPECTED_COUNT, LOWER_BOUND, UPPER_BOUND, IS_ANOMALY, PERCENTILE, "
        "ACTUAL_CHARGES FROM pred_denial_anomalies ORDER BY 1, 2"),
    "f52_all_readmission_drivers": DRV.format(t="pred_readmission_drivers", lim=""),
    "f53_all_leakage_drivers": DRV.format(t="pred_leakage_drivers", lim=""),
}

# U2 filter-value lists
from carelake.plans.filtered import FILTER_LISTS  # noqa: E402

_SRC = {"dim_facility": "dim_facility", "mart_readmission_los": "m_readmit", "mart_patient_leakage": "m_leak",
        "mart_or_capacity": "m_or", "mart_staffing_quality": "m_staff", "mart_financial_performance": "m_fin",
        "mart_denials_revcycle": "m_den"}
for _name, (_src, _col, _drop) in FILTER_LISTS.items():
    _w = f" WHERE {_col} IS NOT NULL" if _drop else ""
    Q[_name] = f"SELECT DISTINCT {_col} FROM {_SRC[_src]}{_w} ORDER BY 1"
