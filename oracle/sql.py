"""Oracle SQL per registered query (DuckDB dialect over the raw views)."""

from __future__ import annotations

import re

from carelake.config import TESTDATA as P
from oracle.base import BASE_CTES

RATE = "round(avg(CASE WHEN {f} THEN 1 ELSE 0 END) * 100, {d})"


def rate(flag: str, d: int = 1) -> str:
    return RATE.format(f=flag, d=d)


def crate(flag: str, d: int = 1) -> str:
    return f"round(count_if({flag}) / count(*) * 100, {d})"


def cif(flag: str) -> str:
    return f"CAST(count_if({flag}) AS BIGINT)"


Q: dict[str, str] = {}

# provider dashboard
Q["q01_dash_encounters"] = "SELECT count(*) AS N FROM fct_encounter"
Q["q02_dash_readmission"] = f"SELECT {rate('READMIT_30_FLAG')} AS RATE FROM m_readmit"
Q["q03_dash_leakage"] = f"SELECT {rate('LEAKAGE_FLAG')} AS RATE FROM m_leak"
Q["q04_dash_or_util"] = "SELECT round(avg(UTILIZATION_PCT) * 100, 1) AS RATE FROM m_or"
Q["q05_dash_denied"] = "SELECT round(sum(CHARGE_AMT) / 1e6, 1) AS AMT FROM m_den"
Q["q07_dash_trend_enc"] = ("SELECT CAST(date_trunc('month', ADMIT_DATE) AS DATE) AS MONTH, count(*) AS ENCOUNTERS "
                           "FROM fct_encounter GROUP BY 1 ORDER BY 1")
Q["q08_dash_trend_readmit"] = f"SELECT ADMIT_MONTH AS MONTH, {rate('READMIT_30_FLAG')} AS READMIT_RATE FROM m_readmit GROUP BY 1 ORDER BY 1"
Q["q09_dash_trend_leak"] = f"SELECT REFERRAL_MONTH AS MONTH, {rate('LEAKAGE_FLAG')} AS LEAK_RATE FROM m_leak GROUP BY 1 ORDER BY 1"
Q["q10_dash_top_drg"] = ("SELECT DRG_DESCRIPTION, count(*) AS N FROM m_readmit WHERE READMIT_30_FLAG = TRUE "
                         "GROUP BY 1 ORDER BY 2 DESC NULLS FIRST, 1 ASC NULLS LAST LIMIT 1")
Q["q11_dash_top_spec"] = ("SELECT REFERRED_TO_SPECIALTY, round(sum(LOST_REVENUE), 0) AS LOST FROM m_leak WHERE LEAKAGE_FLAG "
                          "GROUP BY 1 ORDER BY 2 DESC NULLS FIRST, 1 ASC NULLS LAST LIMIT 1")
Q["q12_dash_low_block"] = ("SELECT BLOCK_NAME, round(avg(UTILIZATION_PCT) * 100, 1) AS UTIL FROM m_or "
                           "GROUP BY 1 ORDER BY 2 ASC NULLS LAST, 1 ASC NULLS LAST LIMIT 1")
Q["q13_dash_top_cat"] = ("SELECT DENIAL_CATEGORY, count(*) AS N FROM m_den GROUP BY 1 "
                         "ORDER BY 2 DESC NULLS FIRST, 1 ASC NULLS LAST LIMIT 1")

# readmission & LOS
Q["q16_readmit_kpi"] = (f"SELECT {rate('READMIT_30_FLAG')} AS READMIT_RATE, round(avg(LOS_DAYS), 1) AS AVG_LOS, "
                        "count(*) AS TOTAL_ENCOUNTERS FROM m_readmit")
Q["q17_readmit_trend"] = (f"SELECT CAST(date_trunc('month', DISCHARGE_DATE) AS DATE) AS MONTH, {rate('READMIT_30_FLAG')} AS RATE "
                          "FROM m_readmit GROUP BY 1 ORDER BY 1 NULLS LAST")
Q["q18_readmit_los_hist"] = "SELECT LOS_DAYS, count(*) AS CNT FROM m_readmit GROUP BY 1 ORDER BY 1"
Q["q19_readmit_drg"] = (f"SELECT DRG_DESCRIPTION, {rate('READMIT_30_FLAG')} AS RATE FROM m_readmit "
                        "WHERE DRG_DESCRIPTION IS NOT NULL GROUP BY 1 HAVING count(*) >= 50 "
                        "ORDER BY RATE DESC NULLS FIRST, 1 ASC NULLS LAST LIMIT 10")
Q["q20_readmit_payer"] = (f"SELECT PAYER_NAME, {rate('READMIT_30_FLAG')} AS RATE FROM m_readmit GROUP BY 1 "
                          "ORDER BY 2 DESC NULLS FIRST, 1")
Q["q21_readmit_fs_kpi"] = (f"SELECT {rate('READMIT_30_FLAG')} AS READMIT_RATE, count(*) AS TOTAL_ENCOUNTERS, "
                           "count(DISTINCT FACILITY_NAME) AS FACILITY_COUNT, count(DISTINCT SPECIALTY) AS SPECIALTY_COUNT "
                           "FROM m_readmit WHERE SPECIALTY IS NOT NULL")
Q["q22_readmit_fs_heatmap"] = (f"SELECT FACILITY_NAME, SPECIALTY, {rate('READMIT_30_FLAG')} AS RATE, count(*) AS N "
                               "FROM m_readmit WHERE SPECIALTY IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 30 ORDER BY 1, 2")
Q["q23_readmit_fs_top"] = (f"SELECT FACILITY_NAME || ' — ' || SPECIALTY AS COMBO, {rate('READMIT_30_FLAG')} AS RATE, "
                           "count(*) AS N FROM m_readmit WHERE SPECIALTY IS NOT NULL GROUP BY 1 HAVING count(*) >= 30 "
                           "ORDER BY 2 DESC NULLS FIRST, 1 ASC NULLS LAST LIMIT 10")
Q["q24_readmit_fs_facility"] = (f"SELECT FACILITY_NAME, {rate('READMIT_30_FLAG')} AS RATE FROM m_readmit "
                                "WHERE SPECIALTY IS NOT NULL GROUP BY 1 ORDER BY 2 DESC NULLS FIRST, 1")
Q["q25_readmit_fs_control"] = ("SELECT CAST(date_trunc('month', DISCHARGE_DATE) AS DATE) AS MONTH, count(*) AS N, "
                               "CAST(sum(CASE WHEN READMIT_30_FLAG THEN 1 ELSE 0 END) AS BIGINT) AS READMITS, "
                               f"{rate('READMIT_30_FLAG', 2)} AS RATE FROM m_readmit WHERE DISCHARGE_DATE IS NOT NULL "
                               "GROUP BY 1 ORDER BY 1")
Q["q26_readmit_fs_trend"] = ("SELECT CAST(date_trunc('month', DISCHARGE_DATE) AS DATE) AS MONTH, FACILITY_NAME, "
                             f"{rate('READMIT_30_FLAG')} AS RATE FROM m_readmit WHERE SPECIALTY IS NOT NULL "
                             "GROUP BY 1, 2 ORDER BY 1, 2")

# leakage
Q["q27_leakage_kpi"] = (f"SELECT {rate('LEAKAGE_FLAG')} AS LEAKAGE_RATE, count(*) AS TOTAL_REFERRALS, "
                        "count(CASE WHEN LEAKAGE_FLAG THEN 1 END) AS LEAKED_REFERRALS FROM m_leak")
Q["q28_leakage_trend"] = (f"SELECT CAST(date_trunc('month', REFERRAL_DATE) AS DATE) AS MONTH, {rate('LEAKAGE_FLAG')} AS RATE "
                          "FROM m_leak GROUP BY 1 ORDER BY 1")
Q["q29_leakage_specialty"] = (f"SELECT REFERRED_TO_SPECIALTY AS SPECIALTY, {rate('LEAKAGE_FLAG')} AS RATE FROM m_leak "
                              "WHERE REFERRED_TO_SPECIALTY IS NOT NULL GROUP BY 1 ORDER BY 2 DESC NULLS FIRST, 1 LIMIT 10")
Q["q30_leakage_provider"] = ("SELECT REFERRING_PROVIDER, count(CASE WHEN LEAKAGE_FLAG THEN 1 END) AS LEAKED FROM m_leak "
                             "GROUP BY 1 ORDER BY 2 DESC NULLS FIRST, 1 ASC NULLS LAST LIMIT 10")

# OR capacity
Q["q31_or_kpi"] = ("SELECT round(avg(UTILIZATION_PCT) * 100, 1) AS AVG_UTIL, "
                   f"{rate('FIRST_CASE_ON_TIME')} AS FCOT_PCT, round(avg(DELAY_MINUTES), 1) AS AVG_DELAY, "
                   "count(*) AS TOTAL_CASES, round(avg(CASE_MINUTES), 0) AS AVG_CASE_MIN FROM m_or")
Q["q32_or_heatmap"] = ("SELECT BLOCK_NAME, CASE_DAY_OF_WEEK AS DOW, round(avg(UTILIZATION_PCT) * 100, 1) AS UTIL "
                       "FROM m_or GROUP BY 1, 2")
Q["q33_or_monthly"] = ("SELECT CASE_MONTH AS MONTH, BLOCK_NAME, round(avg(UTILIZATION_PCT) * 100, 1) AS UTIL "
                       "FROM m_or GROUP BY 1, 2 ORDER BY 1, 2")
Q["q34_or_surgeons"] = ("SELECT SURGEON_NAME, count(*) AS CASES, round(avg(UTILIZATION_PCT) * 100, 1) AS UTIL "
                        "FROM m_or GROUP BY 1 ORDER BY CASES DESC NULLS FIRST, 1 ASC NULLS LAST LIMIT 10")

# staffing
_RR = "round(avg(CASE WHEN READMIT_RATE IS NOT NULL THEN READMIT_RATE END) * 100, 1)"
Q["q35_staff_kpi"] = ("SELECT round(avg(HRS_PER_PATIENT), 1) AS AVG_HRS, round(avg(OT_PCT) * 100, 1) AS AVG_OT, "
                      "round(CAST(sum(CASE WHEN IS_UNDERSTAFFED THEN 1 ELSE 0 END) AS DOUBLE) / nullif(count(*), 0) * 100, 1) AS UNDER_PCT, "
                      "round(avg(CASE WHEN IS_UNDERSTAFFED AND READMIT_RATE IS NOT NULL THEN READMIT_RATE END) * 100, 1) AS READMIT_UNDER, "
                      "round(avg(CASE WHEN NOT IS_UNDERSTAFFED AND READMIT_RATE IS NOT NULL THEN READMIT_RATE END) * 100, 1) AS READMIT_OK "
                      "FROM m_staff WHERE PATIENT_CENSUS > 0")
Q["q36_staff_trend"] = (f"SELECT SHIFT_MONTH AS MONTH, round(avg(HRS_PER_PATIENT), 1) AS HRS, {_RR} AS READMIT "
                        "FROM m_staff WHERE PATIENT_CENSUS > 0 GROUP BY 1 ORDER BY 1")
Q["q37_staff_scatter"] = (f"SELECT DEPT_NAME, DEPT_TYPE, round(avg(HRS_PER_PATIENT), 1) AS HRS, {_RR} AS READMIT, "
                          "CAST(sum(PATIENT_CENSUS) AS BIGINT) AS TOTAL FROM m_staff "
                          "WHERE PATIENT_CENSUS > 0 AND READMIT_RATE IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 30")
Q["q38_staff_ot"] = ("SELECT DEPT_NAME, round(avg(OT_PCT) * 100, 1) AS OT_PCT FROM m_staff WHERE PATIENT_CENSUS > 0 "
                     "GROUP BY 1 HAVING count(*) >= 30 ORDER BY OT_PCT DESC NULLS FIRST, 1 LIMIT 12")

# finance
_MARGIN = "round((sum(TOTAL_REVENUE) - sum(TOTAL_EXPENSE)) / nullif(sum(TOTAL_REVENUE), 0) * 100, 1)"
Q["q39_fin_kpi"] = ("SELECT round(sum(TOTAL_REVENUE) / 1e6, 1) AS REV, round(sum(TOTAL_EXPENSE) / 1e6, 1) AS EXP, "
                    f"{_MARGIN} AS MARGIN, round(avg(COST_PER_CMI_DISCHARGE), 0) AS CPD, "
                    "round(avg(LABOR_PCT) * 100, 1) AS LABOR FROM m_fin")
Q["q40_fin_monthly"] = ("SELECT PERIOD_DATE AS MONTH, round(sum(TOTAL_REVENUE) / 1e6, 2) AS REV, "
                        f"round(sum(TOTAL_EXPENSE) / 1e6, 2) AS EXP, {_MARGIN} AS MARGIN FROM m_fin GROUP BY 1 ORDER BY 1")
Q["q41_fin_cost_breakdown"] = ("SELECT PERIOD_DATE AS MONTH, round(sum(LABOR_COST) / 1e6, 2) AS LABOR, "
                               "round(sum(SUPPLY_COST) / 1e6, 2) AS SUPPLIES, round(sum(OVERHEAD_COST) / 1e6, 2) AS OVERHEAD, "
                               "round(sum(DEPRECIATION_COST) / 1e6, 2) AS DEPRECIATION FROM m_fin GROUP BY 1 ORDER BY 1")
Q["q42_fin_dept_cost"] = ("SELECT DEPT_NAME, round(avg(COST_PER_CMI_DISCHARGE), 0) AS COST, "
                          "round(avg(OPERATING_MARGIN) * 100, 1) AS MARGIN FROM m_fin "
                          "WHERE COST_PER_CMI_DISCHARGE IS NOT NULL GROUP BY 1 ORDER BY COST DESC NULLS FIRST, 1 LIMIT 12")
Q["q43_fin_facility"] = f"SELECT FACILITY_NAME, {_MARGIN} AS MARGIN FROM m_fin GROUP BY 1 ORDER BY MARGIN DESC NULLS FIRST, 1"

# denials
Q["q44_denials_kpi"] = ("SELECT count(*) AS TOTAL_DENIALS, round(sum(CHARGE_AMT) / 1e6, 1) AS DENIED_AMT_M, "
                        "round(avg(DAYS_TO_FILE), 0) AS AVG_DAYS_TO_FILE, "
                        "round(avg(CASE WHEN IS_APPEALED AND APPEAL_OUTCOME = 'WON' THEN 1 WHEN IS_APPEALED THEN 0 END) * 100, 1) AS APPEAL_WIN_PCT, "
                        "round(sum(ESTIMATED_RECOVERY) / 1e6, 1) AS RECOVERY_M FROM m_den")
Q["q45_denials_category"] = ("SELECT DENIAL_CATEGORY, count(*) AS CNT, round(sum(CHARGE_AMT) / 1e6, 2) AS AMT FROM m_den "
                             "GROUP BY 1 ORDER BY 3 DESC NULLS FIRST, 1")
Q["q46_denials_trend"] = ("SELECT SERVICE_MONTH AS MONTH, count(*) AS CNT, round(sum(CHARGE_AMT) / 1e6, 2) AS AMT "
                          "FROM m_den GROUP BY 1 ORDER BY 1")
Q["q47_denials_payer"] = ("SELECT PAYER_NAME, count(*) AS CNT, round(sum(CHARGE_AMT) / 1e6, 2) AS AMT FROM m_den "
                          "GROUP BY 1 ORDER BY 3 DESC NULLS FIRST, 1 LIMIT 8")

# predictive actuals
Q["q49_pred_actuals"] = ("SELECT ENCOUNTER_TYPE, ADMIT_DATE AS DT, count(*) AS CNT FROM fct_encounter "
                         f"WHERE ADMIT_DATE BETWEEN DATE '{P.recent_start}' AND DATE '{P.recent_end}' "
                         "GROUP BY 1, 2 ORDER BY 1, 2")

# ops monitor
Q["q53_ops_encounters"] = "SELECT count(*) AS N FROM fct_encounter"
Q["q54_ops_patients"] = "SELECT count(*) AS N FROM dim_patient"
Q["q55_ops_providers"] = "SELECT count(*) AS N FROM dim_provider"

# verified semantic queries
Q["vq01_readmission_rate_by_facility"] = (
    f"SELECT FACILITY_NAME, count(*) AS TOTAL_ENCOUNTERS, {cif('READMIT_30_FLAG')} AS READMISSIONS, "
    f"{crate('READMIT_30_FLAG')} AS READMISSION_RATE_PCT FROM m_readmit GROUP BY FACILITY_NAME "
    "ORDER BY READMISSION_RATE_PCT DESC NULLS FIRST, 1")
Q["vq02_monthly_readmission_trend"] = (
    f"SELECT ADMIT_MONTH, count(*) AS ENCOUNTERS, {cif('READMIT_30_FLAG')} AS READMISSIONS, "
    f"{crate('READMIT_30_FLAG')} AS READMISSION_RATE_PCT FROM m_readmit GROUP BY ADMIT_MONTH ORDER BY ADMIT_MONTH")
Q["vq03_top_drgs_by_readmission"] = (
    f"SELECT DRG_DESCRIPTION, count(*) AS ENCOUNTERS, {cif('READMIT_30_FLAG')} AS READMISSIONS, "
    f"{crate('READMIT_30_FLAG')} AS READMISSION_RATE_PCT FROM m_readmit GROUP BY DRG_DESCRIPTION "
    "HAVING count(*) >= 100 ORDER BY READMISSION_RATE_PCT DESC NULLS FIRST, 1 ASC NULLS LAST LIMIT 10")
Q["vq04_leakage_rate_by_specialty"] = (
    f"SELECT REFERRING_SPECIALTY, count(*) AS TOTAL_REFERRALS, {cif('LEAKAGE_FLAG')} AS LEAKED, "
    f"{crate('LEAKAGE_FLAG')} AS LEAKAGE_RATE_PCT, round(sum(LOST_REVENUE), 0) AS TOTAL_LOST_REVENUE "
    "FROM m_leak GROUP BY REFERRING_SPECIALTY ORDER BY TOTAL_LOST_REVENUE DESC NULLS FIRST, 1")
Q["vq05_total_lost_revenue"] = (
    f"SELECT round(sum(LOST_REVENUE), 0) AS TOTAL_LOST_REVENUE, {cif('LEAKAGE_FLAG')} AS LEAKED_REFERRALS, "
    f"count(*) AS TOTAL_REFERRALS, {crate('LEAKAGE_FLAG')} AS LEAKAGE_RATE_PCT FROM m_leak")
Q["vq06_or_utilization_by_block"] = (
    "SELECT BLOCK_NAME, count(*) AS CASES, round(avg(UTILIZATION_PCT) * 100, 1) AS AVG_UTILIZATION_PCT "
    "FROM m_or GROUP BY BLOCK_NAME ORDER BY BLOCK_NAME")
Q["vq07_denials_by_category"] = (
    "SELECT DENIAL_CATEGORY, count(*) AS DENIED_CLAIMS, round(sum(CHARGE_AMT), 0) AS TOTAL_DENIED_CHARGES "
    "FROM m_den GROUP BY DENIAL_CATEGORY ORDER BY TOTAL_DENIED_CHARGES DESC NULLS FIRST, 1")
Q["vq08_appeal_success_rate"] = (
    f"SELECT DENIAL_CATEGORY, count(*) AS APPEALS_FILED, {cif("APPEAL_OUTCOME = 'WON'")} AS APPEALS_WON, "
    f"{crate("APPEAL_OUTCOME = 'WON'")} AS WIN_RATE_PCT FROM m_den WHERE IS_APPEALED = TRUE "
    "GROUP BY DENIAL_CATEGORY ORDER BY WIN_RATE_PCT DESC NULLS FIRST, 1")
Q["vq11_facility_performance"] = (
    f"SELECT FACILITY_NAME, count(*) AS ENCOUNTERS, {crate('READMIT_30_FLAG')} AS READMISSION_RATE_PCT, "
    "round(avg(LOS_INDEX), 2) AS AVG_LOS_INDEX FROM m_readmit GROUP BY FACILITY_NAME ORDER BY ENCOUNTERS DESC NULLS FIRST, 1")
Q["vq12_underutilized_blocks"] = (
    "SELECT BLOCK_NAME, FACILITY_NAME, round(avg(UTILIZATION_PCT) * 100, 1) AS AVG_UTILIZATION_PCT, "
    f"{cif('IS_UNDERUTILIZED')} AS UNDERUTILIZED_CASES FROM m_or GROUP BY BLOCK_NAME, FACILITY_NAME "
    "HAVING avg(UTILIZATION_PCT) < 0.7 ORDER BY AVG_UTILIZATION_PCT, 1, 2")


def _referenced(sql: str, ctes: dict[str, str]) -> list[str]:
    """CTE names needed by ``sql`` (transitively), in definition order."""
    names = list(ctes)
    need: set[str] = set()
    frontier = [sql]
    while frontier:
        text = frontier.pop()
        for n in names:
            if n not in need and re.search(rf"\b{re.escape(n)}\b", text):
                need.add(n)
                frontier.append(ctes[n])
    return [n for n in names if n in need]


def decimal_round(sql: str) -> str:
    """Rewrite ``round(x, n)`` so DuckDB rounds half-up on the value's
    shortest decimal form, the SQL meaning of ROUND that Spark implements
    (DuckDB's double round works on the binary value: 2794.635 -> 2794.63)."""
    out, i, low = [], 0, sql.lower()
    while True:
        j = low.find("round(", i)
        if j < 0 or (j > 0 and (low[j - 1].isalnum() or low[j - 1] == "_")):
            if j < 0:
                out.append(sql[i:])
                return "".join(out)
            out.append(sql[i:j + 6])
            i = j + 6
            continue
        depth, k, comma = 1, j + 6, None
        while depth:
            ch = sql[k]
            if ch == "(":
                depth += 1
            elif ch == ")":
                depth -= 1
            elif ch == "," and depth == 1:
                comma = k
            k += 1
        arg = decimal_round(sql[j + 6:comma])
        digits = sql[comma + 1:k - 1].strip()
        out.append(sql[i:j])
        out.append(f"CAST(round(CAST(CAST({arg} AS VARCHAR) AS DECIMAL(38,18)), {digits}) AS DOUBLE)")
        i = k


# Columns of type DOUBLE whose sums and averages are taken over DECIMAL, so that no result depends on the
# order of the additions. Integer columns need no such care.
AMOUNTS = {
    "AMOUNT", "CHARGE_AMT", "COST_PER_CMI_DISCHARGE", "COST_PER_DAY", "DENIED_CHARGES", "DEPRECIATION_COST", "ESTIMATED_RECOVERY",
    "EXPECTED_REVENUE", "HRS_PER_PATIENT", "LABOR_COST", "LABOR_PCT", "LOS_INDEX", "LOST_REVENUE", "NET_REVENUE", "OPERATING_MARGIN",
    "OT_PCT", "OVERHEAD_COST", "READMIT_RATE", "SUPPLY_COST", "TOTAL_EXPENSE", "TOTAL_REVENUE", "UTILIZATION_PCT",
}
_AMOUNT_CASE = re.compile(r"^CASE WHEN .*READMIT_RATE IS NOT NULL THEN READMIT_RATE END$")


def exact(sql: str) -> str:
    """``sum(x)`` and ``avg(x)`` of an amount as DECIMAL sums."""
    out, i = [], 0
    for m in re.finditer(r"(?i)(?<![A-Za-z0-9_])(sum|avg)\(", sql):
        if m.start() < i:
            continue
        depth, k = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        arg = sql[m.end():k - 1].strip()
        if arg.split(".")[-1] in AMOUNTS or _AMOUNT_CASE.match(arg):
            total = f"CAST(sum(CAST({arg} AS DECIMAL(28,6))) AS DOUBLE)"
            out += [sql[i:m.start()], total if m[1].lower() == "sum" else f"({total} / nullif(count({arg}), 0))"]
            i = k
    return "".join(out) + sql[i:]


def with_ctes(sql: str, extra: dict[str, str] | None = None) -> str:
    ctes = {**BASE_CTES, **(extra or {})}
    used = _referenced(sql, ctes)
    if sql.startswith("WITH "):
        sql = f"SELECT * FROM ({sql})"
    if not used:
        return decimal_round(exact(sql))
    body = ",\n".join(f"{n} AS ({ctes[n]})" for n in used)
    return decimal_round(exact(f"WITH {body}\n{sql}"))


def oracle_sql() -> dict[str, str]:
    from oracle import filtered, models, ops, positions
    extra = {**models.EXTRA_CTES, **ops.EXTRA_CTES, **positions.EXTRA_CTES}
    return {k: with_ctes(v, extra) for k, v in {**Q, **models.Q, **ops.Q, **filtered.Q, **positions.Q}.items()}


ORACLE_SQL = Q
