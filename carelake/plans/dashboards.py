"""Named dashboard queries: Q1-Q59 and the verified semantic
queries VQ1-VQ12. Each is ``fn(t: Tables) -> DataFrame``.

Sort rules: the source dialect sorts NULL as the largest value, so ascending
sorts put nulls last and descending sorts put them first; every top-k adds
the group key as a final tie-breaker so LIMIT is deterministic.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelake.functions import compat as C
from carelake.operators.topk import top_k
from carelake.sources.adapter import Tables

A, D = F.asc_nulls_last, F.desc_nulls_first


def _rm(t):
    return t.mart("mart_readmission_los")


def _lk(t):
    return t.mart("mart_patient_leakage")


def _orc(t):
    return t.mart("mart_or_capacity")


def _dn(t):
    return t.mart("mart_denials_revcycle")


def _st(t):
    return t.mart("mart_staffing_quality")


def _fn(t):
    return t.mart("mart_financial_performance")


def _cnt(name="N"):
    return F.count(F.lit(1)).alias(name)


# ---------------------------------------------------------------- provider dashboard
def q01_dash_encounters(t: Tables) -> DataFrame:
    return t.get("fct_encounter").agg(_cnt())


def q02_dash_readmission(t):
    return _rm(t).agg(C.rate_pct("READMIT_30_FLAG").alias("RATE"))


def q03_dash_leakage(t):
    return _lk(t).agg(C.rate_pct("LEAKAGE_FLAG").alias("RATE"))


def q04_dash_or_util(t):
    return _orc(t).agg(F.round(C.exact_avg("UTILIZATION_PCT") * 100, 1).alias("RATE"))


def q05_dash_denied(t):
    return _dn(t).agg(C.millions(C.exact_sum("CHARGE_AMT"), 1).alias("AMT"))


def q07_dash_trend_enc(t):
    e = t.get("fct_encounter")
    return (e.groupBy(C.month_start("ADMIT_DATE").alias("MONTH")).agg(_cnt("ENCOUNTERS"))
             .orderBy(A("MONTH")))


def q08_dash_trend_readmit(t):
    return (_rm(t).groupBy(F.col("ADMIT_MONTH").alias("MONTH"))
            .agg(C.rate_pct("READMIT_30_FLAG").alias("READMIT_RATE")).orderBy(A("MONTH")))


def q09_dash_trend_leak(t):
    return (_lk(t).groupBy(F.col("REFERRAL_MONTH").alias("MONTH"))
            .agg(C.rate_pct("LEAKAGE_FLAG").alias("LEAK_RATE")).orderBy(A("MONTH")))


def q10_dash_top_drg(t):
    g = _rm(t).where(F.col("READMIT_30_FLAG") == True).groupBy("DRG_DESCRIPTION").agg(_cnt())  # noqa: E712
    return top_k(g, 1, D("N"), A("DRG_DESCRIPTION"))


def q11_dash_top_spec(t):
    g = (_lk(t).where(F.col("LEAKAGE_FLAG")).groupBy("REFERRED_TO_SPECIALTY")
         .agg(F.round(C.exact_sum("LOST_REVENUE"), 0).alias("LOST")))
    return top_k(g, 1, D("LOST"), A("REFERRED_TO_SPECIALTY"))


def q12_dash_low_block(t):
    g = _orc(t).groupBy("BLOCK_NAME").agg(F.round(C.exact_avg("UTILIZATION_PCT") * 100, 1).alias("UTIL"))
    return top_k(g, 1, A("UTIL"), A("BLOCK_NAME"))


def q13_dash_top_cat(t):
    g = _dn(t).groupBy("DENIAL_CATEGORY").agg(_cnt())
    return top_k(g, 1, D("N"), A("DENIAL_CATEGORY"))


# ---------------------------------------------------------------- readmission & LOS
def q16_readmit_kpi(t):
    return _rm(t).agg(C.rate_pct("READMIT_30_FLAG").alias("READMIT_RATE"),
                      F.round(F.avg("LOS_DAYS"), 1).alias("AVG_LOS"),
                      _cnt("TOTAL_ENCOUNTERS"))


def q17_readmit_trend(t):
    return (_rm(t).groupBy(C.month_start("DISCHARGE_DATE").alias("MONTH"))
            .agg(C.rate_pct("READMIT_30_FLAG").alias("RATE")).orderBy(A("MONTH")))


def q18_readmit_los_hist(t):
    return _rm(t).groupBy("LOS_DAYS").agg(_cnt("CNT")).orderBy(A("LOS_DAYS"))


def q19_readmit_drg(t):
    g = (_rm(t).where(F.col("DRG_DESCRIPTION").isNotNull()).groupBy("DRG_DESCRIPTION")
         .agg(C.rate_pct("READMIT_30_FLAG").alias("RATE"), _cnt("_n")).where(F.col("_n") >= 50).drop("_n"))
    return top_k(g, 10, D("RATE"), A("DRG_DESCRIPTION"))


def q20_readmit_payer(t):
    return (_rm(t).groupBy("PAYER_NAME").agg(C.rate_pct("READMIT_30_FLAG").alias("RATE"))
            .orderBy(D("RATE"), A("PAYER_NAME")))


def _spec(t):
    return _rm(t).where(F.col("SPECIALTY").isNotNull())


def q21_readmit_fs_kpi(t):
    return _spec(t).agg(C.rate_pct("READMIT_30_FLAG").alias("READMIT_RATE"), _cnt("TOTAL_ENCOUNTERS"),
                        F.count_distinct("FACILITY_NAME").alias("FACILITY_COUNT"),
                        F.count_distinct("SPECIALTY").alias("SPECIALTY_COUNT"))


def q22_readmit_fs_heatmap(t):
    return (_spec(t).groupBy("FACILITY_NAME", "SPECIALTY")
            .agg(C.rate_pct("READMIT_30_FLAG").alias("RATE"), _cnt("N")).where(F.col("N") >= 30)
            .orderBy(A("FACILITY_NAME"), A("SPECIALTY")))


def q23_readmit_fs_top(t):
    g = (_spec(t).groupBy(C.concat_strict(F.col("FACILITY_NAME"), " — ", F.col("SPECIALTY")).alias("COMBO"))
         .agg(C.rate_pct("READMIT_30_FLAG").alias("RATE"), _cnt("N")).where(F.col("N") >= 30))
    return top_k(g, 10, D("RATE"), A("COMBO"))


def q24_readmit_fs_facility(t):
    return (_spec(t).groupBy("FACILITY_NAME").agg(C.rate_pct("READMIT_30_FLAG").alias("RATE"))
            .orderBy(D("RATE"), A("FACILITY_NAME")))


def q25_readmit_fs_control(t):
    return (_rm(t).where(F.col("DISCHARGE_DATE").isNotNull())
            .groupBy(C.month_start("DISCHARGE_DATE").alias("MONTH"))
            .agg(_cnt("N"), F.sum(C.flag01("READMIT_30_FLAG")).cast("long").alias("READMITS"),
                 C.rate_pct("READMIT_30_FLAG", 2).alias("RATE"))
            .orderBy(A("MONTH")))


def q26_readmit_fs_trend(t):
    return (_spec(t).groupBy(C.month_start("DISCHARGE_DATE").alias("MONTH"), "FACILITY_NAME")
            .agg(C.rate_pct("READMIT_30_FLAG").alias("RATE")).orderBy(A("MONTH"), A("FACILITY_NAME")))


# ---------------------------------------------------------------- leakage
def q27_leakage_kpi(t):
    return _lk(t).agg(C.rate_pct("LEAKAGE_FLAG").alias("LEAKAGE_RATE"), _cnt("TOTAL_REFERRALS"),
                      F.count(F.when(F.col("LEAKAGE_FLAG"), 1)).alias("LEAKED_REFERRALS"))


def q28_leakage_trend(t):
    return (_lk(t).groupBy(C.month_start("REFERRAL_DATE").alias("MONTH"))
            .agg(C.rate_pct("LEAKAGE_FLAG").alias("RATE")).orderBy(A("MONTH")))


def q29_leakage_specialty(t):
    g = (_lk(t).where(F.col("REFERRED_TO_SPECIALTY").isNotNull())
         .groupBy(F.col("REFERRED_TO_SPECIALTY").alias("SPECIALTY"))
         .agg(C.rate_pct("LEAKAGE_FLAG").alias("RATE")))
    return top_k(g, 10, D("RATE"), A("SPECIALTY"))


def q30_leakage_provider(t):
    g = _lk(t).groupBy("REFERRING_PROVIDER").agg(F.count(F.when(F.col("LEAKAGE_FLAG"), 1)).alias("LEAKED"))
    return top_k(g, 10, D("LEAKED"), A("REFERRING_PROVIDER"))


# ---------------------------------------------------------------- OR capacity
def q31_or_kpi(t):
    return _orc(t).agg(F.round(C.exact_avg("UTILIZATION_PCT") * 100, 1).alias("AVG_UTIL"),
                       C.rate_pct("FIRST_CASE_ON_TIME").alias("FCOT_PCT"),
                       F.round(F.avg("DELAY_MINUTES"), 1).alias("AVG_DELAY"),
                       _cnt("TOTAL_CASES"),
                       F.round(F.avg("CASE_MINUTES"), 0).alias("AVG_CASE_MIN"))


def q32_or_heatmap(t):
    return (_orc(t).groupBy("BLOCK_NAME", F.col("CASE_DAY_OF_WEEK").alias("DOW"))
            .agg(F.round(C.exact_avg("UTILIZATION_PCT") * 100, 1).alias("UTIL")))


def q33_or_monthly(t):
    return (_orc(t).groupBy(F.col("CASE_MONTH").alias("MONTH"), "BLOCK_NAME")
            .agg(F.round(C.exact_avg("UTILIZATION_PCT") * 100, 1).alias("UTIL"))
            .orderBy(A("MONTH"), A("BLOCK_NAME")))


def q34_or_surgeons(t):
    g = (_orc(t).groupBy("SURGEON_NAME")
         .agg(_cnt("CASES"), F.round(C.exact_avg("UTILIZATION_PCT") * 100, 1).alias("UTIL")))
    return top_k(g, 10, D("CASES"), A("SURGEON_NAME"))


# ---------------------------------------------------------------- staffing
def _census(t):
    return _st(t).where(F.col("PATIENT_CENSUS") > 0)


def _avg_rate(c="READMIT_RATE"):
    return F.round(C.exact_avg(F.when(F.col(c).isNotNull(), F.col(c))) * 100, 1)


def q35_staff_kpi(t):
    u = F.col("IS_UNDERSTAFFED")
    return _census(t).agg(
        F.round(C.exact_avg("HRS_PER_PATIENT"), 1).alias("AVG_HRS"),
        F.round(C.exact_avg("OT_PCT") * 100, 1).alias("AVG_OT"),
        F.round(C.safe_div(F.sum(C.flag01("IS_UNDERSTAFFED")), F.count(F.lit(1))) * 100, 1).alias("UNDER_PCT"),
        F.round(C.exact_avg(F.when(u & F.col("READMIT_RATE").isNotNull(), F.col("READMIT_RATE"))) * 100, 1).alias("READMIT_UNDER"),
        F.round(C.exact_avg(F.when(~u & F.col("READMIT_RATE").isNotNull(), F.col("READMIT_RATE"))) * 100, 1).alias("READMIT_OK"))


def q36_staff_trend(t):
    return (_census(t).groupBy(F.col("SHIFT_MONTH").alias("MONTH"))
            .agg(F.round(C.exact_avg("HRS_PER_PATIENT"), 1).alias("HRS"), _avg_rate().alias("READMIT"))
            .orderBy(A("MONTH")))


def q37_staff_scatter(t):
    return (_census(t).where(F.col("READMIT_RATE").isNotNull()).groupBy("DEPT_NAME", "DEPT_TYPE")
            .agg(F.round(C.exact_avg("HRS_PER_PATIENT"), 1).alias("HRS"), _avg_rate().alias("READMIT"),
                 F.sum("PATIENT_CENSUS").cast("long").alias("TOTAL"), _cnt("_n"))
            .where(F.col("_n") >= 30).drop("_n"))


def q38_staff_ot(t):
    g = (_census(t).groupBy("DEPT_NAME").agg(F.round(C.exact_avg("OT_PCT") * 100, 1).alias("OT_PCT"), _cnt("_n"))
         .where(F.col("_n") >= 30).drop("_n"))
    return top_k(g, 12, D("OT_PCT"), A("DEPT_NAME"))


# ---------------------------------------------------------------- finance
def _margin(digits=1):
    rev, exp = C.exact_sum("TOTAL_REVENUE"), C.exact_sum("TOTAL_EXPENSE")
    return F.round(C.safe_div(rev - exp, rev) * 100, digits)


def q39_fin_kpi(t):
    return _fn(t).agg(C.millions(C.exact_sum("TOTAL_REVENUE"), 1).alias("REV"),
                      C.millions(C.exact_sum("TOTAL_EXPENSE"), 1).alias("EXP"),
                      _margin().alias("MARGIN"),
                      F.round(C.exact_avg("COST_PER_CMI_DISCHARGE"), 0).alias("CPD"),
                      F.round(C.exact_avg("LABOR_PCT") * 100, 1).alias("LABOR"))


def q40_fin_monthly(t):
    return (_fn(t).groupBy(F.col("PERIOD_DATE").alias("MONTH"))
            .agg(C.millions(C.exact_sum("TOTAL_REVENUE"), 2).alias("REV"),
                 C.millions(C.exact_sum("TOTAL_EXPENSE"), 2).alias("EXP"), _margin().alias("MARGIN"))
            .orderBy(A("MONTH")))


def q41_fin_cost_breakdown(t):
    return (_fn(t).groupBy(F.col("PERIOD_DATE").alias("MONTH"))
            .agg(C.millions(C.exact_sum("LABOR_COST"), 2).alias("LABOR"),
                 C.millions(C.exact_sum("SUPPLY_COST"), 2).alias("SUPPLIES"),
                 C.millions(C.exact_sum("OVERHEAD_COST"), 2).alias("OVERHEAD"),
                 C.millions(C.exact_sum("DEPRECIATION_COST"), 2).alias("DEPRECIATION"))
            .orderBy(A("MONTH")))


def q42_fin_dept_cost(t):
    g = (_fn(t).where(F.col("COST_PER_CMI_DISCHARGE").isNotNull()).groupBy("DEPT_NAME")
         .agg(F.round(C.exact_avg("COST_PER_CMI_DISCHARGE"), 0).alias("COST"),
              F.round(C.exact_avg("OPERATING_MARGIN") * 100, 1).alias("MARGIN")))
    return top_k(g, 12, D("COST"), A("DEPT_NAME"))


def q43_fin_facility(t):
    return (_fn(t).groupBy("FACILITY_NAME").agg(_margin().alias("MARGIN"))
            .orderBy(D("MARGIN"), A("FACILITY_NAME")))


# ---------------------------------------------------------------- denials
def appeal_win_pct(digits=1):
    """Win rate over appealed rows only (A9; SURVEY §8 item 11)."""
    ap = F.col("IS_APPEALED")
    return F.round(F.avg(F.when(ap & (F.col("APPEAL_OUTCOME") == "WON"), 1).when(ap, 0)) * 100, digits)


def q44_denials_kpi(t):
    return _dn(t).agg(_cnt("TOTAL_DENIALS"),
                      C.millions(C.exact_sum("CHARGE_AMT"), 1).alias("DENIED_AMT_M"),
                      F.round(F.avg("DAYS_TO_FILE"), 0).alias("AVG_DAYS_TO_FILE"),
                      appeal_win_pct().alias("APPEAL_WIN_PCT"),
                      C.millions(C.exact_sum("ESTIMATED_RECOVERY"), 1).alias("RECOVERY_M"))


def q45_denials_category(t):
    return (_dn(t).groupBy("DENIAL_CATEGORY")
            .agg(_cnt("CNT"), C.millions(C.exact_sum("CHARGE_AMT"), 2).alias("AMT"))
            .orderBy(D("AMT"), A("DENIAL_CATEGORY")))


def q46_denials_trend(t):
    return (_dn(t).groupBy(F.col("SERVICE_MONTH").alias("MONTH"))
            .agg(_cnt("CNT"), C.millions(C.exact_sum("CHARGE_AMT"), 2).alias("AMT")).orderBy(A("MONTH")))


def q47_denials_payer(t):
    g = _dn(t).groupBy("PAYER_NAME").agg(_cnt("CNT"), C.millions(C.exact_sum("CHARGE_AMT"), 2).alias("AMT"))
    return top_k(g, 8, D("AMT"), A("PAYER_NAME"))


# ---------------------------------------------------------------- predictive (actuals)
def q49_pred_actuals(t):
    lo, hi = t.profile.recent_start, t.profile.recent_end
    e = t.get("fct_encounter").where(F.col("ADMIT_DATE").between(F.lit(lo), F.lit(hi)))
    return (e.groupBy("ENCOUNTER_TYPE", F.col("ADMIT_DATE").alias("DT")).agg(_cnt("CNT"))
            .orderBy(A("ENCOUNTER_TYPE"), A("DT")))


# ---------------------------------------------------------------- ops monitor
def q53_ops_encounters(t):
    return t.get("fct_encounter").agg(_cnt())


def q54_ops_patients(t):
    return t.get("dim_patient").agg(_cnt())


def q55_ops_providers(t):
    return t.get("dim_provider").agg(_cnt())


# ---------------------------------------------------------------- verified semantic queries
def vq01_readmission_rate_by_facility(t):
    return (_rm(t).groupBy("FACILITY_NAME")
            .agg(_cnt("TOTAL_ENCOUNTERS"), C.count_if("READMIT_30_FLAG").alias("READMISSIONS"),
                 C.count_rate_pct("READMIT_30_FLAG").alias("READMISSION_RATE_PCT"))
            .orderBy(D("READMISSION_RATE_PCT"), A("FACILITY_NAME")))


def vq02_monthly_readmission_trend(t):
    return (_rm(t).groupBy("ADMIT_MONTH")
            .agg(_cnt("ENCOUNTERS"), C.count_if("READMIT_30_FLAG").alias("READMISSIONS"),
                 C.count_rate_pct("READMIT_30_FLAG").alias("READMISSION_RATE_PCT"))
            .orderBy(A("ADMIT_MONTH")))


def vq03_top_drgs_by_readmission(t):
    g = (_rm(t).groupBy("DRG_DESCRIPTION")
         .agg(_cnt("ENCOUNTERS"), C.count_if("READMIT_30_FLAG").alias("READMISSIONS"),
              C.count_rate_pct("READMIT_30_FLAG").alias("READMISSION_RATE_PCT"))
         .where(F.col("ENCOUNTERS") >= 100))
    return top_k(g, 10, D("READMISSION_RATE_PCT"), A("DRG_DESCRIPTION"))


def vq04_leakage_rate_by_specialty(t):
    return (_lk(t).groupBy("REFERRING_SPECIALTY")
            .agg(_cnt("TOTAL_REFERRALS"), C.count_if("LEAKAGE_FLAG").alias("LEAKED"),
                 C.count_rate_pct("LEAKAGE_FLAG").alias("LEAKAGE_RATE_PCT"),
                 F.round(C.exact_sum("LOST_REVENUE"), 0).alias("TOTAL_LOST_REVENUE"))
            .orderBy(D("TOTAL_LOST_REVENUE"), A("REFERRING_SPECIALTY")))


def vq05_total_lost_revenue(t):
    return _lk(t).agg(F.round(C.exact_sum("LOST_REVENUE"), 0).alias("TOTAL_LOST_REVENUE"),
                      C.count_if("LEAKAGE_FLAG").alias("LEAKED_REFERRALS"),
                      _cnt("TOTAL_REFERRALS"),
                      C.count_rate_pct("LEAKAGE_FLAG").alias("LEAKAGE_RATE_PCT"))


def vq06_or_utilization_by_block(t):
    return (_orc(t).groupBy("BLOCK_NAME")
            .agg(_cnt("CASES"), F.round(C.exact_avg("UTILIZATION_PCT") * 100, 1).alias("AVG_UTILIZATION_PCT"))
            .orderBy(A("BLOCK_NAME")))


def vq07_denials_by_category(t):
    return (_dn(t).groupBy("DENIAL_CATEGORY")
            .agg(_cnt("DENIED_CLAIMS"), F.round(C.exact_sum("CHARGE_AMT"), 0).alias("TOTAL_DENIED_CHARGES"))
            .orderBy(D("TOTAL_DENIED_CHARGES"), A("DENIAL_CATEGORY")))


def vq08_appeal_success_rate(t):
    won = F.col("APPEAL_OUTCOME") == "WON"
    return (_dn(t).where(F.col("IS_APPEALED") == True).groupBy("DENIAL_CATEGORY")  # noqa: E712
            .agg(_cnt("APPEALS_FILED"), C.count_if(won).alias("APPEALS_WON"),
                 C.count_rate_pct(won).alias("WIN_RATE_PCT"))
            .orderBy(D("WIN_RATE_PCT"), A("DENIAL_CATEGORY")))


def vq11_facility_performance(t):
    return (_rm(t).groupBy("FACILITY_NAME")
            .agg(_cnt("ENCOUNTERS"), C.count_rate_pct("READMIT_30_FLAG").alias("READMISSION_RATE_PCT"),
                 F.round(C.exact_avg("LOS_INDEX"), 2).alias("AVG_LOS_INDEX"))
            .orderBy(D("ENCOUNTERS"), A("FACILITY_NAME")))


def vq12_underutilized_blocks(t):
    return (_orc(t).groupBy("BLOCK_NAME", "FACILITY_NAME")
            .agg(F.round(C.exact_avg("UTILIZATION_PCT") * 100, 1).alias("AVG_UTILIZATION_PCT"),
                 C.count_if("IS_UNDERUTILIZED").alias("UNDERUTILIZED_CASES"),
                 C.exact_avg("UTILIZATION_PCT").alias("_u"))
            .where(F.col("_u") < 0.7).drop("_u")
            .orderBy(A("AVG_UTILIZATION_PCT"), A("BLOCK_NAME"), A("FACILITY_NAME")))


QUERIES = {name: fn for name, fn in dict(globals()).items()
           if callable(fn) and re.match(r"^v?q\d\d_", name)}
