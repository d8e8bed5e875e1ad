"""Filterable page queries of the older app (F1-F53) with the P9 filter
record: a date range on the page's date column, a facility or "all", and
multi-select lists where an empty selection adds no clause. Filters are
Columns combined with AND, so Catalyst pushes them into the mart scan (or,
on the raw path, as far down the joins as their columns allow).
"""

from __future__ import annotations

import datetime as dt
import functools
import operator
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carelake.functions import compat as C
from carelake.operators import pivot
from carelake.operators.topk import top_k
from carelake.plans import features as V
from carelake.plans import models
from carelake.sources.adapter import Tables

A, D = F.asc_nulls_last, F.desc_nulls_first


MONTH_OF = {"ADMIT_DATE": "ADMIT_MONTH", "REFERRAL_DATE": "REFERRAL_MONTH", "CASE_DATE": "CASE_MONTH",
            "SERVICE_DATE": "SERVICE_MONTH", "SHIFT_DATE": "SHIFT_MONTH"}


@dataclass(frozen=True)
class Filter:
    start: dt.date
    end: dt.date
    facility: str | None = None          # None = "All Facilities"
    lists: tuple[tuple[str, tuple], ...] = ()

    def where(self, date_col: str, facility_col: str | None = "FACILITY_NAME", with_month: bool = True) -> Column:
        cs = [F.col(date_col).between(F.lit(self.start), F.lit(self.end))]
        month = MONTH_OF.get(date_col) if with_month else None
        if month:
            # Implied by the date range (month = trunc(date)); stated so a
            # month-partitioned mart prunes directories.
            cs.append(F.col(month).between(F.trunc(F.lit(self.start), "MM"), F.trunc(F.lit(self.end), "MM")))
        if facility_col and self.facility is not None:
            cs.append(F.col(facility_col) == F.lit(self.facility))
        cs += [F.col(c).isin(list(v)) for c, v in self.lists if v]
        return functools.reduce(operator.and_, cs)


# Filters the registered queries run with (test data spans 1995-2001).
_S, _E = dt.date(1996, 1, 1), dt.date(2000, 12, 31)
PAGE_FILTERS = {
    "provider360": Filter(_S, _E, "AMERICA"),
    "readmission": Filter(_S, _E, "AMERICA", (("ENCOUNTER_TYPE", ("INPATIENT",)),
                                              ("PAYER_TYPE", ("MEDICARE", "MEDICAID", "COMMERCIAL")),
                                              ("DRG_DESCRIPTION", ()))),
    "leakage": Filter(_S, _E, "AMERICA", (("REFERRING_SPECIALTY", ()),
                                          ("REFERRED_TO_SPECIALTY", ("Cardiology", "Oncology", "Neurology")),
                                          ("PATIENT_PAYER_TYPE", ()))),
    "or": Filter(_S, _E, "AMERICA", (("BLOCK_NAME", ("A", "B", "C")), ("SPECIALTY", ()),
                                     ("CASE_DAY_OF_WEEK", ("Mon", "Tue", "Wed", "Thu", "Fri")))),
    "staffing": Filter(_S, _E, "AMERICA", (("DEPT_TYPE", ("INPATIENT", "ICU", "ED")), ("DEPT_NAME", ()))),
    "finance": Filter(_S, _E, "AMERICA", (("DEPT_TYPE", ()), ("FACILITY_NAME", ("AMERICA", "ASIA")))),
    "denials": Filter(_S, _E, None, (("PAYER_TYPE", ("MEDICARE", "COMMERCIAL")), ("DENIAL_CATEGORY", ()),
                                     ("CPT_CATEGORY", ("ECONOMY", "PROMO")))),
}


def _cnt(name="N"):
    return F.count(F.lit(1)).alias(name)


def _flag_sum(c):
    return F.sum(C.flag01(c)).cast("long")


def _rm(t, f):
    return t.mart("mart_readmission_los").where(f.where("ADMIT_DATE"))


def _lk(t, f):
    return t.mart("mart_patient_leakage").where(f.where("REFERRAL_DATE"))


def _orc(t, f):
    return t.mart("mart_or_capacity").where(f.where("CASE_DATE"))


def _st(t, f):
    return t.mart("mart_staffing_quality").where(f.where("SHIFT_DATE") & (F.col("PATIENT_CENSUS") > 0))


def _fn(t, f):
    return t.mart("mart_financial_performance").where(f.where("PERIOD_DATE"))


def _dn(t, f):
    return t.mart("mart_denials_revcycle").where(f.where("SERVICE_DATE", None))


def _enc(t, f):
    """Fact with the page's facility filter: the fact carries FACILITY_ID, so
    the facility name is resolved through the (small) facility dimension."""
    e = t.get("fct_encounter").where(f.where("ADMIT_DATE", None, with_month=False))
    if f.facility is not None:
        ids = t.get("dim_facility").where(F.col("FACILITY_NAME") == f.facility).select("FACILITY_ID")
        e = e.join(ids, "FACILITY_ID", "left_semi")  # dimension-sized: AQE broadcasts by its statistics
    return e


# ---------------------------------------------------------------- 1 provider 360
def f01_kpis(t, f):
    parts = [
        _enc(t, f).agg(F.count(F.lit(1)).cast("double").alias("VALUE")).select(F.lit("ENCOUNTERS").alias("KPI"), "VALUE"),
        _rm(t, f).agg(C.rate_pct("READMIT_30_FLAG").alias("VALUE")).select(F.lit("READMIT_RATE").alias("KPI"), "VALUE"),
        _lk(t, f).agg(C.rate_pct("LEAKAGE_FLAG").alias("VALUE")).select(F.lit("LEAKAGE_RATE").alias("KPI"), "VALUE"),
        _orc(t, f).agg(F.round(C.exact_avg("UTILIZATION_PCT") * 100, 1).alias("VALUE"))
                  .select(F.lit("OR_UTIL").alias("KPI"), "VALUE"),
        t.mart("mart_denials_revcycle").where(f.where("SERVICE_DATE", None))
         .agg(F.round(C.exact_sum("CHARGE_AMT"), 0).alias("VALUE")).select(F.lit("DENIED_AMT").alias("KPI"), "VALUE"),
        models.prediction_inventory(t).agg(F.sum("ROW_COUNT").cast("double").alias("VALUE"))
              .select(F.lit("PREDICTION_ROWS").alias("KPI"), "VALUE"),
    ]
    return functools.reduce(DataFrame.unionByName, parts)


def f02_date_bounds(t, f):
    return t.mart("mart_readmission_los").agg(F.min("ADMIT_DATE").alias("MIN_DT"), F.max("ADMIT_DATE").alias("MAX_DT"))


def f03a_trend_encounters(t, f):
    return (_enc(t, f).groupBy(C.month_start("ADMIT_DATE").alias("MONTH")).agg(_cnt("ENCOUNTERS"))
            .orderBy(A("MONTH")))


def f03b_trend_readmit(t, f):
    return (_rm(t, f).groupBy(F.col("ADMIT_MONTH").alias("MONTH"))
            .agg(C.rate_pct("READMIT_30_FLAG").alias("READMIT_RATE")).orderBy(A("MONTH")))


def f03c_trend_leak(t, f):
    return (_lk(t, f).groupBy(F.col("REFERRAL_MONTH").alias("MONTH"))
            .agg(C.rate_pct("LEAKAGE_FLAG").alias("LEAK_RATE")).orderBy(A("MONTH")))


def f04a_top_drg(t, f):
    g = _rm(t, f).where(F.col("READMIT_30_FLAG") == True).groupBy("DRG_DESCRIPTION").agg(_cnt())  # noqa: E712
    return top_k(g, 1, D("N"), A("DRG_DESCRIPTION"))


def f04b_top_spec(t, f):
    g = (_lk(t, f).where(F.col("LEAKAGE_FLAG") == True).groupBy("REFERRED_TO_SPECIALTY")  # noqa: E712
         .agg(F.round(C.exact_sum("LOST_REVENUE"), 0).alias("LOST")))
    return top_k(g, 1, D("LOST"), A("REFERRED_TO_SPECIALTY"))


def f04c_low_block(t, f):
    g = _orc(t, f).groupBy("BLOCK_NAME").agg(F.round(C.exact_avg("UTILIZATION_PCT") * 100, 1).alias("UTIL"))
    return top_k(g, 1, A("UTIL"), A("BLOCK_NAME"))


def f04d_top_cat(t, f):
    g = t.mart("mart_denials_revcycle").where(f.where("SERVICE_DATE", None)).groupBy("DENIAL_CATEGORY").agg(_cnt())
    return top_k(g, 1, D("N"), A("DENIAL_CATEGORY"))


def f05a_forecast(t, f):
    return (models.pred_encounter_volume(t)
            .select("ENCOUNTER_TYPE", "FORECAST_DATE", "FORECAST_COUNT", "LOWER_BOUND", "UPPER_BOUND")
            .orderBy(A("ENCOUNTER_TYPE"), A("FORECAST_DATE")))


def f05b_anomalies(t, f):
    return (models.pred_denial_anomalies(t)
            .select("DENIAL_CATEGORY", "TS", "ACTUAL_COUNT", "EXPECTED_COUNT", "LOWER_BOUND", "UPPER_BOUND", "IS_ANOMALY")
            .orderBy(A("DENIAL_CATEGORY"), A("TS")))


# ---------------------------------------------------------------- 2 readmission
def f06_readmit_kpis(t, f):
    return _rm(t, f).agg(C.rate_pct("READMIT_30_FLAG").alias("READMIT_RATE"),
                         F.round(C.exact_avg("LOS_INDEX"), 2).alias("AVG_LOS_INDEX"),
                         C.rate_pct("IS_LONG_STAY").alias("LONG_STAY_PCT"),
                         F.round(C.exact_avg("COST_PER_DAY"), 0).alias("AVG_CPD"), _cnt("TOTAL_ENC"))


def f07_readmit_trend(t, f):
    return (_rm(t, f).groupBy(F.col("ADMIT_MONTH").alias("MONTH"))
            .agg(C.rate_pct("READMIT_30_FLAG").alias("READMIT_RATE"), _cnt("ENCOUNTERS")).orderBy(A("MONTH")))


def f08_los_histogram(t, f):
    return (_rm(t, f).where(F.col("LOS_DAYS") <= 30).groupBy("LOS_DAYS").agg(_cnt())
            .orderBy(A("LOS_DAYS")))


def f09_top_drg(t, f):
    g = (_rm(t, f).where(F.col("DRG_DESCRIPTION").isNotNull()).groupBy("DRG_DESCRIPTION")
         .agg(_cnt("TOTAL"), _flag_sum("READMIT_30_FLAG").alias("READMITS"),
              C.rate_pct("READMIT_30_FLAG").alias("RATE"))
         .where(F.col("TOTAL") >= 50))
    return top_k(g, 10, D("RATE"), A("DRG_DESCRIPTION"))


def f10_payer_readmit(t, f):
    return (_rm(t, f).groupBy("PAYER_TYPE").agg(_cnt("TOTAL"), C.rate_pct("READMIT_30_FLAG").alias("RATE"))
            .orderBy(D("RATE"), A("PAYER_TYPE")))


def _drivers(df, k):
    d = df.select("CONTRIBUTOR", "RELATIVE_CONTRIBUTION", "GROWTH_RATE", "METRIC_CONTROL", "METRIC_TEST")
    d = d.orderBy(D(F.abs("RELATIVE_CONTRIBUTION")), A("CONTRIBUTOR"))
    return d.limit(k) if k else d


def f11_readmit_drivers(t, f):
    return _drivers(models.pred_readmission_drivers(t), 15)


def f12_encounter_detail(t, f):
    cols = ["ENCOUNTER_ID", "MRN", "PATIENT_NAME", "PATIENT_AGE", "PATIENT_GENDER", "ENCOUNTER_TYPE", "ADMIT_DATE",
            "DISCHARGE_DATE", "LOS_DAYS", "LOS_INDEX", "IS_LONG_STAY", "READMIT_30_FLAG", "DRG_DESCRIPTION",
            "PAYER_TYPE", "FACILITY_NAME", "TOTAL_CHARGES", "NET_REVENUE"]
    return top_k(_rm(t, f).select(*cols), 500, D("ADMIT_DATE"), A("ENCOUNTER_ID"))


# ---------------------------------------------------------------- 3 leakage
def f13_leakage_kpis(t, f):
    hv = F.col("LEAKAGE_FLAG") & F.col("IS_HIGH_VALUE")
    return _lk(t, f).agg(C.rate_pct("LEAKAGE_FLAG").alias("LEAK_RATE"),
                         F.round(C.exact_sum("LOST_REVENUE"), 0).alias("LOST_REV"),
                         F.sum(F.when(hv, 1).otherwise(0)).cast("long").alias("HV_LEAKED"), _cnt("TOTAL_REF"))


def f14_top_leaked_specialty(t, f):
    g = _lk(t, f).where(F.col("LEAKAGE_FLAG") == True).groupBy("REFERRED_TO_SPECIALTY").agg(_cnt())  # noqa: E712
    return top_k(g, 1, D("N"), A("REFERRED_TO_SPECIALTY"))


def f15_leakage_trend(t, f):
    return (_lk(t, f).groupBy(F.col("REFERRAL_MONTH").alias("MONTH"))
            .agg(C.rate_pct("LEAKAGE_FLAG").alias("LEAK_RATE"), _cnt("REFERRALS")).orderBy(A("MONTH")))


def f16_leakage_by_specialty(t, f):
    g = (_lk(t, f).groupBy(F.col("REFERRED_TO_SPECIALTY").alias("SPECIALTY"))
         .agg(_cnt("TOTAL"), _flag_sum("LEAKAGE_FLAG").alias("LEAKED"), C.rate_pct("LEAKAGE_FLAG").alias("RATE"),
              F.round(C.exact_sum("LOST_REVENUE"), 0).alias("LOST_REV")))
    return top_k(g, 10, D("LOST_REV"), A("SPECIALTY"))


def f17_lost_by_referring_specialty(t, f):
    return (_lk(t, f).where(F.col("LEAKAGE_FLAG") == True)  # noqa: E712
            .groupBy(F.col("REFERRING_SPECIALTY").alias("SPECIALTY"))
            .agg(F.round(C.exact_sum("LOST_REVENUE"), 0).alias("LOST_REV"), _cnt("REFERRALS"))
            .orderBy(D("LOST_REV"), A("SPECIALTY")))


def f18_leakage_by_payer(t, f):
    return (_lk(t, f).groupBy(F.col("PATIENT_PAYER_TYPE").alias("PAYER"))
            .agg(_cnt("TOTAL"), _flag_sum("LEAKAGE_FLAG").alias("LEAKED"), C.rate_pct("LEAKAGE_FLAG").alias("RATE"))
            .orderBy(D("RATE"), A("PAYER")))


def f19_leakage_drivers(t, f):
    return _drivers(models.pred_leakage_drivers(t), 15)


def f20_referral_detail(t, f):
    cols = ["REFERRAL_ID", "MRN", "PATIENT_NAME", "REFERRING_PROVIDER", "REFERRING_SPECIALTY", "REFERRED_TO_SPECIALTY",
            "REFERRAL_DATE", "STATUS", "LEAKAGE_FLAG", "IS_HIGH_VALUE", "EXPECTED_REVENUE", "LOST_REVENUE",
            "FACILITY_NAME"]
    return top_k(_lk(t, f).select(*cols), 500, D("REFERRAL_DATE"), A("REFERRAL_ID"))


# ---------------------------------------------------------------- 4 OR capacity
def _util(digits=1):
    return F.round(C.exact_avg("UTILIZATION_PCT") * 100, digits)


def f21_or_kpis(t, f):
    return _orc(t, f).agg(_util().alias("AVG_UTIL"), C.rate_pct("FIRST_CASE_ON_TIME").alias("FCOT_PCT"),
                          F.round(F.avg("DELAY_MINUTES"), 1).alias("AVG_DELAY"), _cnt("TOTAL_CASES"),
                          F.round(F.avg("CASE_MINUTES"), 0).alias("AVG_CASE_MIN"))


def f22_block_weekday_matrix(t, f):
    heat = (_orc(t, f).groupBy("BLOCK_NAME", F.col("CASE_DAY_OF_WEEK").alias("DAY_OF_WEEK"))
            .agg(_util().alias("UTIL")))
    return pivot.pivot_matrix(heat, ["BLOCK_NAME"], "DAY_OF_WEEK", "UTIL", pivot.WEEKDAYS, how="avg")


def f23_util_by_month_block(t, f):
    return (_orc(t, f).groupBy(F.col("CASE_MONTH").alias("MONTH"), "BLOCK_NAME").agg(_util().alias("UTIL"))
            .orderBy(A("MONTH"), A("BLOCK_NAME")))


def f24_delay_histogram(t, f):
    d = _orc(t, f).where((F.col("DELAY_MINUTES") > 0) & (F.col("DELAY_MINUTES") <= 120))
    return d.groupBy("DELAY_MINUTES").agg(_cnt()).orderBy(A("DELAY_MINUTES"))


def f25_top_surgeons(t, f):
    g = (_orc(t, f).groupBy("SURGEON_NAME", "SPECIALTY")
         .agg(_cnt("CASES"), _util().alias("AVG_UTIL"), F.round(F.avg("CASE_MINUTES"), 0).alias("AVG_CASE_MIN")))
    return top_k(g, 10, D("CASES"), A("SURGEON_NAME"), A("SPECIALTY"))


def f26_under_over_by_block(t, f):
    under, over = _flag_sum("IS_UNDERUTILIZED"), _flag_sum("IS_OVERTIME")
    return (_orc(t, f).groupBy("BLOCK_NAME")
            .agg(under.alias("UNDER"), over.alias("OVER"), (F.count(F.lit(1)) - under - over).alias("NORMAL"))
            .orderBy(A("BLOCK_NAME")))


def f27_case_detail(t, f):
    cols = [F.col(c) for c in ["CASE_ID", "OR_ROOM_ID", "FACILITY_NAME", "SURGEON_NAME", "SPECIALTY", "BLOCK_NAME",
                               "CASE_DATE", "CASE_DAY_OF_WEEK", "DELAY_MINUTES", "CASE_MINUTES", "TURNOVER_MINUTES"]]
    cols += [F.round(F.col("UTILIZATION_PCT") * 100, 1).alias("UTIL_PCT")]
    cols += [F.col(c) for c in ["FIRST_CASE_ON_TIME", "IS_UNDERUTILIZED", "IS_OVERTIME", "CPT_DESCRIPTION"]]
    return top_k(_orc(t, f).select(*cols), 500, D("CASE_DATE"), A("CASE_ID"))


# ---------------------------------------------------------------- 5 staffing
def _rr(extra=None):
    cond = F.col("READMIT_RATE").isNotNull() if extra is None else extra & F.col("READMIT_RATE").isNotNull()
    return F.round(C.exact_avg(F.when(cond, F.col("READMIT_RATE"))) * 100, 1)


def f28_staffing_kpis(t, f):
    u = F.col("IS_UNDERSTAFFED")
    return _st(t, f).agg(
        F.round(C.exact_avg("HRS_PER_PATIENT"), 1).alias("AVG_HRS_PER_PATIENT"),
        F.round(C.exact_avg("OT_PCT") * 100, 1).alias("AVG_OT_PCT"),
        F.round(C.safe_div(F.sum(C.flag01("IS_UNDERSTAFFED")), F.count(F.lit(1))) * 100, 1).alias("UNDERSTAFFED_DAY_PCT"),
        _rr(u).alias("READMIT_UNDERSTAFFED"), _rr(~u).alias("READMIT_ADEQUATE"))


def f29_staffing_trend(t, f):
    return (_st(t, f).groupBy(F.col("SHIFT_MONTH").alias("MONTH"))
            .agg(F.round(C.exact_avg("HRS_PER_PATIENT"), 1).alias("HRS_PER_PATIENT"), _rr().alias("READMIT_RATE"))
            .orderBy(A("MONTH")))


def f30_staffing_scatter(t, f):
    return (_st(t, f).where(F.col("READMIT_RATE").isNotNull()).groupBy("DEPT_NAME", "DEPT_TYPE")
            .agg(F.round(C.exact_avg("HRS_PER_PATIENT"), 1).alias("HRS_PER_PATIENT"), _rr().alias("READMIT_RATE"),
                 F.sum("PATIENT_CENSUS").cast("long").alias("TOTAL_PATIENTS"), _cnt("_n"))
            .where(F.col("_n") >= 30).drop("_n"))


def f31_ot_by_department(t, f):
    g = (_st(t, f).groupBy("DEPT_NAME")
         .agg(F.round(C.exact_avg("OT_PCT") * 100, 1).alias("OT_PCT"), _rr().alias("READMIT_RATE"), _cnt("_n"))
         .where(F.col("_n") >= 30).drop("_n"))
    return top_k(g, 12, D("OT_PCT"), A("DEPT_NAME"))


def f32_department_weekday_matrix(t, f):
    cells = (_st(t, f).groupBy("DAY_OF_WEEK", "DEPT_NAME")
             .agg(F.round(C.exact_avg("HRS_PER_PATIENT"), 1).alias("HRS_PER_PATIENT"), _cnt("_n"))
             .where(F.col("_n") >= 5).drop("_n"))
    return pivot.pivot_matrix(cells, ["DEPT_NAME"], "DAY_OF_WEEK", "HRS_PER_PATIENT", pivot.WEEKDAYS, how="avg")


def f33_department_day_detail(t, f):
    cols = [F.col(c) for c in ["DEPT_NAME", "FACILITY_NAME", "SHIFT_DATE", "DAY_OF_WEEK", "STAFF_COUNT",
                               "TOTAL_WORKED_HRS", "TOTAL_OT_HRS"]]
    cols += [F.round(F.col("OT_PCT") * 100, 1).alias("OT_PCT")]
    cols += [F.col(c) for c in ["PATIENT_CENSUS", "HRS_PER_PATIENT", "ADMITS", "DISCHARGES", "READMIT_COUNT"]]
    cols += [F.round(F.col("READMIT_RATE") * 100, 1).alias("READMIT_RATE_PCT"),
             F.round("AVG_LOS_DAYS", 1).alias("AVG_LOS"), F.col("IS_UNDERSTAFFED"), F.col("HIGH_OT_FLAG"),
             F.col("FACILITY_ID")]
    out = top_k(_st(t, f).select(*cols), 500, D("SHIFT_DATE"), A("DEPT_NAME"), A("FACILITY_ID"))
    return out.drop("FACILITY_ID")


# ---------------------------------------------------------------- 6 finance
def _margin():
    rev, exp = C.exact_sum("TOTAL_REVENUE"), C.exact_sum("TOTAL_EXPENSE")
    return F.round(C.safe_div(rev - exp, rev) * 100, 1)


def f34_finance_kpis(t, f):
    return _fn(t, f).agg(C.millions(C.exact_sum("TOTAL_REVENUE"), 1).alias("REVENUE_M"),
                         C.millions(C.exact_sum("TOTAL_EXPENSE"), 1).alias("EXPENSE_M"), _margin().alias("MARGIN_PCT"),
                         F.round(C.exact_avg("COST_PER_CMI_DISCHARGE"), 0).alias("AVG_COST_CMI"),
                         F.round(C.exact_avg("LABOR_PCT") * 100, 1).alias("AVG_LABOR_PCT"))


def f35_finance_trend(t, f):
    return (_fn(t, f).groupBy(F.col("PERIOD_DATE").alias("MONTH"))
            .agg(C.millions(C.exact_sum("TOTAL_REVENUE"), 2).alias("REVENUE_M"),
                 C.millions(C.exact_sum("TOTAL_EXPENSE"), 2).alias("EXPENSE_M"), _margin().alias("MARGIN_PCT"))
            .orderBy(A("MONTH")))


def f36_cost_breakdown(t, f):
    return (_fn(t, f).groupBy(F.col("PERIOD_DATE").alias("MONTH"))
            .agg(C.millions(C.exact_sum("LABOR_COST"), 2).alias("LABOR"), C.millions(C.exact_sum("SUPPLY_COST"), 2).alias("SUPPLIES"),
                 C.millions(C.exact_sum("OVERHEAD_COST"), 2).alias("OVERHEAD"),
                 C.millions(C.exact_sum("DEPRECIATION_COST"), 2).alias("DEPRECIATION"))
            .orderBy(A("MONTH")))


def f37_department_cost(t, f):
    g = (_fn(t, f).where(F.col("COST_PER_CMI_DISCHARGE").isNotNull()).groupBy("DEPT_NAME")
         .agg(F.round(C.exact_avg("COST_PER_CMI_DISCHARGE"), 0).alias("COST_PER_CMI"),
              F.round(C.exact_avg("OPERATING_MARGIN") * 100, 1).alias("MARGIN_PCT")))
    return top_k(g, 12, D("COST_PER_CMI"), A("DEPT_NAME"))


def f38_facility_margin(t, f):
    return (_fn(t, f).groupBy("FACILITY_NAME")
            .agg(C.millions(C.exact_sum("TOTAL_REVENUE"), 1).alias("REVENUE_M"),
                 C.millions(C.exact_sum("TOTAL_EXPENSE"), 1).alias("EXPENSE_M"), _margin().alias("MARGIN_PCT"))
            .orderBy(D("MARGIN_PCT"), A("FACILITY_NAME")))


def f39_department_month_detail(t, f):
    cols = [F.col("DEPT_NAME"), F.col("FACILITY_NAME"), F.col("PERIOD_DATE"),
            F.round("TOTAL_REVENUE", 0).alias("REVENUE"), F.round("TOTAL_EXPENSE", 0).alias("EXPENSE"),
            F.round("NET_REVENUE", 0).alias("NET_REVENUE"), F.round(F.col("OPERATING_MARGIN") * 100, 1).alias("MARGIN_PCT"),
            F.col("DISCHARGES"), F.round("PATIENT_DAYS", 0).alias("PATIENT_DAYS"),
            F.round("COST_PER_DISCHARGE", 0).alias("COST_PER_DC"), F.round("COST_PER_CMI_DISCHARGE", 0).alias("COST_PER_CMI_DC"),
            F.round(F.col("LABOR_PCT") * 100, 1).alias("LABOR_PCT"), F.round(F.col("SUPPLY_PCT") * 100, 1).alias("SUPPLY_PCT"),
            F.col("FACILITY_ID")]
    out = top_k(_fn(t, f).select(*cols), 500, D("PERIOD_DATE"), A("DEPT_NAME"), A("FACILITY_ID"))
    return out.drop("FACILITY_ID")


# ---------------------------------------------------------------- 7 denials
def _charges():
    return F.round(C.exact_sum("CHARGE_AMT"), 0)


def f40_denials_kpis(t, f):
    return _dn(t, f).agg(_charges().alias("TOTAL_DENIED"), C.rate_pct("IS_APPEALED").alias("APPEAL_RATE"),
                         F.round(C.exact_sum("ESTIMATED_RECOVERY"), 0).alias("EST_RECOVERY"),
                         F.round(F.avg("DAYS_TO_FILE"), 1).alias("AVG_DTF"),
                         C.rate_pct("IS_TIMELY_FILED").alias("TIMELY_PCT"), _cnt("TOTAL_CLAIMS"))


def f41_denials_trend(t, f):
    return (_dn(t, f).groupBy(F.col("SERVICE_MONTH").alias("MONTH"), "DENIAL_CATEGORY")
            .agg(_cnt("CLAIMS"), _charges().alias("CHARGES")).orderBy(A("MONTH"), A("DENIAL_CATEGORY")))


def f42_denials_by_category(t, f):
    return (_dn(t, f).groupBy("DENIAL_CATEGORY").agg(_cnt("CLAIMS"), _charges().alias("CHARGES"))
            .orderBy(D("CLAIMS"), A("DENIAL_CATEGORY")))


def f43_top_cpt(t, f):
    g = (_dn(t, f).groupBy(C.concat_strict(F.col("CPT_CODE"), " - ", F.col("CPT_DESCRIPTION")).alias("CPT_LABEL"))
         .agg(_cnt("CLAIMS"), _charges().alias("CHARGES")))
    return top_k(g, 10, D("CHARGES"), A("CPT_LABEL"))


def f44_timely_by_payer(t, f):
    return (_dn(t, f).groupBy("PAYER_TYPE")
            .agg(_cnt("TOTAL"), C.rate_pct("IS_TIMELY_FILED").alias("TIMELY_PCT"),
                 F.round(F.avg("DAYS_TO_FILE"), 1).alias("AVG_DTF"))
            .orderBy(A("TIMELY_PCT"), A("PAYER_TYPE")))


def f45_appeal_outcomes(t, f):
    return (_dn(t, f).where(F.col("IS_APPEALED") == True)  # noqa: E712
            .groupBy("DENIAL_CATEGORY", "APPEAL_OUTCOME").agg(_cnt("CLAIMS"), _charges().alias("CHARGES"))
            .orderBy(A("DENIAL_CATEGORY"), A("APPEAL_OUTCOME")))


def f46_anomaly_series(t, f):
    return (models.pred_denial_anomalies(t)
            .select("DENIAL_CATEGORY", "TS", "ACTUAL_COUNT", "EXPECTED_COUNT", "LOWER_BOUND", "UPPER_BOUND",
                    "IS_ANOMALY", "ACTUAL_CHARGES")
            .orderBy(A("DENIAL_CATEGORY"), A("TS")))


def f47_claim_detail(t, f):
    cols = ["CLAIM_ID", "LINE_NUMBER", "MRN", "PATIENT_NAME", "PAYER_NAME", "PAYER_TYPE", "SERVICE_DATE",
            "DENIAL_CATEGORY", "DENIAL_REASON", "CHARGE_AMT", "ALLOWED_AMT", "IS_APPEALED", "APPEAL_OUTCOME",
            "CPT_CODE", "CPT_DESCRIPTION", "DAYS_TO_FILE", "IS_TIMELY_FILED", "ESTIMATED_RECOVERY", "CLAIM_LINE_SK"]
    return top_k(_dn(t, f).select(*cols), 500, D("SERVICE_DATE"), A("CLAIM_LINE_SK")).drop("CLAIM_LINE_SK")


# ---------------------------------------------------------------- 8 predictive
def f48_prediction_tables(t, f):
    return models.prediction_inventory(t).orderBy(A("TABLE_NAME"))


def f49_forecast_rounded(t, f):
    return models.vq09_encounter_forecast(t)


def f50_actuals_since(t, f):
    v1 = V.daily_encounter_volume(t)
    return (v1.where(F.col("TS") >= F.lit(t.profile.recent_start).cast("timestamp_ntz"))
            .select("ENCOUNTER_TYPE", F.col("TS").cast("date").alias("DT"), F.col("ENCOUNTER_COUNT").alias("ACTUAL"))
            .orderBy(A("ENCOUNTER_TYPE"), A("DT")))


def f51_anomalies_with_percentile(t, f):
    return (models.pred_denial_anomalies(t)
            .select("DENIAL_CATEGORY", "TS", "ACTUAL_COUNT", "EXPECTED_COUNT", "LOWER_BOUND", "UPPER_BOUND",
                    "IS_ANOMALY", "PERCENTILE", "ACTUAL_CHARGES")
            .orderBy(A("DENIAL_CATEGORY"), A("TS")))


def f52_all_readmission_drivers(t, f):
    return _drivers(models.pred_readmission_drivers(t), None)


def f53_all_leakage_drivers(t, f):
    return _drivers(models.pred_leakage_drivers(t), None)


# Which page filter each query runs with when registered.
PAGE_OF = {
    "f01": "provider360", "f02": "provider360", "f03": "provider360", "f04": "provider360", "f05": "provider360",
    **{f"f{i:02d}": "readmission" for i in range(6, 13)},
    **{f"f{i:02d}": "leakage" for i in range(13, 21)},
    **{f"f{i:02d}": "or" for i in range(21, 28)},
    **{f"f{i:02d}": "staffing" for i in range(28, 34)},
    **{f"f{i:02d}": "finance" for i in range(34, 40)},
    **{f"f{i:02d}": "denials" for i in range(40, 48)},
    **{f"f{i:02d}": "provider360" for i in range(48, 54)},
}


def _bind(fn, flt):
    def q(t: Tables) -> DataFrame:
        return fn(t, flt)
    q.__name__ = fn.__name__
    return q


QUERIES = {name: _bind(fn, PAGE_FILTERS[PAGE_OF[name[:3]]]) for name, fn in dict(globals()).items()
           if callable(fn) and re.match(r"^f\d\d[a-d]?_", name)}


# ---------------------------------------------------------------- U2 filter-value lists
# name -> (source table, column, drop nulls) for every "SELECT DISTINCT col ... ORDER BY 1" option list.
FILTER_LISTS = {
    "u2_facility_names": ("dim_facility", "FACILITY_NAME", False),
    "u2_readmission_encounter_types": ("mart_readmission_los", "ENCOUNTER_TYPE", False),
    "u2_readmission_payer_types": ("mart_readmission_los", "PAYER_TYPE", False),
    "u2_readmission_drgs": ("mart_readmission_los", "DRG_DESCRIPTION", True),
    "u2_leakage_referring_specialties": ("mart_patient_leakage", "REFERRING_SPECIALTY", False),
    "u2_leakage_referred_specialties": ("mart_patient_leakage", "REFERRED_TO_SPECIALTY", False),
    "u2_leakage_payer_types": ("mart_patient_leakage", "PATIENT_PAYER_TYPE", False),
    "u2_or_blocks": ("mart_or_capacity", "BLOCK_NAME", False),
    "u2_or_specialties": ("mart_or_capacity", "SPECIALTY", False),
    "u2_staffing_dept_types": ("mart_staffing_quality", "DEPT_TYPE", False),
    "u2_staffing_departments": ("mart_staffing_quality", "DEPT_NAME", False),
    "u2_finance_dept_types": ("mart_financial_performance", "DEPT_TYPE", False),
    "u2_finance_facilities": ("mart_financial_performance", "FACILITY_NAME", False),
    "u2_denials_payer_types": ("mart_denials_revcycle", "PAYER_TYPE", False),
    "u2_denials_categories": ("mart_denials_revcycle", "DENIAL_CATEGORY", False),
    "u2_denials_cpt_categories": ("mart_denials_revcycle", "CPT_CATEGORY", False),
}


def filter_values(t: Tables, source: str, column: str, drop_nulls: bool = False) -> DataFrame:
    """Distinct option list, sorted. ``distinct`` is a map-side combined
    aggregate; the sorted result is as small as the column's cardinality."""
    df = t.mart(source) if source.startswith("mart_") else t.get(source)
    df = df.select(column)
    if drop_nulls:
        df = df.where(F.col(column).isNotNull())
    return df.distinct().orderBy(A(column))


def _u2(source, column, drop):
    def q(t: Tables) -> DataFrame:
        return filter_values(t, source, column, drop)
    return q


QUERIES.update({name: _u2(*spec) for name, spec in FILTER_LISTS.items()})
