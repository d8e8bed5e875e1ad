"""Data-quality checks D1-D16.

Each mart is scanned ONCE: a single aggregate yields every measure its checks
need, and a fixed-size explode turns that one row into check rows. Key
uniqueness (D14) is a groupBy on the declared key; only the number of
duplicate keys leaves the aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carelake.functions import compat as C
from carelake.sources.adapter import Tables

# Metric bands (pass low, pass high, warn low, warn high).
RATE_BANDS = {
    "METRIC_READMISSION_RATE": (5, 25, 3, 30),
    "METRIC_LEAKAGE_RATE": (5, 30, 2, 40),
    "METRIC_OR_UTILIZATION": (60, 95, 40, 100),
}
DECLARED_KEYS = {
    "MART_PATIENT_LEAKAGE": ["REFERRAL_ID"],
    "MART_READMISSION_LOS": ["ENCOUNTER_ID"],
    "MART_OR_CAPACITY": ["CASE_ID"],
    "MART_DENIALS_REVCYCLE": ["CLAIM_LINE_SK"],
    "MART_STAFFING_QUALITY": ["DEPT_ID", "SHIFT_DATE"],
    "MART_FINANCIAL_PERFORMANCE": ["DEPT_ID", "FISCAL_YEAR", "FISCAL_PERIOD"],
}
CHECK_COLUMNS = ["TABLE_NAME", "CHECK_NAME", "RESULT", "EXPECTED_VALUE", "ACTUAL_VALUE", "DETAILS"]


def _row(table, check, result: Column, expected: str, actual: Column, details: str) -> Column:
    return F.struct(F.lit(table).alias("TABLE_NAME"), F.lit(check).alias("CHECK_NAME"), result.alias("RESULT"),
                    F.lit(expected).alias("EXPECTED_VALUE"), actual.cast("string").alias("ACTUAL_VALUE"),
                    F.lit(details).alias("DETAILS"))


def _band(check: str, v: Column) -> Column:
    pl, ph, wl, wh = RATE_BANDS[check]
    return F.when(v.between(pl, ph), "PASS").when(v.between(wl, wh), "WARN").otherwise("FAIL")


def _mart_checks(table: str, mart: DataFrame, pk: str, minimum: int, noun: str,
                 rate: tuple[str, Column] | None, fresh: tuple[str, str] | None, fresh_date) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("RC"), F.count_if(F.col(pk).isNull()).alias("NULLS")]
    if rate:
        aggs.append(rate[1].alias("RATE"))
    if fresh:
        aggs.append(F.max(fresh[0]).alias("NEWEST"))
    a = mart.agg(*aggs)
    rc, nulls = F.col("RC"), F.col("NULLS")
    rows = [
        _row(table, "ROW_COUNT_MIN", F.when(rc >= minimum, "PASS").otherwise("FAIL"), f">= {minimum}", rc,
             f"{table} should have at least {minimum} {noun}"),
        _row(table, "NULL_PK_CHECK", F.when(nulls == 0, "PASS").otherwise("FAIL"), "0", nulls,
             f"{pk} should never be NULL"),
    ]
    if rate:
        check = rate[0]
        pl, ph, _, _ = RATE_BANDS[check]
        rows.append(_row(table, check, _band(check, F.col("RATE")), f"{pl}-{ph}%",
                         F.concat(F.round("RATE", 2).cast("string"), F.lit("%")),
                         f"{check} should lie in {pl}-{ph}%"))
    if fresh:
        newest = F.col("NEWEST")
        rows.append(_row(table, "DATE_FRESHNESS", F.when(newest >= F.lit(fresh_date), "PASS").otherwise("WARN"),
                         f">= {fresh_date.isoformat()}", newest, f"Most recent {fresh[1]} should be recent"))
    return a.select(F.explode(F.array(*rows)).alias("c")).select("c.*")


def uniqueness_checks(marts: dict[str, DataFrame]) -> DataFrame:
    """Declared-key uniqueness (the DDL's PRIMARY KEY is not enforced)."""
    out = None
    for table, keys in DECLARED_KEYS.items():
        dup = (marts[table].groupBy(*keys).count().where(F.col("count") > 1)
               .agg(F.count(F.lit(1)).alias("D")))
        part = dup.select(F.lit(table).alias("TABLE_NAME"), F.lit("PK_UNIQUE").alias("CHECK_NAME"),
                          F.when(F.col("D") == 0, "PASS").otherwise("FAIL").alias("RESULT"),
                          F.lit("0").alias("EXPECTED_VALUE"), F.col("D").cast("string").alias("ACTUAL_VALUE"),
                          F.lit("duplicate keys on (" + ", ".join(keys) + ")").alias("DETAILS"))
        out = part if out is None else out.unionByName(part)
    return out


def data_quality_checks(t: Tables, with_uniqueness: bool = False) -> DataFrame:
    """D1-D13 (+D14): one row per check."""
    p = t.profile
    rm, lk, orc, dn = t.mart("mart_readmission_los"), t.mart("mart_patient_leakage"), t.mart("mart_or_capacity"), t.mart("mart_denials_revcycle")
    mins = p.row_minimums
    parts = [
        _mart_checks("MART_READMISSION_LOS", rm, "ENCOUNTER_ID", mins["MART_READMISSION_LOS"], "IP/OBS encounters",
                     ("METRIC_READMISSION_RATE", F.avg(C.flag01("READMIT_30_FLAG")) * 100),
                     ("ADMIT_DATE", "admit date"), p.freshness_date),
        _mart_checks("MART_PATIENT_LEAKAGE", lk, "REFERRAL_ID", mins["MART_PATIENT_LEAKAGE"], "referrals",
                     ("METRIC_LEAKAGE_RATE", F.avg(C.flag01("LEAKAGE_FLAG")) * 100),
                     ("REFERRAL_DATE", "referral date"), p.freshness_date),
        _mart_checks("MART_OR_CAPACITY", orc, "CASE_ID", mins["MART_OR_CAPACITY"], "cases",
                     ("METRIC_OR_UTILIZATION", C.exact_avg("UTILIZATION_PCT") * 100), None, p.freshness_date),
        _mart_checks("MART_DENIALS_REVCYCLE", dn, "CLAIM_LINE_SK", mins["MART_DENIALS_REVCYCLE"],
                     "denied claim lines", None, None, p.freshness_date),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    if with_uniqueness:
        out = out.unionByName(uniqueness_checks({
            "MART_PATIENT_LEAKAGE": lk, "MART_READMISSION_LOS": rm, "MART_OR_CAPACITY": orc,
            "MART_DENIALS_REVCYCLE": dn, "MART_STAFFING_QUALITY": t.mart("mart_staffing_quality"),
            "MART_FINANCIAL_PERFORMANCE": t.mart("mart_financial_performance")}))
    return out


def summary(checks: DataFrame) -> DataFrame:
    """Pass / fail / warn counts, JSON metadata and the summary text."""
    cnt = {r: F.count_if(F.col("RESULT") == r).cast("long") for r in ("PASS", "FAIL", "WARN")}
    return checks.agg(*[v.alias(f"{k}_COUNT") for k, v in cnt.items()]).select(
        "*",
        F.to_json(F.struct(F.col("PASS_COUNT").alias("pass"), F.col("FAIL_COUNT").alias("fail"),
                           F.col("WARN_COUNT").alias("warn"))).alias("METADATA"),
        F.concat(F.lit("DQ checks complete. PASS: "), F.col("PASS_COUNT").cast("string"),
                 F.lit(", FAIL: "), F.col("FAIL_COUNT").cast("string"),
                 F.lit(", WARN: "), F.col("WARN_COUNT").cast("string")).alias("SUMMARY"))


def latest_batch(check_log: DataFrame, window_minutes: int = 5) -> DataFrame:
    """Checks within ``window_minutes`` of the newest CHECK_TS, counted
    by result. The log is read once: it is counted by (time, result) first, and
    the newest time is a window over those few rows."""
    counts = check_log.groupBy("CHECK_TS", "RESULT").agg(F.count(F.lit(1)).alias("N"))
    newest = F.max("CHECK_TS").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    recent = counts.withColumn("_newest", newest).where(
        F.col("CHECK_TS") >= F.col("_newest") - F.expr(f"INTERVAL {window_minutes} MINUTES"))
    return recent.groupBy("RESULT").agg(F.sum("N").alias("N"))


# Minutes between a mart's checks and the newest ones in the registered D16 query.
CHECK_DELAY = {"MART_READMISSION_LOS": 0, "MART_PATIENT_LEAKAGE": 5, "MART_OR_CAPACITY": 6}


def _timed(checks: DataFrame, t: Tables) -> DataFrame:
    late = F.lit(60)
    for table, minutes in CHECK_DELAY.items():
        late = F.when(F.col("TABLE_NAME") == table, minutes).otherwise(late)
    newest = F.lit(t.profile.as_of.isoformat()).cast("timestamp_ntz")
    return checks.withColumn("CHECK_TS", F.timestamp_add("MINUTE", -late.cast("long"), newest))


QUERIES = {
    "d01_d13_data_quality_checks": lambda t: data_quality_checks(t),
    "d14_key_uniqueness": lambda t: uniqueness_checks({
        "MART_PATIENT_LEAKAGE": t.mart("mart_patient_leakage"), "MART_READMISSION_LOS": t.mart("mart_readmission_los"),
        "MART_OR_CAPACITY": t.mart("mart_or_capacity"), "MART_DENIALS_REVCYCLE": t.mart("mart_denials_revcycle"),
        "MART_STAFFING_QUALITY": t.mart("mart_staffing_quality"), "MART_FINANCIAL_PERFORMANCE": t.mart("mart_financial_performance")}),
    "d15_quality_summary": lambda t: summary(data_quality_checks(t)),
    "d16_latest_check_batch": lambda t: latest_batch(_timed(data_quality_checks(t), t)),
}
