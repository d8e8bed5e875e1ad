"""Threshold alerts R1-R7, re-aimed from scheduled e-mail alerts to a batch
rule job: a rules table joined (equi-join on METRIC) with one aggregate row
per metric; a rule fires when its comparison holds. A null aggregate never
fires. Each mart is aggregated once for all of its metrics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carelake.functions import compat as C

from carelake.sources.adapter import Tables

# Fixed values: (metric, alert name, default operator, default threshold).
# OR utilization and overtime are on a 0-1 scale while their defaults are
# percents; the formulas are kept as they are.
DEFAULT_RULES = [
    ("readmission_rate", "HIGH_READMISSION_RATE", "exceeds", 15.0),
    ("avg_los", "HIGH_AVG_LOS", "exceeds", 5.0),
    ("or_utilization", "LOW_OR_UTILIZATION", "falls_below", 60.0),
    ("overtime_pct", "HIGH_OVERTIME", "exceeds", 10.0),
    ("denial_rate", "HIGH_DENIAL_RATE", "exceeds", 8.0),
    ("operating_margin", "LOW_OPERATING_MARGIN", "falls_below", 5.0),
]


def metric_values(t: Tables) -> DataFrame:
    """(METRIC, VALUE): one aggregate per mart, stacked with UNION ALL."""
    rm = t.mart("mart_readmission_los").agg(
        (F.avg(F.col("READMIT_30_FLAG").cast("int")) * 100).alias("readmission_rate"),
        F.avg("LOS_DAYS").alias("avg_los"))
    orc = t.mart("mart_or_capacity").agg(C.exact_avg("UTILIZATION_PCT").alias("or_utilization"))
    st = t.mart("mart_staffing_quality").agg(C.exact_avg("OT_PCT").alias("overtime_pct"))
    dn = t.mart("mart_denials_revcycle").agg(
        (F.sum(F.when(F.col("CLAIM_STATUS") == "DENIED", 1).otherwise(0)) * 100.0
         / F.when(F.count(F.lit(1)) != 0, F.count(F.lit(1)))).cast("double").alias("denial_rate"))
    fn = t.mart("mart_financial_performance").agg((C.exact_avg("OPERATING_MARGIN") * 100).alias("operating_margin"))
    parts = [df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("METRIC"), F.col(c).cast("double").alias("VALUE"))
                                           for c in df.columns])).alias("x")).select("x.*") for df in (rm, orc, st, dn, fn)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def rules_frame(t: Tables, rules=None) -> DataFrame:
    return t.spark.createDataFrame(rules or DEFAULT_RULES, "METRIC string, ALERT_NAME string, OPERATOR string, THRESHOLD double")


def evaluate_alerts(t: Tables, rules=None) -> DataFrame:
    """Every rule with its current value and whether it fires."""
    j = rules_frame(t, rules).join(metric_values(t), "METRIC", "left")
    fired = (F.when(F.col("OPERATOR") == "exceeds", F.col("VALUE") > F.col("THRESHOLD"))
              .otherwise(F.col("VALUE") < F.col("THRESHOLD")))
    return j.select("ALERT_NAME", "METRIC", "OPERATOR", "THRESHOLD", F.round("VALUE", 6).alias("VALUE"),
                    F.coalesce(fired, F.lit(False)).alias("FIRED"))


def custom_condition(df: DataFrame, aggregate: Column, predicate) -> DataFrame:
    """A one-row global aggregate with a HAVING-style predicate: 0 or 1 row."""
    a = df.agg(aggregate.alias("VALUE"))
    return a.where(predicate(F.col("VALUE")))


QUERIES = {
    "r1_r6_alert_evaluation": evaluate_alerts,
    "r1_r6_alerts_fired": lambda t: evaluate_alerts(t).where(F.col("FIRED")),
    "r7_custom_condition": lambda t: custom_condition(
        t.mart("mart_denials_revcycle"), F.round(C.exact_sum("CHARGE_AMT") / F.lit(1e6), 2), lambda v: v > 1.0),
}
