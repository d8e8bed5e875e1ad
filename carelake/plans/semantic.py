"""Semantic layer X1-X7: logical tables, relationships, facts, dimensions and
metrics as a Python registry of Column builders, plus ``metric_query``.

``metric_query(metrics, dims, where)`` groups by the requested dimensions and
computes the requested metrics. A dimension of another table is reached only
through a declared many-to-one relationship (fact -> readmissions on
ENCOUNTER_ID), so the join cannot fan out. Metrics of different tables are
aggregated per table first and the small aggregates are then joined on the
shared dimensions (never fact-to-fact).
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carelake.functions import compat as C
from carelake.plans import models
from carelake.sources.adapter import Tables


@dataclass(frozen=True)
class LogicalTable:
    name: str
    source: Callable[[Tables], DataFrame]
    key: str | None


# Logical tables and their unique keys.
TABLES = {
    "readmissions": LogicalTable("readmissions", lambda t: t.mart("mart_readmission_los"), "ENCOUNTER_ID"),
    "leakage": LogicalTable("leakage", lambda t: t.mart("mart_patient_leakage"), "REFERRAL_ID"),
    "or_cases": LogicalTable("or_cases", lambda t: t.mart("mart_or_capacity"), "CASE_ID"),
    "denials": LogicalTable("denials", lambda t: t.mart("mart_denials_revcycle"), "CLAIM_LINE_SK"),
    "encounter_forecast": LogicalTable("encounter_forecast", models.pred_encounter_volume, None),
    "denial_anomalies": LogicalTable("denial_anomalies", models.pred_denial_anomalies, None),
}

# Relationships (many side, column) -> (one side, column).
RELATIONSHIPS = {
    ("denials", "ENCOUNTER_ID"): ("readmissions", "ENCOUNTER_ID"),
    ("or_cases", "ENCOUNTER_ID"): ("readmissions", "ENCOUNTER_ID"),
}

# Facts, semantic name -> physical column, per table (renamed where two
# tables would collide).
FACTS = {
    "readmissions": {n: n for n in ["LOS_DAYS", "EXPECTED_LOS", "LOS_VARIANCE", "LOS_INDEX", "DRG_WEIGHT",
                                    "TOTAL_CHARGES", "TOTAL_COST", "TOTAL_PAYMENTS", "COST_PER_DAY",
                                    "NET_REVENUE", "PATIENT_AGE", "HCC_SCORE"]},
    "leakage": {n: n for n in ["EXPECTED_REVENUE", "LOST_REVENUE", "DAYS_SINCE_REFERRAL"]},
    "or_cases": {n: n for n in ["DELAY_MINUTES", "CASE_MINUTES", "TURNOVER_MINUTES", "BLOCK_MINUTES",
                                "UTILIZATION_PCT"]},
    "denials": {n: n for n in ["CHARGE_AMT", "ALLOWED_AMT", "DAYS_TO_FILE", "ESTIMATED_RECOVERY"]},
    "encounter_forecast": {"FORECAST_COUNT": "FORECAST_COUNT", "FORECAST_LOWER": "LOWER_BOUND",
                           "FORECAST_UPPER": "UPPER_BOUND"},
    "denial_anomalies": {"ANOM_EXPECTED_COUNT": "EXPECTED_COUNT", "ANOM_ACTUAL_COUNT": "ACTUAL_COUNT",
                         "ANOM_ACTUAL_CHARGES": "ACTUAL_CHARGES", "ANOM_PERCENTILE": "PERCENTILE"},
}

# Dimensions, semantic name -> physical column.
DIMENSIONS = {
    "readmissions": {
        "ENCOUNTER_ID": "ENCOUNTER_ID", "READMIT_MRN": "MRN", "ENCOUNTER_TYPE": "ENCOUNTER_TYPE",
        "READMIT_PAYER_TYPE": "PAYER_TYPE", "READMIT_PAYER_NAME": "PAYER_NAME",
        "READMIT_FACILITY": "FACILITY_NAME", "DEPT_NAME": "DEPT_NAME", "READMIT_SPECIALTY": "SPECIALTY",
        "ATTENDING_PROVIDER": "ATTENDING_PROVIDER", "DRG_CODE": "DRG_CODE", "DRG_DESCRIPTION": "DRG_DESCRIPTION",
        "MDC_DESCRIPTION": "MDC_DESCRIPTION", "DISCHARGE_DISPOSITION": "DISCHARGE_DISPOSITION",
        "PATIENT_GENDER": "PATIENT_GENDER", "IS_LONG_STAY": "IS_LONG_STAY", "READMIT_30_FLAG": "READMIT_30_FLAG",
        "ADMIT_DATE": "ADMIT_DATE", "ADMIT_MONTH": "ADMIT_MONTH",
    },
    "leakage": {
        "REFERRAL_ID": "REFERRAL_ID", "REFERRING_PROVIDER": "REFERRING_PROVIDER",
        "REFERRING_SPECIALTY": "REFERRING_SPECIALTY", "REFERRED_TO_SPECIALTY": "REFERRED_TO_SPECIALTY",
        "LEAKAGE_FACILITY": "FACILITY_NAME", "LEAKAGE_PAYER_TYPE": "PATIENT_PAYER_TYPE",
        "REFERRAL_STATUS": "STATUS", "LEAKAGE_FLAG": "LEAKAGE_FLAG", "IS_HIGH_VALUE": "IS_HIGH_VALUE",
        "REFERRAL_DATE": "REFERRAL_DATE", "REFERRAL_MONTH": "REFERRAL_MONTH", "REFERRAL_QUARTER": "REFERRAL_QUARTER",
    },
    "or_cases": {
        "CASE_ID": "CASE_ID", "OR_FACILITY": "FACILITY_NAME", "SURGEON_NAME": "SURGEON_NAME",
        "OR_SPECIALTY": "SPECIALTY", "BLOCK_NAME": "BLOCK_NAME", "CASE_DAY_OF_WEEK": "CASE_DAY_OF_WEEK",
        "CASE_CLASS": "CASE_CLASS", "ASA_CLASS": "ASA_CLASS", "FIRST_CASE_ON_TIME": "FIRST_CASE_ON_TIME",
        "IS_UNDERUTILIZED": "IS_UNDERUTILIZED", "IS_OVERTIME": "IS_OVERTIME", "PRIME_TIME_FLAG": "PRIME_TIME_FLAG",
        "CASE_DATE": "CASE_DATE", "CASE_MONTH": "CASE_MONTH",
    },
    "denials": {
        "CLAIM_LINE_SK": "CLAIM_LINE_SK", "CLAIM_ID": "CLAIM_ID", "DENIAL_ENCOUNTER_ID": "ENCOUNTER_ID",
        "DENIAL_PAYER_NAME": "PAYER_NAME", "DENIAL_PAYER_TYPE": "PAYER_TYPE", "DENIAL_CATEGORY": "DENIAL_CATEGORY",
        "DENIAL_REASON": "DENIAL_REASON", "CLAIM_STATUS": "CLAIM_STATUS", "IS_APPEALED": "IS_APPEALED",
        "APPEAL_OUTCOME": "APPEAL_OUTCOME", "CPT_CATEGORY": "CPT_CATEGORY", "IS_TIMELY_FILED": "IS_TIMELY_FILED",
        "SERVICE_DATE": "SERVICE_DATE", "SERVICE_MONTH": "SERVICE_MONTH",
    },
    "encounter_forecast": {"FORECAST_ENCOUNTER_TYPE": "ENCOUNTER_TYPE", "FORECAST_DATE": "FORECAST_DATE"},
    "denial_anomalies": {"ANOMALY_CATEGORY": "DENIAL_CATEGORY", "ANOMALY_DATE": "TS", "IS_ANOMALY": "IS_ANOMALY"},
}


def _pct(flag: str) -> Column:
    return F.avg(C.flag01(flag)) * 100


# Metrics, name -> (table, aggregate builder).
METRICS: dict[str, tuple[str, Callable[[], Column]]] = {
    "READMISSION_RATE": ("readmissions", lambda: _pct("READMIT_30_FLAG")),
    "AVG_LOS_INDEX": ("readmissions", lambda: C.exact_avg("LOS_INDEX")),
    "LONG_STAY_PCT": ("readmissions", lambda: _pct("IS_LONG_STAY")),
    "ENCOUNTER_COUNT": ("readmissions", lambda: F.count("ENCOUNTER_ID")),
    "AVG_COST_PER_DAY": ("readmissions", lambda: C.exact_avg("COST_PER_DAY")),
    "TOTAL_NET_REVENUE": ("readmissions", lambda: C.exact_sum("NET_REVENUE")),
    "LEAKAGE_RATE": ("leakage", lambda: _pct("LEAKAGE_FLAG")),
    "TOTAL_LOST_REVENUE": ("leakage", lambda: C.exact_sum("LOST_REVENUE")),
    "REFERRAL_COUNT": ("leakage", lambda: F.count("REFERRAL_ID")),
    "HIGH_VALUE_LEAK_COUNT": ("leakage", lambda: F.sum(F.when(F.col("LEAKAGE_FLAG") & F.col("IS_HIGH_VALUE"), 1)
                                                       .otherwise(0)).cast("long")),
    "AVG_UTILIZATION": ("or_cases", lambda: C.exact_avg("UTILIZATION_PCT") * 100),
    "FIRST_CASE_ON_TIME_PCT": ("or_cases", lambda: _pct("FIRST_CASE_ON_TIME")),
    "AVG_DELAY_MINUTES": ("or_cases", lambda: F.avg("DELAY_MINUTES")),
    "CASE_COUNT": ("or_cases", lambda: F.count("CASE_ID")),
    "TOTAL_DENIED_CHARGES": ("denials", lambda: C.exact_sum("CHARGE_AMT")),
    "APPEAL_RATE": ("denials", lambda: _pct("IS_APPEALED")),
    "TIMELY_FILING_PCT": ("denials", lambda: _pct("IS_TIMELY_FILED")),
    "DENIED_CLAIM_COUNT": ("denials", lambda: F.count("CLAIM_LINE_SK")),
}


def _resolve_dim(name: str) -> tuple[str, str, str]:
    """'table.SEMANTIC' or unique 'SEMANTIC' -> (table, semantic, physical)."""
    if "." in name:
        tb, sem = name.split(".", 1)
        return tb, sem, DIMENSIONS[tb][sem]
    hits = [(tb, name, d[name]) for tb, d in DIMENSIONS.items() if name in d]
    if len(hits) != 1:
        raise KeyError(f"dimension {name!r} is {'ambiguous' if hits else 'unknown'}")
    return hits[0]


def _source_for(t: Tables, base: str, dim_tables: set[str]) -> DataFrame:
    """Base table, joined (many-to-one) to each other table its dims need."""
    df = TABLES[base].source(t).alias(base)
    for other in sorted(dim_tables - {base}):
        rel = next(((c, oc) for (tb, c), (ot, oc) in RELATIONSHIPS.items() if tb == base and ot == other), None)
        if rel is None:
            raise ValueError(f"no relationship from {base} to {other}")
        c, oc = rel
        one = TABLES[other].source(t).alias(other)
        df = df.join(one, F.col(f"{base}.{c}") == F.col(f"{other}.{oc}"), "left")
    return df


def fact_query(t: Tables, table: str, facts: list[str] | None = None, dims: list[str] | None = None,
               where: Column | None = None) -> DataFrame:
    """Rows of a logical table under the semantic names of its facts and
    dimensions (all facts, no dimensions unless named)."""
    known, by = FACTS[table], DIMENSIONS[table]
    src = TABLES[table].source(t)
    if where is not None:
        src = src.where(where)
    return src.select(*[F.col(by[d]).alias(d) for d in dims or []],
                      *[F.col(known[f]).alias(f) for f in (known if facts is None else facts)])


def metric_query(t: Tables, metrics: list[str], dims: list[str], where: Column | None = None,
                 verify_keys: bool = False) -> DataFrame:
    """X6."""
    resolved = [_resolve_dim(d) for d in dims]
    by_table: dict[str, list[str]] = {}
    for m in metrics:
        by_table.setdefault(METRICS[m][0], []).append(m)
    parts = []
    for base, ms in by_table.items():
        dim_tables = {tb for tb, _, _ in resolved}
        src = _source_for(t, base, dim_tables)
        if verify_keys:
            for other in dim_tables - {base}:
                key = TABLES[other].key
                dup = TABLES[other].source(t).groupBy(key).count().where(F.col("count") > 1).limit(1).count()
                if dup:
                    raise ValueError(f"{other}.{key} is not unique: the join would fan out")
        if where is not None:
            src = src.where(where)
        keys = [F.col(f"{tb}.{phys}").alias(sem) for tb, sem, phys in resolved]
        aggs = [METRICS[m][1]().alias(m) for m in ms]
        parts.append(src.groupBy(*keys).agg(*aggs) if keys else src.agg(*aggs))
    out = parts[0]
    names = [sem for _, sem, _ in resolved]
    for p in parts[1:]:
        if not names:
            out = out.join(p)  # one row each
            continue
        # the null group of one base is the null group of the other
        p = p.withColumnsRenamed({n: f"_{n}" for n in names})
        same = functools.reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"_{n}")) for n in names])
        j = out.join(p, same, "full")
        out = j.select(*[F.coalesce(n, f"_{n}").alias(n) for n in names],
                       *[c for c in j.columns if c not in names and c not in [f"_{n}" for n in names]])
    return out


QUERIES = {
    "x6_denials_and_cases_by_readmit_payer": lambda t: metric_query(
        t, ["TOTAL_DENIED_CHARGES", "DENIED_CLAIM_COUNT", "CASE_COUNT"], ["readmissions.READMIT_PAYER_TYPE"]).select(
        "READMIT_PAYER_TYPE", F.round("TOTAL_DENIED_CHARGES", 2).alias("TOTAL_DENIED_CHARGES"),
        "DENIED_CLAIM_COUNT", "CASE_COUNT"),
    "x6_cost_and_revenue_by_payer": lambda t: metric_query(
        t, ["AVG_COST_PER_DAY", "TOTAL_NET_REVENUE"], ["readmissions.READMIT_PAYER_TYPE"]).select(
        "READMIT_PAYER_TYPE", F.round("AVG_COST_PER_DAY", 4).alias("AVG_COST_PER_DAY"),
        F.round("TOTAL_NET_REVENUE", 2).alias("TOTAL_NET_REVENUE")),
    "x3_or_case_facts": lambda t: fact_query(t, "or_cases", dims=["CASE_ID", "OR_FACILITY"]),
    "x3_anomaly_facts": lambda t: fact_query(t, "denial_anomalies", dims=["ANOMALY_CATEGORY", "ANOMALY_DATE"]),
    "x6_timely_filing": lambda t: metric_query(t, ["TIMELY_FILING_PCT", "DENIED_CLAIM_COUNT"], []).select(
        F.round("TIMELY_FILING_PCT", 4).alias("TIMELY_FILING_PCT"), "DENIED_CLAIM_COUNT"),
    "x6_readmission_metrics_by_facility": lambda t: metric_query(
        t, ["READMISSION_RATE", "AVG_LOS_INDEX", "LONG_STAY_PCT", "ENCOUNTER_COUNT"], ["READMIT_FACILITY"]).select(
        "READMIT_FACILITY", F.round("READMISSION_RATE", 4).alias("READMISSION_RATE"),
        F.round("AVG_LOS_INDEX", 4).alias("AVG_LOS_INDEX"), F.round("LONG_STAY_PCT", 4).alias("LONG_STAY_PCT"),
        "ENCOUNTER_COUNT"),
    "x6_denied_charges_by_readmit_payer": lambda t: metric_query(
        t, ["TOTAL_DENIED_CHARGES", "DENIED_CLAIM_COUNT", "APPEAL_RATE"], ["readmissions.READMIT_PAYER_TYPE"]).select(
        "READMIT_PAYER_TYPE", F.round("TOTAL_DENIED_CHARGES", 2).alias("TOTAL_DENIED_CHARGES"),
        "DENIED_CLAIM_COUNT", F.round("APPEAL_RATE", 4).alias("APPEAL_RATE")),
    "x6_leakage_metrics_by_specialty": lambda t: metric_query(
        t, ["LEAKAGE_RATE", "TOTAL_LOST_REVENUE", "REFERRAL_COUNT", "HIGH_VALUE_LEAK_COUNT"],
        ["REFERRING_SPECIALTY"]).select(
        "REFERRING_SPECIALTY", F.round("LEAKAGE_RATE", 4).alias("LEAKAGE_RATE"),
        F.round("TOTAL_LOST_REVENUE", 2).alias("TOTAL_LOST_REVENUE"), "REFERRAL_COUNT", "HIGH_VALUE_LEAK_COUNT"),
    "x6_or_metrics_by_block": lambda t: metric_query(
        t, ["AVG_UTILIZATION", "FIRST_CASE_ON_TIME_PCT", "AVG_DELAY_MINUTES", "CASE_COUNT"], ["BLOCK_NAME"]).select(
        "BLOCK_NAME", F.round("AVG_UTILIZATION", 4).alias("AVG_UTILIZATION"),
        F.round("FIRST_CASE_ON_TIME_PCT", 4).alias("FIRST_CASE_ON_TIME_PCT"),
        F.round("AVG_DELAY_MINUTES", 4).alias("AVG_DELAY_MINUTES"), "CASE_COUNT"),
}
