"""Governance: masking (G1-G7), row access (G8-G10), tags (G11), role-scoped
patient preview (G12).

``secure(df, role, ...)`` is a DataFrame -> DataFrame transform: masks fold
to built-in expressions for the session's role set, and row access is a
left-semi join against the role map (a table of roles x departments, i.e.
dimension-sized; AQE broadcasts it when small).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carelake.functions import masking as MK
from carelake.sources.adapter import Tables

# The finance role's explicit grants.
FINANCE_DEPTS = ["DEPT-004", "DEPT-005", "DEPT-011", "DEPT-019", "DEPT-024"]
FINANCE_FACILITIES = ["FAC-001", "FAC-002", "FAC-003"]
# Roles granted every department / facility by the role-map build.
ALL_SCOPE_ROLES = [MK.CLINICIAN, MK.ANALYST, MK.EXEC]
# Which key column carries the row-access policy, per fact table.
ROW_POLICIES = {
    "fct_encounter": "DEPT_ID",
    "fct_adt_event": "DEPT_ID",
    "fct_labor_hour": "DEPT_ID",
    "fct_bed_status": "DEPT_ID",
    "fct_or_case": "FACILITY_ID",
}
UNRESTRICTED = (MK.ADMIN, MK.ENGINEER)


def role_dept_access(t: Tables) -> DataFrame:
    """(ROLE_NAME, DEPT_ID). Insert-select per all-scope role, plus the
    finance literals. The fan-out is an explode of a fixed role list."""
    spark = t.spark
    every = t.get("dim_department").select(
        F.explode(F.array(*[F.lit(r) for r in ALL_SCOPE_ROLES])).alias("ROLE_NAME"), "DEPT_ID")
    fin = spark.createDataFrame([(MK.FINANCE, d) for d in FINANCE_DEPTS], "ROLE_NAME string, DEPT_ID string")
    return every.unionByName(fin)


def role_facility_access(t: Tables) -> DataFrame:
    spark = t.spark
    every = t.get("dim_facility").select(
        F.explode(F.array(*[F.lit(r) for r in ALL_SCOPE_ROLES])).alias("ROLE_NAME"), "FACILITY_ID")
    fin = spark.createDataFrame([(MK.FINANCE, f) for f in FINANCE_FACILITIES], "ROLE_NAME string, FACILITY_ID string")
    return every.unionByName(fin)


def row_access(df: DataFrame, key: str, role: str, access: DataFrame) -> DataFrame:
    """Keep rows whose key is mapped to any role in the session."""
    roles = MK.roles_in_session(role)
    if any(r in roles for r in UNRESTRICTED):
        return df
    allowed = access.where(F.col("ROLE_NAME").isin(sorted(roles))).select(F.col(key).alias("_k")).distinct()
    return df.join(allowed, df[key] == allowed["_k"], "left_semi")


def mask_columns(df: DataFrame, role: str) -> DataFrame:
    """Apply the column masks to whichever protected columns ``df`` has."""
    roles = MK.roles_in_session(role)
    return df.select(*[(MK.COLUMN_MASKS[c](F.col(c), roles) if c in MK.COLUMN_MASKS else F.col(c)).alias(c)
                       for c in df.columns])


def secure(df: DataFrame, role: str, t: Tables, table: str | None = None) -> DataFrame:
    """Role-scoped view of a table: row access for the policy-bearing facts,
    then column masks."""
    key = ROW_POLICIES.get(table or "")
    if key == "DEPT_ID":
        df = row_access(df, key, role, role_dept_access(t))
    elif key == "FACILITY_ID":
        df = row_access(df, key, role, role_facility_access(t))
    return mask_columns(df, role)


# G11, fixed values: the tag vocabulary, the patient columns' tags and the tables' tags.
TAG_VALUES = {
    "DATA_CLASSIFICATION": ["PHI", "PII", "FINANCIAL", "RESTRICTED", "INTERNAL", "PUBLIC"],
    "PII_TYPE": ["SSN", "NAME", "DOB", "ADDRESS", "PHONE", "EMAIL", "MRN"],
    "DATA_DOMAIN": ["CLINICAL", "CLAIMS", "FINANCIAL", "DEMOGRAPHIC", "OPERATIONS", "WORKFORCE", "REFERENCE"],
    "RETENTION_POLICY": ["30_DAYS", "90_DAYS", "1_YEAR", "3_YEARS", "7_YEARS", "INDEFINITE"],
}
PATIENT_TAGS = {
    "SSN": {"DATA_CLASSIFICATION": "PHI", "PII_TYPE": "SSN"},
    "DOB": {"DATA_CLASSIFICATION": "PHI", "PII_TYPE": "DOB"},
    "FIRST_NAME": {"DATA_CLASSIFICATION": "PII", "PII_TYPE": "NAME"},
    "LAST_NAME": {"DATA_CLASSIFICATION": "PII", "PII_TYPE": "NAME"},
    "MRN": {"DATA_CLASSIFICATION": "PHI", "PII_TYPE": "MRN"},
    "PHONE": {"DATA_CLASSIFICATION": "PII", "PII_TYPE": "PHONE"},
    "EMAIL": {"DATA_CLASSIFICATION": "PII", "PII_TYPE": "EMAIL"},
    "ADDRESS": {"DATA_CLASSIFICATION": "PII", "PII_TYPE": "ADDRESS"},
}
TABLE_TAGS = {
    "DIM_PATIENT": {"DATA_DOMAIN": "DEMOGRAPHIC", "RETENTION_POLICY": "7_YEARS"},
    "FCT_ENCOUNTER": {"DATA_DOMAIN": "CLINICAL", "RETENTION_POLICY": "7_YEARS"},
    "FCT_CLAIM_LINE": {"DATA_DOMAIN": "CLAIMS", "RETENTION_POLICY": "7_YEARS"},
    "FCT_REMITTANCE": {"DATA_DOMAIN": "FINANCIAL", "RETENTION_POLICY": "7_YEARS"},
    "FCT_LABOR_HOUR": {"DATA_DOMAIN": "WORKFORCE", "RETENTION_POLICY": "3_YEARS"},
    "FCT_SUPPLY_USAGE": {"DATA_DOMAIN": "OPERATIONS", "RETENTION_POLICY": "3_YEARS"},
}


def _check_tags(tags: dict[str, str]) -> None:
    for k, v in tags.items():
        if v not in TAG_VALUES.get(k, []):
            raise ValueError(f"{v!r} is not an allowed value of tag {k}")


def tag_columns(df: DataFrame, tags: dict[str, dict[str, str]]) -> DataFrame:
    """``df`` with the tags of its columns as field metadata; tags of columns it lacks are left out."""
    for kv in tags.values():
        _check_tags(kv)
    return df.select(*[F.col(c).alias(c, metadata={"tags": tags[c]}) if c in tags else F.col(c) for c in df.columns])


def tag_report(df: DataFrame, table: str) -> DataFrame:
    """TABLE_NAME, COLUMN_NAME (null: the table itself), TAG, VALUE: the table's tags and those of its
    columns. Reads the schema only."""
    own = TABLE_TAGS.get(table.upper(), {})
    _check_tags(own)
    rows = [(table, None, k, v) for k, v in own.items()]
    rows += [(table, f.name, k, v) for f in df.schema.fields for k, v in (f.metadata or {}).get("tags", {}).items()]
    return df.sparkSession.createDataFrame(rows, TAG_REPORT_SCHEMA)


TAG_REPORT_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("TABLE_NAME", "COLUMN_NAME", "TAG", "VALUE")])


# ---------------------------------------------------------------- registered queries
PREVIEW_COLUMNS = ["MRN", "FIRST_NAME", "LAST_NAME", "DOB", "SSN", "PHONE", "EMAIL", "GENDER", "HCC_SCORE"]


def phi_demo_patients(t: Tables, role: str) -> DataFrame:
    """Masked preview of 25 active patients."""
    p = t.get("dim_patient").where(F.col("IS_ACTIVE") == True)  # noqa: E712
    top = p.orderBy(F.asc_nulls_last("PATIENT_SK")).limit(25)
    return mask_columns(top, role).select(*PREVIEW_COLUMNS)


def visible_rows_by_role(t: Tables, table: str) -> DataFrame:
    """Rows each role sees in a policy-bearing fact (G8/G9 check): the fact is
    counted once per key, the counts meet the roles that see the key, and
    each role adds up its keys."""
    key = ROW_POLICIES[table]
    access = role_dept_access(t) if key == "DEPT_ID" else role_facility_access(t)
    granted = [(r, g) for r in MK.ROLES for g in sorted(MK.roles_in_session(r))]
    sessions = F.broadcast(t.spark.createDataFrame(granted, "SESSION_ROLE string, ROLE_NAME string"))  # fixed list
    sees = (access.join(sessions, "ROLE_NAME").groupBy(F.col(key).alias("_k"))
                  .agg(F.collect_set("SESSION_ROLE").alias("SEEN_BY")))  # at most every role
    always = F.array(*[F.lit(r) for r in MK.ROLES if any(u in MK.roles_in_session(r) for u in UNRESTRICTED)])
    counts = t.get(table).groupBy(key).agg(F.count(F.lit(1)).alias("N"))
    seen = counts.join(sees, F.col(key) == F.col("_k"), "left").select(
        F.explode(F.array_union(F.coalesce("SEEN_BY", F.array().cast("array<string>")), always)).alias("ROLE_NAME"), "N")
    totals = seen.groupBy("ROLE_NAME").agg(F.sum("N").alias("N"))
    roles = t.spark.createDataFrame([(r,) for r in MK.ROLES], "ROLE_NAME string")
    return roles.join(totals, "ROLE_NAME", "left").select("ROLE_NAME", F.coalesce("N", F.lit(0)).alias("VISIBLE_ROWS"))


def _role_query(role):
    def q(t):
        return phi_demo_patients(t, role)
    return q


QUERIES = {f"q59_phi_demo_patients_{r.lower()}": _role_query(r) for r in MK.ROLES}
QUERIES["g08_encounter_rows_by_role"] = lambda t: visible_rows_by_role(t, "fct_encounter")
QUERIES["g08_labor_rows_by_role"] = lambda t: visible_rows_by_role(t, "fct_labor_hour")
QUERIES["g09_or_case_rows_by_role"] = lambda t: visible_rows_by_role(t, "fct_or_case")
QUERIES["g10_role_dept_access"] = role_dept_access
QUERIES["g10_role_facility_access"] = role_facility_access
