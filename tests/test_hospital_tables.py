"""The marts run over the hospital's own table schemas, from Parquet and CSV."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carelake.plans.marts import MARTS
from carelake.sources.hospital import SCHEMAS, HospitalTables, schema

D = dt.date


def _value(f: T.StructField, i: int):
    kind = f.dataType
    if isinstance(kind, T.StringType):
        return f"{f.name[:4]}-{i % 3}"
    if isinstance(kind, T.BooleanType):
        return i % 2 == 0
    if isinstance(kind, T.DateType):
        return D(2024, 1, 1) + dt.timedelta(days=i)
    if isinstance(kind, T.TimestampNTZType):
        return dt.datetime(2024, 1, 1, 8) + dt.timedelta(hours=i)
    return float(i) + 0.5 if isinstance(kind, T.DoubleType) else i


FIXED = {
    "ENCOUNTER_TYPE": "INPATIENT", "DEPT_TYPE": "ICU", "CATEGORY": "REVENUE", "DENIED_FLAG": True, "CLAIM_STATUS": "DENIED",
    "FISCAL_YEAR": 2024, "FISCAL_PERIOD": 1,
}


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_marts_over_the_hospital_tables(spark, tmp_path, fmt):
    for name in SCHEMAS:
        s = schema(name)
        rows = [tuple(FIXED.get(f.name, _value(f, i)) for f in s.fields) for i in range(1, 7)]
        w = spark.createDataFrame(rows, s).coalesce(1).write
        (w.option("header", True) if fmt == "csv" else w).format(fmt).save(f"{tmp_path}/{name}")
    t = HospitalTables(spark, str(tmp_path), fmt=fmt)
    n = {name: build(t).count() for name, build in MARTS.items()}
    assert n["mart_readmission_los"] >= 6 and n["mart_or_capacity"] >= 6 and n["mart_denials_revcycle"] == 6
    assert n["mart_patient_leakage"] >= 6 and n["mart_staffing_quality"] > 0 and n["mart_financial_performance"] > 0
    for name in SCHEMAS:
        assert {r.NULLS for r in t.missing_values(name).collect()} == {0}
    assert t.get("fct_adt_event").count() == t.get("fct_bed_status").count() == 6


def test_census_counts_an_encounter_that_is_loaded_twice_once(spark, tmp_path):
    s = schema("fct_encounter")
    base = {f.name: _value(f, 1) for f in s.fields} | {"ENCOUNTER_TYPE": "INPATIENT", "ADMIT_DATE": D(2024, 1, 1), "DEPT_ID": "D"}
    rows = [tuple((base | x)[f.name] for f in s.fields) for x in (
        {"ENCOUNTER_ID": "E1", "DISCHARGE_DATE": D(2024, 1, 3)}, {"ENCOUNTER_ID": "E1", "DISCHARGE_DATE": D(2024, 1, 3)},
        {"ENCOUNTER_ID": "E2", "DISCHARGE_DATE": D(2024, 1, 2)})]
    spark.createDataFrame(rows, s).write.parquet(f"{tmp_path}/fct_encounter")
    from carelake.plans.marts import census_daily
    got = {r.CENSUS_DATE: (r.PATIENT_CENSUS, r.ADMITS) for r in census_daily(HospitalTables(spark, str(tmp_path))).collect()}
    assert got == {D(2024, 1, 1): (2, 2), D(2024, 1, 2): (2, 0), D(2024, 1, 3): (1, 0)}


def test_required_columns_are_reported(spark, tmp_path):
    df = spark.range(2).select(F.lit("FAC-1").alias("FACILITY_ID"), F.lit(None).cast("string").alias("FACILITY_NAME"))
    df.write.parquet(f"{tmp_path}/dim_facility")
    nulls = {r.COLUMN_NAME: r.NULLS for r in HospitalTables(spark, str(tmp_path)).missing_values("dim_facility").collect()}
    assert nulls["FACILITY_ID"] == 0 and nulls["FACILITY_NAME"] == 2
