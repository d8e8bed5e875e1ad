"""The hospital's own tables: schemas and a loader.

``HospitalTables`` serves the same marts, queries and checks as the test-data
adapter, from a folder of Parquet tables (or CSV files with a header) named
like the tables below. Columns are read by name with the declared types, so
scans stay pruned and a missing optional column is null; a required column
that is missing or null fails the load check, not the query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carelake.config import REFERENCE, Profile
from carelake.sources.adapter import Tables

# The tables' columns in order. "not null" marks required ones.
SCHEMAS = {
    "dim_date": """DATE_KEY int not null, FULL_DATE date not null, YEAR int not null, QUARTER int not null, MONTH int not null,
        MONTH_NAME string not null, DAY_OF_MONTH int not null, DAY_OF_WEEK int not null, DAY_NAME string not null,
        WEEK_OF_YEAR int not null, FISCAL_YEAR int not null, FISCAL_QUARTER int not null, IS_WEEKEND boolean not null,
        IS_HOLIDAY boolean not null, HOLIDAY_NAME string""",
    "dim_facility": """FACILITY_SK long not null, FACILITY_ID string not null, FACILITY_NAME string not null,
        FACILITY_TYPE string not null, ADDRESS string, CITY string, STATE string, ZIP string, LATITUDE double, LONGITUDE double,
        BED_COUNT int, OR_ROOM_COUNT int, IS_OWNED boolean not null, OPENED_DATE date, _LOADED_AT timestamp_ntz""",
    "dim_department": """DEPT_SK long not null, DEPT_ID string not null, DEPT_NAME string not null, DEPT_TYPE string not null,
        FACILITY_ID string not null, COST_CENTER string, BED_COUNT int, TARGET_OCCUPANCY double, MANAGER_NAME string,
        IS_ACTIVE boolean not null, _LOADED_AT timestamp_ntz""",
    "dim_payer": """PAYER_SK long not null, PAYER_ID string not null, PAYER_NAME string not null, PAYER_TYPE string not null,
        PLAN_NAME string, IS_IN_NETWORK boolean not null, CONTRACT_RATE_PCT double, TIMELY_FILING_DAYS int,
        _LOADED_AT timestamp_ntz""",
    "dim_patient": """PATIENT_SK long not null, MRN string not null, FIRST_NAME string not null, LAST_NAME string not null,
        DOB date not null, GENDER string not null, RACE string, ETHNICITY string, LANGUAGE string, MARITAL_STATUS string,
        SSN string, PHONE string, EMAIL string, ADDRESS string, CITY string, STATE string, ZIP string, COUNTY string,
        PRIMARY_PAYER_ID string, HCC_SCORE double, SDOH_RISK_INDEX double, IS_ACTIVE boolean not null, DEATH_DATE date,
        _LOADED_AT timestamp_ntz""",
    "dim_provider": """PROVIDER_SK long not null, NPI string not null, FIRST_NAME string not null, LAST_NAME string not null,
        CREDENTIAL string, SPECIALTY string not null, DEPT_ID string, FACILITY_ID string, IS_EMPLOYED boolean not null,
        IS_ACTIVE boolean not null, HIRE_DATE date, FTE double, _LOADED_AT timestamp_ntz""",
    "dim_diagnosis": """DX_SK long not null, ICD10_CODE string not null, DESCRIPTION string not null, CHAPTER string,
        CHAPTER_DESC string, CATEGORY string, IS_CHRONIC boolean not null, HCC_FLAG boolean not null, HCC_CATEGORY string,
        _LOADED_AT timestamp_ntz""",
    "dim_procedure": """PROC_SK long not null, CPT_CODE string not null, DESCRIPTION string not null, CATEGORY string,
        SUBCATEGORY string, RVU_WORK double, RVU_PE double, RVU_MALPRACTICE double, RVU_TOTAL double, _LOADED_AT timestamp_ntz""",
    "dim_drg": """DRG_SK long not null, DRG_CODE string not null, DESCRIPTION string not null, MDC string, MDC_DESCRIPTION string,
        TYPE string, WEIGHT double not null, GEOMETRIC_LOS double, ARITHMETIC_LOS double, _LOADED_AT timestamp_ntz""",
    "dim_medication": """MED_SK long not null, RXNORM_CODE string not null, GENERIC_NAME string not null, BRAND_NAME string,
        DRUG_CLASS string, THERAPEUTIC_AREA string, ROUTE string, IS_CONTROLLED boolean not null, DEA_SCHEDULE string,
        UNIT_COST double, IS_ON_SHORTAGE boolean not null, _LOADED_AT timestamp_ntz""",
    "fct_encounter": """ENCOUNTER_SK long not null, ENCOUNTER_ID string not null, PATIENT_SK long not null, PROVIDER_SK long,
        FACILITY_ID string not null, DEPT_ID string not null, PAYER_SK long, DRG_SK long, PRIMARY_DX_SK long,
        ENCOUNTER_TYPE string not null, ADMIT_DATE date not null, ADMIT_DATE_KEY int not null, DISCHARGE_DATE date,
        DISCHARGE_DATE_KEY int, DISCHARGE_DISPOSITION string, LOS_DAYS double, EXPECTED_LOS double, TOTAL_CHARGES double,
        TOTAL_COST double, TOTAL_PAYMENTS double, NET_REVENUE double, READMIT_30_FLAG boolean, ED_REVISIT_72H boolean,
        _LOADED_AT timestamp_ntz""",
    "fct_adt_event": """ADT_EVENT_SK long not null, ENCOUNTER_ID string not null, PATIENT_SK long not null,
        FACILITY_ID string not null, DEPT_ID string not null, BED_ID string, EVENT_TYPE string not null,
        EVENT_DATETIME timestamp_ntz not null, EVENT_DATE_KEY int not null, PRIOR_DEPT_ID string, BED_HOURS double,
        TRANSFER_FLAG boolean, _LOADED_AT timestamp_ntz""",
    "fct_or_case": """OR_CASE_SK long not null, CASE_ID string not null, ENCOUNTER_ID string, PATIENT_SK long not null,
        SURGEON_SK long not null, FACILITY_ID string not null, OR_ROOM_ID string not null, PRIMARY_CPT_SK long,
        CASE_DATE date not null, CASE_DATE_KEY int not null, SCHEDULED_START timestamp_ntz not null, ACTUAL_START timestamp_ntz,
        ACTUAL_END timestamp_ntz, BLOCK_NAME string, BLOCK_MINUTES double, CASE_MINUTES double, TURNOVER_MINUTES double,
        FIRST_CASE_ON_TIME boolean, PRIME_TIME_FLAG boolean, CASE_CLASS string, ASA_CLASS string, _LOADED_AT timestamp_ntz""",
    "fct_claim_line": """CLAIM_LINE_SK long not null, CLAIM_ID string not null, LINE_NUMBER int not null, ENCOUNTER_ID string,
        PATIENT_SK long not null, PAYER_SK long not null, PROVIDER_SK long, DX_SK long, PROC_SK long, SERVICE_DATE date not null,
        SERVICE_DATE_KEY int not null, PLACE_OF_SERVICE string, CHARGE_AMT double not null, ALLOWED_AMT double, PAID_AMT double,
        PATIENT_RESP_AMT double, DENIED_FLAG boolean, DENIAL_REASON string, CLAIM_STATUS string, FILING_DATE date,
        _LOADED_AT timestamp_ntz""",
    "fct_remittance": """REMIT_LINE_SK long not null, REMIT_ID string not null, CLAIM_ID string not null, LINE_NUMBER int not null,
        PAYER_SK long not null, PATIENT_SK long not null, SERVICE_DATE date not null, SERVICE_DATE_KEY int not null,
        PAID_AMT double not null, ALLOWED_AMT double, ADJUSTMENT_AMT double, CARC_CODE string, CARC_GROUP string, RARC_CODE string,
        REMIT_DATE date, CHECK_NUMBER string, _LOADED_AT timestamp_ntz""",
    "fct_referral": """REFERRAL_SK long not null, REFERRAL_ID string not null, PATIENT_SK long not null,
        REFERRING_PROVIDER_SK long not null, REFERRED_TO_NPI string not null, REFERRED_TO_SPECIALTY string,
        REFERRAL_DATE date not null, REFERRAL_DATE_KEY int not null, STATUS string not null, LEAKAGE_FLAG boolean,
        EXPECTED_REVENUE double, FACILITY_ID string, _LOADED_AT timestamp_ntz""",
    "fct_care_gap": """CARE_GAP_SK long not null, PATIENT_SK long not null, MEASURE_ID string not null, MEASURE_NAME string not null,
        MEASURE_YEAR int not null, IS_ELIGIBLE boolean not null, IS_OPEN boolean not null, DUE_DATE date, LAST_SERVICE_DATE date,
        LAST_RESULT string, RISK_PRIORITY string, OUTREACH_STATUS string, _LOADED_AT timestamp_ntz""",
    "fct_ehr_usage": """EHR_USAGE_SK long not null, PROVIDER_SK long not null, USAGE_DATE date not null, USAGE_DATE_KEY int not null,
        TOTAL_EHR_MIN double, CHART_REVIEW_MIN double, DOCUMENTATION_MIN double, INBOX_MIN double, ORDER_ENTRY_MIN double,
        PAJAMA_TIME_MIN double, AFTER_HOURS_FLAG boolean, WEEKEND_FLAG boolean, ENCOUNTERS_CLOSED int, TIME_TO_CLOSE_HRS double,
        _LOADED_AT timestamp_ntz""",
    "fct_labor_hour": """LABOR_HOUR_SK long not null, EMPLOYEE_ID string not null, EMPLOYEE_NAME string, JOB_TITLE string,
        DEPT_ID string not null, FACILITY_ID string not null, SHIFT_DATE date not null, SHIFT_DATE_KEY int not null,
        SHIFT_TYPE string not null, SCHEDULED_HRS double, WORKED_HRS double not null, OT_HRS double, AGENCY_FLAG boolean,
        HOURLY_RATE double, TOTAL_LABOR_COST double, _LOADED_AT timestamp_ntz""",
    "fct_gl_transaction": """GL_TRANS_SK long not null, GL_ACCOUNT_CODE string not null, GL_ACCOUNT_DESC string,
        COST_CENTER string not null, DEPT_ID string, FACILITY_ID string not null, FISCAL_YEAR int not null,
        FISCAL_PERIOD int not null, POSTING_DATE date not null, POSTING_DATE_KEY int not null, AMOUNT double not null,
        DEBIT_CREDIT string not null, CATEGORY string, SOURCE_SYSTEM string, _LOADED_AT timestamp_ntz""",
    "fct_supply_usage": """SUPPLY_USAGE_SK long not null, ENCOUNTER_ID string, PATIENT_SK long, ITEM_ID string not null,
        ITEM_DESC string, ITEM_CATEGORY string, DEPT_ID string not null, FACILITY_ID string not null, USAGE_DATE date not null,
        USAGE_DATE_KEY int not null, QTY double not null, UNIT_COST double, TOTAL_COST double, PAR_LEVEL double,
        REORDER_POINT double, ON_HAND_QTY double, _LOADED_AT timestamp_ntz""",
    "fct_bed_status": """BED_STATUS_SK string not null, BED_ID string not null, FACILITY_ID string not null, DEPT_ID string not null,
        STATUS string not null, STATUS_START timestamp_ntz not null, STATUS_END timestamp_ntz, DWELL_TIME_MIN double,
        PATIENT_SK long, EVENT_DATE_KEY int not null, _LOADED_AT timestamp_ntz""",
}


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[name])


class HospitalTables(Tables):
    """``Tables`` over the hospital's own tables in ``root``/<table> (``fmt``: parquet or csv)."""

    def __init__(self, spark: SparkSession, root: str, profile: Profile = REFERENCE, fmt: str = "parquet",
                 materialized: dict[str, DataFrame] | None = None):
        super().__init__(spark, root, profile, materialized)
        self.fmt = fmt

    def get(self, name: str) -> DataFrame:
        if name not in self._built:
            reader = self.spark.read.schema(schema(name))
            if self.fmt == "csv":
                reader = reader.option("header", True)
            self._built[name] = reader.format(self.fmt).load(f"{self.sf_dir.rstrip('/')}/{name}")
        return self._built[name]

    def missing_values(self, name: str) -> DataFrame:
        """Load check: one row per required column with the number of nulls (one scan)."""
        required = [f.name for f in schema(name).fields if not f.nullable]
        counts = self.get(name).agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in required])
        return counts.select(F.explode(F.array(*[
            F.struct(F.lit(name).alias("TABLE_NAME"), F.lit(c).alias("COLUMN_NAME"), F.col(c).alias("NULLS")) for c in required
        ])).alias("x")).select("x.*")
