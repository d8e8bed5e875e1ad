"""Literal-row Tables for unit tests (driver tables contain no nulls or
orphans, so every null branch is exercised here)."""

from __future__ import annotations

from carelake.config import TESTDATA
from carelake.sources.adapter import Tables


class FakeTables(Tables):
    def __init__(self, spark, frames: dict, profile=TESTDATA):
        super().__init__(spark, "/nonexistent", profile)
        self.frames = frames

    def get(self, name):  # noqa: D401 - same contract as Tables.get
        if name in self.frames:
            return self.frames[name]
        return super().get(name)


PATIENT = ("PATIENT_SK long, MRN string, FIRST_NAME string, LAST_NAME string, DOB date, GENDER string, "
           "SSN string, PHONE string, EMAIL string, ZIP string, PRIMARY_PAYER_ID string, HCC_SCORE double, "
           "IS_ACTIVE boolean")
PROVIDER = "PROVIDER_SK long, NPI string, FIRST_NAME string, LAST_NAME string, CREDENTIAL string, SPECIALTY string"
PAYER = "PAYER_SK long, PAYER_ID string, PAYER_NAME string, PAYER_TYPE string, TIMELY_FILING_DAYS int"
DRG = ("DRG_SK long, DRG_CODE string, DESCRIPTION string, MDC_DESCRIPTION string, WEIGHT double, "
       "GEOMETRIC_LOS double")
DEPT = "DEPT_ID string, DEPT_NAME string, DEPT_TYPE string, FACILITY_ID string"
FAC = "FACILITY_ID string, FACILITY_NAME string"
ENCOUNTER = ("ENCOUNTER_ID string, PATIENT_SK long, PROVIDER_SK long, PAYER_SK long, DRG_SK long, "
             "ENCOUNTER_TYPE string, ADMIT_DATE date, DISCHARGE_DATE date, DISCHARGE_DISPOSITION string, "
             "LOS_DAYS int, EXPECTED_LOS double, TOTAL_CHARGES double, TOTAL_COST double, TOTAL_PAYMENTS double, "
             "READMIT_30_FLAG boolean, NET_REVENUE double, DEPT_ID string, FACILITY_ID string")
CLAIM = ("CLAIM_LINE_SK long, CLAIM_ID string, LINE_NUMBER int, ENCOUNTER_ID string, PATIENT_SK long, "
         "PAYER_SK long, PROVIDER_SK long, DX_SK long, PROC_SK long, SERVICE_DATE date, CHARGE_AMT double, "
         "ALLOWED_AMT double, DENIED_FLAG boolean, DENIAL_REASON string, CLAIM_STATUS string, FILING_DATE date")
OR_CASE = ("CASE_ID string, ENCOUNTER_ID string, SURGEON_SK long, OR_ROOM_ID string, PRIMARY_CPT_SK long, "
           "CASE_DATE date, SCHEDULED_START timestamp_ntz, ACTUAL_START timestamp_ntz, ACTUAL_END timestamp_ntz, "
           "BLOCK_NAME string, BLOCK_MINUTES double, CASE_MINUTES double, TURNOVER_MINUTES double, "
           "FIRST_CASE_ON_TIME boolean, PRIME_TIME_FLAG boolean, CASE_CLASS string, ASA_CLASS string, "
           "FACILITY_ID string")
PROC = "PROC_SK long, CPT_CODE string, DESCRIPTION string, CATEGORY string"
DX = "DX_SK long, ICD10_CODE string, DESCRIPTION string"
LABOR = ("EMPLOYEE_ID string, SHIFT_DATE date, WORKED_HRS double, OT_HRS double, AGENCY_FLAG boolean, "
         "TOTAL_LABOR_COST double, DEPT_ID string, FACILITY_ID string")
GL = "FISCAL_YEAR int, FISCAL_PERIOD int, AMOUNT double, CATEGORY string, DEPT_ID string, FACILITY_ID string"
