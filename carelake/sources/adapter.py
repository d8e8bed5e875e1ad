"""Maps the driver's TPC-H-like tables onto the hospital star schema.

Every derivation is integer/float arithmetic on keys so the DuckDB oracle
(``oracle/``) reproduces it exactly. Design rules for scale:

* a fact is derived from ONE driver table plus broadcast lookups of the
  fixed-size ``nation`` (25 rows) / ``region`` (5 rows) tables; the only
  fact-to-fact join is claim lines -> orders (service date), which shuffles
  both sides on the order key once;
* dimensions derived from big tables (patient, provider, procedure) are plain
  projections: no global window, no collect.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from carelake.config import TESTDATA, Profile
from carelake.sources.raw import read_raw

# ---------------------------------------------------------------------------
# Fixed values (code lists of the reference schema, and the adapter's own
# assignment tables). Index = key modulo list length.
# ---------------------------------------------------------------------------
ENCOUNTER_TYPES = ["INPATIENT", "OUTPATIENT", "ED", "OBSERVATION"]
DEPT_TYPES = ["INPATIENT", "OUTPATIENT", "ED", "OR", "ICU", "ANCILLARY"]
REFERRAL_STATUSES = ["OPEN", "SCHEDULED", "COMPLETED", "CANCELLED"]
DENIAL_REASONS = ["ELIGIBILITY", "AUTH_REQUIRED", "CODING_ERROR", "MEDICAL_NECESSITY", "TIMELY_FILING"]
GL_CATEGORIES = ["LABOR", "SUPPLIES", "OVERHEAD", "DEPRECIATION", "REVENUE", "REVENUE", "REVENUE", "REVENUE"]
SPECIALTIES = ["Cardiology", "Orthopedics", "Oncology", "Neurology", "General Surgery",
               "Internal Medicine", "Pulmonology", "Gastroenterology"]
CREDENTIALS = ["MD", "DO", "NP"]
DISPOSITIONS = ["HOME", "SNF", "HOME_HEALTH", "REHAB", "EXPIRED"]
BLOCKS = ["A", "B", "C", "D", "E", "F"]
ASA_CLASSES = ["I", "II", "III", "IV", "V"]
EMAIL_DOMAINS = ["mail.example.com", "inbox.example.org", "post.example.net"]
# payer: (sk, id, name, type, timely filing days); keyed by market segment
PAYERS = [
    (1, "PAY-001", "Medicare", "MEDICARE", 365),
    (2, "PAY-002", "Medicaid", "MEDICAID", 180),
    (3, "PAY-003", "Blue Shield Commercial", "COMMERCIAL", 90),
    (4, "PAY-004", "Managed Care Plus", "MANAGED_CARE", 30),
    (5, "PAY-005", "Self Pay", "SELF_PAY", None),
]
SEGMENT_PAYER = {"AUTOMOBILE": "PAY-001", "BUILDING": "PAY-002", "FURNITURE": "PAY-003",
                 "HOUSEHOLD": "PAY-004", "MACHINERY": "PAY-005"}
DRG_COUNT = 25


def pick(values: list, idx: Column) -> Column:
    """values[idx] for a 0-based integer Column."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx % len(values)).cast("int") + 1)


def lpad_num(c: Column, n: int) -> Column:
    """At least ``n`` digits: longer numbers stay whole (``lpad`` alone would cut them)."""
    s = c.cast("string")
    return F.lpad(s, F.greatest(F.lit(n), F.length(s)), F.lit("0"))


def facility_id(region_key: Column) -> Column:
    return F.concat(F.lit("FAC-"), lpad_num(region_key + 1, 3))


def dept_id(nation_key: Column) -> Column:
    return F.concat(F.lit("DEPT-"), lpad_num(nation_key + 1, 3))


# Total order of lines inside an order (every column, so exact duplicates are
# the only ties, and those produce identical rows whichever way they break).
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
              "l_returnflag", "l_linestatus", "l_shipdate"]


LINE_NATURAL_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def duplicate_rank(*also: str) -> Column:
    """1-based rank among lines sharing (order, line, part, supplier) and the
    columns ``also``: 1 for all but exact repeats. Partitioned by the whole
    natural key, so a hot order spreads over many partitions, and a filter on
    one of these columns is pushed below the window."""
    keys = [*LINE_NATURAL_KEY, *also]
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*[c for c in LINE_ORDER if c not in keys]))


class Tables:
    """Lazily built, session-cached DataFrames for one data directory.

    Nothing is materialised here: each accessor returns a logical plan, so a
    query only scans the columns and rows it needs.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, profile: Profile = TESTDATA,
                 materialized: dict[str, DataFrame] | None = None):
        self.spark = spark
        self.sf_dir = sf_dir
        self.profile = profile
        # mart name -> DataFrame over a written table (set by the refresh
        # pipeline); queries then read the table instead of rebuilding it.
        self.materialized = dict(materialized or {})
        self._built: dict[str, DataFrame] = {}

    def mart(self, name: str) -> DataFrame:
        if name in self.materialized:
            return self.materialized[name]
        from carelake.plans.marts import MARTS  # late import: plans depend on sources
        return MARTS[name](self)

    def raw(self, name: str) -> DataFrame:
        return read_raw(self.spark, self.sf_dir, name)

    # -- small fixed-size lookups ------------------------------------------
    def _nation_facility(self) -> DataFrame:
        """nation key -> (DEPT_ID, FACILITY_ID); 25 rows, always broadcast."""
        n = self.raw("nation")
        return F.broadcast(n.select(
            F.col("n_nationkey").cast("long").alias("_nk"),
            dept_id(F.col("n_nationkey")).alias("DEPT_ID"),
            facility_id(F.col("n_regionkey")).alias("FACILITY_ID")))

    def _with_dept(self, df: DataFrame, nation_key: Column) -> DataFrame:
        return (df.withColumn("_nk", nation_key)
                  .join(self._nation_facility(), "_nk", "left")
                  .drop("_nk"))

    def _supplier_count(self) -> Column:
        """Scalar subquery: number of providers."""
        return self.raw("supplier").select(F.count(F.lit(1))).scalar()

    # -- dimensions ----------------------------------------------------------
    def dim_facility(self) -> DataFrame:
        r = self.raw("region")
        return r.select(facility_id(F.col("r_regionkey")).alias("FACILITY_ID"),
                        F.col("r_name").alias("FACILITY_NAME"))

    def dim_department(self) -> DataFrame:
        n = self.raw("nation")
        return n.select(dept_id(F.col("n_nationkey")).alias("DEPT_ID"),
                        F.col("n_name").alias("DEPT_NAME"),
                        pick(DEPT_TYPES, F.col("n_nationkey")).alias("DEPT_TYPE"),
                        facility_id(F.col("n_regionkey")).alias("FACILITY_ID"))

    def dim_payer(self) -> DataFrame:
        # A literal table carries no size statistics, so without the hint
        # Spark would sort-merge join (and shuffle the whole fact on a 5-value
        # key). Its size is fixed by the list above: a proven bound.
        return F.broadcast(self.spark.createDataFrame(
            PAYERS, "PAYER_SK long, PAYER_ID string, PAYER_NAME string, PAYER_TYPE string, "
                    "TIMELY_FILING_DAYS int"))

    def dim_patient(self) -> DataFrame:
        c = self.raw("customer")
        k = F.col("c_custkey")
        seg_map = F.create_map(*[x for kv in SEGMENT_PAYER.items() for x in map(F.lit, kv)])
        return c.select(
            k.alias("PATIENT_SK"),
            F.concat(F.lit("MRN-"), lpad_num(k, 7)).alias("MRN"),
            F.split_part(F.col("c_name"), F.lit("#"), F.lit(1)).alias("FIRST_NAME"),
            F.split_part(F.col("c_name"), F.lit("#"), F.lit(2)).alias("LAST_NAME"),
            F.date_add(F.lit("1930-01-01").cast("date"), ((k * 37) % 30000).cast("int")).alias("DOB"),
            F.when(k % 2 == 0, "F").otherwise("M").alias("GENDER"),
            F.concat(lpad_num(k % 800 + 100, 3), F.lit("-"), lpad_num(k % 100, 2), F.lit("-"),
                     lpad_num(k % 10000, 4)).alias("SSN"),
            F.concat(F.lit("("), lpad_num(k % 700 + 200, 3), F.lit(") 555-"),
                     lpad_num(k % 10000, 4)).alias("PHONE"),
            F.concat(F.lit("patient"), k.cast("string"), F.lit("@"), pick(EMAIL_DOMAINS, k)).alias("EMAIL"),
            lpad_num((k * 7919) % 100000, 5).alias("ZIP"),
            seg_map[F.col("c_mktsegment")].alias("PRIMARY_PAYER_ID"),
            ((F.col("c_acctbal") + 1000) / 2500).alias("HCC_SCORE"),
            (k % 10 != 9).alias("IS_ACTIVE"),
        )

    def dim_provider(self) -> DataFrame:
        s = self.raw("supplier")
        k = F.col("s_suppkey")
        return s.select(
            k.alias("PROVIDER_SK"),
            F.concat(F.lit("1"), lpad_num(k, 9)).alias("NPI"),
            F.split_part(F.col("s_name"), F.lit("#"), F.lit(1)).alias("FIRST_NAME"),
            F.split_part(F.col("s_name"), F.lit("#"), F.lit(2)).alias("LAST_NAME"),
            F.when(k % 10 != 0, pick(CREDENTIALS, k)).alias("CREDENTIAL"),
            pick(SPECIALTIES, k).alias("SPECIALTY"),
        )

    def dim_procedure(self) -> DataFrame:
        p = self.raw("part")
        return p.select(F.col("p_partkey").alias("PROC_SK"),
                        F.concat(F.lit("CPT"), F.col("p_partkey").cast("string")).alias("CPT_CODE"),
                        F.col("p_name").alias("DESCRIPTION"),
                        F.col("p_type").alias("CATEGORY"))

    def dim_diagnosis(self) -> DataFrame:
        p = self.raw("part").select("p_size").distinct()
        return p.select(F.col("p_size").cast("long").alias("DX_SK"),
                        F.concat(F.lit("ICD-"), lpad_num(F.col("p_size"), 3)).alias("ICD10_CODE"),
                        F.concat(F.lit("Diagnosis group "), F.col("p_size").cast("string")).alias("DESCRIPTION"))

    def dim_drg(self) -> DataFrame:
        sk = F.col("id")
        code = lpad_num(sk + 1, 3)
        return self.spark.range(DRG_COUNT).select(
            sk.alias("DRG_SK"),
            code.alias("DRG_CODE"),
            F.concat(F.lit("DRG "), code).alias("DESCRIPTION"),
            F.concat(F.lit("MDC "), (sk % 5 + 1).cast("string")).alias("MDC_DESCRIPTION"),
            ((sk * 1789 % 24000 + 5001).cast("double") / 10000).alias("WEIGHT"),
            F.when(sk % 12 != 0, (sk % 7 + 1).cast("double")).alias("GEOMETRIC_LOS"),
        )

    # -- facts ---------------------------------------------------------------
    def fct_encounter(self) -> DataFrame:
        o = self.raw("orders")
        k = F.col("o_orderkey")
        admit = F.col("o_orderdate").cast("date")
        los = (k % 9 + 1).cast("int")
        base = o.select(
            F.concat(F.lit("ENC-"), k.cast("string")).alias("ENCOUNTER_ID"),
            F.col("o_custkey").alias("PATIENT_SK"),
            (k % self._supplier_count()).alias("PROVIDER_SK"),
            (F.col("o_custkey") % 5 + 1).alias("PAYER_SK"),
            (k % DRG_COUNT).alias("DRG_SK"),
            (k % 25).alias("_nation"),
            pick(ENCOUNTER_TYPES, k * 7919).alias("ENCOUNTER_TYPE"),
            admit.alias("ADMIT_DATE"),
            F.when(k % 50 != 0, F.date_add(admit, los)).alias("DISCHARGE_DATE"),
            pick(DISPOSITIONS, k).alias("DISCHARGE_DISPOSITION"),
            los.alias("LOS_DAYS"),
            (k % 6).cast("double").alias("EXPECTED_LOS"),
            F.col("o_totalprice").alias("TOTAL_CHARGES"),
            (F.col("o_totalprice") * 3 / 5).alias("TOTAL_COST"),
            (F.col("o_totalprice") * 7 / 10).alias("TOTAL_PAYMENTS"),
            ((k * 104729) % 100 < 12).alias("READMIT_30_FLAG"),
        ).withColumn("NET_REVENUE", F.col("TOTAL_PAYMENTS") - F.col("TOTAL_COST"))
        return self._with_dept(base, F.col("_nation")).drop("_nation")

    def fct_referral(self) -> DataFrame:
        o = self.raw("orders")
        k = F.col("o_orderkey")
        base = o.select(
            F.concat(F.lit("REF-"), k.cast("string")).alias("REFERRAL_ID"),
            F.col("o_custkey").alias("PATIENT_SK"),
            ((k * 31) % self._supplier_count()).alias("REFERRING_PROVIDER_SK"),
            F.concat(F.lit("2"), lpad_num(k % 100000, 9)).alias("REFERRED_TO_NPI"),
            pick(SPECIALTIES, k * 13).alias("REFERRED_TO_SPECIALTY"),
            F.col("o_orderdate").cast("date").alias("REFERRAL_DATE"),
            pick(REFERRAL_STATUSES, k).alias("STATUS"),
            (F.col("o_orderstatus") == "F").alias("LEAKAGE_FLAG"),
            (F.col("o_totalprice") / 20).alias("EXPECTED_REVENUE"),
            (k % 25).alias("_nation"),
        )
        return self._with_dept(base, F.col("_nation")).drop("_nation", "DEPT_ID")

    def fct_claim_line(self) -> DataFrame:
        # Key: the line's natural columns, its return flag (the denial filter,
        # which so passes the window) and a rank among exact repeats.
        li = self.raw("lineitem").withColumn("_dup", duplicate_rank("l_returnflag"))
        o = self.raw("orders").select("o_orderkey", "o_custkey", "o_orderdate")
        j = li.join(o, li.l_orderkey == o.o_orderkey, "inner")
        denied = F.col("l_returnflag") == "R"
        return j.select(
            F.concat_ws("-", *[F.col(c).cast("string") for c in (*LINE_NATURAL_KEY, "l_returnflag", "_dup")])
             .alias("CLAIM_LINE_SK"),
            F.concat(F.lit("CLM-"), F.col("l_orderkey").cast("string")).alias("CLAIM_ID"),
            F.col("l_linenumber").alias("LINE_NUMBER"),
            F.concat(F.lit("ENC-"), F.col("l_orderkey").cast("string")).alias("ENCOUNTER_ID"),
            F.col("o_custkey").alias("PATIENT_SK"),
            (F.col("l_orderkey") % 5 + 1).alias("PAYER_SK"),
            F.col("l_suppkey").alias("PROVIDER_SK"),
            (F.col("l_partkey") % 50 + 1).alias("DX_SK"),
            F.col("l_partkey").alias("PROC_SK"),
            F.col("o_orderdate").cast("date").alias("SERVICE_DATE"),
            F.col("l_extendedprice").alias("CHARGE_AMT"),
            (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("ALLOWED_AMT"),
            denied.alias("DENIED_FLAG"),
            F.when(denied, pick(DENIAL_REASONS, F.col("l_linenumber"))).alias("DENIAL_REASON"),
            F.when(denied & (F.col("l_linestatus") == "F"), "APPEALED")
             .when(denied, "DENIED").otherwise("ADJUDICATED").alias("CLAIM_STATUS"),
            F.col("l_shipdate").cast("date").alias("FILING_DATE"),
        )

    def fct_or_case(self) -> DataFrame:
        li = self.raw("lineitem")
        ok, pk, ln = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_linenumber")
        case_date = F.col("l_shipdate").cast("date")
        sched = F.timestamp_add("HOUR", (ln + 7).cast("long"), case_date.cast("timestamp_ntz"))
        start = F.timestamp_add("MINUTE", (ok % 61 - 10).cast("long"), sched)
        case_min = F.col("l_quantity") * 8
        base = li.withColumn("_dup", duplicate_rank()).select(
            F.concat_ws("-", F.lit("CASE"), ok.cast("string"), ln.cast("string"), pk.cast("string"),
                        F.col("l_suppkey").cast("string"), F.col("_dup").cast("string")).alias("CASE_ID"),
            F.concat(F.lit("ENC-"), ok.cast("string")).alias("ENCOUNTER_ID"),
            F.col("l_suppkey").alias("SURGEON_SK"),
            F.concat(F.lit("OR-"), lpad_num(pk % 12 + 1, 2)).alias("OR_ROOM_ID"),
            pk.alias("PRIMARY_CPT_SK"),
            case_date.alias("CASE_DATE"),
            sched.alias("SCHEDULED_START"),
            start.alias("ACTUAL_START"),
            F.when(ok % 53 != 0, F.timestamp_add("MINUTE", case_min.cast("long"), start)).alias("ACTUAL_END"),
            pick(BLOCKS, pk).alias("BLOCK_NAME"),
            F.when(pk % 97 == 0, F.lit(0.0)).when(pk % 6 == 5, F.lit(360.0)).otherwise(F.lit(240.0)).alias("BLOCK_MINUTES"),
            case_min.alias("CASE_MINUTES"),
            (ln * 5 + 15).cast("double").alias("TURNOVER_MINUTES"),
            (ok % 61 <= 15).alias("FIRST_CASE_ON_TIME"),
            (ln <= 3).alias("PRIME_TIME_FLAG"),
            F.when(ok % 5 == 0, "URGENT").otherwise("ELECTIVE").alias("CASE_CLASS"),
            pick(ASA_CLASSES, pk).alias("ASA_CLASS"),
            (ok % 25).alias("_nation"),
        )
        return self._with_dept(base, F.col("_nation")).drop("_nation", "DEPT_ID")

    def fct_labor_hour(self) -> DataFrame:
        li = self.raw("lineitem")
        sk = F.col("l_suppkey")
        hrs = (F.col("l_quantity").cast("long") % 9 + 4).cast("double")
        base = li.select(
            F.concat(F.lit("EMP-"), sk.cast("string")).alias("EMPLOYEE_ID"),
            F.col("l_shipdate").cast("date").alias("SHIFT_DATE"),
            hrs.alias("WORKED_HRS"),
            (F.col("l_linenumber") % 3).cast("double").alias("OT_HRS"),
            (F.col("l_returnflag") == "A").alias("AGENCY_FLAG"),
            (hrs * 45).alias("TOTAL_LABOR_COST"),
            (sk % 25).alias("_nation"),
        )
        return self._with_dept(base, F.col("_nation")).drop("_nation")

    def fct_gl_transaction(self) -> DataFrame:
        li = self.raw("lineitem")
        base = li.select(
            F.year("l_shipdate").alias("FISCAL_YEAR"),
            F.month("l_shipdate").alias("FISCAL_PERIOD"),
            F.col("l_extendedprice").alias("AMOUNT"),
            pick(GL_CATEGORIES, F.col("l_partkey")).alias("CATEGORY"),
            (F.col("l_suppkey") % 25).alias("_nation"),
        )
        return self._with_dept(base, F.col("_nation")).drop("_nation")

    # -- cached accessor ----------------------------------------------------
    def get(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = getattr(self, name)()
        return self._built[name]
