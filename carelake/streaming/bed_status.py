"""Bed-status events (one JSON object per line) as a file stream.

The reference only declares this feed (file format, stage, fact DDL); no job
derives anything from it. The Spark form is an incremental ingest into the
FCT_BED_STATUS shape: ``readStream`` with a fixed schema (files arriving in
the landing folder are picked up exactly once, tracked by the checkpoint),
derived key columns, the default-filled load timestamp, and an append-only
Parquet sink. The checkpoints live in a shared folder that the caller names,
so a restarted query (or a lost executor) resumes from the last committed
batch. Events that the fact's DDL refuses land in a table of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from carelake.functions import compat as C

# Event payload as it lands (IoT / RTLS).
EVENT_SCHEMA = T.StructType([
    T.StructField("BED_ID", T.StringType()),
    T.StructField("FACILITY_ID", T.StringType()),
    T.StructField("DEPT_ID", T.StringType()),
    T.StructField("STATUS", T.StringType()),
    T.StructField("STATUS_START", T.TimestampNTZType()),
    T.StructField("STATUS_END", T.TimestampNTZType()),
    T.StructField("PATIENT_SK", T.LongType()),
])
# Allowed bed statuses.
STATUSES = ["OCCUPIED", "VACANT_CLEAN", "VACANT_DIRTY", "MAINTENANCE", "BLOCKED"]


REQUIRED = ["BED_ID", "FACILITY_ID", "DEPT_ID", "STATUS", "STATUS_START"]


def reject_reason() -> Column:
    """Why the fact's DDL refuses an event; null if it doesn't."""
    why = F.when(~F.col("STATUS").isin(STATUSES), F.lit("unknown STATUS"))
    for c in reversed(REQUIRED):
        why = F.when(F.col(c).isNull(), F.lit(f"{c} is null")).otherwise(why)
    return why


def to_rejected(events: DataFrame) -> DataFrame:
    """The events that ``to_fact`` leaves out, with REJECT_REASON."""
    return events.withColumn("REJECT_REASON", reject_reason()).where(F.col("REJECT_REASON").isNotNull()) \
                 .withColumn("_LOADED_AT", F.current_timestamp())


def to_fact(events: DataFrame) -> DataFrame:
    """Event rows -> FCT_BED_STATUS columns. Rows missing a NOT NULL column or
    carrying an unknown status go to ``to_rejected``. The surrogate key is the
    SHA-256 of the natural key (S8: no global numbering on a stream)."""
    ok = reject_reason().isNull()
    dwell = C.minutes_between("STATUS_START", "STATUS_END").cast("double")
    return events.where(ok).select(
        F.sha2(F.concat_ws("|", "BED_ID", F.col("STATUS_START").cast("string"), "STATUS"), 256).alias("BED_STATUS_SK"),
        "BED_ID", "FACILITY_ID", "DEPT_ID", "STATUS", "STATUS_START", "STATUS_END",
        dwell.alias("DWELL_TIME_MIN"),
        "PATIENT_SK",
        C.date_key(F.col("STATUS_START")).cast("int").alias("EVENT_DATE_KEY"),
        F.current_timestamp().alias("_LOADED_AT"),
    )


def read_events(spark: SparkSession, landing: str, max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(EVENT_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.json(landing)


def start_ingest(spark: SparkSession, landing: str, table_path: str, rejected_path: str, checkpoint_root: str,
                 name: str = "bed_status_ingest", available_now: bool = True) -> list[StreamingQuery]:
    """Start the ingest: the fact rows and the rejected rows, each a query with
    its own checkpoint below ``checkpoint_root`` (a folder all executors share).
    ``available_now`` processes what has landed and stops (a scheduled batch);
    otherwise they run continuously every minute."""
    if not checkpoint_root:
        raise ValueError("checkpoint_root must name a shared folder")
    out = []
    for part, rows, path in (("fact", to_fact, table_path), ("rejected", to_rejected, rejected_path)):
        w = (rows(read_events(spark, landing)).writeStream.format("parquet").option("path", path)
             .option("checkpointLocation", f"{checkpoint_root.rstrip('/')}/{name}-{part}")
             .outputMode("append").queryName(f"{name}_{part}"))
        out.append((w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")).start())
    return out
