"""Batch refresh (O1-O7): marts -> (forecast, anomalies) -> quality -> summary.

Every step reads tables, writes a new table version (S6) and appends one row
to the run log (S10). Written tables cut the lineage, so a lost executor
only recomputes from the last written step. Steps that do not depend on
each other run as concurrent Spark jobs from two driver threads (O4).

The run log is the ledger of a run: a step's SUCCESS row names the version it
wrote. A refresh started again with the same run id skips the steps that have
such a row, reads their versions (whatever other runs have written since) and
goes on behind them. Each attempt writes versions of its own, so a step that
died after its table was switched is simply done again.
"""

from __future__ import annotations

import json
import time
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carelake.plans import models, quality
from carelake.plans.marts import MARTS
from carelake.sources import sinks
from carelake.sources.adapter import Tables

LOG_SCHEMA = ("RUN_ID string, RUN_TS timestamp_ntz, TASK_NAME string, STATUS string, ROWS_AFFECTED long, "
              "DURATION_SECONDS decimal(10,2), ERROR_MESSAGE string, METADATA string")
# Fact-grain marts are written partitioned by month (dashboards filter on date
# ranges, so reads prune whole directories). Rows are hash-partitioned on
# (month, bucket of the key) first: a month holding a third of the rows is
# split over ``k`` tasks instead of landing in one, each (month, bucket) is
# written by exactly one task (months x k files), and unlike a range
# repartition there is no sampling pass that would recompute the mart.
MART_LAYOUT = {
    "mart_patient_leakage": ("REFERRAL_MONTH", "REFERRAL_ID"),
    "mart_readmission_los": ("ADMIT_MONTH", "ENCOUNTER_ID"),
    "mart_or_capacity": ("CASE_MONTH", "CASE_ID"),
    "mart_denials_revcycle": ("SERVICE_MONTH", "CLAIM_LINE_SK"),
    "mart_staffing_quality": ("SHIFT_MONTH", "DEPT_ID"),
}
MODEL_LOG_SCHEMA = "LOG_ID string, LOG_TS timestamp_ntz, MODEL_NAME string, METRIC_NAME string, METRIC_VALUE double, DETAILS string"


class Refresh:
    def __init__(self, t: Tables, root: str, run_id: str | None = None):
        self.t = t
        self.spark: SparkSession = t.spark
        self.root = root.rstrip("/")
        self.run_id = run_id or uuid.uuid4().hex
        self.attempt = uuid.uuid4().hex[:8]
        self.done = self._ledger()
        self.versions = {n: v for _, meta in self.done.values() for n, v in meta.get("versions", {}).items()}

    def _ledger(self) -> dict[str, tuple[int | None, dict]]:
        """Task -> (rows, metadata) of the steps that this run has finished before; a step counts only if
        the versions that it wrote are still there."""
        if not sinks.exists(self.spark, self.path("pipeline_run_log")):
            return {}
        rows = (self.table_log().where((F.col("RUN_ID") == self.run_id) & (F.col("STATUS") == "SUCCESS"))
                .select("TASK_NAME", "ROWS_AFFECTED", "METADATA").collect())  # at most one row a step and attempt
        done = {r.TASK_NAME: (r.ROWS_AFFECTED, json.loads(r.METADATA or "{}")) for r in rows}
        return {k: v for k, v in done.items() if all(
            sinks.exists(self.spark, sinks.version_path(self.path(n), x)) for n, x in v[1].get("versions", {}).items())}

    # -- plumbing ---------------------------------------------------------------
    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def log(self, task: str, status: str, rows: int | None, seconds: float, error: str | None = None,
            metadata: dict | None = None) -> None:
        import datetime as dt
        import decimal
        row = (self.run_id, dt.datetime.now(dt.UTC).replace(tzinfo=None), task, status, rows,
               decimal.Decimal(f"{seconds:.2f}"), error, json.dumps(metadata) if metadata else None)
        sinks.append(self.spark.createDataFrame([row], LOG_SCHEMA), self.path("pipeline_run_log"))

    def model_log(self, model: str, metric: str, value: float, details: dict | None = None) -> None:
        import datetime as dt
        row = (uuid.uuid4().hex, dt.datetime.now(dt.UTC).replace(tzinfo=None), model, metric, float(value),
               json.dumps(details) if details else None)
        sinks.append(self.spark.createDataFrame([row], MODEL_LOG_SCHEMA), self.path("model_performance_log"))

    def write(self, name: str, df: DataFrame) -> int:
        layout = MART_LAYOUT.get(name)
        if layout:
            n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            k = max(1, n // 8)
            month, key = layout
            df = df.repartition(n, F.col(month), F.pmod(F.xxhash64(key), F.lit(k)))
        if name in MARTS:
            df = sinks.with_audit(df)
        version = f"{self.run_id}-{self.attempt}"
        p = sinks.write_version(df, self.path(name), version, partition_by=layout[0] if layout else None)
        self.versions[name] = version
        # Row count from the written files (parquet footers), not a recompute.
        return self.spark.read.parquet(p).count()

    def step(self, task: str, fn, *tables: str) -> int | None:
        """Runs a step that writes ``tables``, unless this run has finished it before."""
        if task in self.done:
            return self.done[task][0]
        t0 = time.time()
        try:
            rows = fn()
        except Exception as e:  # noqa: BLE001 - the log records the failure, then re-raises
            self.log(task, "FAILURE", None, time.time() - t0, str(e))
            raise
        meta = {"versions": {n: self.versions[n] for n in tables}}
        self.log(task, "SUCCESS", rows, time.time() - t0, None, meta)
        self.done[task] = (rows, meta)
        return rows

    def table(self, name: str) -> DataFrame:
        if name in self.versions:
            df = self.spark.read.parquet(sinks.version_path(self.path(name), self.versions[name]))
        else:
            df = sinks.read_current(self.spark, self.path(name))
        if name in MART_LAYOUT:
            # Partition discovery returns the month column last, as a date.
            df = df.withColumn(MART_LAYOUT[name][0], F.col(MART_LAYOUT[name][0]).cast("date"))
        return df

    # -- steps --------------------------------------------------------------------
    def refresh_marts(self) -> dict[str, int]:
        """O1 (all six marts; SURVEY §8 item 9)."""
        out = {}
        for name, build in MARTS.items():
            out[name] = self.step(f"REFRESH_{name.upper()}", lambda b=build, n=name: self.write(n, b(self.t)), name)
        # Downstream steps read the written marts.
        self.t.materialized.update({n: self.table(n) for n in MARTS})
        return out

    def refresh_forecast(self) -> int:
        """O2."""
        def run():
            n = self.write("pred_encounter_volume", models.pred_encounter_volume(self.t))
            self.model_log("FORECAST_ENCOUNTER_VOLUME", "PREDICTION_COUNT", n)
            return n
        return self.step("REFRESH_FORECAST", run, "pred_encounter_volume")

    def refresh_anomalies(self) -> int:
        """O3."""
        def run():
            n = self.write("pred_denial_anomalies", models.pred_denial_anomalies(self.t))
            anomalies = self.table("pred_denial_anomalies").where(F.col("IS_ANOMALY")).count()
            self.model_log("ANOMALY_DENIAL_VOLUME", "ANOMALY_COUNT", anomalies, {"observations": n})
            return n
        return self.step("REFRESH_ANOMALIES", run, "pred_denial_anomalies")

    def refresh_drivers(self) -> dict[str, int]:
        return {
            "pred_readmission_drivers": self.step("REFRESH_READMISSION_DRIVERS", lambda: self.write(
                "pred_readmission_drivers", models.pred_readmission_drivers(self.t)), "pred_readmission_drivers"),
            "pred_leakage_drivers": self.step("REFRESH_LEAKAGE_DRIVERS", lambda: self.write(
                "pred_leakage_drivers", models.pred_leakage_drivers(self.t)), "pred_leakage_drivers"),
        }

    def quality(self) -> int:
        """D1-D14 with check ids and timestamps, then the D15 summary row."""
        def run():
            checks = (quality.data_quality_checks(self.t, with_uniqueness=True)
                      .withColumn("CHECK_ID", F.expr("uuid()"))
                      .withColumn("CHECK_TS", F.current_timestamp().cast("timestamp_ntz")))
            n = self.write("data_quality_checks", checks)
            s = quality.summary(self.table("data_quality_checks")).first()
            self.log("DATA_QUALITY_CHECKS", "SUCCESS", None, 0.0, None,
                     {"pass": s["PASS_COUNT"], "fail": s["FAIL_COUNT"], "warn": s["WARN_COUNT"]})
            return n
        return self.step("DATA_QUALITY", run, "data_quality_checks")

    def summary(self) -> int:
        """Completion row = rows logged by this run (filter by run id,
        not by wall-clock window)."""
        if "PIPELINE_SUMMARY" in self.done:
            return self.done["PIPELINE_SUMMARY"][0]
        log = self.table_log()
        # a step that was done again counts once
        rows = (log.where((F.col("RUN_ID") == self.run_id) & (F.col("STATUS") == "SUCCESS"))
                   .groupBy("TASK_NAME").agg(F.max_by("ROWS_AFFECTED", "RUN_TS").alias("ROWS")))
        total = rows.agg(F.sum("ROWS")).first()[0] or 0
        self.log("PIPELINE_SUMMARY", "SUCCESS", int(total), 0.0, None, {"run_id": self.run_id})
        return int(total)

    def table_log(self) -> DataFrame:
        return self.spark.read.parquet(self.path("pipeline_run_log"))

    def inventory(self) -> DataFrame:
        """O7."""
        names = list(MARTS) + list(n.lower() for n in models.PREDICTION_TABLES) + ["data_quality_checks"]
        return sinks.table_inventory(self.spark, {n.upper(): self.path(n) for n in names})

    def prediction_tables(self) -> DataFrame:
        """Q58 on a live refresh: TABLE_NAME, ROW_COUNT, BYTES, LAST_ALTERED of the written prediction tables."""
        return sinks.table_inventory(self.spark, {n: self.path(n.lower()) for n in models.PREDICTION_TABLES}) \
                    .orderBy(F.asc_nulls_last("TABLE_NAME"))

    # -- O4 ordering ----------------------------------------------------------------
    def run(self) -> dict:
        marts = self.refresh_marts()
        with ThreadPoolExecutor(max_workers=2) as pool:
            fc = pool.submit(self.refresh_forecast)
            an = pool.submit(self.refresh_anomalies)
            preds = {"pred_encounter_volume": fc.result(), "pred_denial_anomalies": an.result()}
        preds.update(self.refresh_drivers())
        checks = self.quality()
        total = self.summary()
        return {"run_id": self.run_id, "marts": marts, "predictions": preds, "checks": checks, "total_rows": total}


def run_log_summary(log: DataFrame) -> DataFrame:
    """Runs, latest status and rows per task (latest = max_by on
    the run timestamp, not input order)."""
    return (log.groupBy("TASK_NAME")
               .agg(F.count(F.lit(1)).alias("RUNS"), F.max_by("STATUS", "RUN_TS").alias("LAST_STATUS"),
                    F.sum("ROWS_AFFECTED").cast("long").alias("TOTAL_ROWS")))


def latest_runs(log: DataFrame, n: int = 50) -> DataFrame:
    """newest ``n`` run-log rows."""
    return log.orderBy(F.desc_nulls_first("RUN_TS")).limit(n)


# Metrics that the refresh logs for its models.
MODEL_METRICS = ["ANOMALY_COUNT", "PREDICTION_COUNT"]


def model_metrics_pivot(model_log: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """Latest value of each metric per model, one column per metric
    (given, so no job looks for them)."""
    latest = model_log.groupBy("MODEL_NAME", "METRIC_NAME").agg(F.max_by("METRIC_VALUE", "LOG_TS").alias("V"))
    return latest.groupBy("MODEL_NAME").pivot("METRIC_NAME", metrics or MODEL_METRICS).agg(F.first("V"))
