"""Sinks S6, S7, S10 and audit columns S9.

* Full refresh (S6/S7): write the new version to a fresh directory, then
  point the table at it. Readers never see a half-written table, and a failed
  task is retried by Spark without touching the live version.
* Append log rows (S10).
"""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def version_path(table_root: str, version: str) -> str:
    return f"{table_root.rstrip('/')}/v={version}"


def write_version(df: DataFrame, table_root: str, version: str | None = None,
                  partition_by: str | None = None) -> str:
    """Write ``df`` as a new version directory and mark it current."""
    spark = df.sparkSession
    version = version or uuid.uuid4().hex
    path = version_path(table_root, version)
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(partition_by)
    w.parquet(path)
    _point_to(spark, table_root.rstrip("/"), version)
    return path


def _point_to(spark: SparkSession, root: str, version: str) -> None:
    """Writes the pointer beside the old one and renames it over that, so a
    reader finds either the old or the new version, never an empty file."""
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs, new = _fs(spark, f"{root}/_CURRENT.{uuid.uuid4().hex}")
    out = fs.create(new, True)
    out.write(bytearray(version.encode()))
    out.close()
    replace = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    replace[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    cur = jvm.org.apache.hadoop.fs.Path(f"{root}/_CURRENT")
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(cur).toUri(), hadoop).rename(
        fs.makeQualified(new), fs.makeQualified(cur), replace)


def current_path(spark: SparkSession, table_root: str) -> str | None:
    fs, cur = _fs(spark, f"{table_root.rstrip('/')}/_CURRENT")
    if not fs.exists(cur):
        return None
    stream = fs.open(cur)
    reader = spark.sparkContext._jvm.java.io.BufferedReader(
        spark.sparkContext._jvm.java.io.InputStreamReader(stream))
    version = reader.readLine()
    reader.close()
    return version_path(table_root, version)


def read_current(spark: SparkSession, table_root: str) -> DataFrame:
    p = current_path(spark, table_root)
    if p is None:
        raise FileNotFoundError(table_root)
    return spark.read.parquet(p)


_APPENDING = threading.Lock()


def append(df: DataFrame, path: str) -> None:
    """Append rows to a log table. One job at a time: two that write to
    one folder share its temporary directory, and the first to commit removes it."""
    with _APPENDING:
        df.write.mode("append").parquet(path)


def with_audit(df: DataFrame, loaded_at_col: str = "_LOADED_AT") -> DataFrame:
    """Default-filled load timestamp."""
    return df.withColumn(loaded_at_col, F.current_timestamp())


def table_inventory(spark: SparkSession, roots: dict[str, str]) -> DataFrame:
    """(TABLE_NAME, ROW_COUNT, BYTES, LAST_ALTERED) of written tables.
    Row counts come from Spark (parquet footers); size and time are two calls
    to the file system per table, on the folder of its current version."""
    rows = []
    counts = None
    for name, root in roots.items():
        p = current_path(spark, root)
        if p is None:
            continue
        fs, path = _fs(spark, p)
        rows.append((name, int(fs.getContentSummary(path).getLength()), int(fs.getFileStatus(path).getModificationTime())))
        c = spark.read.parquet(p).agg(F.count(F.lit(1)).alias("ROW_COUNT")).select(F.lit(name).alias("TABLE_NAME"), "ROW_COUNT")
        counts = c if counts is None else counts.unionByName(c)
    meta = spark.createDataFrame(rows, "TABLE_NAME string, BYTES long, MTIME_MS long")
    return (counts.join(meta, "TABLE_NAME")
            .select("TABLE_NAME", "ROW_COUNT", "BYTES",
                    F.timestamp_millis("MTIME_MS").cast("timestamp_ntz").alias("LAST_ALTERED")))


def repair_partitions(path: str, repaired: DataFrame, partition_by: str) -> list:
    """Brings the partitions of a written table up to ``repaired`` (all its rows, same columns) and returns the values
    of those that it rewrote. A partition whose rows are the same, in any order, is not touched: per partition, count, sum and
    xor of the rows' hashes are compared first. The others are written beside the old ones and swapped by Spark's dynamic
    partition overwrite; partitions that ``repaired`` has no row of stay."""
    from carelake.operators.numbering import checkpointed
    spark = repaired.sparkSession
    live = spark.read.parquet(path)
    columns = sorted(live.columns)

    def marks(df: DataFrame, prefix: str) -> DataFrame:
        h = F.xxhash64(*columns)
        return df.groupBy(F.col(partition_by).alias(f"{prefix}_part")).agg(F.struct(
            F.count(F.lit(1)), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h), F.bit_xor(F.xxhash64(F.lit(1), *columns))).alias(f"{prefix}_marks"))

    want, have = marks(repaired.select(*live.columns), "new"), marks(live, "old")
    touched = checkpointed(want.join(have, F.col("new_part").eqNullSafe(F.col("old_part")), "left")
                           .where(~F.col("new_marks").eqNullSafe(F.col("old_marks"))).select("new_part"))
    parts = [r[0] for r in touched.orderBy("new_part").collect()]  # as many as the table has folders
    if parts:
        rows = repaired.select(*live.columns).join(F.broadcast(touched), F.col(partition_by).eqNullSafe(F.col("new_part")), "left_semi")
        # the rows come from the files that they replace
        checkpointed(rows).repartition(partition_by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
            .partitionBy(partition_by).parquet(path)
    return parts
