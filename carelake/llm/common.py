"""Shared helpers: table access, the cluster's shared folder, batch sizes for Python stages."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The white space of all word and text rules here: space and \t \n \v \f \r.
ASCII_SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

# Broadcast only below this many rows (checked by a count); wider sides use a shuffle join.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.
    Only a local session may go without it; then a temporary folder is set once."""
    sc = spark.sparkContext
    d = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="llm-shared-")
        sc.setCheckpointDir(d)
    return d.rstrip("/")


def saved_dir(spark: SparkSession) -> str:
    """Where this application's saved tables are."""
    return f"{shared_dir(spark)}/llm/{spark.sparkContext.applicationId}"


def remove_saved(spark: SparkSession) -> None:
    """Deletes the tables that this application has saved. Call it when the results are written:
    results that are not yet computed read them."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(saved_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def save(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back: cuts the
    lineage, survives lost executors, and is computed once however often it is read."""
    path = f"{saved_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint for a narrow saved table if its counted rows are within
    ``limit``; else the table as it is, which Spark joins by a shuffle."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def arrow_batches(spark: SparkSession, rows: int = 256) -> None:
    """Readies the session for Python stages on whole texts: batches of few rows, as some texts are
    very long, and this package's modules sent to the executors."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    ship(spark)


def ship(spark: SparkSession) -> None:
    """Sends the package's modules to the executors (once per application), whose Python workers
    import them: they need not be installed there, nor be in the driver's working directory."""
    sc = spark.sparkContext
    if getattr(sc, "_llm_shipped", False):
        return
    here = Path(__file__).resolve().parent
    path = f"{tempfile.mkdtemp(prefix='llm-ship-')}/carelake_llm.zip"  # the driver serves this file
    with zipfile.ZipFile(path, "w") as z:
        for f in [here.parent / "__init__.py", *sorted(here.glob("*.py"))]:
            z.write(f, str(f.relative_to(here.parent.parent)))
    sc.addPyFile(path)
    sc._llm_shipped = True


def n_words(text: Column) -> Column:
    """Number of words (runs of anything but ASCII white space); null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def fresh(name: str, taken: list[str]) -> str:
    """``name``, prefixed until it clashes with no column of ``taken`` (case-insensitively)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Consecutive rows of equal ``key`` of a sorted partition, one table per key;
    a key may span batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        keys = b.column(b.schema.get_field_index(key)).to_pylist()
        at = 0
        for i, k in enumerate(keys):
            if k != last or not (held or i > at):
                if held or i > at:
                    yield pa.Table.from_batches(held + ([b.slice(at, i - at)] if i > at else []))
                held, at, last = [], i, k
        held.append(b.slice(at))
    if held:
        yield pa.Table.from_batches(held)
