"""File sources S1-S5: every reader takes an explicit schema (no inference).

* S1 Parquet (snappy is Spark's default codec).
* S2 CSV with a header, ``"`` quoting, and NULL / null / empty all read as null
  (the CSV reader accepts one ``nullValue``; the others are mapped after).
* S3 JSON whose file is one outer array: each element is a row (``json_array.py``,
  in splits).
* S4 JSON with one object per line (bed-status events).
* S5 binding of each raw source to its reader, schema and path.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carelake.sources.json_array import read_json_array

NULL_TOKENS = ("NULL", "null", "")


def read_parquet(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """S2. Columns are read as strings first so every null token can be
    mapped, then cast to the declared types."""
    as_text = T.StructType([T.StructField(f.name, T.StringType(), True) for f in schema.fields])
    raw = (spark.read.schema(as_text).option("header", True).option("quote", '"').option("escape", '"')
           .option("nullValue", "NULL").option("emptyValue", "").csv(path))
    cols = []
    for f in schema.fields:
        c = F.col(f.name)
        c = F.when(c.isin(*NULL_TOKENS) | c.isNull(), F.lit(None)).otherwise(c)
        cols.append(c.cast(f.dataType).alias(f.name))
    return raw.select(*cols)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One JSON object per line."""
    return spark.read.schema(schema).json(path)


READERS = {"parquet": read_parquet, "csv": read_csv, "json_array": read_json_array, "json_lines": read_json_lines}


@dataclass(frozen=True)
class SourceBinding:
    name: str
    fmt: str
    schema: T.StructType
    path: str

    def read(self, spark: SparkSession) -> DataFrame:
        return READERS[self.fmt](spark, self.path, self.schema)


# Which raw feed arrives in which format.
SOURCE_FORMATS = {
    "ehr": "csv",
    "erp": "csv",
    "hr": "csv",
    "supply": "csv",
    "claims": "json_array",
    "directory_log": "json_array",
    "iot_bed_status": "json_lines",
}


def bind_sources(root: str, schemas: dict[str, T.StructType]) -> dict[str, SourceBinding]:
    return {n: SourceBinding(n, fmt, schemas[n], f"{root.rstrip('/')}/{n}")
            for n, fmt in SOURCE_FORMATS.items() if n in schemas}
