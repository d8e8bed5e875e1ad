"""Dense surrogate keys that stay the same from load to load.

A registry folder holds one row per natural key ever seen, and its number. A load looks its natural keys up, numbers those it
does not find from the highest number on (without gaps, by distributed row numbers) and appends them, then joins the numbers to
its rows. Numbers are never given twice or changed: an append that fails commits no row, and a load that is run again finds what
it committed. Loads of one registry must not run at the same time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carelake.operators.numbering import number_rows
from carelake.sources.sinks import _fs, append


def read_registry(spark: SparkSession, root: str, natural: T.StructType, key: str) -> DataFrame:
    schema = T.StructType([*natural.fields, T.StructField(key, T.LongType())])
    fs, path = _fs(spark, root)
    if not fs.exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(root)


def _same(left: DataFrame, right: DataFrame, names: list[str], other: list[str]) -> Column:
    cond = F.lit(True)
    for a, b in zip(names, other):
        cond = cond & left[a].eqNullSafe(right[b])
    return cond


def stable_keys(rows: DataFrame, natural: list[str], root: str, key: str = "SK") -> DataFrame:
    """``rows`` and their number in the registry at ``root``; equal natural keys (null equals null) have one number."""
    spark = rows.sparkSession
    schema = rows.select(*natural).schema
    known = read_registry(spark, root, schema, key)
    other = [f"_known_{i}" for i in range(len(natural))]
    look_up = known.toDF(*other, key)
    seen = rows.select(*natural).distinct()
    new = seen.join(look_up, _same(seen, look_up, natural, other), "left_anti")
    high = known.agg(F.coalesce(F.max(key), F.lit(0))).first()[0]
    numbered = number_rows(new, [F.asc_nulls_first(c) for c in natural], key).withColumn(key, F.col(key) + high)
    if not numbered.isEmpty():
        append(numbered, root)
    look_up = read_registry(spark, root, schema, key).toDF(*other, key)
    return rows.join(look_up, _same(rows, look_up, natural, other), "left").drop(*other)
