"""Stable keys over loads, and repair of a written table's partitions."""

import datetime as dt
import os
import random

from pyspark.sql import functions as F

from carelake.plans import marts
from carelake.sources import keys, sinks


def test_keys_stay_over_loads(spark, tmp_path):
    root = f"{tmp_path}/registry"
    rng = random.Random(1)
    first = [(rng.choice(["a", "b", None]), i % 400) for i in range(1500)]
    second = first[500:900] + [("c", i) for i in range(300)] + [(None, None)]
    a = keys.stable_keys(spark.createDataFrame(first, "S string, K long").repartition(5), ["S", "K"], root).collect()
    known = {(r.S, r.K): r.SK for r in a}
    assert len(a) == len(first) and sorted(known.values()) == list(range(1, len(set(first)) + 1))
    b = keys.stable_keys(spark.createDataFrame(second, "S string, K long").repartition(3), ["S", "K"], root).collect()
    assert len(b) == len(second) and all(known.get((r.S, r.K), r.SK) == r.SK for r in b)
    both = known | {(r.S, r.K): r.SK for r in b}
    assert sorted(both.values()) == list(range(1, len(set(first) | set(second)) + 1))
    # a load that is run again numbers nothing anew
    files = sorted(os.listdir(root))
    again = keys.stable_keys(spark.createDataFrame(second, "S string, K long"), ["S", "K"], root)
    assert {(r.S, r.K): r.SK for r in again.collect()} == {(r.S, r.K): r.SK for r in b} and sorted(os.listdir(root)) == files


def files_of(path):
    return {d: sorted(f for f in names if f.endswith(".parquet")) for d, _, names in os.walk(path) if "=" in os.path.basename(d)}


def test_backfill_rewrites_touched_months_only(spark, tables, tmp_path):
    path = f"{tmp_path}/staffing"
    mart = tables.mart("mart_staffing_quality").withColumn("MONTH", F.trunc("SHIFT_DATE", "MM").cast("string"))
    mart.repartition("MONTH").write.partitionBy("MONTH").parquet(path)
    good = sorted(map(tuple, spark.read.parquet(path).select(*sorted(mart.columns)).collect()), key=repr)
    full = marts.discharge_backfill(spark.read.parquet(path), tables)
    assert sinks.repair_partitions(path, full, "MONTH") == []  # nothing is wrong yet

    # spoil the discharge columns of two months that have discharges
    months = [str(r.MONTH) for r in spark.read.parquet(path).where("DISCHARGES > 0").select("MONTH").distinct().orderBy("MONTH").limit(2).collect()]
    bad = spark.read.parquet(path).where(F.col("MONTH").cast("string").isin(months))
    bad = spark.createDataFrame(bad.withColumn("DISCHARGES", F.lit(0).cast(dict(bad.dtypes)["DISCHARGES"])).collect(), bad.schema)
    bad.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("MONTH").parquet(path)
    before = files_of(path)
    touched = sinks.repair_partitions(path, marts.discharge_backfill(spark.read.parquet(path), tables), "MONTH")
    after = files_of(path)
    assert [str(x) for x in touched] == months
    assert {d for d in before if before[d] != after.get(d)} == {d for d in before if any(d.endswith(m) for m in months)}
    spark.catalog.refreshByPath(path)
    assert sorted(map(tuple, spark.read.parquet(path).select(*sorted(mart.columns)).collect()), key=repr) == good
    assert sinks.repair_partitions(path, marts.discharge_backfill(spark.read.parquet(path), tables), "MONTH") == []
    assert files_of(path) == after and dt.date.fromisoformat(months[0])
