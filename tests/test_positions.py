"""Row numbers, running totals, positional joins and band look-ups."""

import random

import pytest
from pyspark.sql import functions as F

from carelake.operators import bands, numbering
from carelake.plans import positions


def plan(df):
    return df._jdf.queryExecution().toString()


def test_numbers_with_ties_and_nulls(spark):
    rng = random.Random(1)
    rows = [(rng.choice([1, 1, 1, 2, None, 7]), i) for i in range(3000)] + [(1, 5000)] * 1500
    df = spark.createDataFrame(rows, "K long, V long").repartition(7)
    got = numbering.number_rows(df, [F.asc_nulls_first("K"), F.desc("V")]).collect()
    assert sorted(r.RN for r in got) == list(range(1, len(rows) + 1))
    assert [(r.K, r.V) for r in sorted(got, key=lambda r: r.RN)] == sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, -r[1]))
    # rows equal in the whole key are dealt out over tasks
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be one task
    parts = numbering._dealt(df.where("V = 5000"), [F.asc("K"), F.asc("V")]).groupBy(numbering.PART).count().collect()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(parts) > 1
    assert numbering.number_rows(df.limit(0), [F.asc("K")]).count() == 0


def test_running_total(spark):
    rows = [(i, None if i % 50 == 0 else (i * 37 % 101) / 4 - 10) for i in range(2000)]
    df = spark.createDataFrame(rows, "K long, V double").repartition(6)
    got = {r.K: r.T for r in numbering.running_total(df, [F.asc("K")], "V", "T").collect()}
    total = 0.0
    for k, v in rows:
        total += v or 0.0
        assert float(got[k]) == pytest.approx(total, abs=1e-9)


def test_positions_repeat_the_shorter_table(spark):
    left = numbering.number_rows(spark.range(25).select(F.col("id").alias("A")), [F.asc("A")])
    right = spark.createDataFrame([("z",), ("x",), ("y",)], "N string")
    got = {r.A: r.N for r in numbering.join_positions(left, "RN", right, [F.asc("N")]).collect()}
    assert got == {a: "xyz"[a % 3] for a in range(25)}
    assert numbering.join_positions(left, "RN", right.limit(0), [F.asc("N")]).where("N is null").count() == 25


def test_bands_of_uneven_widths(spark):
    rng = random.Random(2)
    weights = [(i, rng.choice([0.0, 0.001, 1.0, 50.0, 4000.0])) for i in range(300)]
    b = bands.running_bands(spark.createDataFrame(weights, "K long, W double"), "K", "W")
    total = sum(w for _, w in weights)
    values = [rng.uniform(-5, total + 5) for _ in range(2000)] + [float(r.hi) for r in b.collect()] + [0.0, total, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "I long, V double")
    held = [(r.K, float(r.lo), float(r.hi)) for r in b.collect()]
    got = {r.I: r.K for r in bands.lookup_band(df, "V", b, "K").collect()}
    assert len(got) == len(values)
    for i, v in enumerate(values):
        want = [k for k, lo, hi in held if v is not None and lo < v <= hi]
        assert got[i] == (want[0] if want else None), v


def test_bands_are_an_equi_join(spark):
    df = spark.range(100).select(F.col("id").cast("double").alias("V"))
    b = spark.createDataFrame([(k, float(k), float(k + 1)) for k in range(90)], "K long, lo double, hi double")
    text = plan(bands.lookup_band(df, "V", b, "K"))
    assert "NestedLoop" not in text and "Cartesian" not in text


@pytest.mark.parametrize("name", sorted(positions.QUERIES))
def test_no_task_holds_a_table(tables, name):
    text = plan(positions.QUERIES[name](tables))
    assert "NestedLoop" not in text and "Cartesian" not in text
    assert "No Partition Defined" not in text
    assert "Window [" not in text or "windowspecdefinition(_part" in text
