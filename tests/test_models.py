"""Forecast, anomalies and drivers on fixtures whose truth is known."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from carelake.operators import regression, timeseries

START = dt.date(2019, 1, 1)


def day(i):
    return START + dt.timedelta(days=i)


def grown(rng, i):
    """A series with a slope, a weekly and a yearly wave."""
    d = day(i)
    return 40 + 0.05 * i + (8 if d.weekday() < 5 else 0) + 9 * math.sin(2 * math.pi * i / 365.25) + rng.gauss(0, 2)


def test_fit_is_least_squares(spark):
    rng = random.Random(1)
    rows = [(s, day(i), grown(rng, i) * k) for s, k in (("a", 1.0), ("b", 3.0)) for i in range(900) if rng.random() < 0.9]
    df = spark.createDataFrame(rows, "SERIES string, D date, Y double").repartition(5)
    x = regression.with_terms(df, F.lit(day(0)), F.lit(day(899)))
    model = {r.SERIES: r for r in regression.fit(x, "SERIES", "Y").collect()}
    for s in "ab":
        got = x.where(F.col("SERIES") == s).select("X", "Y").collect()
        X, y = np.array([r.X for r in got]), np.array([r.Y for r in got])
        b, rss, _, _ = np.linalg.lstsq(X, y, rcond=None)
        assert np.allclose(model[s].B, b, rtol=1e-5, atol=1e-5) and model[s].N == len(y)
        assert model[s].V == pytest.approx(rss[0] / (len(y) - regression.N_TERMS), rel=1e-5)
        assert np.allclose(np.array(model[s].C), np.linalg.inv(X.T @ X), rtol=1e-3, atol=1e-7)


def test_forecast_follows_growth_and_season(spark):
    rng = random.Random(2)
    y = [max(round(grown(rng, i)), 0) for i in range(1185)]
    df = spark.createDataFrame([("s", day(i), v) for i, v in enumerate(y[:1095])], "S string, TS date, Y long")
    ahead = np.array(y[1095:])

    def error(fc):
        rows = sorted(fc.collect(), key=lambda r: r.TS)
        assert [r.TS.date() for r in rows] == [day(i) for i in range(1095, 1185)]
        return np.abs(np.array([r.FORECAST for r in rows]) - ahead).mean(), np.mean([r.LOWER <= v <= r.UPPER for r, v in zip(rows, ahead)])

    new, inside = error(timeseries.seasonal_forecast(df, "S", "TS", "Y", 90))
    old, _ = error(timeseries.weekday_forecast(df, "S", "TS", "Y", 90))
    assert new < 3 and new < old / 5 and inside > 0.88


def test_days_without_rows_count_zero(spark):
    rows = [("a", day(i), 7) for i in range(0, 200, 2)] + [("b", day(199), 1)]
    fc = {(r.SERIES, r.TS): r.FORECAST for r in timeseries.seasonal_forecast(
        spark.createDataFrame(rows, "S string, TS date, Y long"), "S", "TS", "Y", 14).collect()}
    assert len(fc) == 28 and 2 < np.mean([v for (s, _), v in fc.items() if s == "a"]) < 5


def test_false_alarms_of_skewed_series(spark):
    """Gamma noise: quantiles keep the nominal rate on both sides, bounds of a normal curve do not."""
    rng = random.Random(3)
    rows = [(s, day(i), round(1000 * (20 + 3 * (day(i).weekday() == 0) + rng.gammavariate(2, 3)))) for s in "abcdefghijklmnopqrst" for i in range(3000)]
    df = spark.createDataFrame(rows, "S string, TS date, Y long")
    got = timeseries.quantile_anomalies(df, "S", "TS", "Y", eval_months=18).collect()
    rate = np.mean([r.IS_ANOMALY for r in got])
    assert abs(rate - 0.05) < 0.01
    below = np.mean([r.Y < r.LOWER for r in got])
    assert abs(below - 0.025) < 0.01
    normal = timeseries.weekday_anomalies(df, "S", "TS", "Y", eval_months=18).collect()
    assert np.mean([r.Y < r.LOWER for r in normal]) < 0.001  # the normal curve never sees the short side
    p = np.array([r.PERCENTILE for r in got])
    assert abs(p.mean() - 0.5) < 0.02 and p.min() >= 0 and p.max() <= 1


def test_short_series_have_no_expectation(spark):
    rows = [("a", day(i), 5) for i in range(200)] + [("b", day(i), 5) for i in range(0, 200, 9)]
    got = timeseries.quantile_anomalies(spark.createDataFrame(rows, "S string, TS date, Y long"), "S", "TS", "Y", 2).collect()
    assert all((r.EXPECTED is None) == (r.SERIES == "b") for r in got) and {r.SERIES for r in got} == {"a", "b"}
    assert all(r.IS_ANOMALY is None and r.PERCENTILE is None for r in got if r.SERIES == "b")


def test_segments_are_the_lattice(spark):
    """Every frequent, telling segment of up to three dimensions, by trying all."""
    from collections import Counter
    from itertools import combinations

    from carelake.operators import drivers
    rng, rows = random.Random(4), []
    for i in range(1500):
        a, b = rng.choice("xyz"), rng.choice(["p", "q", None])
        c = a.upper() if rng.random() < 0.995 else "W"  # says what a says
        d = rng.choice([f"r{k}" for k in range(40)] + ["big"] * 30)
        label = rng.random() < 0.4
        hot = label and a == "x" and b == "q" and d == "big"
        rows.append((a, b, c, d, label, int(rng.random() < (0.9 if hot else 0.2))))
    dims = ["A", "B", "C", "D"]
    df = spark.createDataFrame(rows, "A string, B string, C string, D string, L boolean, M int").repartition(4)
    got = {r.CONTRIBUTOR: r for r in drivers.segment_drivers(df, "M", "L", dims, min_pct=2, cover=97).collect()}

    count = Counter()
    for r in rows:
        for k in range(4):
            for s in combinations(range(4), k):
                count[tuple((i, r[i] or "NULL") for i in s)] += 1
    frequent = {s for s, n in count.items() if 100 * n >= 2 * len(rows)}
    telling = {s for s in frequent if not any(len(s) > 1 and 100 * count[s] >= 97 * count[s[:j] + s[j + 1:]] for j in range(len(s)))}
    name = lambda s: "[" + ", ".join(f'"{dims[i]} = {v}"' for i, v in s) + "]" if s else drivers.OVERALL
    assert set(got) == {name(s) for s in telling} and len(telling) < len(frequent)
    assert any(len(s) == 3 for s in telling)
    for s in telling:
        assert got[name(s)].TEST_COUNT + got[name(s)].CONTROL_COUNT == count[s]
    top = max((r for k, r in got.items() if k != drivers.OVERALL), key=lambda r: (r.METRIC_TEST or 0) - (r.METRIC_CONTROL or 0))
    assert top.CONTRIBUTOR in ('["A = x", "B = q", "D = big"]', '["B = q", "C = X", "D = big"]')
