"""Operators checked against brute force on small literal inputs."""

import datetime as dt
import itertools

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from carelake.functions import masking as MK
from carelake.functions.stats import normal_cdf
from carelake.operators import bands, calendar, control_chart, drivers, pivot, stay_days, timeseries, topk
from carelake.plans import governance as G
from tests import fakes
from tests.fakes import FakeTables

D = dt.date


def test_stay_days_equals_naive_range_join(spark):
    stays = [("open", D(2024, 12, 20), None), ("reversed", D(2024, 5, 10), D(2024, 5, 1)),
             ("same", D(2024, 3, 3), D(2024, 3, 3)), ("left_edge", D(2023, 6, 25), D(2023, 7, 3)),
             ("right_edge", D(2024, 12, 28), D(2025, 1, 4)), ("inside", D(2024, 2, 27), D(2024, 3, 2))]
    lo, hi = D(2023, 7, 1), D(2024, 12, 30)
    df = spark.createDataFrame(stays, "ID string, S date, E date")
    got = sorted((r.ID, r.DAY) for r in stay_days.expand_stay_days(df, "S", "E", lo, hi).collect())
    spine = [lo + dt.timedelta(days=i) for i in range((hi - lo).days + 1)]
    want = sorted((i, d) for i, s, e in stays for d in spine if s <= d <= (e if e is not None else d))
    assert got == want
    # The rewrite plans without a nested-loop join.
    plan = stay_days.expand_stay_days(df, "S", "E", lo, hi)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan


def test_calendar_matches_duckdb_rules(spark):
    lo, hi = D(2023, 1, 1), D(2025, 12, 31)
    got = calendar.date_dim(spark, lo, hi).toPandas()
    assert len(got) == 1096
    con = duckdb.connect()
    want = con.sql(f"""
        SELECT d AS FULL_DATE, year(d) * 10000 + month(d) * 100 + day(d) AS DATE_KEY, dayofweek(d) AS DOW,
               strftime(d, '%a') AS DAY_NAME, strftime(d, '%b') AS MONTH_NAME, weekofyear(d) AS WEEK_OF_YEAR,
               CASE WHEN month(d) >= 7 THEN year(d) + 1 ELSE year(d) END AS FISCAL_YEAR
        FROM (SELECT CAST(unnest(generate_series(DATE '{lo}', DATE '{hi}', INTERVAL 1 DAY)) AS DATE) AS d)
        ORDER BY 1""").df()
    got = got.sort_values("FULL_DATE").reset_index(drop=True)
    assert list(got.DATE_KEY) == list(want.DATE_KEY)
    assert list(got.DAY_OF_WEEK) == list(want.DOW)
    assert list(got.DAY_NAME) == list(want.DAY_NAME) and list(got.MONTH_NAME) == list(want.MONTH_NAME)
    assert list(got.WEEK_OF_YEAR) == list(want.WEEK_OF_YEAR) and list(got.FISCAL_YEAR) == list(want.FISCAL_YEAR)
    hol = dict(zip(got.FULL_DATE.astype(str), got.HOLIDAY_NAME))
    assert hol["2024-11-28"] == "Thanksgiving" and hol["2024-09-02"] == "Labor Day"
    assert hol["2024-05-27"] == "Memorial Day" and hol["2024-07-04"] == "Independence Day"
    assert got.IS_HOLIDAY.sum() == 18 and got[got.FULL_DATE == D(2024, 6, 1)].IS_WEEKEND.item()


def test_weighted_band_lookup(spark):
    w = spark.createDataFrame([("A", 3.0), ("B", 1.0), ("C", 6.0)], "CAT string, W double")
    b = bands.cumulative_bands(w, "CAT", "W")
    vals = spark.createDataFrame([(0.5,), (3.0,), (3.5,), (4.0,), (9.99,), (10.0,), (10.5,)], "V double")
    got = {r.V: r.CAT for r in bands.assign_band(vals, "V", b, "CAT").collect()}
    assert got == {0.5: "A", 3.0: "A", 3.5: "B", 4.0: "B", 9.99: "C", 10.0: "C", 10.5: None}


def test_top_k_null_order_and_ties(spark):
    df = spark.createDataFrame([("a", None), ("b", 1.0), ("c", 1.0), ("d", 0.5)], "K string, V double")
    low = topk.top_k(df, 1, F.asc_nulls_last("V"), F.asc("K")).first()
    high = topk.top_k(df, 2, F.desc_nulls_first("V"), F.asc("K")).collect()
    assert low.K == "d" and [r.K for r in high] == ["a", "b"]


def test_key_drivers_against_pandas(spark):
    rows = []
    for i in range(400):
        rows.append((i % 3 == 0, "x" if i % 2 else "y", "p" if i % 5 else "q", i % 7 < 2 if i < 150 else i % 7 < 4))
    pdf = pd.DataFrame(rows, columns=["L", "D1", "D2", "M"]).assign(M=lambda d: d.M.astype(int))
    df = spark.createDataFrame(pdf)
    got = {r.CONTRIBUTOR: r for r in drivers.key_drivers(df, "M", "L", ["D1", "D2"]).collect()}
    t, c = pdf[pdf.L], pdf[~pdf.L]
    change = abs(t.M.mean() - c.M.mean())
    segs = [({"D1": v},) for v in "xy"] + [({"D2": v},) for v in "pq"] + \
           [({"D1": a, "D2": b},) for a, b in itertools.product("xy", "pq")]
    for (seg,) in segs:
        mt = (t[list(seg)] == pd.Series(seg)).all(axis=1)
        mc = (c[list(seg)] == pd.Series(seg)).all(axis=1)
        key = "[" + ", ".join(f'"{k} = {v}"' for k, v in seg.items()) + "]"
        contrib = mt.sum() / len(t) * t[mt].M.mean() - mc.sum() / len(c) * c[mc].M.mean()
        assert got[key].CONTRIBUTION == pytest.approx(round(contrib, 6), abs=1e-6)
        assert got[key].RELATIVE_CONTRIBUTION == pytest.approx(round(contrib / change, 6), abs=1e-6)
        assert got[key].TEST_COUNT == mt.sum() and got[key].CONTROL_COUNT == mc.sum()
    assert drivers.OVERALL in got


def test_forecast_and_anomaly_shapes(spark):
    base = D(2024, 1, 1)
    rows = [(s, base + dt.timedelta(days=i), (i % 7) + (3 if s == "a" else 0))
            for s in ("a", "b") for i in range(200) if not (s == "b" and i % 10 == 0)]
    df = spark.createDataFrame(rows, "S string, TS date, Y long")
    fc = timeseries.weekday_forecast(df, "S", "TS", "Y", horizon=30).collect()
    assert len(fc) == 60
    a = [r for r in fc if r.SERIES == "a"]
    assert all(r.LOWER == r.FORECAST == r.UPPER for r in a)   # perfectly periodic -> zero spread
    an = timeseries.weekday_anomalies(df, "S", "TS", "Y", eval_months=2).collect()
    assert {r.SERIES for r in an} == {"a", "b"}
    # one scored row per row of the evaluation side; days without a row are not made up
    assert sorted((r.SERIES, r.TS.date()) for r in an) == sorted((s, d) for s, d, _ in rows if d >= D(2024, 5, 18))
    cdf = spark.range(1).select(normal_cdf(F.lit(0.0)).alias("a"), normal_cdf(F.lit(1.96)).alias("b"),
                                normal_cdf(F.lit(-1.0)).alias("c")).first()
    assert cdf.a == pytest.approx(0.5, abs=1e-7) and cdf.b == pytest.approx(0.9750021, abs=1e-6)
    assert cdf.c == pytest.approx(0.1586553, abs=1e-6)


def test_p_chart(spark):
    m = spark.createDataFrame([(D(2024, 1, 1), 100, 5, 5.0), (D(2024, 2, 1), 100, 35, 35.0),
                               (D(2024, 3, 1), 100, 20, 20.0)],
                              "MONTH date, N long, READMITS long, RATE double")
    out = {r.MONTH: r for r in control_chart.p_chart(m).collect()}
    assert out[D(2024, 1, 1)].P_BAR_PCT == 20.0
    assert out[D(2024, 2, 1)].OUT_OF_CONTROL and out[D(2024, 1, 1)].OUT_OF_CONTROL
    assert not out[D(2024, 3, 1)].OUT_OF_CONTROL
    assert out[D(2024, 1, 1)].UCL == pytest.approx(32.0, abs=1e-9)


def test_pivot_fixed_columns(spark):
    df = spark.createDataFrame([("A", "Mon", 1.0), ("A", "Tue", 2.0), ("B", "Sun", 3.0)], "R string, C string, V double")
    out = pivot.pivot_matrix(df, ["R"], "C", "V", pivot.WEEKDAYS)
    assert out.columns == ["R"] + pivot.WEEKDAYS
    assert {r.R: r.Sun for r in out.collect()} == {"A": None, "B": 3.0}


@pytest.mark.parametrize("role", MK.ROLES)
def test_masks_by_role(spark, role):
    df = spark.createDataFrame([("123-45-6789", D(1980, 5, 17), "Ann", "MRN-1", "(555) 555-1234", "a@x.org"),
                                (None, None, None, None, None, None)],
                               "SSN string, DOB date, FIRST_NAME string, MRN string, PHONE string, EMAIL string")
    r, n = G.mask_columns(df, role).collect()
    roles = MK.roles_in_session(role)
    full = bool(roles & {MK.ADMIN, MK.CLINICIAN, MK.ENGINEER})
    if MK.ADMIN in roles:
        assert r.SSN == "123-45-6789"
    elif full:
        assert r.SSN == "XXX-XX-6789" and n.SSN is None
    else:
        assert r.SSN == "***-**-****" and n.SSN == "***-**-****"
    assert r.DOB == (D(1980, 5, 17) if full else D(1980, 1, 1))
    assert r.FIRST_NAME == "Ann" if full else r.FIRST_NAME.startswith("PATIENT_") and len(r.FIRST_NAME) == 16
    assert r.MRN == ("MRN-1" if full else "***MRN***")
    if full:
        assert r.PHONE == "(555) 555-1234"
    elif role == MK.ANALYST:
        assert r.PHONE == "(***) ***-1234"
    else:
        assert r.PHONE == "**********"
    assert r.EMAIL == ("a@x.org" if full else "****@x.org")


def test_admin_inherits_all_roles():
    assert MK.roles_in_session(MK.ADMIN) == frozenset(MK.ROLES)
    assert MK.roles_in_session(MK.FINANCE) == frozenset({MK.FINANCE})


def test_row_access_by_role(spark):
    frames = {
        "dim_department": spark.createDataFrame(
            [(f"DEPT-{i:03d}", f"D{i}", "INPATIENT", "FAC-001") for i in range(1, 26)], fakes.DEPT),
        "dim_facility": spark.createDataFrame([(f"FAC-{i:03d}", f"F{i}") for i in range(1, 6)], fakes.FAC),
    }
    t = FakeTables(spark, frames)
    facts = spark.createDataFrame([(f"DEPT-{i:03d}",) for i in range(1, 26)], "DEPT_ID string")
    seen = {r: G.secure(facts, r, t, "fct_encounter").count() for r in MK.ROLES}
    assert seen == {MK.ADMIN: 25, MK.ENGINEER: 25, MK.ANALYST: 25, MK.CLINICIAN: 25, MK.FINANCE: 5, MK.EXEC: 25}
    ors = spark.createDataFrame([(f"FAC-{i:03d}",) for i in range(1, 6)], "FACILITY_ID string")
    assert G.secure(ors, MK.FINANCE, t, "fct_or_case").count() == 3


def test_tags_are_validated(spark):
    df = spark.createDataFrame([("1", "a")], "SSN string, X string")
    tagged = G.tag_columns(df, {"SSN": {"DATA_CLASSIFICATION": "PHI", "PII_TYPE": "SSN"}})
    report = G.tag_report(tagged, "DIM_PATIENT")
    assert report.columns == ["TABLE_NAME", "COLUMN_NAME", "TAG", "VALUE"]
    assert {tuple(r)[1:] for r in report.collect()} == {
        ("SSN", "DATA_CLASSIFICATION", "PHI"), ("SSN", "PII_TYPE", "SSN"),
        (None, "DATA_DOMAIN", "DEMOGRAPHIC"), (None, "RETENTION_POLICY", "7_YEARS")}
    with pytest.raises(ValueError):
        G.tag_columns(df, {"SSN": {"DATA_CLASSIFICATION": "SECRET"}})


def test_visible_rows_count_the_fact_once(spark):
    frames = {
        "dim_department": spark.createDataFrame(
            [(f"DEPT-{i:03d}", f"D{i}", "INPATIENT", "FAC-001") for i in range(1, 26)], fakes.DEPT),
        "fct_encounter": spark.createDataFrame([(f"DEPT-{i % 30:03d}",) for i in range(300)] + [(None,)], "DEPT_ID string"),
    }
    t = FakeTables(spark, frames)
    got = {r.ROLE_NAME: r.VISIBLE_ROWS for r in G.visible_rows_by_role(t, "fct_encounter").collect()}
    assert got == {r: G.secure(frames["fct_encounter"], r, t, "fct_encounter").count() for r in MK.ROLES}
    assert got[MK.ADMIN] == 301 and got[MK.FINANCE] == 50


def test_daily_levels_equal_expanded_days(spark):
    import random
    rnd = random.Random(3)
    rows = [(rnd.choice("ab"), f"E{rnd.randrange(60)}", D(2024, 1, 1) + dt.timedelta(days=rnd.randrange(90)), rnd.randrange(-2, 20))
            for _ in range(200)]
    rows = [(k, e, s, None if n == 19 else s + dt.timedelta(days=n)) for k, e, s, n in rows]
    df = spark.createDataFrame(rows, "K string, E string, S date, T date")
    lo, hi = D(2024, 1, 20), D(2024, 3, 10)
    want = {}
    for r in stay_days.expand_stay_days(df, "S", "T", lo, hi).collect():
        n, seen = want.setdefault((r.K, r.DAY), [0, set()])
        want[(r.K, r.DAY)][0] += 1
        seen.add(r.E)
    clipped = stay_days.clip_stays(df, "S", "T", lo, hi)
    one = F.lit(1).cast("long")
    events = stay_days.changes(clipped, ["K"], {"N": one}).unionByName(
        stay_days.changes(stay_days.merge_stays(clipped, ["K", "E"]), ["K"], {"H": one}), allowMissingColumns=True)
    got = {(r.K, r.DAY): (r.N, r.H) for r in stay_days.daily_levels(events, ["K"], ["N", "H"]).collect()}
    assert got == {k: (n, len(seen)) for k, (n, seen) in want.items()}


def test_numbers_longer_than_their_width_stay_whole(spark):
    from carelake.sources.adapter import lpad_num
    got = [r[0] for r in spark.range(1).select(F.explode(F.array(F.lit(7), F.lit(1234567), F.lit(12345670))).alias("x"))
           .select(lpad_num(F.col("x"), 7)).collect()]
    assert got == ["0000007", "1234567", "12345670"]


def test_sums_keep_four_decimals_and_do_not_depend_on_order(spark):
    from carelake.functions import compat as C
    df = spark.createDataFrame([(1.7893,), (1.0672,), (None,)], "W double")
    assert df.agg(C.exact_sum("W")).first()[0] == 2.8565
    big = spark.createDataFrame([(0.1,)] * 1000 + [(1e9,), (-1e9,)], "W double")
    assert {big.repartition(n).agg(C.exact_sum("W")).first()[0] for n in (1, 3, 7)} == {100.0}
    assert df.where("W is null").agg(C.exact_avg("W")).first()[0] is None
