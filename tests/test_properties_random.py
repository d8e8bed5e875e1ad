"""Randomised checks of the operators with the most edge cases."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from carelake.operators.stay_days import expand_stay_days

BASE = dt.date(2024, 1, 1)
day = st.integers(min_value=-20, max_value=80).map(lambda n: BASE + dt.timedelta(days=n))
stay = st.tuples(day, st.one_of(st.none(), day))


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(stays=st.lists(stay, min_size=1, max_size=25),
       lo=st.integers(min_value=-10, max_value=30), span=st.integers(min_value=0, max_value=40))
def test_stay_days_matches_naive_join(spark, stays, lo, span):
    lo_d = BASE + dt.timedelta(days=lo)
    hi_d = lo_d + dt.timedelta(days=span)
    rows = [(i, s, e) for i, (s, e) in enumerate(stays)]
    df = spark.createDataFrame(rows, "ID int, S date, E date")
    got = sorted((r.ID, r.D) for r in expand_stay_days(df, "S", "E", lo_d, hi_d, "D").collect())
    spine = [lo_d + dt.timedelta(days=k) for k in range(span + 1)]
    want = sorted((i, d) for i, s, e in rows for d in spine if s <= d <= (e if e is not None else d))
    assert got == want
