"""Run parameters. Every date that the reference reads from the wall clock or
hard-codes for its demo period is a parameter here, so runs are reproducible."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Profile:
    # CURRENT_DATE stand-in (days-since-referral).
    as_of: dt.date
    # Calendar dimension span.
    calendar_start: dt.date
    calendar_end: dt.date
    # Census date window for the staffing mart (M5).
    census_start: dt.date
    census_end: dt.date
    # Freshness threshold for D12/D13.
    freshness_date: dt.date
    # "Last quarter" of actuals shown next to the forecast (Q49).
    recent_start: dt.date = dt.date(2024, 10, 1)
    recent_end: dt.date = dt.date(2024, 12, 30)
    # Row minimums for D1-D4 (mart name -> rows).
    row_minimums: dict = field(default_factory=dict)
    # Forecast horizon (L1), anomaly evaluation window in months (L2/V5),
    # driver label window in months (V3/V4).
    forecast_days: int = 90
    eval_months: int = 6
    label_months: int = 3


# Fixed values of the reference deployment (demo period Jul 2023 - Dec 2024).
REFERENCE = Profile(
    as_of=dt.date(2025, 1, 1),
    calendar_start=dt.date(2023, 1, 1),
    calendar_end=dt.date(2025, 12, 31),
    census_start=dt.date(2023, 7, 1),
    census_end=dt.date(2024, 12, 30),
    freshness_date=dt.date(2024, 12, 1),
    row_minimums={
        "MART_READMISSION_LOS": 100000,
        "MART_PATIENT_LEAKAGE": 40000,
        "MART_OR_CAPACITY": 25000,
        "MART_DENIALS_REVCYCLE": 100000,
    },
)

# Driver test tables: orders span 1995-01-01 .. 2001-08-01, ship dates run to
# 2001-11-04. Same thresholds as the reference; only the dates move.
TESTDATA = Profile(
    as_of=dt.date(2002, 1, 1),
    calendar_start=dt.date(1995, 1, 1),
    calendar_end=dt.date(2002, 12, 31),
    census_start=dt.date(1995, 1, 1),
    census_end=dt.date(2001, 12, 30),
    freshness_date=dt.date(2001, 7, 1),
    recent_start=dt.date(2001, 5, 1),
    recent_end=dt.date(2001, 7, 30),
    row_minimums=dict(REFERENCE.row_minimums),
)
