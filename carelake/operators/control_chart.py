"""K1: Shewhart p-chart over monthly counts.

p-bar = sum(events) / sum(n) over all months (a window over the monthly rows,
so they are worked out once); per month
UCL/LCL = p-bar +/- 3 sqrt(p-bar (1 - p-bar) / n), in percent, clamped to
[0, 100]. A month is out of control when its (already rounded) rate lies
beyond a limit. Input is one row per month, so nothing here grows with the
fact table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def p_chart(monthly: DataFrame, n: str = "N", events: str = "READMITS", rate: str = "RATE",
            digits: int = 4) -> DataFrame:
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    pbar = F.sum(events).over(everything) / F.sum(n).over(everything)
    half = F.lit(3.0) * F.sqrt(pbar * (F.lit(1.0) - pbar) / F.col(n))
    ucl = F.least(F.lit(100.0), (pbar + half) * 100)
    lcl = F.greatest(F.lit(0.0), (pbar - half) * 100)
    return monthly.select(
        "*",
        F.round(pbar * 100, digits).alias("P_BAR_PCT"),
        F.round(ucl, digits).alias("UCL"),
        F.round(lcl, digits).alias("LCL"),
        ((F.col(rate) > ucl) | (F.col(rate) < lcl)).alias("OUT_OF_CONTROL"),
    )
