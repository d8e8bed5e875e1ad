"""Pivots for display matrices.

With an explicit value list Spark skips the extra distinct job and the pivot
compiles to one aggregate with one conditional column per value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WEEKDAYS = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]


def pivot_matrix(df: DataFrame, rows: list[str], column: str, value: str, values: list | None = None,
                 how: str = "first") -> DataFrame:
    agg = {"first": F.first, "avg": F.avg, "sum": F.sum, "max": F.max}[how]
    g = df.groupBy(*rows)
    g = g.pivot(column, values) if values is not None else g.pivot(column)
    return g.agg(agg(value))
