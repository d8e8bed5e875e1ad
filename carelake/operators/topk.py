"""T4/T5: ORDER BY ... LIMIT k.

``orderBy().limit(k)`` plans as ``TakeOrderedAndProject``: every task keeps
its own k best rows and only k x tasks rows reach the final merge, so the
result never gathers a whole table. Callers pass explicit null ordering and a
unique tie-breaker so the k rows are deterministic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(k)
