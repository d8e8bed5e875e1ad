"""Calendar dimension, one row per day (S12 row generator).

``spark.range`` spreads the days over tasks; every attribute is a built-in
date function, so the whole dimension is one codegen stage.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carelake.functions import compat as C

# US holidays (name, rule on month / day / weekday 0=Sunday).
def _holiday_conds(m, d, dow):
    return [
        ("New Year's Day", (m == 1) & (d == 1)),
        ("Independence Day", (m == 7) & (d == 4)),
        ("Christmas Day", (m == 12) & (d == 25)),
        ("Thanksgiving", (m == 11) & (dow == 4) & d.between(22, 28)),
        ("Labor Day", (m == 9) & (dow == 1) & (d <= 7)),
        ("Memorial Day", (m == 5) & (dow == 1) & (d >= 25)),
    ]


def date_dim(spark: SparkSession, start: dt.date, end: dt.date) -> DataFrame:
    n = (end - start).days + 1
    d = F.col("FULL_DATE")
    base = spark.range(n).select(F.date_add(F.lit(start), F.col("id").cast("int")).alias("FULL_DATE"))
    m, day, dow = F.month(d), F.dayofmonth(d), C.dow_sunday0(d)
    name = F
    flag = F.lit(False)
    for label, cond in _holiday_conds(m, day, dow):
        name = name.when(cond, F.lit(label))
        flag = flag | cond
    return base.select(
        C.date_key(d).alias("DATE_KEY"),
        d,
        F.year(d).alias("YEAR"),
        F.quarter(d).alias("QUARTER"),
        m.alias("MONTH"),
        C.month_abbrev(d).alias("MONTH_NAME"),
        day.alias("DAY_OF_MONTH"),
        dow.alias("DAY_OF_WEEK"),
        C.day_abbrev(d).alias("DAY_NAME"),
        F.weekofyear(d).alias("WEEK_OF_YEAR"),
        F.when(m >= 7, F.year(d) + 1).otherwise(F.year(d)).alias("FISCAL_YEAR"),
        F.when(m.isin(7, 8, 9), 1).when(m.isin(10, 11, 12), 2).when(m.isin(1, 2, 3), 3).otherwise(4)
         .alias("FISCAL_QUARTER"),
        dow.isin(0, 6).alias("IS_WEEKEND"),
        flag.alias("IS_HOLIDAY"),
        name.otherwise(F.lit(None).cast("string")).alias("HOLIDAY_NAME"),
    )
