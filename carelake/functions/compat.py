"""Column helpers for the source dialect's semantics.

All helpers return built-in Spark Columns, so they stay inside whole-stage
codegen; none is a UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def concat_strict(*parts) -> Column:
    """``a || b``: any null part nulls the result (E-1)."""
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def month_start(c) -> Column:
    """``DATE_TRUNC('MONTH', d)`` kept as DATE (E-12)."""
    return F.trunc(col(c).cast("date"), "MM")


def quarter_label(c) -> Column:
    """``YEAR(d)::STRING || '-Q' || QUARTER(d)::STRING`` (E-18)."""
    d = col(c)
    return F.concat(F.year(d).cast("string"), F.lit("-Q"), F.quarter(d).cast("string"))


def days_between(start, end) -> Column:
    """``DATEDIFF(DAY, start, end)``: day boundaries crossed (E-13)."""
    return F.datediff(col(end).cast("date"), col(start).cast("date"))


def years_between(start, end) -> Column:
    """``DATEDIFF(YEAR, start, end)``: year boundaries, not whole years (E-13)."""
    return F.year(col(end)) - F.year(col(start))


def minutes_between(start, end) -> Column:
    """``DATEDIFF(MINUTE, start, end)``: minute boundaries crossed; negative
    when ``end`` precedes ``start`` (E-13)."""
    s = F.date_trunc("minute", col(start).cast("timestamp"))
    e = F.date_trunc("minute", col(end).cast("timestamp"))
    return ((F.unix_seconds(e) - F.unix_seconds(s)) / 60).cast("long")


def add_minutes(ts, minutes) -> Column:
    return F.timestamp_add("MINUTE", col(minutes).cast("long"), col(ts))


def dow_sunday0(c) -> Column:
    """``DAYOFWEEK`` with 0 = Sunday (E-10)."""
    return F.dayofweek(col(c)) - 1


def day_abbrev(c) -> Column:
    """``DAYNAME``: three-letter English day (E-9)."""
    return F.dayname(col(c))


def month_abbrev(c) -> Column:
    """``MONTHNAME``: three-letter English month (E-9)."""
    return F.monthname(col(c))


def date_key(c) -> Column:
    """Integer ``YYYYMMDD`` key (E-15)."""
    d = col(c)
    return F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)


def safe_div(num, den) -> Column:
    """``num / NULLIF(den, 0)``; ANSI Spark raises on /0, so every divisor is
    guarded (A10, E-28)."""
    n, d = col(num), col(den)
    return F.when(d != 0, n.cast("double") / d)


def flag01(c) -> Column:
    """``CASE WHEN flag THEN 1 ELSE 0 END``; a null flag counts as 0."""
    return F.when(col(c), F.lit(1)).otherwise(F.lit(0))


def rate_pct(flag, digits: int = 1) -> Column:
    """``ROUND(AVG(CASE WHEN flag THEN 1 ELSE 0 END)*100, digits)``."""
    return F.round(F.avg(flag01(flag)) * 100, digits)


def count_if(c) -> Column:
    """``COUNT_IF`` as BIGINT."""
    return F.count_if(col(c)).cast("long")


def count_rate_pct(flag, digits: int = 1) -> Column:
    """``ROUND(COUNT_IF(flag) / COUNT(*) * 100, digits)`` (verified queries)."""
    return F.round(F.count_if(col(flag)) / F.count(F.lit(1)) * 100, digits)


def hash_bucket_100(c) -> Column:
    """Stand-in for ``ABS(MOD(HASH(x), 100))`` (E-7). The vendor hash is not
    public; the first 32 bits of MD5 give a portable, reproducible bucket."""
    return (F.conv(F.substring(F.md5(col(c).cast("string")), 1, 8), 16, 10).cast("long") % 100)


def millions(c, digits: int) -> Column:
    """``ROUND(x/1e6, digits)``."""
    return F.round(col(c) / F.lit(1e6), digits)


# A double SUM depends on the order in which partial sums are combined, so two
# runs (or a SQL oracle) can land on either side of a rounding tie. Sums and
# averages of amounts go through DECIMAL instead: exact, order-independent, and
# the same for every column. Six decimals keep amounts, weights (four) and the
# marts' stored rates whole; the sum has 32 digits before the point.
AMOUNT_DECIMALS = 6


def exact_sum(c, decimals: int = AMOUNT_DECIMALS) -> Column:
    """``SUM(CAST(x AS DECIMAL(28, decimals)))`` as DOUBLE."""
    return F.sum(col(c).cast(f"decimal(28,{decimals})")).cast("double")


def exact_avg(c, decimals: int = AMOUNT_DECIMALS) -> Column:
    """Exact sum over the non-null count; null if there is none."""
    n = F.count(col(c))
    return F.when(n > 0, exact_sum(c, decimals) / n)
