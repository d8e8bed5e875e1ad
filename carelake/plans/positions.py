"""Queries by position and by band over the driver tables: W1, W3, W5, J5, J6, J11, C1, C2."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelake.operators import bands, calendar, numbering
from carelake.sources.adapter import Tables

# Of 20 rows in order, the facility's upper bounds.
FACILITY_SHARES = [(12, "FAC-001"), (15, "FAC-002"), (18, "FAC-003"), (19, "FAC-004"), (20, "FAC-005")]


def _numbered_orders(t: Tables) -> DataFrame:
    orders = t.raw("orders").select("o_orderkey", "o_totalprice")
    return numbering.number_rows(orders, [F.desc_nulls_last("o_totalprice"), F.asc_nulls_last("o_orderkey")])


def w1_order_numbers(t: Tables) -> DataFrame:
    """All orders numbered from the dearest on."""
    return _numbered_orders(t)


def w3_running_order_value(t: Tables) -> DataFrame:
    """Value of all orders up to each one, by date."""
    orders = t.raw("orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("o_orderdate"), "o_totalprice")
    out = numbering.running_total(orders, [F.asc_nulls_first("o_orderdate"), F.asc_nulls_first("o_orderkey")], "o_totalprice", "TOTAL")
    return out.select("o_orderkey", F.col("TOTAL").cast("double").alias("TOTAL"))


def w5_j11_orders_to_suppliers(t: Tables) -> DataFrame:
    """Facility by the order's number, and the supplier whose turn it is (suppliers by name, over and over)."""
    orders = _numbered_orders(t).withColumn("FACILITY_ID", numbering.bucket_of(F.col("RN"), 20, FACILITY_SHARES))
    suppliers = t.raw("supplier").select("s_suppkey", "s_name")
    out = numbering.join_positions(orders, "RN", suppliers, [F.asc_nulls_first("s_name"), F.asc_nulls_first("s_suppkey")])
    return out.select("o_orderkey", "RN", "FACILITY_ID", "s_suppkey")


def c2_orders_by_customer_bands(t: Tables) -> DataFrame:
    """C2 (W3, J5, J6): nations weighted by their customers; each order draws a number and gets the nation whose band holds it."""
    weights = t.raw("customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("W")).where("c_nationkey is not null")
    total = t.raw("customer").agg(F.count("c_nationkey")).scalar()
    drawn = t.raw("orders").select("o_orderkey", (F.pmod(F.col("o_orderkey") * 7919, F.nullif(total, F.lit(0))) + 1).alias("DRAWN"))
    out = bands.lookup_band(drawn, "DRAWN", bands.running_bands(weights, "c_nationkey", "W"), "c_nationkey")
    return out.select("o_orderkey", "DRAWN", "c_nationkey")


def c2_lines_by_price_bands(t: Tables) -> DataFrame:
    """J5 with as many bands as parts have prices: each claim line draws a number and gets the price whose band holds it."""
    prices = t.raw("part").select("p_retailprice").distinct().where("p_retailprice > 0")
    bounds = bands.running_bands(prices.withColumn("W", F.lit(1)), "p_retailprice", "W")
    n = t.raw("part").agg(F.count_distinct(F.when(F.col("p_retailprice") > 0, F.col("p_retailprice")))).scalar()
    lines = t.raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey",
                                     (F.pmod(F.col("l_orderkey") * 31 + F.col("l_partkey"), F.nullif(n, F.lit(0))) + 1).alias("DRAWN"))
    out = bands.lookup_band(lines, "DRAWN", bounds, "p_retailprice")
    return out.groupBy("p_retailprice").agg(F.count(F.lit(1)).alias("N"), F.sum("DRAWN").alias("DRAWN"))


def c1_orders_by_calendar(t: Tables) -> DataFrame:
    """C1 over the orders: the calendar's days with their orders, by fiscal quarter, weekend and holiday."""
    days = calendar.date_dim(t.spark, t.profile.calendar_start, t.profile.calendar_end)
    per_day = t.raw("orders").groupBy(F.col("o_orderdate").cast("date").alias("FULL_DATE")).agg(F.count(F.lit(1)).alias("N"))
    out = days.join(per_day, "FULL_DATE", "left")
    return out.groupBy("FISCAL_YEAR", "FISCAL_QUARTER", "IS_WEEKEND", "IS_HOLIDAY").agg(
        F.count(F.lit(1)).alias("DAYS"), F.coalesce(F.sum("N"), F.lit(0)).alias("ORDERS"))


QUERIES = {name: fn for name, fn in dict(globals()).items() if callable(fn) and re.match(r"^(w|c)\d_", name)}
