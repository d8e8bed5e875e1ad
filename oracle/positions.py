"""Oracle SQL by position and by band: plain windows and range joins."""

from __future__ import annotations

from carelake.config import TESTDATA as P

RN = "row_number() OVER (ORDER BY o_totalprice DESC NULLS LAST, o_orderkey)"
HOLIDAY = """((m = 1 AND d = 1) OR (m = 7 AND d = 4) OR (m = 12 AND d = 25) OR (m = 11 AND w = 4 AND d BETWEEN 22 AND 28)
              OR (m = 9 AND w = 1 AND d <= 7) OR (m = 5 AND w = 1 AND d >= 25))"""

EXTRA_CTES = {
    "x_nation_bands": """SELECT c_nationkey, sum(W) OVER (ORDER BY c_nationkey) AS hi, sum(W) OVER (ORDER BY c_nationkey) - W AS lo
             FROM (SELECT c_nationkey, count(*) AS W FROM customer WHERE c_nationkey IS NOT NULL GROUP BY 1)""",
    "x_price_bands": """SELECT p_retailprice, row_number() OVER (ORDER BY p_retailprice) AS hi, row_number() OVER (ORDER BY p_retailprice) - 1 AS lo
             FROM (SELECT DISTINCT p_retailprice FROM part WHERE p_retailprice > 0)""",
}

Q = {
    "w1_order_numbers": f"SELECT o_orderkey, o_totalprice, {RN} AS RN FROM orders",
    "w3_running_order_value": """SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(28,6))) OVER (
             ORDER BY CAST(o_orderdate AS DATE), o_orderkey ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS TOTAL FROM orders""",
    "w5_j11_orders_to_suppliers": f"""
             SELECT o.o_orderkey, o.RN, CASE WHEN RN % 20 < 12 THEN 'FAC-001' WHEN RN % 20 < 15 THEN 'FAC-002'
                    WHEN RN % 20 < 18 THEN 'FAC-003' WHEN RN % 20 < 19 THEN 'FAC-004' ELSE 'FAC-005' END AS FACILITY_ID, s.s_suppkey
             FROM (SELECT o_orderkey, {RN} AS RN FROM orders) o
             JOIN (SELECT s_suppkey, row_number() OVER (ORDER BY s_name, s_suppkey) AS idx FROM supplier) s
               ON s.idx = (o.RN - 1) % (SELECT count(*) FROM supplier) + 1""",
    "c2_orders_by_customer_bands": """
             SELECT o_orderkey, DRAWN, c_nationkey
             FROM (SELECT o_orderkey, (o_orderkey * 7919) % (SELECT count(c_nationkey) FROM customer) + 1 AS DRAWN FROM orders) o
             LEFT JOIN x_nation_bands b ON o.DRAWN > b.lo AND o.DRAWN <= b.hi""",
    "c2_lines_by_price_bands": """
             SELECT p_retailprice, count(*) AS N, CAST(sum(DRAWN) AS BIGINT) AS DRAWN
             FROM (SELECT (l_orderkey * 31 + l_partkey) % (SELECT count(*) FROM x_price_bands) + 1 AS DRAWN FROM lineitem) l
             LEFT JOIN x_price_bands b ON l.DRAWN > b.lo AND l.DRAWN <= b.hi GROUP BY 1""",
    "c1_orders_by_calendar": f"""
             SELECT CASE WHEN m >= 7 THEN y + 1 ELSE y END AS FISCAL_YEAR,
                    CASE WHEN m IN (7, 8, 9) THEN 1 WHEN m IN (10, 11, 12) THEN 2 WHEN m IN (1, 2, 3) THEN 3 ELSE 4 END AS FISCAL_QUARTER,
                    w IN (0, 6) AS IS_WEEKEND, {HOLIDAY} AS IS_HOLIDAY, count(*) AS DAYS, CAST(coalesce(sum(N), 0) AS BIGINT) AS ORDERS
             FROM (SELECT CAST(g AS DATE) AS DD, year(g) AS y, month(g) AS m, day(g) AS d, dayofweek(g) AS w
                   FROM (SELECT unnest(generate_series(TIMESTAMP '{P.calendar_start}', TIMESTAMP '{P.calendar_end}', INTERVAL 1 DAY)) AS g))
             LEFT JOIN (SELECT CAST(o_orderdate AS DATE) AS OD, count(*) AS N FROM orders GROUP BY 1) o ON OD = DD
             GROUP BY ALL""",
}
