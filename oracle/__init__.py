"""DuckDB oracle: the adapter and the marts written as plain SQL over the
driver's raw views, independent of the Spark code. Used by
``__spark_entry__.oracle_sql`` and by the tests.
"""

from oracle.sql import ORACLE_SQL, with_ctes  # noqa: F401
