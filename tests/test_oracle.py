"""Every hospital query against its DuckDB oracle on sf0.001."""

import pytest

import __spark_entry__ as E
from carelake.plans.registry import all_queries
from tests.compare import canon, duck, is_ordered
from tests.conftest import SF001

QUERIES = E.queries()
SQL = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


def test_every_query_has_oracle():
    assert set(all_queries()) <= set(SQL) <= set(QUERIES)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["FACILITY_NAME", "TOTAL_ENCOUNTERS", "READMISSIONS", "READMISSION_RATE_PCT"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF001)
    srows, scols = [tuple(r) for r in df.collect()], df.columns
    rel = con.sql(SQL[name])
    drows, dcols = rel.fetchall(), rel.columns
    assert sorted(scols) == sorted(dcols)
    in_order = is_ordered(SQL[name])
    assert canon(srows, scols, in_order) == canon(drows, dcols, in_order)
