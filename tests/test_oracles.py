"""Every query of the plans against its SQL oracle, on whole tables."""

import oracle
import pytest

from itemforge.plans import PLANS

QUERIES = {n: (q, plan.ORACLES[n]) for plan in PLANS for n, q in plan.QUERIES.items()}


@pytest.fixture(scope="module")
def con():
    return oracle.connect()


@pytest.mark.parametrize("name", QUERIES)
def test_oracle(spark, con, name):
    query, sql = QUERIES[name]
    assert oracle.rows_of_spark(query(spark, oracle.DATA)) == oracle.rows_of_duckdb(con, sql)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
