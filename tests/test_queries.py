"""Every query of the core runs, and agrees with its SQL."""

import pytest

from evidlake import plans

QUERIES, SQL = plans.queries(), plans.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, same, spark, sf):
    if name in SQL:
        same(QUERIES[name], SQL[name])
    else:
        df = QUERIES[name](spark, sf)
        assert df.columns
        assert df.count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
