"""Every query of the training-data operators runs, and agrees with its SQL where it has one."""

import pytest

from evidlake.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, same, spark, sf):
    if name in SQL:
        same(QUERIES[name], SQL[name])
    else:
        df = QUERIES[name](spark, sf)
        n = df.count()
        # One or two labelled documents a subject, as in the smallest tables, teach nothing.
        assert n > 0 or name.startswith("p9_")
        if name.endswith("_found"):
            assert df.distinct().count() == n
