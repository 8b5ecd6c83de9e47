"""Every query of the library against its SQL, over the smallest tables."""

import os

import pytest

from thermoflux.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_sql(name, same_as_sql):
    same_as_sql(registry.QUERIES[name], registry.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_without_sql_gives_whole_rows(name, spark):
    """Rows, and in every column some value that is no null; the values are recomputed in test_models_recomputed.py and test_operators.py."""
    rows = registry.QUERIES[name](spark, DATA).collect()
    assert rows
    assert all(any(r[c] is not None for r in rows) for c in rows[0].__fields__)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
