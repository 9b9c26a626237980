"""Every registered query of the library proper against its SQL, or for rows."""

import pytest

from siteloom import plans

from .compare import database, same

QUERIES, SQL = plans.queries(), plans.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return database(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf_dir, name):
    if name in SQL:
        same(spark, con, QUERIES[name], SQL[name], sf_dir)
    else:
        df = QUERIES[name](spark, sf_dir)
        assert df.columns and df.count() > 0


def test_entry_module(spark):
    import __spark_entry__ as entry

    found = entry.queries()
    assert set(entry.oracle_sql()) <= set(found) and set(QUERIES) <= set(found)
    assert entry.entry(spark).count() > 0
