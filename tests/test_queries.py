"""Every registered query of the engine's own operators, against its oracle where it has one."""

from __future__ import annotations

import pytest

from oracle import compare, connection
from palimpsest.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connection(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    if name in ORACLE_SQL:
        compare(df, con, ORACLE_SQL[name])
    else:
        assert df.columns and df.count() >= 0


def test_oracles_belong_to_queries():
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_entry_runs(spark, sf_dir):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
