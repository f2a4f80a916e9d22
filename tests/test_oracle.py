"""Every core query against its DuckDB SQL on the smallest tables."""

from __future__ import annotations

import oracle
import pytest

from basalt import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, sf, name):
    _, differs = oracle.compare(spark, con, QUERIES[name], SQL[name], sf)
    assert not differs


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
