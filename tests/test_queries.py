"""Every registered query of the library that has SQL gives the rows of the SQL."""

from __future__ import annotations

import pytest
from oracle import DATA, compare, connect


from panelwright.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def con():
    return connect(f"{DATA}/sf0.01")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, con, name):
    assert compare(spark, con, name, QUERIES[name], ORACLE_SQL[name], f"{DATA}/sf0.01") is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, f"{DATA}/sf0.001").count() > 0
