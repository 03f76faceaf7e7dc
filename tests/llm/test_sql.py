"""Queries of the training-data operators that have SQL give its rows."""

from __future__ import annotations

import pytest
from oracle import DATA, compare, connect

from panelwright.llm import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, name):
    assert compare(spark, connect(f"{DATA}/sf0.01"), name, QUERIES[name], ORACLE_SQL[name], f"{DATA}/sf0.01") is None
