"""Every registered query against its DuckDB oracle at sf0.01 (the driver's
correctness gate, run locally)."""

import pytest

from quire.plans.oracle import oracle_sql
from quire.plans.registry import queries

from .conftest import SF_ORACLE
from .oracle_compare import compare, duck

KEYS = sorted(oracle_sql())


@pytest.fixture(scope="module")
def con():
    return duck(SF_ORACLE)


def test_every_query_has_an_oracle_or_is_listed():
    missing = set(queries()) - set(oracle_sql())
    assert not missing, missing


@pytest.mark.parametrize("name", KEYS)
def test_matches_duckdb(spark, con, name):
    rows, problems = compare(spark, con, name, queries()[name], oracle_sql()[name], SF_ORACLE)
    assert not problems, problems
    assert rows > 0
