"""Queries with SQL against DuckDB on whole tables; the others return whole results."""

import pytest

from quire.llm.queries import ORACLE_SQL, QUERIES

from ..conftest import SF_SMALL
from ..oracle_compare import compare, duck

ROWS = {"op7_embedding_passes": "embeddings"}


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_duckdb(spark, con, name):
    rows, problems = compare(spark, con, name, QUERIES[name], ORACLE_SQL[name], SF_SMALL)
    assert not problems, problems
    assert rows > 0


@pytest.mark.parametrize("name", ["op1_quality_ordinal", "op2_toxicity_counterfactual", "op3_lm_cross_entropy", "op9_weak_supervision"])
def test_one_row_for_each_document(spark, con, name):
    got = sorted(r["doc_id"] for r in QUERIES[name](spark, SF_SMALL).select("doc_id").collect())
    assert got == [r[0] for r in con.sql("select doc_id from documents order by doc_id").fetchall()]


def test_entry_registers_them():
    import __spark_entry__

    queries = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 14)} <= {k.split("_")[0] for k in queries} and "pipeline" in queries
    assert set(ORACLE_SQL) <= set(__spark_entry__.oracle_sql())
