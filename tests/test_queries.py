"""Every registered query against its SQL oracle on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.compare import TESTDATA, oracle_connection, oracle_rows, spark_rows
from tidemark.plans import catalogue

SF_DIR = f"{TESTDATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SF_DIR)


@pytest.mark.parametrize("key", list(catalogue.queries()))
def test_query_matches_oracle(spark, con, key):
    result = catalogue.queries()[key](spark, SF_DIR)
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert "Python" not in plan and ("InPandas" not in plan or key in ("warc_scan", "warc_split_scan"))
    assert spark_rows(result) == oracle_rows(con, catalogue.oracle_sql()[key])


def test_every_query_has_an_oracle():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())
    assert set(catalogue.queries()) <= set(entry.queries()) and set(catalogue.oracle_sql()) <= set(entry.oracle_sql())


def test_entry_has_rows(spark):
    assert not entry.entry(spark).isEmpty()
