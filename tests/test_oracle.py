import pytest

import __spark_entry__ as entry
from tests import oracle

QUERIES = entry.queries()
SQL = entry.oracle_sql()
#: Queries of the training-data operators have their own tests.
ROWS_ONLY = {name for name in QUERIES if name.startswith("op") or name == "pipeline"}


@pytest.fixture(scope="module")
def con(sf_check):
    return oracle.connect(sf_check)


def test_every_query_has_an_oracle():
    assert set(QUERIES) - set(SQL) <= ROWS_ONLY
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_check, con, name):
    assert oracle.compare(QUERIES[name](spark, sf_check), con, SQL[name]) >= (0 if name in {"hard_dq_anti"} else 1)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
