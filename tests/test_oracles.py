"""Every query that has SQL gives the rows that DuckDB gives for it."""

import pytest

from terralith.plans import registry

from .compare import SF, duck, same

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck()


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, con, name):
    same(QUERIES[name](spark, SF), con, SQL[name])


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


SLOW = {"reg_mgwr"}  # iterative, half a minute or more


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - SLOW))
def test_without_sql_runs(spark, name):
    got = QUERIES[name](spark, SF)
    assert len(got.columns) == len(set(got.columns)) and got.count() > 0  # their values are tested in test_models, test_tiles and the like
