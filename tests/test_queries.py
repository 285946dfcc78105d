import pytest

from cantata import registry
from tests.differential import DATA, compare, connect

FOLDER = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_agrees_with_sql(spark, con, name):
    assert compare(spark, con, registry.QUERIES[name], registry.ORACLES[name], FOLDER) is None


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_runs(spark, name):
    assert registry.QUERIES[name](spark, FOLDER).collect() is not None
