"""Every registered query with an oracle equals it at the smallest scale."""
import pytest

from compare import DATA, compare, duck
from curbcast.plans.registry import oracles, queries

SF = "0.001"
QUERIES, ORACLES = queries(), oracles()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, con, name):
    assert compare(QUERIES[name](spark, f"{DATA}/sf{SF}"), con, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_oracle_runs(spark, name):
    assert QUERIES[name](spark, f"{DATA}/sf{SF}").count() > 0
