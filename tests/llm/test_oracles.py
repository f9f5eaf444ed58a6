import pytest

from tests.compare import differences
from tidemill.llm import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, small, name):
    ours, theirs, _ = differences(registry.QUERIES[name](spark, small), registry.ORACLES[name], small)
    assert (ours, theirs) == ([], [])
