import pytest

from strataform.llm.queries import QUERIES
from tests.empty import empty_tables


@pytest.fixture(scope="module")
def nothing(data, tmp_path_factory):
    return empty_tables(data, str(tmp_path_factory.mktemp("empty")))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_every_query_takes_empty_tables(spark, nothing, name):
    assert QUERIES[name](spark, nothing).count() == 0
