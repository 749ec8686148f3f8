import pytest

from clipweave.llm import queries
from tests.oracle import differences


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_sql(spark, tiny, name):
    more, less = differences(queries.QUERIES[name](spark, tiny), queries.ORACLE[name], tiny)
    assert not more and not less


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_query_without_sql_runs(spark, tiny, name):
    assert queries.QUERIES[name](spark, tiny).count() > 0
