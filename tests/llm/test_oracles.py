import compare
import pytest

from folio.llm import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_sql(spark, data, name):
    assert not compare.differences(registry.QUERIES[name](spark, data), compare.connect(data), registry.ORACLE_SQL[name])


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))
