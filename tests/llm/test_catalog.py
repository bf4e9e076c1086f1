"""Every query with SQL against DuckDB."""

import pytest
from compare import difference

from netlens.llm.catalog import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf, duck, name):
    assert difference(QUERIES[name](spark, sf), duck, SQL[name]) is None


def test_one_query_for_each_operator():
    assert sorted(int(q.split("_")[0][2:]) for q in QUERIES) == list(range(1, 14))
