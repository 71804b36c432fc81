"""Every registered corpus query with SQL against DuckDB."""

import pytest
from oracle import DATA, assert_same

from handbill.llm import queries

pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="the test tables are not here")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_agrees_with_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, str(DATA)), queries.SQL[name])
