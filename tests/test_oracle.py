"""Every registered query of the listings engine against its SQL in DuckDB."""

import pytest
from oracle import DATA, assert_same

from handbill.plans import registry

pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="the test tables are not here")


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_agrees_with_sql(spark, name):
    assert_same(registry.QUERIES[name](spark, str(DATA)), registry.SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_without_sql_runs(spark, name):
    df = registry.QUERIES[name](spark, str(DATA))
    assert len(set(df.columns)) == len(df.columns)
    df.count()
