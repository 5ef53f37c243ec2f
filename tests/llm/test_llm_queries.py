import pytest
from helpers import same_as_sql

from loomline.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, sf, name):
    same_as_sql(spark, duck, sf, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    rows = QUERIES[name](spark, sf)
    assert rows.count() == rows.distinct().count() > 0
