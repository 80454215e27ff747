import pytest

from tests.conftest import SF
from weftline.llm.queries import QUERIES, SQL


def test_every_sql_has_its_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns
    df.collect()
