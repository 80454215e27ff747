import pytest

from tests import edge_tables
from weftline.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
@pytest.mark.parametrize("kind", ["empty", "odd"])
def test_edge(spark, tmp_path, kind, name):
    QUERIES[name](spark, getattr(edge_tables, kind)(str(tmp_path))).collect()
