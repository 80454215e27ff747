"""Every core query on empty tables and on tables with nulls in any column, repeated rows and clashing extra columns."""

import pytest

from tests import edge_tables
from tests.test_oracle import QUERIES


@pytest.fixture(scope="module")
def empty(tmp_path_factory):
    return edge_tables.empty(str(tmp_path_factory.mktemp("empty")))


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    return edge_tables.odd(str(tmp_path_factory.mktemp("odd")))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty(spark, empty, name):
    QUERIES[name](spark, empty).collect()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd(spark, odd, name):
    QUERIES[name](spark, odd).collect()
