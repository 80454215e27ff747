"""Every registered core query runs; those with SQL give the same rows as DuckDB."""

import importlib

import pytest

from tests.conftest import SF
from tests.helpers import duck_bag, spark_bag
from weftline.plans import MODULES

LOADED = [importlib.import_module(f"weftline.plans.{m}") for m in MODULES]
QUERIES = {n: f for m in LOADED for n, f in m.QUERIES.items()}
SQL = {n: s for m in LOADED for n, s in m.SQL.items()}


def test_every_sql_has_its_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    columns, rows = spark_bag(QUERIES[name](spark, SF))
    assert columns
    if name in SQL:
        assert (columns, rows) == duck_bag(duck, SQL[name])
