"""Every core query with SQL against DuckDB; those without must run and have a stable schema."""

from __future__ import annotations

import pytest

from lexspark.plans import registry
from tests.check_sql import compare, duck


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf, con, name):
    same, note = compare(spark, con, sf, name, registry.queries()[name], registry.oracle_sql().get(name))
    assert same is not False, note


def test_entry():
    import __spark_entry__ as e

    assert registry.FLAGSHIP in e.queries() and set(e.oracle_sql()) <= set(e.queries())
