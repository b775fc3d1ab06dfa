"""Every registered query of the note corpus against DuckDB."""

from __future__ import annotations

import pytest

from marginalia import catalog
from tests.compare import assert_same


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_rows(spark, data, name):
    assert_same(spark, data, catalog.QUERIES[name], catalog.ORACLE_SQL[name])


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)
