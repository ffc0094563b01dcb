"""Every registered query with SQL, side by side with DuckDB; the others must run and return rows."""

import pytest

from panelcast.plans import catalog
from tests.oracle import compare, duck


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_matches_sql(spark, sf_dir, con, name):
    assert compare(catalog.QUERIES[name](spark, sf_dir), con, catalog.ORACLE[name]) == ""


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_runs(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
