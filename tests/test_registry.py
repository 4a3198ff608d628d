"""Every registered query against its check SQL at the smallest scale."""

import __spark_entry__ as registry
import compare
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def checker():
    return compare.connect(SF)


def test_names_agree():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_entry_runs(spark):
    assert registry.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query(spark, checker, name):
    ok, _, note = compare.compare(spark, checker, SF, registry.queries()[name], registry.oracle_sql().get(name))
    assert ok, note
