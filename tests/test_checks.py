"""Every registered query against its SQL on the smallest test tables."""

from pathlib import Path

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from dossier_checks import queries_operators
from dossier_checks.compare import compare, connect
from dossier_checks.queries_sections import section_queries

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_sql_belongs_to_queries():
    """Every query of the engine has SQL; operators that SQL cannot express have tests of their own."""
    assert set(oracle_sql()) <= set(queries())
    engine = set(queries_operators.QUERIES) | set(section_queries())
    assert engine <= set(oracle_sql())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, con, name):
    ok, note = compare(spark, con, SF, queries()[name], oracle_sql()[name])
    assert ok, note


def test_entry(spark):
    assert entry(spark).count() > 0
