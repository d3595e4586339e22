"""Every registered query with a SQL twin gives the twin's rows."""

import pytest

import check_oracles
from statera.plans import load

QUERIES = load()


@pytest.fixture(scope="module")
def con(sf):
    return check_oracles.connect(sf)


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_same_rows(spark, sf, con, name):
    status, _ = check_oracles.compare(QUERIES[name].run(spark, sf), con, QUERIES[name].sql)
    assert status == "ok"


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if not q.sql])
def test_runs(spark, sf, name):
    assert QUERIES[name].run(spark, sf).count() >= 0


def test_entry_names_match():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 180
