import importlib
import os

import pytest
from oracle import DATA, assert_same, connect

MODULES = [importlib.import_module(f"varloom.queries.{m}") for m in ("intake", "sites", "cohort", "markers", "helpers")]
QUERIES = {n: q for m in MODULES for n, q in m.QUERIES.items()}
ORACLES = {n: q for m in MODULES for n, q in m.ORACLES.items()}
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect()


def test_every_sql_has_its_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    assert_same(spark, con, QUERIES[name], ORACLES[name])


#: Queries whose result needs more samples than the smallest tables have.
WIDER = {"recurrent_origins"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, name):
    df = QUERIES[name](spark, DATA.replace("0.001", "0.01") if name in WIDER else DATA)
    assert df.columns and df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
