import os

import pytest

from plumbline.plans import registry

from .compare import connect, differing, duck_rows, spark_rows

FOLDER = "/root/testdata/sf0.001"
registry.load()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, con, name):
    got, want = spark_rows(registry.QUERIES[name](spark, FOLDER)), duck_rows(con, registry.ORACLES[name])
    assert got[0] == want[0]
    assert not differing(got[1], want[1])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
