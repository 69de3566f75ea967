"""Every registered query against its SQL twin at the smallest scale."""

from pathlib import Path

import pytest

from __spark_entry__ import QUERY_MODULES, entry
from compare import compare, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="driver tables not present")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


NAMES = [name for m in QUERY_MODULES for name in m.QUERIES]


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    ok, note = compare(spark, con, name, SF)
    assert ok, note


def test_every_query_has_sql():
    assert {name for m in QUERY_MODULES for name in m.ORACLES} == set(NAMES)


def test_entry(spark):
    assert entry(spark).count() == 11
