"""Every registered query against its oracle on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry_points
from tests import oracle

from rowtide.plans import catalog

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not there")

# At the smallest scale these have no rows: no failure streak is long enough for an alert.
LARGER = "/root/testdata/sf0.01"
NEED_LARGER = {"threshold_alerts", "get_by_name", "skipped_deletes"}


def test_registered():
    assert set(catalog.ORACLES) == set(catalog.QUERIES) <= set(entry_points.queries())


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    sf_dir = LARGER if name in NEED_LARGER else SF_DIR
    frame = catalog.QUERIES[name](spark, sf_dir)
    assert oracle.compare(frame, oracle.connect(sf_dir), catalog.ORACLES[name]) is None
