"""Every registered query beside its DuckDB oracle, and streams beside their batch twins."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.compare import compare, connect

DIRECTORY = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIRECTORY), reason="driver tables not present")
SQL, BUILD = oracle_sql(), queries()


@pytest.fixture(scope="module")
def duck():
    return connect(DIRECTORY)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_oracle(spark, duck, name):
    problem = compare(spark, duck, BUILD[name], SQL[name], DIRECTORY)
    assert problem in (None, "both empty"), problem


def test_streamed_alerts_equal_the_batch_gate(spark):
    batch = {tuple(r) for r in BUILD["alert_gate"](spark, DIRECTORY).select("id", "sent").collect()}
    stream = {tuple(r) for r in BUILD["stream_alerts"](spark, DIRECTORY).select("id", "sent").collect()}
    assert batch and stream == batch


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0


def test_names_match():
    assert set(SQL) <= set(BUILD)
