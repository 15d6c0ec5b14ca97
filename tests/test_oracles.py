"""Every registered query against its SQL twin on the smallest data set."""

import pytest

import __spark_entry__ as entry
from oracle_check import check, duck
from telespark.plans import catalog

SF = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.QUERIES, catalog.ORACLES
MAY_BE_EMPTY = {"latency_hotspot", "log_context"}       # they find nothing in the smallest data set


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_a_twin():
    assert set(SQL) == set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    message, _ = check(spark, con, SF, name, QUERIES[name], SQL[name])
    assert message.startswith("ok") or message == "EMPTY" and name in MAY_BE_EMPTY, message


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns[:3] == ["service_name", "is_total", "bucket"]
    assert df.limit(1).count() == 1
