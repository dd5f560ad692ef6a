"""Every registered query of the log gives the rows of its SQL."""

import pytest

from tests.oracle import connect, rows_of, rows_of_sql
from tidelog.plans import aggregates, attributes, feeds, meta_writes, partitions, read_write, registry, sessions  # noqa: F401

MAY_BE_EMPTY = {"dur_timeout", "scan_get_by_seqno", "scan_by_seqno", "scan_history", "failover_asof", "kv_getif_meta", "write_add", "write_replace"}


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_sql(spark, sf, con, name):
    got = rows_of(registry.QUERIES[name](spark, sf))
    want = rows_of_sql(con, registry.ORACLE_SQL[name])
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_rows_only_query_runs(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns and set(e.oracle_sql()) <= set(e.queries())
