"""Queries that apply an operation to every event or wanted key give the rows of their SQL, one for each."""

import pytest

from tests.oracle import connect, rows_of, rows_of_sql
from tidelog.plans import feeds, read_write, registry, sessions, whole_log  # noqa: F401

OF = {"write_cas_status": "events", "write_cas_status_whole": "events", "write_store_if": "events", "write_store_if_whole": "events", "rollback_decision": "events", "rollback_decision_whole": "events", "kv_get_multi": "customer", "kv_observe": "customer", "write_append": None}


@pytest.mark.parametrize("name", sorted(OF))
def test_whole(spark, sf, name):
    con = connect(sf)
    got = rows_of(registry.QUERIES[name](spark, sf))
    assert got == rows_of_sql(con, registry.ORACLE_SQL[name])
    want = con.sql(f"SELECT count(*) FROM {OF[name]}" if OF[name] else "SELECT count(DISTINCT user_id) FROM events").fetchall()[0][0]
    assert len(got[1]) == want
