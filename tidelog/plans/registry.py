"""Queries by name, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: The mapping of tidelog.model in SQL: the log, its newest rows, the live ones, the collections.
LOG_SQL = """WITH m AS (
    SELECT user_id % 16 AS vb, row_number() OVER (PARTITION BY user_id % 16 ORDER BY event_id) AS seqno,
        8 + user_id % 4 AS cid, 'u' || user_id::VARCHAR AS key, 'mutation' AS op, props AS value,
        epoch_us(ts) * 1000 - (epoch_us(ts) * 1000) % 65536 AS cas,
        row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rev, 0::BIGINT AS flags,
        CASE WHEN event_type = 'view' THEN epoch_us(ts) // 1000000 + 86400 ELSE 0 END AS exptime,
        event_type = 'error' AS deleted, event_id, event_type, value AS amount, epoch_us(ts) AS us, user_id FROM events),
ck AS (SELECT *, (seqno - 1) // 50 AS checkpoint_id FROM m),
newest AS (SELECT * FROM ck QUALIFY row_number() OVER (PARTITION BY vb, cid, key ORDER BY seqno DESC) = 1),
cur AS (SELECT * FROM newest WHERE NOT deleted AND NOT (exptime <> 0 AND exptime < 1706000000)),
coll AS (SELECT r_regionkey::BIGINT AS sid, r_name AS scope, (8 + n_nationkey)::BIGINT AS cid, n_name AS collection,
        (n_nationkey * 10)::BIGINT AS start_seqno, CASE WHEN n_nationkey % 3 = 0 THEN 3600 END::BIGINT AS max_ttl, n_nationkey % 4 = 1 AS history
    FROM nation JOIN region ON n_regionkey = r_regionkey)
"""


def query(name: str, sql: str | None = None, *, log: bool = True) -> Callable[[Query], Query]:
    """Registers a query; `log` puts LOG_SQL before its SQL, which then starts with SELECT or more tables after a comma."""

    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = (LOG_SQL if log else "") + sql
        return f

    return put
