"""Registered queries: each event as an operation on the document as it was just before it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidelog.model import AS_OF, mutations
from tidelog.operators import feed, writes
from tidelog.plans.feeds import FAILOVER, _failover
from tidelog.plans.registry import query


def _before():
    """The versions of a document, oldest first."""
    return Window.partitionBy("vb", "cid", "key").orderBy("seqno")


@query(
    "write_cas_status_whole",
    """, o AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 0 WHEN 1 THEN lag(cas, 1, cas) OVER w ELSE cas END AS op_cas, lag(cas) OVER w AS have,
        lag(NOT deleted AND NOT (exptime <> 0 AND exptime < 1706000000)) OVER w AS alive FROM m WINDOW w AS (PARTITION BY vb, cid, key ORDER BY seqno))
    SELECT event_id, CASE WHEN have IS NULL OR NOT alive THEN CASE WHEN op_cas = 0 THEN 'success' ELSE 'no_such_key' END WHEN op_cas = 0 OR op_cas = have THEN 'success' ELSE 'key_already_exists' END AS status FROM o""",
)
def write_cas_status_whole(spark, d):
    """Each event as a conditional write on the document as it was before it."""
    kind = F.pmod("event_id", F.lit(3))
    op_cas = F.when(kind == 0, F.lit(0)).when(kind == 1, F.coalesce(F.lag("cas").over(_before()), "cas")).otherwise(F.col("cas")).cast("long")
    ops = mutations(spark, d).select("event_id", op_cas.alias("op_cas"), F.lag("cas").over(_before()).alias("have"), F.lag(writes.live(AS_OF)).over(_before()).alias("alive"))
    return ops.select("event_id", writes.cas_verdict().alias("status"))


@query("write_store_if_whole", "SELECT event_id, CASE WHEN coalesce(lag(rev) OVER (PARTITION BY vb, cid, key ORDER BY seqno), 0) % 2 = 0 THEN 'success' ELSE 'predicate_failed' END AS status FROM m")
def write_store_if_whole(spark, d):
    """Each event as a store with a predicate on the document as it was before it; absent documents pass."""
    before = F.lag("rev").over(_before())
    return mutations(spark, d).select("event_id", F.when(before.isNull() | (before % 2 == 0), "success").otherwise("predicate_failed").alias("status"))


@query(
    "rollback_decision_whole",
    FAILOVER
    + """, hs AS (SELECT vb, max(seqno) AS high_seqno FROM m GROUP BY vb),
    rq AS (SELECT event_id AS request_id, vb, seqno AS start_seqno, CASE WHEN event_id % 11 = 0 THEN 0 WHEN event_id % 7 = 0 THEN 5 ELSE 1000 + vb * 10 + event_id % 3 END AS uuid,
        seqno - event_id % 4 AS snap_start, seqno + event_id % 5 AS snap_end, high_seqno, 30::BIGINT AS purge_seqno, event_id % 2 AS remote_purge FROM m JOIN hs USING (vb)),
    br AS (SELECT vb, uuid, lead(by_seqno) OVER (PARTITION BY vb ORDER BY by_seqno) AS hi FROM fo),
    j AS (SELECT rq.*, br.uuid AS known, coalesce(hi, high_seqno) AS upper, CASE WHEN start_seqno = snap_start THEN start_seqno ELSE snap_end END AS se FROM rq LEFT JOIN br ON rq.vb = br.vb AND rq.uuid = br.uuid)
    SELECT request_id, CASE WHEN start_seqno < purge_seqno AND start_seqno <> 0 AND remote_purge * 30 <> purge_seqno THEN 0 WHEN known IS NULL THEN 0 WHEN se <= upper THEN NULL
        ELSE least(upper, CASE WHEN start_seqno = se THEN start_seqno ELSE snap_start END) END AS rollback_seqno FROM j""",
)
def rollback_decision_whole(spark, d):
    """A stream request from each event; the local high seqno is the partition's own."""
    log = mutations(spark, d)
    e = F.col("event_id")
    uuid = F.when(e % 11 == 0, 0).when(e % 7 == 0, 5).otherwise(F.lit(1000) + F.col("vb") * 10 + e % 3)
    requests = log.join(F.broadcast(log.groupBy("vb").agg(F.max("seqno").alias("high_seqno"))), "vb")
    requests = requests.select(e.alias("request_id"), "vb", F.col("seqno").alias("start_seqno"), uuid.alias("uuid"), (F.col("seqno") - e % 4).alias("snap_start"), (F.col("seqno") + e % 5).alias("snap_end"), "high_seqno", F.lit(30).cast("long").alias("purge_seqno"), (e % 2 * 30).alias("remote_purge_seqno"), F.lit(True).alias("strict"), F.lit(None).cast("long").alias("collection_high"))
    return feed.rollback_decision(requests, _failover(log))
