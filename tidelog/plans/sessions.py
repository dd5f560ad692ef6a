"""Registered queries: stream requests, queues, flushes, access, labels, configuration."""

from __future__ import annotations

import base64

from pyspark.sql import functions as F

from tidelog import model
from tidelog.model import AS_OF, mutations
from tidelog.operators import feed, reads, scans, sessions, stats
from tidelog.plans.feeds import CURSORS, FAILOVER, _cursors, _failover
from tidelog.plans.registry import query


@query("scan_session", "SELECT cid, key FROM cur WHERE cid = 9 AND key >= 'u1' AND key < 'u9'")
def scan_session(spark, d):
    as_64 = lambda k: base64.b64encode(k.encode()).decode()
    return scans.create(mutations(spark, d), 9, {"range": {"start": as_64("u1"), "excl_end": as_64("u9")}, "key_only": True}, AS_OF).rows


@query("warmup_by_access", ", hot AS (SELECT DISTINCT cid, key FROM m WHERE event_type = 'purchase' AND seqno > 400) SELECT vb, cid, key, seqno FROM newest SEMI JOIN hot USING (cid, key)")
def warmup_by_access(spark, d):
    log = mutations(spark, d)
    hot = log.where("event_type = 'purchase' AND seqno > 400").select("cid", "key").distinct()
    return reads.latest(log).join(hot, ["cid", "key"], "left_semi").select("vb", "cid", "key", "seqno")


@query(
    "stream_request_status",
    "SELECT event_id AS request_id, CASE WHEN seqno > seqno + 10 - event_id % 20 OR seqno - event_id % 3 + 1 > seqno OR seqno > 300 THEN 'out_of_range' ELSE 'success' END AS status FROM m",
)
def stream_request_status(spark, d):
    e, s = F.col("event_id"), F.col("seqno")
    return sessions.request_status(mutations(spark, d).select(e.alias("request_id"), s.alias("start_seqno"), (s + 10 - e % 20).alias("end_seqno"), (s - e % 3 + 1).alias("snap_start"), s.alias("snap_end"), F.lit(300).alias("high_seqno")))


@query(
    "observe_seqno",
    FAILOVER + """, br AS (SELECT vb, uuid, lead(by_seqno) OVER (PARTITION BY vb ORDER BY by_seqno) AS hi FROM fo), sq AS (SELECT vb, max(seqno) AS h, max(seqno) - 20 AS p FROM m GROUP BY vb),
    rq AS (SELECT vb, 1000 + vb * 10 + vb % 4 AS uuid FROM sq)
    SELECT rq.vb, rq.uuid, CASE WHEN br.uuid IS NULL THEN 'no_such_key' ELSE 'success' END AS status, CASE WHEN br.uuid IS NOT NULL THEN h END AS current, CASE WHEN br.uuid IS NOT NULL THEN p END AS persisted, hi AS branch_end
    FROM rq LEFT JOIN br ON br.vb = rq.vb AND br.uuid = rq.uuid LEFT JOIN sq ON sq.vb = rq.vb""",
)
def observe_seqno(spark, d):
    log = mutations(spark, d)
    seqnos = log.groupBy("vb").agg(F.max("seqno").alias("high_seqno"), (F.max("seqno") - 20).alias("persisted_seqno"))
    requests = seqnos.select("vb", (F.lit(1000) + F.col("vb") * 10 + F.pmod("vb", F.lit(4))).alias("uuid"))
    return sessions.observe_seqno(requests, feed.branches(_failover(log)), seqnos)


PERSISTED = ", ps AS (SELECT vb, max(seqno) - 50 AS persisted_seqno FROM m GROUP BY vb)"


def _persisted(log):
    return log.groupBy("vb").agg((F.max("seqno") - 50).alias("persisted_seqno"))


@query("takeover_estimate", CURSORS + PERSISTED + " SELECT vb, count(*) FILTER (seqno > cursor_seqno) AS items, count(*) FILTER (deleted AND seqno > persisted_seqno) AS deletes FROM m JOIN cursors USING (vb) JOIN ps USING (vb) GROUP BY vb")
def takeover_estimate(spark, d):
    log = mutations(spark, d)
    return sessions.takeover_estimate(log, _cursors(log), _persisted(log))


@query("queue_age", PERSISTED + " SELECT vb, count(*) AS queued, sum(strlen(value))::BIGINT AS bytes, (sum(1707000000000000 - us) // 1000000)::BIGINT AS age_s FROM m JOIN ps USING (vb) WHERE seqno > persisted_seqno GROUP BY vb")
def queue_age(spark, d):
    log = mutations(spark, d)
    return sessions.queue(log, _persisted(log), 1_707_000_000_000_000)


@query("flush_state", "SELECT vb, seqno // 200 AS batch, min(seqno) AS range_start, max(seqno) AS range_end, max(seqno) AS max_visible, max(cas) AS max_cas, coalesce(max(rev) FILTER (deleted), 0) AS max_deleted_rev FROM m GROUP BY 1, 2")
def flush_state(spark, d):
    return sessions.flush_state(mutations(spark, d), F.floor(F.col("seqno") / 200).cast("long"))


@query(
    "write_lives",
    ", f AS (SELECT *, CASE WHEN coalesce(lag(deleted) OVER w, true) THEN 1 ELSE 0 END AS fresh FROM m WINDOW w AS (PARTITION BY vb, cid, key ORDER BY seqno)), l AS (SELECT *, sum(fresh) OVER (PARTITION BY vb, cid, key ORDER BY seqno)::BIGINT AS life FROM f) SELECT vb, seqno, life, row_number() OVER (PARTITION BY vb, cid, key, life ORDER BY seqno) AS rev_in_life FROM l",
)
def write_lives(spark, d):
    return sessions.revisions(mutations(spark, d)).select("vb", "seqno", "life", "rev_in_life")


@query("hlc_validity", "SELECT event_id, cas < 1706300000000000000 AS valid, CASE WHEN cas < 1706300000000000000 THEN cas ELSE 1706000000000000000 - 1706000000000000000 % 65536 END AS replaced_cas FROM m")
def hlc_validity(spark, d):
    return sessions.valid_clocks(mutations(spark, d), AS_OF * 1_000_000_000, 300_000).select("event_id", "valid", "replaced_cas")


@query("write_store_if", ", st AS (SELECT * FROM ck WHERE seqno <= 300 QUALIFY row_number() OVER (PARTITION BY vb, cid, key ORDER BY seqno DESC) = 1) SELECT o.event_id, CASE WHEN st.key IS NULL OR st.rev % 2 = 0 THEN 'success' ELSE 'predicate_failed' END AS status FROM m o LEFT JOIN st ON st.cid = o.cid AND st.key = o.key")
def write_store_if(spark, d):
    log = mutations(spark, d)
    ops = log.select("cid", "key", "event_id")
    return sessions.store_if(ops, reads.state_at(log, 300), F.col("doc.rev") % 2 == 0).select("event_id", "status")


@query("write_keep_xattrs", "SELECT vb, seqno, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY vb, cid, key ORDER BY seqno ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS xattrs FROM m")
def write_keep_xattrs(spark, d):
    log = mutations(spark, d).withColumn("xattrs", F.when(F.col("event_type") == "signup", F.col("event_id")))
    return sessions.keep_attributes(log).select("vb", "seqno", "xattrs")


@query("audit_filter", "SELECT event_id FROM m WHERE event_id % 5 IN (1, 3) AND key NOT IN ('u1', 'u2')")
def audit_filter(spark, d):
    rows = mutations(spark, d).select("event_id", F.pmod("event_id", F.lit(5)).alias("event_kind"), F.col("key").alias("user"))
    return sessions.audit_filter(rows, enabled=[1, 3], exclude=["u1", "u2"]).select("event_id")


@query("access_permitted", "SELECT event_id FROM m JOIN coll USING (cid) WHERE key = 'u5' OR (key = 'u6' AND sid = 0) OR (key IN ('u7', 'u12') AND cid = 8)")
def access_permitted(spark, d):
    rows = mutations(spark, d).join(F.broadcast(model.collections(spark, d).select("cid", "sid")), "cid").select("event_id", F.col("key").alias("user"), "sid", "cid")
    grants = spark.createDataFrame([("u5", None, None), ("u6", 0, None), ("u7", 0, 8), ("u12", 0, 8)], "user string, sid long, cid long")
    return sessions.permitted(rows, grants).select("event_id")


@query("vb_filter_slice", "SELECT vb FROM (SELECT vb, row_number() OVER (ORDER BY vb) - 1 AS place FROM (SELECT DISTINCT vb FROM m)) WHERE place >= 2 AND (place - 2) % 3 = 0")
def vb_filter_slice(spark, d):
    return sessions.partition_slice(mutations(spark, d).select("vb").distinct(), 2, 3)


@query("ckpt_by_bytes")
def ckpt_by_bytes(spark, d):
    return sessions.assign_checkpoints(mutations(spark, d), 500).groupBy("vb", "checkpoint_id").agg(F.count("*").alias("items"))


@query("failover_capped", FAILOVER + " SELECT vb, row_number() OVER (PARTITION BY vb ORDER BY by_seqno DESC) - 1 AS idx, uuid, by_seqno FROM fo QUALIFY idx < 2")
def failover_capped(spark, d):
    return sessions.failover_table(_failover(mutations(spark, d)), 2).select("vb", "idx", "uuid", "by_seqno")


@query("stats_series", "SELECT event_type, round(avg(amount), 6) AS mean, max(amount) AS most, round(quantile_cont(amount, 0.99), 6) AS p99 FROM m GROUP BY 1")
def stats_series(spark, d):
    return sessions.series(mutations(spark, d), "event_type", "amount")


@query("stats_long_form", ", g AS (SELECT vb, cid, count(*)::DOUBLE AS items, max(seqno)::DOUBLE AS high_seqno FROM m GROUP BY 1, 2) SELECT vb::VARCHAR || ':' || cid::VARCHAR AS labels, 'items' AS name, items AS value FROM g UNION ALL SELECT vb::VARCHAR || ':' || cid::VARCHAR, 'high_seqno', high_seqno FROM g")
def stats_long_form(spark, d):
    return sessions.long_form(stats.collection_details(mutations(spark, d)), ["vb", "cid"], ["items", "high_seqno"])


@query("config_newest", "SELECT 'b' || vb::VARCHAR AS bucket, value AS body, seqno // 100 AS epoch, seqno % 100 AS rev FROM m QUALIFY row_number() OVER (PARTITION BY vb ORDER BY seqno DESC) = 1")
def config_newest(spark, d):
    return sessions.newest_config(mutations(spark, d).select(F.concat(F.lit("b"), F.col("vb").cast("string")).alias("bucket"), F.col("value").alias("body"), F.floor(F.col("seqno") / 100).cast("long").alias("epoch"), (F.col("seqno") % 100).alias("rev")))


@query(
    "dur_replica_marks",
    """, sn AS (SELECT vb, s * 100 AS end_seqno, lag(s * 100, 1, 0) OVER (PARTITION BY vb ORDER BY s) AS start_seqno, s % 2 = 0 AS disk, s <= vb % 5 AS persisted FROM (SELECT DISTINCT vb FROM m), range(1, 5) AS g(s)),
    pj AS (SELECT m.vb, m.seqno, 1 + m.event_id % 3 <= CASE WHEN persisted THEN 3 WHEN NOT disk THEN 2 ELSE 0 END AS ok FROM m JOIN sn ON sn.vb = m.vb AND m.seqno > start_seqno AND m.seqno <= end_seqno WHERE event_type = 'signup')
    SELECT vb, max(seqno) AS high_prepared FROM pj WHERE seqno < coalesce((SELECT min(seqno) FROM pj q WHERE q.vb = pj.vb AND NOT ok), 1000000000) GROUP BY vb""",
)
def dur_replica_marks(spark, d):
    log = mutations(spark, d)
    steps = log.select("vb").distinct().select("vb", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("s"))
    snapshots = steps.select("vb", (F.col("s") * 100).cast("long").alias("end_seqno"), (F.col("s") % 2 == 0).alias("disk"), (F.col("s") <= F.pmod("vb", F.lit(5))).alias("persisted"))
    prepares = log.where("event_type = 'signup'").select("vb", "seqno", (1 + F.pmod("event_id", F.lit(3))).alias("level"))
    return sessions.replicated_prepares(snapshots, prepares)


@query("clock_repair", "SELECT vb, cid, key, cas FROM newest WHERE cas > 1706600000000000000")
def clock_repair(spark, d):
    return reads.latest(mutations(spark, d)).where("cas > 1706600000000000000").select("vb", "cid", "key", "cas")
