"""Registered queries: change feed, filters, durability, maintenance, catalog, JSON paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog import model
from tidelog.functions import subdoc
from tidelog.model import AS_OF, mutations
from tidelog.operators import catalog, durability, feed, maintenance, reads, stats
from tidelog.plans.registry import query

DEDUP = ", dd AS (SELECT * FROM ck QUALIFY row_number() OVER (PARTITION BY vb, checkpoint_id, cid, key ORDER BY seqno DESC) = 1)"


@query("ckpt_dedup", DEDUP + " SELECT vb, checkpoint_id, seqno, key FROM dd")
def ckpt_dedup(spark, d):
    return feed.dedup(mutations(spark, d), ["vb", "checkpoint_id"]).select("vb", "checkpoint_id", "seqno", "key")


@query("ckpt_dedup_history", DEDUP + " SELECT vb, seqno, key FROM dd WHERE cid <> 9 UNION ALL SELECT vb, seqno, key FROM ck WHERE cid = 9")
def ckpt_dedup_history(spark, d):
    return feed.dedup(mutations(spark, d), ["vb", "checkpoint_id"], F.col("cid") == 9).select("vb", "seqno", "key")


@query("flush_dedup", "SELECT vb, seqno // 200 AS batch, cid, key, max(seqno) AS seqno FROM m GROUP BY ALL")
def flush_dedup(spark, d):
    log = mutations(spark, d).withColumn("batch", F.floor(F.col("seqno") / 200).cast("long"))
    return feed.dedup(log, ["vb", "batch"]).select("vb", "batch", "cid", "key", "seqno")


@query("snapshot_ranges", DEDUP + " SELECT vb, checkpoint_id, min(seqno) AS snap_start, max(seqno) AS snap_end, count(*) AS items FROM dd GROUP BY 1, 2")
def snapshot_ranges(spark, d):
    return feed.snapshot_ranges(mutations(spark, d))


@query("seqno_gaps", DEDUP + ", g AS (SELECT vb, seqno, seqno - lag(seqno) OVER (PARTITION BY vb ORDER BY seqno) - 1 AS gap FROM dd) SELECT * FROM g WHERE gap > 0")
def seqno_gaps(spark, d):
    return feed.gaps(feed.dedup(mutations(spark, d), ["vb", "checkpoint_id"]))


CURSORS = ", cursors AS (SELECT vb, 'c' || (vb % 3)::VARCHAR AS name, vb * 20 AS cursor_seqno FROM (SELECT DISTINCT vb FROM m))"


def _cursors(log: DataFrame) -> DataFrame:
    return log.select("vb").distinct().select("vb", F.concat(F.lit("c"), F.pmod("vb", F.lit(3)).cast("string")).alias("name"), (F.col("vb") * 20).alias("cursor_seqno"))


@query("cursor_remaining", CURSORS + " SELECT name, vb, count(*) AS remaining FROM cursors JOIN m USING (vb) WHERE seqno > cursor_seqno GROUP BY 1, 2")
def cursor_remaining(spark, d):
    log = mutations(spark, d)
    return feed.remaining(log, _cursors(log))


@query("cursor_expel", CURSORS + ", low AS (SELECT min(cursor_seqno) AS c, vb FROM cursors GROUP BY vb) SELECT vb, count(*) AS items, sum(strlen(value))::BIGINT AS bytes FROM m JOIN low USING (vb) WHERE seqno < c GROUP BY vb")
def cursor_expel(spark, d):
    log = mutations(spark, d)
    low = _cursors(log).groupBy("vb").agg(F.min("cursor_seqno").alias("c"))
    return log.join(low, "vb").where("seqno < c").groupBy("vb").agg(F.count("*").alias("items"), F.sum(F.octet_length("value")).alias("bytes"))


FAILOVER = ", fo AS (SELECT vb, idx, 1000 + vb * 10 + idx AS uuid, 100 * (2 - idx) AS by_seqno FROM (SELECT DISTINCT vb FROM m), (SELECT unnest([0, 1, 2])::BIGINT AS idx))"


def _failover(log: DataFrame) -> DataFrame:
    """Three history branches per partition, newest first: from 200, 100 and 0."""
    return log.select("vb").distinct().select("vb", F.explode(F.array(*[F.lit(k).cast("long") for k in range(3)])).alias("idx")).select("vb", "idx", (F.lit(1000) + F.col("vb") * 10 + F.col("idx")).alias("uuid"), (F.lit(100) * (2 - F.col("idx"))).alias("by_seqno"))


@query("failover_asof", FAILOVER + ", br AS (SELECT vb, uuid, by_seqno AS lo, lead(by_seqno) OVER (PARTITION BY vb ORDER BY by_seqno) AS hi FROM fo) SELECT m.vb, seqno, uuid FROM m JOIN br ON m.vb = br.vb AND seqno >= lo AND (hi IS NULL OR seqno < hi)")
def failover_asof(spark, d):
    log = mutations(spark, d)
    return feed.branch_of(log.select("vb", "seqno"), _failover(log)).select("vb", "seqno", "uuid")


@query("failover_pruned", FAILOVER + " SELECT vb, idx, uuid, by_seqno FROM fo WHERE by_seqno <= 100")
def failover_pruned(spark, d):
    return _failover(mutations(spark, d)).where("by_seqno <= 100")


@query(
    "rollback_decision",
    FAILOVER
    + """, rq AS (SELECT event_id AS request_id, vb, seqno AS start_seqno, CASE WHEN event_id % 11 = 0 THEN 0 WHEN event_id % 7 = 0 THEN 5 ELSE 1000 + vb * 10 + event_id % 3 END AS uuid,
        seqno - event_id % 4 AS snap_start, seqno + event_id % 5 AS snap_end, 600::BIGINT AS high_seqno, 30::BIGINT AS purge_seqno, event_id % 2 AS remote_purge FROM m),
    br AS (SELECT vb, uuid, lead(by_seqno) OVER (PARTITION BY vb ORDER BY by_seqno) AS hi FROM fo),
    j AS (SELECT rq.*, br.uuid AS known, coalesce(hi, high_seqno) AS upper, CASE WHEN start_seqno = snap_start THEN start_seqno ELSE snap_end END AS se FROM rq LEFT JOIN br ON rq.vb = br.vb AND rq.uuid = br.uuid)
    SELECT request_id, CASE WHEN start_seqno < purge_seqno AND start_seqno <> 0 AND remote_purge * 30 <> purge_seqno THEN 0 WHEN known IS NULL THEN 0 WHEN se <= upper THEN NULL
        ELSE least(upper, CASE WHEN start_seqno = se THEN start_seqno ELSE snap_start END) END AS rollback_seqno FROM j""",
)
def rollback_decision(spark, d):
    log = mutations(spark, d)
    e = F.col("event_id")
    uuid = F.when(e % 11 == 0, 0).when(e % 7 == 0, 5).otherwise(F.lit(1000) + F.col("vb") * 10 + e % 3)
    requests = log.select(e.alias("request_id"), "vb", F.col("seqno").alias("start_seqno"), uuid.alias("uuid"), (F.col("seqno") - e % 4).alias("snap_start"), (F.col("seqno") + e % 5).alias("snap_end"), F.lit(600).cast("long").alias("high_seqno"), F.lit(30).cast("long").alias("purge_seqno"), (e % 2 * 30).alias("remote_purge_seqno"), F.lit(True).alias("strict"), F.lit(None).cast("long").alias("collection_high"))
    return feed.rollback_decision(requests, _failover(log))


@query("filter_collections", "SELECT vb, seqno, cid FROM m WHERE cid IN (8, 11)")
def filter_collections(spark, d):
    return mutations(spark, d).where(F.col("cid").isin(8, 11)).select("vb", "seqno", "cid")


@query("filter_scope", "SELECT vb, seqno, cid FROM m JOIN coll USING (cid) WHERE scope = 'AFRICA' AND seqno >= start_seqno")
def filter_scope(spark, d):
    return feed.filtered(mutations(spark, d), collections=model.collections(spark, d), scope="AFRICA").select("vb", "seqno", "cid")


SYNC = """, ops AS (SELECT *, CASE WHEN event_type = 'signup' THEN 'pending_sync_write' WHEN lag(event_type) OVER w = 'signup' AND event_type = 'purchase' THEN 'commit_sync_write'
        WHEN lag(event_type) OVER w = 'signup' AND event_type = 'click' THEN 'abort_sync_write' ELSE 'mutation' END AS sop, lag(seqno) OVER w AS before_seqno FROM m WINDOW w AS (PARTITION BY vb, cid, key ORDER BY seqno)),
    pr AS (SELECT vb, cid, key, seqno AS prepare_seqno, us FROM ops WHERE sop = 'pending_sync_write'),
    oc AS (SELECT pr.vb, pr.cid, pr.key, pr.prepare_seqno, o.seqno AS done_seqno, pr.us, CASE o.sop WHEN 'commit_sync_write' THEN 'committed' WHEN 'abort_sync_write' THEN 'aborted' ELSE 'pending' END AS outcome
        FROM pr LEFT JOIN ops o ON o.vb = pr.vb AND o.key = pr.key AND o.before_seqno = pr.prepare_seqno AND o.sop IN ('commit_sync_write', 'abort_sync_write'))"""


def _sync_log(spark: SparkSession, d: str) -> DataFrame:
    """The log with signups as prepares; the key's next event completes one: a purchase commits, a click aborts."""
    log = mutations(spark, d)
    w = Window.partitionBy("vb", "cid", "key").orderBy("seqno")
    after = F.lag("event_type").over(w) == "signup"
    op = F.when(F.col("event_type") == "signup", "pending_sync_write").when(after & (F.col("event_type") == "purchase"), "commit_sync_write").when(after & (F.col("event_type") == "click"), "abort_sync_write").otherwise("mutation")
    done = op.isin("commit_sync_write", "abort_sync_write")
    return log.withColumn("prepare_seqno", F.when(done, F.lag("seqno").over(w))).withColumn("op", op)


@query("filter_visibility", SYNC + " SELECT vb, seqno, sop AS op FROM ops WHERE sop NOT IN ('pending_sync_write', 'abort_sync_write')")
def filter_visibility(spark, d):
    return feed.filtered(_sync_log(spark, d)).select("vb", "seqno", "op")


@query("logical_delete", "SELECT vb, seqno, m.cid FROM m LEFT JOIN (SELECT * FROM coll WHERE cid <> 9) c USING (cid) WHERE c.cid IS NULL OR seqno < start_seqno")
def logical_delete(spark, d):
    return feed.logically_deleted(mutations(spark, d), model.collections(spark, d).where("cid <> 9")).select("vb", "seqno", "cid")


@query("manifest_join", "SELECT scope, collection, count(*) AS n FROM m JOIN coll USING (cid) GROUP BY 1, 2")
def manifest_join(spark, d):
    return mutations(spark, d).join(F.broadcast(model.collections(spark, d)), "cid").groupBy("scope", "collection").agg(F.count("*").alias("n"))


@query("vb_diff", ", a AS (SELECT vb, max(seqno) AS s FROM m GROUP BY vb), r AS (SELECT vb, max(seqno) AS s FROM m WHERE event_id % 10 <> 0 AND vb <> 3 GROUP BY vb) SELECT vb, a.s - coalesce(r.s, 0) AS behind FROM a FULL JOIN r USING (vb)")
def vb_diff(spark, d):
    log = mutations(spark, d)
    a = log.groupBy("vb").agg(F.max("seqno").alias("a"))
    r = log.where("event_id % 10 <> 0 AND vb <> 3").groupBy("vb").agg(F.max("seqno").alias("r"))
    return a.join(r, "vb", "full_outer").select("vb", (F.col("a") - F.coalesce("r", F.lit(0))).alias("behind"))


@query("prepare_commit_match", SYNC + " SELECT vb, cid, key, prepare_seqno, done_seqno, outcome FROM oc")
def prepare_commit_match(spark, d):
    return durability.prepare_outcomes(_sync_log(spark, d))


@query("dur_counters", SYNC + " SELECT vb, count(*) AS accepted, count(*) FILTER (outcome = 'committed') AS committed, count(*) FILTER (outcome = 'aborted') AS aborted FROM oc GROUP BY vb")
def dur_counters(spark, d):
    return durability.counters(durability.prepare_outcomes(_sync_log(spark, d)))


@query("dur_high_marks", SYNC + " SELECT vb, max(seqno) FILTER (sop = 'pending_sync_write') AS high_prepared, max(before_seqno) FILTER (sop IN ('commit_sync_write', 'abort_sync_write')) AS high_completed FROM ops GROUP BY vb")
def dur_high_marks(spark, d):
    return durability.high_marks(_sync_log(spark, d))


@query("dur_outstanding", SYNC + " SELECT vb, key, prepare_seqno AS seqno FROM oc WHERE outcome = 'pending'")
def dur_outstanding(spark, d):
    return durability.outstanding(_sync_log(spark, d)).select("vb", "key", "seqno")


@query("dur_timeout", SYNC + " SELECT vb, prepare_seqno FROM oc WHERE outcome = 'pending' AND us // 1000 + 3600000 < 1706000000000")
def dur_timeout(spark, d):
    log = _sync_log(spark, d)
    started = log.where("op = 'pending_sync_write'").select("vb", F.col("seqno").alias("prepare_seqno"), F.floor(F.col("us") / 1000).cast("long").alias("start_ms"), F.lit(3_600_000).alias("timeout_ms"))
    return durability.timed_out(durability.prepare_outcomes(log).join(started, ["vb", "prepare_seqno"]), AS_OF * 1000).select("vb", "prepare_seqno")


@query(
    "dur_commit_frontier",
    """, acks AS (SELECT vb, event_id % 3 AS node, max(seqno) AS ack FROM m WHERE seqno % 3 <> 1 OR event_id % 3 = 0 GROUP BY 1, 2)
    SELECT vb, least(list(ack ORDER BY ack DESC)[count(*) // 2 + 1], coalesce(max(ack) FILTER (node = 0), 0)) AS frontier FROM acks GROUP BY vb""",
)
def dur_commit_frontier(spark, d):
    log = mutations(spark, d)
    node = F.pmod("event_id", F.lit(3))
    return durability.commit_frontier(log.where((F.col("seqno") % 3 != 1) | (node == 0)).select("vb", node.alias("node"), (node == 0).alias("active"), "seqno"))


@query("union_backfill_memory", DEDUP + " SELECT vb, seqno, key FROM newest WHERE seqno <= 400 UNION ALL SELECT vb, seqno, key FROM dd WHERE seqno > 400")
def union_backfill_memory(spark, d):
    log = mutations(spark, d)
    return feed.backfill_and_memory(reads.latest(log), feed.dedup(log, ["vb", "checkpoint_id"]).select(log.columns), F.lit(400)).select("vb", "seqno", "key")


@query("stream_filtered_feed", DEDUP + " SELECT dd.vb, dd.seqno, dd.key FROM dd JOIN coll USING (cid) WHERE scope = 'AMERICA' AND seqno >= start_seqno AND seqno > 100")
def stream_filtered_feed(spark, d):
    rows = feed.dedup(mutations(spark, d), ["vb", "checkpoint_id"]).where("seqno > 100")
    return feed.filtered(rows, collections=model.collections(spark, d), scope="AMERICA").select("vb", "seqno", "key")


@query("stream_oso", "SELECT vb, cid, key, seqno, max(seqno) OVER (PARTITION BY vb) AS snapshot_end FROM newest WHERE cid = 10")
def stream_oso(spark, d):
    rows = reads.latest(mutations(spark, d).where("cid = 10"))
    return rows.withColumn("snapshot_end", F.max("seqno").over(Window.partitionBy("vb"))).select("vb", "cid", "key", "seqno", "snapshot_end")


@query("stream_cache_transfer_budget", ", u AS (SELECT vb, seqno, sum(strlen(value)) OVER (PARTITION BY vb ORDER BY seqno)::BIGINT AS used FROM cur) SELECT * FROM u WHERE used <= 60")
def stream_cache_transfer_budget(spark, d):
    return feed.transfer_budget(reads.current(mutations(spark, d), AS_OF), 60).select("vb", "seqno", "used")


@query("stream_flow_control", ", u AS (SELECT vb, seqno, sum(strlen(value) - CASE WHEN seqno % 4 = 0 THEN 30 ELSE 0 END) OVER (PARTITION BY vb ORDER BY seqno)::BIGINT AS unacked FROM m) SELECT *, unacked >= 500 AS paused FROM u")
def stream_flow_control(spark, d):
    messages = mutations(spark, d).select("vb", "seqno", F.octet_length("value").alias("bytes"), F.when(F.col("seqno") % 4 == 0, 30).otherwise(0).alias("acked"))
    return feed.flow_control(messages, 500).select("vb", "seqno", "unacked", "paused")


@query("stream_system_events", "SELECT 'create_collection' AS event, cid, start_seqno AS seqno FROM coll WHERE scope = 'ASIA' UNION ALL SELECT 'modify_collection', cid, start_seqno + 1 FROM coll WHERE scope = 'ASIA' AND history")
def stream_system_events(spark, d):
    c = model.collections(spark, d).where("scope = 'ASIA'")
    made = c.select(F.lit("create_collection").alias("event"), "cid", F.col("start_seqno").alias("seqno"))
    return made.unionByName(c.where("history").select(F.lit("modify_collection").alias("event"), "cid", (F.col("start_seqno") + 1).alias("seqno")))


VERDICT = """, st AS (SELECT *, us // 1000000 AS delete_time FROM newest),
    v AS (SELECT st.*, CASE WHEN start_seqno IS NULL OR seqno < start_seqno THEN 'drop_collection'
        WHEN deleted AND seqno <> max(seqno) OVER (PARTITION BY vb) AND seqno <> max(seqno) OVER (PARTITION BY vb, cid) AND us // 1000000 < 1706500000 THEN 'purge_tombstone'
        WHEN NOT deleted AND exptime <> 0 AND exptime < 1707000000 THEN 'expire' ELSE 'keep' END AS verdict FROM st LEFT JOIN (SELECT cid, start_seqno FROM coll WHERE cid <> 11) c USING (cid))"""


def _verdicts(spark: SparkSession, d: str) -> DataFrame:
    state = reads.latest(mutations(spark, d)).withColumn("delete_time", F.floor(F.col("us") / 1_000_000).cast("long"))
    return maintenance.compaction(state, model.collections(spark, d).where("cid <> 11"), purge_before_ts=1_706_500_000, expire_from=AS_OF + 1_000_000)


@query("compact_keep", VERDICT + " SELECT vb, cid, key, seqno, verdict FROM v")
def compact_keep(spark, d):
    return _verdicts(spark, d).select("vb", "cid", "key", "seqno", "verdict")


@query("compact_stats", VERDICT + " SELECT verdict, count(*) AS n, sum(strlen(value))::BIGINT AS bytes FROM v GROUP BY verdict")
def compact_stats(spark, d):
    return _verdicts(spark, d).groupBy("verdict").agg(F.count("*").alias("n"), F.sum(F.octet_length("value")).alias("bytes"))


@query("expiry_pager", "SELECT vb, cid, key, rev + 1 AS rev, 1707000000::BIGINT AS exptime, 'ttl' AS delete_source FROM newest WHERE NOT deleted AND exptime <> 0 AND exptime < 1707000000")
def expiry_pager(spark, d):
    return maintenance.expiry_tombstones(reads.latest(mutations(spark, d)), AS_OF + 1_000_000).select("vb", "cid", "key", "rev", "exptime", "delete_source")


@query("tombstone_purge", ", h AS (SELECT *, max(seqno) OVER (PARTITION BY vb, cid) AS high FROM newest) SELECT vb, cid, key, seqno FROM h WHERE deleted AND us // 1000000 < 1706500000 AND seqno <> high")
def tombstone_purge(spark, d):
    state = reads.latest(mutations(spark, d)).withColumn("delete_time", F.floor(F.col("us") / 1_000_000).cast("long"))
    return maintenance.purged_tombstones(state, 1_706_500_000).select("vb", "cid", "key", "seqno")


EVICT = """, ag AS (SELECT n.vb, n.key, n.rev AS frequency, (greatest(0, t.top - n.cas) >> 16)::BIGINT AS age FROM newest n JOIN (SELECT vb, max(cas) AS top FROM m GROUP BY vb) t USING (vb)),
    fr AS (SELECT frequency, sum(count(*)) OVER (ORDER BY frequency) AS c FROM ag GROUP BY frequency), fc AS (SELECT min(frequency) AS cold FROM fr WHERE c >= greatest(1, floor((SELECT count(*) FROM ag) * 40.0 / 100))),
    ar AS (SELECT age, sum(count(*)) OVER (ORDER BY age) AS c FROM ag GROUP BY age), ac AS (SELECT min(age) AS old FROM ar WHERE c >= greatest(1, floor((SELECT count(*) FROM ag) * 30.0 / 100))),
    ev AS (SELECT ag.*, frequency <= cold AND (age >= old OR frequency < 50) AS evict FROM ag, fc, ac)"""


def _evictions(spark: SparkSession, d: str) -> DataFrame:
    rows = maintenance.age(mutations(spark, d)).select("vb", "key", F.col("rev").alias("frequency"), "age")
    return maintenance.eviction(rows, frequency_percent=40.0, age_percent=30.0, exempt_frequency=50)


@query("evict_decision", EVICT + " SELECT vb, key, frequency, age, evict FROM ev")
def evict_decision(spark, d):
    return _evictions(spark, d)


@query("mfu_decay", EVICT + " SELECT vb, key, CASE WHEN evict THEN frequency ELSE greatest(frequency - 1, 0) END AS frequency FROM ev")
def mfu_decay(spark, d):
    return _evictions(spark, d).select("vb", "key", maintenance.decayed(F.col("frequency"), F.col("evict")).alias("frequency"))


@query("evict_ratios", ", me AS (SELECT vb % 4 = 0 AS replica, strlen(value)::DOUBLE AS b FROM newest), s AS (SELECT sum(b) FILTER (replica) AS r, sum(b) FILTER (NOT replica) AS a FROM me) SELECT round(least(1.0, 600 / r), 9) AS replica_ratio, round(least(1.0, greatest(0.0, 600 - r) / a), 9) AS active_ratio FROM s")
def evict_ratios(spark, d):
    memory = reads.latest(mutations(spark, d)).select((F.pmod("vb", F.lit(4)) == 0).alias("replica"), F.octet_length("value").alias("evictable"))
    return maintenance.eviction_ratios(memory, 600)


NEW_MANIFEST = ", nw AS (SELECT cid, CASE WHEN cid = 12 THEN start_seqno + 5 ELSE start_seqno END AS start_seqno, CASE WHEN cid = 14 THEN 99 ELSE max_ttl END AS max_ttl, history FROM coll WHERE cid <> 10 UNION ALL SELECT 99, 0, NULL, false)"


@query(
    "manifest_diff",
    NEW_MANIFEST + """ SELECT * FROM (SELECT coalesce(a.cid, b.cid)::BIGINT AS cid, CASE WHEN a.cid IS NULL THEN 'create' WHEN b.cid IS NULL THEN 'drop' WHEN b.start_seqno > a.start_seqno THEN 'flush'
        WHEN a.max_ttl IS DISTINCT FROM b.max_ttl OR a.history <> b.history THEN 'modify' END AS change FROM coll a FULL JOIN nw b ON a.cid = b.cid) WHERE change IS NOT NULL""",
)
def manifest_diff(spark, d):
    old = model.collections(spark, d).select("cid", "start_seqno", "max_ttl", "history")
    new = old.where("cid <> 10").select("cid", F.when(F.col("cid") == 12, F.col("start_seqno") + 5).otherwise(F.col("start_seqno")).alias("start_seqno"), F.when(F.col("cid") == 14, 99).otherwise(F.col("max_ttl")).cast("long").alias("max_ttl"), "history")
    extra = spark.range(1).select(F.lit(99).cast("long").alias("cid"), F.lit(0).cast("long").alias("start_seqno"), F.lit(None).cast("long").alias("max_ttl"), F.lit(False).alias("history"))
    return catalog.diff(old, new.unionByName(extra))


@query("catalog_lookup", "SELECT sid, cid FROM coll WHERE scope = 'EUROPE' AND collection = (SELECT min(collection) FROM coll WHERE scope = 'EUROPE')")
def catalog_lookup(spark, d):
    c = model.collections(spark, d)
    first = c.where("scope = 'EUROPE'").agg(F.min("collection")).first()[0]
    return catalog.lookup(c, f"EUROPE.{first}")


@query("catalog_validate", ", x AS (SELECT cid, scope, CASE WHEN cid % 9 = 0 THEN 'bad name' ELSE collection END AS collection FROM coll) SELECT cid, 'name' AS rule FROM x WHERE NOT regexp_matches(collection, '^[A-Za-z0-9_%-]+$')")
def catalog_validate(spark, d):
    c = model.collections(spark, d).withColumn("collection", F.when(F.col("cid") % 9 == 0, "bad name").otherwise(F.regexp_replace("collection", " ", "_")))
    return catalog.violations(c.where("cid % 9 = 0 OR NOT collection LIKE '% %'")).where("rule = 'name'")


@query("vb_filter_split", "SELECT vb, ((row_number() OVER (ORDER BY vb) - 1) % 5)::BIGINT AS part FROM (SELECT DISTINCT vb FROM m)")
def vb_filter_split(spark, d):
    return catalog.partition_split(mutations(spark, d).select("vb").distinct(), 5)


@query("subdoc_get", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events", log=False)
def subdoc_get(spark, d):
    return model.read(spark, d, "events").select("event_id", subdoc.get(F.col("props"), "k").alias("k"))


@query("subdoc_exists", "SELECT event_id, json_exists(props, '$.k') AS has_k, json_exists(props, '$.z') AS has_z FROM events", log=False)
def subdoc_exists(spark, d):
    return model.read(spark, d, "events").select("event_id", subdoc.exists(F.col("props"), "k").alias("has_k"), subdoc.exists(F.col("props"), "z").alias("has_z"))


@query("subdoc_count", "SELECT event_id, len(json_keys(props))::BIGINT AS n FROM events", log=False)
def subdoc_count(spark, d):
    return model.read(spark, d, "events").select("event_id", subdoc.count(F.col("props")).alias("n"))


def _folded(spark: SparkSession, d: str, *ops) -> DataFrame:
    e = model.spread(model.read(spark, d, "events"), "event_id")
    return e.select("event_id", subdoc.fold(F.col("props"), F.array(*ops)).alias("r")).select("event_id", "r.status", "r.doc")


@query("subdoc_counter", """SELECT event_id, 'success' AS status, '{"k":' || (json_extract_string(props, '$.k')::BIGINT + event_id % 5 + 1)::VARCHAR || '}' AS doc FROM events""", log=False)
def subdoc_counter(spark, d):
    return _folded(spark, d, subdoc.operation("counter", "k", (F.col("event_id") % 5 + 1).cast("string")))


@query("subdoc_push_last", """SELECT event_id, 'success' AS status, '{"k":' || json_extract_string(props, '$.k') || ',"a":[' || event_id || ',2]}' AS doc FROM events""", log=False)
def subdoc_push_last(spark, d):
    return _folded(spark, d, subdoc.operation("push_last", "a", F.col("event_id").cast("string"), subdoc.MAKE_PARENTS), subdoc.operation("push_last", "a", "2"))


@query("subdoc_add_unique", """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'path_exists' ELSE 'success' END AS status, CASE WHEN event_id % 2 = 0 THEN props ELSE '{"k":' || json_extract_string(props, '$.k') || ',"a":[0,1]}' END AS doc FROM events""", log=False)
def subdoc_add_unique(spark, d):
    return _folded(spark, d, subdoc.operation("push_last", "a", "0", subdoc.MAKE_PARENTS), subdoc.operation("add_unique", "a", (F.col("event_id") % 2).cast("string")))


@query("subdoc_dict_upsert", """SELECT event_id, 'success' AS status, '{"k":"v","n":' || event_id || '}' AS doc FROM events""", log=False)
def subdoc_dict_upsert(spark, d):
    return _folded(spark, d, subdoc.operation("upsert", "k", '"v"'), subdoc.operation("upsert", "n", F.col("event_id").cast("string")))


@query("array_documents", "SELECT conv_id, count(*) AS turns, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id", log=False)
def array_documents(spark, d):
    c = model.read(spark, d, "conversations")
    grouped = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("a"))
    return grouped.select("conv_id", F.size("a").cast("long").alias("turns"), F.array_join(F.transform("a", lambda x: x["role"]), ",").alias("roles"))


@query("xattr_prune", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '_sync' END AS kept FROM m")
def xattr_prune(spark, d):
    from tidelog.operators.writes import prune_attributes

    attributes = F.map_filter(F.create_map(F.lit("user"), F.col("event_type"), F.lit("_sync"), F.col("key")), lambda k, _: (k == "user") | (F.col("event_id") % 2 == 0))
    return mutations(spark, d).select("event_id", F.array_join(F.map_keys(prune_attributes(attributes)), ",").alias("kept"))


@query("vattr_document", """SELECT event_id, '{"CAS":"0x' || lpad(lower(to_hex(cas)), 16, '0') || '","seqno":"0x' || lpad(lower(to_hex(seqno)), 16, '0') || '","exptime":' || exptime || ',"value_bytes":' || strlen(value) || ',"deleted":' || deleted::VARCHAR || '}' AS doc FROM m""")
def vattr_document(spark, d):
    as_hex = lambda c: F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(c)), 16, "0"))
    return mutations(spark, d).select("event_id", F.to_json(F.struct(as_hex("cas").alias("CAS"), as_hex("seqno").alias("seqno"), "exptime", F.octet_length("value").alias("value_bytes"), "deleted")).alias("doc"))


@query("mfu_histogram", "SELECT rev // 8 AS bin, count(*) AS n, sum(count(*)) OVER (ORDER BY rev // 8)::BIGINT AS cumulative FROM newest GROUP BY 1")
def mfu_histogram(spark, d):
    return stats.histogram(reads.latest(mutations(spark, d)), F.floor(F.col("rev") / 8).cast("long"))
