"""Registered queries: partitions and their streams, merged statistics, changes of the catalog."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidelog.functions import scalars
from tidelog.model import AS_OF, collections, mutations
from tidelog.operators import catalog, feed, partitions, stats
from tidelog.plans.registry import query

STATES = ["active", "replica", "pending", "dead"]


def _state(number):
    return F.element_at(F.array(*map(F.lit, STATES)), (F.pmod(number, F.lit(4)) + 1).cast("int"))


@query(
    "stream_flags",
    """, r AS (SELECT event_id, event_id % 512 AS flags, seqno AS start_seqno, seqno + 5 AS end_seqno, seqno + 3 AS high, ['active', 'replica', 'pending', 'dead'][1 + vb % 4] AS state FROM m),
    t AS (SELECT *, CASE WHEN flags & 64 <> 0 THEN high ELSE start_seqno END AS from_seqno, CASE WHEN flags & 1 <> 0 THEN 9223372036854775807 WHEN flags & 6 <> 0 THEN high ELSE end_seqno END AS to_seqno FROM r)
    SELECT event_id, from_seqno, to_seqno, CASE WHEN flags & 16 <> 0 AND state <> 'active' THEN 'not_my_partition' WHEN from_seqno > to_seqno THEN 'out_of_range' ELSE 'success' END AS status,
        array_to_string(list_filter([CASE WHEN flags & 1 <> 0 THEN 'take_over' END, CASE WHEN flags & 2 <> 0 THEN 'disk_only' END, CASE WHEN flags & 4 <> 0 THEN 'to_latest' END, CASE WHEN flags & 8 <> 0 THEN 'no_value' END, CASE WHEN flags & 16 <> 0 THEN 'active_only' END,
            CASE WHEN flags & 32 <> 0 THEN 'strict_uuid' END, CASE WHEN flags & 64 <> 0 THEN 'from_latest' END, CASE WHEN flags & 128 <> 0 THEN 'ignore_purged' END, CASE WHEN flags & 256 <> 0 THEN 'cache_transfer' END], lambda x: x IS NOT NULL), ',') AS names FROM t""",
)
def stream_flags(spark, d):
    rows = mutations(spark, d).select("event_id", (F.col("event_id") % 512).cast("int").alias("flags"), F.col("seqno").alias("start_seqno"), (F.col("seqno") + 5).alias("end_seqno"), (F.col("seqno") + 3).alias("high_seqno"), _state(F.col("vb")).alias("state"))
    return partitions.resolved_requests(rows).select("event_id", "from_seqno", "to_seqno", "status", partitions.flag_names(F.col("flags")).alias("names"))


@query(
    "stream_ends",
    """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'disconnected' WHEN event_id % 7 = 0 THEN 'state_changed' WHEN event_id % 3 > 0 AND event_id % 4 >= event_id % 3 THEN 'filter_empty' WHEN seqno >= 100 THEN 'ok' END AS ended FROM m""",
)
def stream_ends(spark, d):
    e = F.col("event_id")
    rows = mutations(spark, d).select("event_id", F.col("seqno").alias("sent_seqno"), F.lit(100).alias("end_seqno"), (e % 5 != 0).alias("connected"), (e % 7 == 0).alias("state_changed"), (e % 3).alias("filter_collections"), (e % 4).alias("gone_collections"))
    return partitions.stream_ends(rows).select("event_id", "ended")


@query(
    "cursor_drop_slow",
    """, c AS (SELECT vb, event_type AS name, max(seqno) AS seqno, sum(octet_length(value::BLOB)) AS held FROM m GROUP BY vb, event_type)
    SELECT vb, name, coalesce(sum(held) OVER (PARTITION BY vb ORDER BY seqno, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 2000 AS dropped FROM c""",
)
def cursor_drop_slow(spark, d):
    cursors = mutations(spark, d).groupBy("vb", F.col("event_type").alias("name")).agg(F.max("seqno").alias("seqno"), F.sum(F.octet_length("value")).alias("held"))
    return partitions.dropped_cursors(cursors, 2000).select("vb", "name", "dropped")


@query(
    "seqno_persistence",
    """, f AS (SELECT vb, checkpoint_id, max(us) + 1000000 AS flushed, max(seqno) AS persisted FROM ck GROUP BY vb, checkpoint_id),
    r AS (SELECT vb, checkpoint_id, min(seqno) AS seqno, min(us) AS asked FROM ck GROUP BY vb, checkpoint_id),
    j AS (SELECT r.vb, r.seqno, r.asked, min(f.flushed) FILTER (f.persisted >= r.seqno) AS covered FROM r LEFT JOIN f USING (vb) GROUP BY ALL)
    SELECT vb, seqno, CASE WHEN covered IS NULL OR greatest(asked, covered) > asked + 86400000000 THEN 'temporary_failure' ELSE 'success' END AS status,
        CASE WHEN NOT (covered IS NULL OR greatest(asked, covered) > asked + 86400000000) THEN greatest(asked, covered) END AS done_at FROM j""",
)
def seqno_persistence(spark, d):
    log = mutations(spark, d).groupBy("vb", "checkpoint_id").agg(F.max("us").alias("last_us"), F.max("seqno").alias("last"), F.min("seqno").alias("first"), F.min("us").alias("first_us"))
    flushes = log.select("vb", (F.col("last_us") + 1_000_000).alias("at"), F.col("last").alias("persisted"))
    requests = log.select(F.concat_ws(":", "vb", "first").alias("request_id"), "vb", F.col("first").alias("seqno"), F.col("first_us").alias("at"), F.lit(86_400_000_000).alias("timeout"))
    return partitions.persistence_waits(requests, flushes).select("vb", "seqno", "status", "done_at")


@query("connections_stuck", "SELECT key AS name, max(us) AS last_sent FROM m WHERE regexp_full_match(key, 'u[0-9]*7') GROUP BY key HAVING max(us) < 1706000000000000 - 3600000000 AND count(*) % 2 = 0")
def connections_stuck(spark, d):
    rows = mutations(spark, d).groupBy(F.col("key").alias("name")).agg(F.max("us").alias("last_sent"), (F.count("*") % 2 == 0).alias("paused"))
    return partitions.stuck(rows, "u[0-9]*7", AS_OF * 1_000_000, 3_600_000_000).select("name", "last_sent")


@query(
    "partition_transitions",
    """, t AS (SELECT vb, seqno, ['active', 'replica', 'pending', 'dead'][1 + event_id % 4] AS state FROM m), u AS (SELECT *, lag(state) OVER (PARTITION BY vb ORDER BY seqno) AS before FROM t)
    SELECT vb, seqno, state, before, state = 'active' AND before IS DISTINCT FROM 'active' AS new_branch, CASE WHEN state = 'active' AND before IS DISTINCT FROM 'active' THEN seqno END AS branch_seqno FROM u""",
)
def partition_transitions(spark, d):
    rows = mutations(spark, d).select("vb", F.col("seqno").alias("at"), _state(F.col("event_id")).alias("state"), F.col("seqno").alias("high_seqno"))
    return partitions.transitions(rows).select("vb", F.col("at").alias("seqno"), "state", "before", "new_branch", "branch_seqno")


@query(
    "partition_details",
    """SELECT vb, count(*) FILTER (rev = 1 AND NOT deleted) AS creates, count(*) FILTER (rev <> 1 AND NOT deleted) AS updates, count(*) FILTER (deleted) AS deletes, count(*) FILTER (exptime <> 0 AND exptime < 1706000000) AS expired,
        sum(octet_length(value::BLOB))::BIGINT AS bytes, max(cas) AS max_cas, count(DISTINCT checkpoint_id) AS checkpoints FROM ck GROUP BY vb""",
)
def partition_details(spark, d):
    return partitions.details(mutations(spark, d), AS_OF)


@query(
    "partition_visit_order",
    """, p AS (SELECT vb, ['active', 'replica', 'pending', 'dead'][1 + vb % 4] AS state, sum(octet_length(value::BLOB)) AS pageable FROM m GROUP BY vb)
    SELECT vb, row_number() OVER (ORDER BY CASE WHEN state = 'replica' THEN 0 ELSE 1 END, pageable DESC, vb) AS visit FROM p""",
)
def partition_visit_order(spark, d):
    rows = mutations(spark, d).groupBy("vb").agg(F.sum(F.octet_length("value")).alias("pageable")).withColumn("state", _state(F.col("vb")))
    return partitions.visit_order(rows).select("vb", "visit")


@query(
    "partition_map_counts",
    """, c AS (SELECT cid AS bucket, unnest(range(0, 12)) AS p FROM coll)
    SELECT bucket, 'n' || n::VARCHAR AS server, count(*) FILTER (place = 0) AS active, count(*) FILTER (place = 1) AS replica
    FROM (SELECT bucket, (p + bucket) % 3 AS n, 0 AS place FROM c UNION ALL SELECT bucket, (p + bucket + 1) % 4 - 1, 1 FROM c) WHERE n >= 0 GROUP BY bucket, n""",
)
def partition_map_counts(spark, d):
    chains = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda p: F.array((p + F.col("cid")) % 3, (p + F.col("cid") + 1) % 4 - 1))
    body = F.to_json(F.struct(F.struct(F.array(*[F.lit(f"n{k}") for k in range(3)]).alias("serverList"), chains.alias("vBucketMap")).alias("vBucketServerMap")))
    return partitions.map_counts(collections(spark, d).select(F.col("cid").alias("bucket"), body.alias("body")))


@query("partition_clock_attribute", """SELECT vb, '{"$vbucket":{"HLC":{"now":"' || (max(cas) // 1000000000)::VARCHAR || '","mode":"' || CASE WHEN vb % 2 = 0 THEN 'logical' ELSE 'real' END || '"}}}' AS attribute FROM m GROUP BY vb""")
def partition_clock_attribute(spark, d):
    rows = mutations(spark, d).groupBy("vb").agg(F.max("cas").alias("cas"))
    return rows.select("vb", partitions.clock_attribute(F.col("cas"), F.col("vb") % 2 == 0).alias("attribute"))


@query("histogram_merge", "SELECT bin, count(*) AS n FROM (SELECT rev AS bin FROM m) GROUP BY bin")
def histogram_merge(spark, d):
    parts = mutations(spark, d).groupBy("vb", F.col("rev").alias("bin")).agg(F.count("*").alias("n"))
    return stats.merged_histograms(parts)


@query(
    "timing_bins",
    """, t AS (SELECT (event_id * 7919 % 9973) * (event_id % 7) * (event_id % 7) * 20011 AS ns FROM m),
    b AS (SELECT CASE WHEN ns < 1000 THEN 'ns' WHEN ns < 1000000 THEN 'us' || lpad((ns // 10000 * 10)::VARCHAR, 3, '0') WHEN ns < 50000000 THEN 'ms' || lpad((ns // 1000000)::VARCHAR, 2, '0') WHEN ns < 5000000000 THEN 'half' || (ns // 500000000)::VARCHAR ELSE 'wayout' END AS bin FROM t)
    SELECT bin, count(*) AS n FROM b GROUP BY bin""",
)
def timing_bins(spark, d):
    e = F.col("event_id")
    nanos = (e * 7919 % 9973) * (e % 7) * (e % 7) * 20011
    return mutations(spark, d).groupBy(stats.timing_bin(nanos).alias("bin")).agg(F.count("*").alias("n"))


@query(
    "counter_expected",
    """, k AS (SELECT key, count(*) * 50 AS n FROM m GROUP BY key)
    SELECT key, n, (SELECT count(*) FROM range(1, 256) AS g(c) WHERE (c - 1) * c * (2 * c - 1) / 6.0 * 0.5 + c <= n) AS shown FROM k""",
)
def counter_expected(spark, d):
    rows = mutations(spark, d).groupBy("key").agg((F.count("*") * 50).alias("n"))
    return rows.select("key", "n", stats.expected_counter(F.col("n"), 0.5).alias("shown"))


@query("compaction_merge", "SELECT vb, bool_or(event_id % 97 = 0) AS drop_deletes, bool_or(deleted) AS retain_erroneous, max(us) AS purge_before_ts, max(seqno) AS purge_before_seq FROM m GROUP BY vb")
def compaction_merge(spark, d):
    rows = mutations(spark, d).select("vb", (F.col("event_id") % 97 == 0).alias("drop_deletes"), F.col("deleted").alias("retain_erroneous"), F.col("us").alias("purge_before_ts"), F.col("seqno").alias("purge_before_seq"))
    return stats.merged_compaction(rows)


@query(
    "flush_dedup_order",
    """SELECT vb, seqno, row_number() OVER (PARTITION BY vb ORDER BY cid, key, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END, seqno DESC) AS place FROM m WHERE event_id % 5 <> 0""",
)
def flush_dedup_order(spark, d):
    op = F.when(F.col("event_id") % 5 == 0, "checkpoint_start").when(F.col("event_id") % 3 == 0, "pending_sync_write").otherwise("mutation")
    return feed.dedup_order(feed.without_meta(mutations(spark, d).withColumn("op", op))).select("vb", "seqno", "place")


@query("datatype_negotiated", "SELECT event_id, event_id % 8 & 5 AS datatype FROM m")
def datatype_negotiated(spark, d):
    return mutations(spark, d).select("event_id", scalars.negotiated(F.col("event_id") % 8, F.lit(5)).alias("datatype"))


@query("text_helpers", "SELECT event_id, string_split(event_id::VARCHAR || '.' || key, '.')[2] AS second, TRY_CAST(substr(key, 2) AS BIGINT) AS number FROM m")
def text_helpers(spark, d):
    text = F.concat_ws(".", F.col("event_id").cast("string"), "key")
    return mutations(spark, d).select("event_id", scalars.split_limited(text, ".", 1)[1].alias("second"), scalars.whole_number(F.substring("key", 2, 20)).alias("number"))


def _next_manifest(spark, d):
    """The catalog after collections 3 mod 5 went, 1 mod 5 were flushed, and every even one got a twin."""
    now, c = collections(spark, d), F.col("cid")
    kept = now.where(c % 5 != 3).withColumn("start_seqno", F.when(c % 5 == 1, F.col("start_seqno") + 1000).otherwise(F.col("start_seqno")))
    return now, kept.unionByName(now.where(c % 2 == 0).withColumn("cid", c + 100).withColumn("collection", F.concat("collection", F.lit("_2"))))


@query(
    "manifest_events",
    """, x AS (SELECT cid, 'drop' AS change, 0 AS rank FROM coll WHERE cid % 5 = 3 UNION ALL SELECT cid + 100, 'create', 1 FROM coll WHERE cid % 2 = 0 UNION ALL SELECT cid, 'flush', 2 FROM coll WHERE cid % 5 = 1),
    n AS (SELECT *, row_number() OVER (ORDER BY rank, cid) AS place FROM x), h AS (SELECT vb, max(seqno) AS high FROM m GROUP BY vb)
    SELECT vb, cid, change, 12::BIGINT AS uid, high + place AS seqno, CASE WHEN change IN ('create', 'flush') THEN high + place END AS start_seqno FROM h, n""",
)
def manifest_events(spark, d):
    old, new = _next_manifest(spark, d)
    return catalog.system_events(old, new, 12, mutations(spark, d).groupBy("vb").agg(F.max("seqno").alias("high_seqno")))


@query(
    "manifest_succession",
    """SELECT 'scope_renamed' AS rule, sid AS id FROM coll WHERE sid = 2 GROUP BY sid UNION ALL SELECT 'collection_changed', cid FROM coll WHERE cid % 7 = 0""",
)
def manifest_succession(spark, d):
    old, _ = _next_manifest(spark, d)
    new = old.withColumn("scope", F.when(F.col("sid") == 2, "RENAMED").otherwise(F.col("scope"))).withColumn("collection", F.when(F.col("cid") % 7 == 0, F.concat("collection", F.lit("x"))).otherwise(F.col("collection")))
    return catalog.successor(old, new, 4, 5)
