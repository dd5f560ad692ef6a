"""Registered queries: reads, range scans, writes, conflicts, clocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog import model
from tidelog.model import AS_OF, mutations
from tidelog.operators import conflict, reads, writes
from tidelog.plans.registry import query


def _wanted(spark: SparkSession, d: str) -> DataFrame:
    return model.read(spark, d, "customer").select((F.lit(8) + F.pmod("c_custkey", F.lit(4))).cast("long").alias("cid"), F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("key"))


WANTED = ", wanted AS (SELECT 8 + c_custkey % 4 AS cid, 'u' || c_custkey::VARCHAR AS key FROM customer)"


@query("kv_latest_live", "SELECT vb, cid, key, seqno, cas, rev, value FROM cur")
def kv_latest_live(spark, d):
    return reads.current(mutations(spark, d), AS_OF).select("vb", "cid", "key", "seqno", "cas", "rev", "value")


@query("kv_get_multi", WANTED + " SELECT cid, key, seqno, value, CASE WHEN seqno IS NULL THEN 'no_such_key' ELSE 'success' END AS status FROM wanted LEFT JOIN cur USING (cid, key)")
def kv_get_multi(spark, d):
    return reads.get_multi(mutations(spark, d), _wanted(spark, d), AS_OF).select("cid", "key", "seqno", "value", "status")


@query("kv_get_meta", "SELECT vb, cid, key, seqno, deleted, flags, exptime, rev, cas FROM newest")
def kv_get_meta(spark, d):
    return reads.get_meta(mutations(spark, d)).select("vb", "cid", "key", "seqno", "deleted", "flags", "exptime", "rev", "cas")


@query("kv_getif_meta", "SELECT vb, cid, key, seqno, value FROM cur WHERE rev >= 65")
def kv_getif_meta(spark, d):
    return reads.get_if(mutations(spark, d), F.col("rev") >= 65, AS_OF).select("vb", "cid", "key", "seqno", "value")


@query("kv_replica_get", "SELECT vb, key, value FROM cur WHERE vb % 4 = 0")
def kv_replica_get(spark, d):
    return reads.current(mutations(spark, d).where(F.pmod("vb", F.lit(4)) == 0), AS_OF).select("vb", "key", "value")


@query(
    "kv_observe",
    WANTED + """, p AS (SELECT vb, max(seqno) - 20 AS persisted FROM m GROUP BY vb)
    SELECT w.cid, w.key, cas, CASE WHEN seqno IS NULL THEN 'not_found' WHEN deleted THEN 'logically_deleted' WHEN seqno > persisted THEN 'not_persisted' ELSE 'persisted' END AS state
    FROM wanted w LEFT JOIN (SELECT * FROM newest JOIN p USING (vb)) n ON n.cid = w.cid AND n.key = w.key""",
)
def kv_observe(spark, d):
    log = mutations(spark, d)
    return reads.observe(log, _wanted(spark, d), log.groupBy("vb").agg((F.max("seqno") - 20).alias("persisted_seqno")))


@query(
    "kv_vkey_compare",
    """, disk AS (SELECT * FROM ck WHERE seqno <= 500 QUALIFY row_number() OVER (PARTITION BY vb, cid, key ORDER BY seqno DESC) = 1)
    SELECT vb, cid, key, CASE WHEN a.seqno IS NULL OR b.seqno IS NULL THEN 'item_deleted' WHEN a.flags <> b.flags THEN 'flags_mismatch' WHEN strlen(a.value) <> strlen(b.value) THEN 'data_size_mismatch'
        WHEN a.rev <> b.rev THEN 'revseqno_mismatch' WHEN a.cas <> b.cas THEN 'cas_mismatch' WHEN a.value <> b.value THEN 'data_mismatch' ELSE 'valid' END AS status
    FROM newest a FULL JOIN disk b USING (vb, cid, key)""",
)
def kv_vkey_compare(spark, d):
    log = mutations(spark, d)
    return reads.compare(reads.latest(log), reads.state_at(log, 500))


@query("scan_range_inclusive", "SELECT cid, key, seqno FROM cur WHERE key >= 'u100' AND key <= 'u12'")
def scan_range_inclusive(spark, d):
    return reads.key_range(reads.current(mutations(spark, d), AS_OF), "u100", "u12").select("cid", "key", "seqno")


@query("scan_range_exclusive", "SELECT cid, key, seqno FROM cur WHERE key > 'u100' AND key < 'u12'")
def scan_range_exclusive(spark, d):
    return reads.key_range(reads.current(mutations(spark, d), AS_OF), "u100", "u12", after_low=True, before_high=True).select("cid", "key", "seqno")


@query("scan_range_parts", "SELECT p_partkey, p_name FROM part WHERE p_partkey >= 100 AND p_partkey < 400", log=False)
def scan_range_parts(spark, d):
    return model.read(spark, d, "part").where("p_partkey >= 100 AND p_partkey < 400").select("p_partkey", "p_name")


@query("scan_range_page", "SELECT cid, key, seqno FROM cur WHERE cid > 9 OR (cid = 9 AND key > 'u12') ORDER BY cid, key LIMIT 25")
def scan_range_page(spark, d):
    return reads.page(reads.current(mutations(spark, d), AS_OF), 25, (9, "u12")).select("cid", "key", "seqno")


@query("scan_byte_limit", ", b AS (SELECT vb, cid, key, coalesce(sum(strlen(value)) OVER (PARTITION BY vb ORDER BY cid, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS bytes_before FROM cur) SELECT * FROM b WHERE bytes_before < 40")
def scan_byte_limit(spark, d):
    return reads.byte_limit(reads.current(mutations(spark, d), AS_OF), 40).select("vb", "cid", "key", "bytes_before")


@query("scan_sample_hash", "SELECT cid, key FROM cur WHERE md5(key) < '4'")
def scan_sample_hash(spark, d):
    return reads.hash_sample(reads.current(mutations(spark, d), AS_OF), "4").select("cid", "key")


@query("scan_sample")
def scan_sample(spark, d):
    return reads.sample(reads.current(mutations(spark, d), AS_OF), 0.5, 1).select("cid", "key")


@query("scan_by_seqno", "SELECT vb, seqno, key, deleted FROM newest WHERE seqno >= 550")
def scan_by_seqno(spark, d):
    return reads.by_seqno(mutations(spark, d), 550).select("vb", "seqno", "key", "deleted")


@query("scan_history", "SELECT vb, seqno, key, rev FROM m WHERE seqno >= 550")
def scan_history(spark, d):
    return reads.history(mutations(spark, d), 550).select("vb", "seqno", "key", "rev")


@query("scan_get_by_seqno", "SELECT vb, seqno, key, value FROM newest WHERE seqno = 600")
def scan_get_by_seqno(spark, d):
    return reads.latest(mutations(spark, d)).where("seqno = 600").select("vb", "seqno", "key", "value")


@query("get_all_keys", "SELECT key FROM newest WHERE cid = 9 AND key >= 'u11' ORDER BY key LIMIT 20")
def get_all_keys(spark, d):
    return reads.all_keys(reads.latest(mutations(spark, d)), "u11", 20, 9)


@query("rollback_state", "SELECT vb, cid, key, seqno, rev, deleted FROM ck WHERE seqno <= 300 QUALIFY row_number() OVER (PARTITION BY vb, cid, key ORDER BY seqno DESC) = 1")
def rollback_state(spark, d):
    return reads.state_at(mutations(spark, d), 300).select("vb", "cid", "key", "seqno", "rev", "deleted")


STATE = ", st AS (SELECT *, NOT deleted AND NOT (exptime <> 0 AND exptime < 1706000000) AS alive FROM ck WHERE seqno <= 300 QUALIFY row_number() OVER (PARTITION BY vb, cid, key ORDER BY seqno DESC) = 1)"


@query(
    "write_add",
    STATE + " SELECT cid, key, event_id, value FROM (SELECT * FROM m WHERE seqno > 300 AND event_type = 'signup' QUALIFY row_number() OVER (PARTITION BY cid, key ORDER BY event_id) = 1) o WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.cid = o.cid AND st.key = o.key AND alive)",
)
def write_add(spark, d):
    log = mutations(spark, d)
    ops = log.where("seqno > 300 AND event_type = 'signup'").select("cid", "key", "event_id", "value")
    return writes.add(ops, reads.state_at(log, 300), AS_OF)


@query("write_replace", STATE + " SELECT cid, key, event_id, value FROM m o WHERE seqno > 300 AND event_type = 'purchase' AND EXISTS (SELECT 1 FROM st WHERE st.cid = o.cid AND st.key = o.key AND alive)")
def write_replace(spark, d):
    log = mutations(spark, d)
    ops = log.where("seqno > 300 AND event_type = 'purchase'").select("cid", "key", "event_id", "value")
    return writes.replace(ops, reads.state_at(log, 300), AS_OF)


@query(
    "write_cas_status",
    STATE + """ SELECT o.event_id, CASE WHEN st.cas IS NULL OR NOT alive THEN CASE WHEN o.op_cas = 0 THEN 'success' ELSE 'no_such_key' END WHEN o.op_cas = 0 OR o.op_cas = st.cas THEN 'success' ELSE 'key_already_exists' END AS status
    FROM (SELECT event_id, cid, key, CASE WHEN event_id % 3 = 0 THEN 0 ELSE cas END AS op_cas FROM m) o LEFT JOIN st ON st.cid = o.cid AND st.key = o.key""",
)
def write_cas_status(spark, d):
    log = mutations(spark, d)
    ops = log.select("event_id", "cid", "key", F.when(F.col("event_id") % 3 == 0, 0).otherwise(F.col("cas")).cast("long").alias("op_cas"))
    return writes.cas_status(ops, reads.state_at(log, 300), AS_OF).select("event_id", "status")


@query("write_touch", "SELECT vb, seqno, last_value(CASE WHEN event_type <> 'click' THEN value END IGNORE NULLS) OVER (PARTITION BY vb, cid, key ORDER BY seqno ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM m")
def write_touch(spark, d):
    log = mutations(spark, d).withColumn("value", F.when(F.col("event_type") != "click", F.col("value")))
    return writes.touch_runs(log).select("vb", "seqno", "value")


@query("write_counter_incr", "SELECT cid, key, (5 + sum(CASE WHEN rev > 1 THEN event_id % 7 ELSE 0 END))::VARCHAR AS counter FROM m GROUP BY cid, key")
def write_counter_incr(spark, d):
    ops = mutations(spark, d).select("cid", "key", "seqno", F.pmod("event_id", F.lit(7)).alias("delta"), F.lit(5).alias("initial"))
    return writes.counters(ops).withColumn("counter", F.col("counter").cast("string"))


@query("write_append", "SELECT cid, key, string_agg(event_type, '' ORDER BY seqno) AS value FROM m GROUP BY cid, key")
def write_append(spark, d):
    return writes.appended(mutations(spark, d).select("cid", "key", "seqno", F.col("event_type").alias("value")))


@query("ttl_convert", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 0 WHEN event_id * 700 <= 2592000 THEN event_id * 700 + 1706000000 ELSE event_id * 700 END AS expiry FROM m")
def ttl_convert(spark, d):
    t = F.when(F.col("event_id") % 5 == 0, 0).otherwise(F.col("event_id") * 700)
    return mutations(spark, d).select("event_id", writes.absolute_expiry(t, AS_OF).alias("expiry"))


@query("ttl_cap", "SELECT vb, seqno, CASE WHEN coalesce(max_ttl, 7200) > 0 AND (exptime = 0 OR exptime > 1706000000 + coalesce(max_ttl, 7200)) THEN 1706000000 + coalesce(max_ttl, 7200) ELSE exptime END AS exptime FROM m JOIN coll USING (cid)")
def ttl_cap(spark, d):
    joined = mutations(spark, d).join(F.broadcast(model.collections(spark, d)), "cid")
    return joined.select("vb", "seqno", writes.capped_expiry(F.col("exptime"), F.col("max_ttl"), 7200, AS_OF).alias("exptime"))


@query("lock_grants")
def lock_grants(spark, d):
    requests = mutations(spark, d).select("key", F.floor(F.col("us") / 1_000_000).cast("long").alias("at"))
    return writes.lock_intervals(requests, 1800)


@query("cr_lww", "SELECT cid, key, event_id, cas, rev FROM (SELECT *, row_number() OVER (PARTITION BY cid, key, event_id % 2 ORDER BY event_id) AS site_rev FROM m) QUALIFY row_number() OVER (PARTITION BY cid, key ORDER BY cas DESC, rev DESC, exptime DESC, flags DESC, value DESC) = 1")
def cr_lww(spark, d):
    return conflict.merge_sites(mutations(spark, d), "lww", ["cid", "key"], ["value"]).select("cid", "key", "event_id", "cas", "rev")


SITES = ", sites AS (SELECT cid, key, event_id, cas, row_number() OVER (PARTITION BY cid, key, event_id % 2 ORDER BY event_id) AS rev, exptime, flags, value, event_id % 2 AS site FROM m)"


def _sites(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    log = mutations(spark, d).withColumn("site", F.pmod("event_id", F.lit(2)))
    return log.withColumn("rev", F.row_number().over(Window.partitionBy("cid", "key", "site").orderBy("event_id")).cast("long")).select("cid", "key", "event_id", "cas", "rev", "exptime", "flags", "value", "site")


@query("cr_revseqno", SITES + " SELECT cid, key, event_id, rev FROM sites QUALIFY row_number() OVER (PARTITION BY cid, key ORDER BY rev DESC, cas DESC, exptime DESC, flags DESC, value DESC) = 1")
def cr_revseqno(spark, d):
    return conflict.merge_sites(_sites(spark, d), "rev", ["cid", "key"], ["value"]).select("cid", "key", "event_id", "rev")


@query(
    "cr_outcome_counts",
    SITES + """, w AS (SELECT * FROM sites QUALIFY row_number() OVER (PARTITION BY cid, key, site ORDER BY rev DESC) = 1)
    SELECT CASE WHEN e.cas IS NULL OR (i.rev, i.cas, i.exptime, i.flags) > (e.rev, e.cas, e.exptime, e.flags) THEN 'accept' WHEN (i.rev, i.cas, i.exptime, i.flags) < (e.rev, e.cas, e.exptime, e.flags) THEN 'reject_behind' ELSE 'reject_identical' END AS outcome, count(*) AS n
    FROM (SELECT * FROM w WHERE site = 1) i LEFT JOIN (SELECT * FROM w WHERE site = 0) e ON i.cid = e.cid AND i.key = e.key GROUP BY 1""",
)
def cr_outcome_counts(spark, d):
    tops = _sites(spark, d).groupBy("cid", "key", "site").agg(F.max_by(F.struct("cas", "rev", "exptime", "flags"), "rev").alias("row")).select("cid", "key", "site", "row.*")
    i, e = tops.where("site = 1").alias("i"), tops.where("site = 0").alias("e")
    joined = i.join(e, (F.col("i.cid") == F.col("e.cid")) & (F.col("i.key") == F.col("e.key")), "left")
    return joined.groupBy(conflict.outcome("rev", attributes=False).alias("outcome")).agg(F.count("*").alias("n"))


@query("hlc_mask", "SELECT event_id, cas FROM m")
def hlc_mask(spark, d):
    return mutations(spark, d).select("event_id", "cas")


@query("hlc_assign", "SELECT vb, seqno AS arrival, max((us * 1000 - (us * 1000) % 65536) - seqno) OVER (PARTITION BY vb ORDER BY seqno) + seqno AS cas FROM m")
def hlc_assign(spark, d):
    return conflict.assign_clocks(mutations(spark, d).select("vb", F.col("seqno").alias("arrival"), (F.col("us") * 1000).alias("now_ns")))


@query("hlc_drift", "SELECT vb, (sum(abs(event_id % 9 - 4) * 65536) // 1000)::BIGINT AS drift_us, count(*) AS updates, count(*) FILTER ((event_id % 9 - 4) * 65536 / 1000 > 150) AS ahead, count(*) FILTER ((event_id % 9 - 4) * 65536 / 1000 < -150) AS behind FROM m GROUP BY vb")
def hlc_drift(spark, d):
    rows = mutations(spark, d).select("vb", F.col("cas").alias("local_cas"), (F.col("cas") + (F.pmod("event_id", F.lit(9)) - 4) * 65536).alias("remote_cas"))
    return conflict.drift(rows, 150, 150)
