"""Registered queries: statistics, top keys, histograms."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog import model
from tidelog.functions import scalars
from tidelog.model import AS_OF, mutations
from tidelog.operators import reads, stats
from tidelog.plans.registry import query


@query("stats_by_state", "SELECT CASE vb % 4 WHEN 0 THEN 'replica' WHEN 1 THEN 'pending' ELSE 'active' END AS vb_state, count(*) FILTER (NOT deleted) AS items, count(*) FILTER (deleted) AS tombstones, sum(strlen(value))::BIGINT AS bytes, max(seqno) AS high_seqno FROM newest GROUP BY 1")
def stats_by_state(spark, d):
    rest = F.pmod("vb", F.lit(4))
    return stats.by_state(reads.latest(mutations(spark, d)), F.when(rest == 0, "replica").when(rest == 1, "pending").otherwise("active"))


@query("stats_datatype", "SELECT CASE WHEN json_valid(v) THEN 1 ELSE 0 END::BIGINT AS datatype, count(*) AS docs FROM (SELECT CASE WHEN event_id % 3 = 0 THEN 'x' || value ELSE value END AS v FROM m) GROUP BY 1")
def stats_datatype(spark, d):
    docs = mutations(spark, d).select(F.when(F.pmod("event_id", F.lit(3)) == 0, F.concat(F.lit("x"), "value")).otherwise(F.col("value")).alias("value"))
    return stats.datatype_counts(docs)


@query("stats_collection", "SELECT cid, count(*) FILTER (NOT deleted) AS item_count, sum(strlen(value))::BIGINT AS data_size, max(seqno) AS high_seqno FROM newest GROUP BY cid")
def stats_collection(spark, d):
    return stats.collection_stats(reads.latest(mutations(spark, d)))


@query("stats_collection_details", "SELECT vb, cid, min(seqno) AS start_seqno, max(seqno) AS high_seqno, count(*) AS items, sum(strlen(value))::BIGINT AS disk_size FROM m GROUP BY vb, cid")
def stats_collection_details(spark, d):
    return stats.collection_details(mutations(spark, d))


@query("stats_scope_rollup", "SELECT r_name AS scope, n_name AS collection, count(*) AS item_count, sum(round(c_acctbal * 100)::BIGINT)::BIGINT AS total FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)", log=False)
def stats_scope_rollup(spark, d):
    c = model.read(spark, d, "customer").select((F.col("c_nationkey") + 8).cast("long").alias("cid"), "c_acctbal")
    joined = c.join(F.broadcast(model.collections(spark, d)), "cid")
    return stats.scope_rollup(joined, F.round(F.col("c_acctbal") * 100).cast("long"))


@query("stats_vb_seqnos", "SELECT vb, max(seqno) AS high_seqno, max(seqno) AS max_visible, min(seqno) AS low_seqno, max(cas) AS max_cas FROM m GROUP BY vb")
def stats_vb_seqnos(spark, d):
    return stats.vb_seqnos(mutations(spark, d))


@query("stats_max_visible", "SELECT vb, max(seqno) FILTER (event_type <> 'signup') AS max_visible FROM m GROUP BY vb")
def stats_max_visible(spark, d):
    log = mutations(spark, d).withColumn("op", F.when(F.col("event_type") == "signup", "pending_sync_write").otherwise(F.col("op")))
    return stats.vb_seqnos(log).select("vb", "max_visible")


@query(
    "stats_hdr_like",
    ", b AS (SELECT CASE WHEN amount < 1 THEN 0.0 ELSE pow(2, floor(log2(amount))) + floor((amount - pow(2, floor(log2(amount)))) / pow(2, floor(log2(amount))) * 4) * pow(2, floor(log2(amount))) / 4 END AS bin FROM m), g AS (SELECT bin, count(*) AS n FROM b GROUP BY bin) SELECT bin, n, sum(n) OVER (ORDER BY bin)::BIGINT AS cumulative FROM g",
)
def stats_hdr_like(spark, d):
    return stats.histogram(mutations(spark, d), stats.octave_bins(F.col("amount")))


PERCENTS = [0.0, 10.0, 50.0, 90.0, 99.0, 100.0]


@query(
    "stats_percentile_bin",
    ", g AS (SELECT floor(amount)::BIGINT AS bin, count(*) AS n FROM m GROUP BY 1), r AS (SELECT bin, sum(n) OVER (ORDER BY bin)::BIGINT AS c FROM g), t AS (SELECT max(c) AS total FROM r) SELECT percent, min(bin) AS bin FROM r, t, (SELECT unnest([0.0, 10.0, 50.0, 90.0, 99.0, 100.0])::DOUBLE AS percent) WHERE c >= greatest(1, floor(percent / 100 * total + 0.5)) GROUP BY percent",
)
def stats_percentile_bin(spark, d):
    return stats.percentile_bin(mutations(spark, d), F.floor("amount").cast("long"), PERCENTS, rounded=True)


@query(
    "stats_eviction_threshold",
    ", g AS (SELECT floor(amount)::BIGINT AS bin, count(*) AS n FROM m GROUP BY 1), r AS (SELECT bin, sum(n) OVER (ORDER BY bin)::BIGINT AS c FROM g), t AS (SELECT max(c) AS total FROM r) SELECT percent, min(bin) AS bin FROM r, t, (SELECT unnest([0.0, 10.0, 50.0, 90.0, 99.0, 100.0])::DOUBLE AS percent) WHERE c >= greatest(1, floor(percent / 100 * total)) GROUP BY percent",
)
def stats_eviction_threshold(spark, d):
    return stats.percentile_bin(mutations(spark, d), F.floor("amount").cast("long"), PERCENTS, rounded=False)


@query("stats_interval_rate", "SELECT us // 3600000000 * 3600 AS start_s, count(*) FILTER (event_type IN ('click', 'view')) AS lookups, count(*) FILTER (event_type NOT IN ('click', 'view')) AS mutations FROM m GROUP BY 1")
def stats_interval_rate(spark, d):
    return stats.interval_rates(mutations(spark, d), 3600)


@query("stats_resident_ratio", "SELECT vb, round(count(*) FILTER (length(value) % 2 = 0) * 100.0::DOUBLE / count(*), 6) AS resident_percent FROM newest GROUP BY vb")
def stats_resident_ratio(spark, d):
    return stats.resident_ratio(reads.latest(mutations(spark, d)), F.length("value") % 2 == 0)


@query("stats_expiry", "SELECT cid, count(*) FILTER (exptime <> 0) AS with_expiry, count(*) FILTER (exptime <> 0 AND exptime < 1706000000) AS expired FROM newest GROUP BY cid")
def stats_expiry(spark, d):
    return stats.expiry_counts(reads.latest(mutations(spark, d)), AS_OF)


@query("stats_value_sizes", "SELECT pow(2, floor(log2(greatest(strlen(text), 1)))) AS bin, count(*) AS n FROM documents GROUP BY 1", log=False)
def stats_value_sizes(spark, d):
    docs = model.read(spark, d, "documents")
    return stats.histogram(docs, stats.octave_bins(F.octet_length("text").cast("double"), 1)).withColumn("bin", F.greatest(F.lit(1.0), "bin")).groupBy("bin").agg(F.sum("n").alias("n"))


@query("stats_response_codes", "SELECT event_type AS status, count(*) AS n, round(avg(amount), 6) AS mean, max(amount) AS most FROM m GROUP BY 1")
def stats_response_codes(spark, d):
    return mutations(spark, d).groupBy(F.col("event_type").alias("status")).agg(F.count("*").alias("n"), F.round(F.avg("amount"), 6).alias("mean"), F.max("amount").alias("most"))


@query(
    "stats_connections",
    """, c AS (SELECT CASE WHEN event_id % 3 = 0 THEN event_type ELSE event_type || ':' || key END AS name, floor(amount)::BIGINT AS items_sent, strlen(value)::BIGINT AS bytes FROM m)
    SELECT split_part(name, ':', 1) AS kind, count(*) AS count, sum(items_sent)::BIGINT AS items_sent, sum(bytes)::BIGINT AS bytes FROM c WHERE contains(name, ':') GROUP BY 1
    UNION ALL SELECT ':total', count(*), sum(items_sent)::BIGINT, sum(bytes)::BIGINT FROM c""",
)
def stats_connections(spark, d):
    name = F.when(F.pmod("event_id", F.lit(3)) == 0, F.col("event_type")).otherwise(F.concat_ws(":", "event_type", "key"))
    rows = mutations(spark, d).select(name.alias("name"), F.floor("amount").cast("long").alias("items_sent"), F.octet_length("value").cast("long").alias("bytes"))
    return stats.connection_totals(rows)


@query("topkeys", "SELECT l_partkey, count(*) AS accesses FROM lineitem GROUP BY 1 ORDER BY accesses DESC, l_partkey LIMIT 20", log=False)
def topkeys(spark, d):
    return stats.top_keys(model.read(spark, d, "lineitem"), ["l_partkey"], 20)


@query("topkeys_filtered", "SELECT cid, key, count(*) AS accesses FROM m WHERE cid IN (8, 10) GROUP BY 1, 2 ORDER BY accesses DESC, cid, key LIMIT 10")
def topkeys_filtered(spark, d):
    return stats.top_keys(mutations(spark, d).where(F.col("cid").isin(8, 10)), ["cid", "key"], 10)


@query("topkeys_capped", ", f AS (SELECT key, min(event_id) AS first, count(*) AS n FROM m GROUP BY key), c AS (SELECT max(first) AS cut FROM (SELECT first FROM f ORDER BY first LIMIT 40)) SELECT sum(n) FILTER (first <= cut)::BIGINT AS collected, coalesce(sum(n) FILTER (first > cut), 0)::BIGINT AS omitted FROM f, c")
def topkeys_capped(spark, d):
    return stats.capped_keys(mutations(spark, d), "key", "event_id", 40)


@query("throttle_window", ", u AS (SELECT us // 3600000000 * 3600 AS start_s, sum(ceil(b / 1024))::BIGINT AS write_units, sum(ceil(b / 4096))::BIGINT AS read_units FROM (SELECT us, floor(amount * 100)::BIGINT::DOUBLE AS b FROM m) GROUP BY 1) SELECT *, greatest(0, write_units - 40)::BIGINT AS throttled FROM u")
def throttle_window(spark, d):
    rows = mutations(spark, d).select("us", F.floor(F.col("amount") * 100).cast("long").alias("bytes"))
    return stats.throttle(rows, 3600, 40)


@query("fn_ids_and_times", "SELECT event_id, lower(to_hex(cid)) AS cid_hex, cas // 1000000000 AS cas_s, strlen(key) BETWEEN 1 AND 250 AS valid, 'c' || ':' || cid::VARCHAR || ':' || key AS stat FROM m")
def fn_ids_and_times(spark, d):
    return mutations(spark, d).select("event_id", scalars.hex_id(F.col("cid")).alias("cid_hex"), scalars.clock_seconds(F.col("cas")).alias("cas_s"), scalars.valid_key(F.col("key")).alias("valid"), scalars.stat_name(F.lit("c"), F.col("cid").cast("string"), F.col("key")).alias("stat"))


@query("fn_partition_of")
def fn_partition_of(spark, d):
    return mutations(spark, d).select("key", scalars.partition_of(F.col("key"), 1024).alias("partition")).distinct()
