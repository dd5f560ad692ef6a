"""Partitions: their states, what streams on them ask for and how they end, and what their owners are told."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Bits of a stream request's flags, and the ends that a stream may come to, in order of their numbers.
STREAM_FLAGS = {"take_over": 0x01, "disk_only": 0x02, "to_latest": 0x04, "no_value": 0x08, "active_only": 0x10, "strict_uuid": 0x20, "from_latest": 0x40, "ignore_purged": 0x80, "cache_transfer": 0x100}
STREAM_ENDS = ["ok", "closed", "state_changed", "disconnected", "slow", "backfill_failed", "rollback", "filter_empty", "lost_privileges"]


def flag_names(flags: Column) -> Column:
    """Names of the bits that are set, in order of the bits."""
    named = F.array(*[F.when(flags.bitwiseAND(F.lit(bit)) != 0, F.lit(name)) for name, bit in STREAM_FLAGS.items()])
    return F.array_join(F.filter(named, lambda x: x.isNotNull()), ",")


def resolved_requests(requests: DataFrame) -> DataFrame:
    """requests (flags, start_seqno, end_seqno, high_seqno, state) with the range that the flags make of them and a status.

    From the latest starts at the high seqno, to the latest and disk-only end there; a take-over has no end; a stream that
    wants an active partition is refused on any other.
    """
    has = lambda name: F.col("flags").bitwiseAND(F.lit(STREAM_FLAGS[name])) != 0
    start = F.when(has("from_latest"), F.col("high_seqno")).otherwise(F.col("start_seqno"))
    end = F.when(has("take_over"), F.lit((1 << 63) - 1)).when(has("to_latest") | has("disk_only"), F.col("high_seqno")).otherwise(F.col("end_seqno"))
    status = F.when(has("active_only") & (F.col("state") != "active"), "not_my_partition").when(start > end, "out_of_range").otherwise("success")
    return requests.withColumns({"from_seqno": start, "to_seqno": end, "status": status})


def stream_ends(streams: DataFrame) -> DataFrame:
    """Why each stream (sent_seqno, end_seqno, connected, state_changed, filter_collections, gone_collections, behind_bytes, limit_bytes) ends, null while it goes on.

    What ends it at once is looked at first: the connection, then the partition, then the filter, then its own end.
    """
    why = F.when(~F.col("connected"), "disconnected").when(F.col("state_changed"), "state_changed").when((F.col("filter_collections") > 0) & (F.col("gone_collections") >= F.col("filter_collections")), "filter_empty")
    return streams.withColumn("ended", why.when(F.col("sent_seqno") >= F.col("end_seqno"), "ok"))


def dropped_cursors(cursors: DataFrame, to_free: int) -> DataFrame:
    """cursors (vb, name, seqno, held: bytes kept for it alone and those behind it) with dropped: the furthest behind first until to_free is reached.

    A dropped cursor's stream reads on from disk. Per partition the running sum is over its cursors, a short list.
    """
    before = Window.partitionBy("vb").orderBy("seqno", "name").rowsBetween(Window.unboundedPreceding, -1)
    return cursors.withColumn("dropped", F.coalesce(F.sum("held").over(before), F.lit(0)) < to_free)


def persistence_waits(requests: DataFrame, flushes: DataFrame) -> DataFrame:
    """requests (request_id, vb, seqno, at, timeout) with the time of the first flush (vb, at, persisted) that covers them, and a status.

    A request that is covered already is answered at once; one whose flush comes after its time is `temporary_failure`.
    """
    f = flushes.select("vb", F.col("at").alias("flushed_at"), "persisted")
    met = requests.join(f, "vb", "left").groupBy("request_id", "vb", "seqno", "at", "timeout").agg(F.min(F.when(F.col("persisted") >= F.col("seqno"), F.col("flushed_at"))).alias("covered_at"))
    done = F.greatest("at", "covered_at")
    late = F.col("covered_at").isNull() | (done > F.col("at") + F.col("timeout"))
    return met.withColumn("status", F.when(late, "temporary_failure").otherwise("success")).withColumn("done_at", F.when(~late, done)).drop("covered_at")


def stuck(connections: DataFrame, pattern: str, now: int, idle: int) -> DataFrame:
    """Connections (name, last_sent, paused) to cut: their name matches all of the pattern, they are paused and silent for longer than `idle`."""
    return connections.where(F.col("name").rlike(f"^(?:{pattern})$") & F.col("paused") & (F.lit(now) - F.col("last_sent") > idle))


def transitions(changes: DataFrame) -> DataFrame:
    """changes (vb, at, state, high_seqno) with `before` and new_branch: a partition that becomes active starts a branch at its high seqno."""
    order = Window.partitionBy("vb").orderBy("at")
    before = F.lag("state").over(order)
    promoted = (F.col("state") == "active") & ~before.eqNullSafe(F.lit("active"))
    return changes.withColumn("before", before).withColumn("new_branch", promoted).withColumn("branch_seqno", F.when(promoted, F.col("high_seqno")))


def topology_status(changes: DataFrame) -> DataFrame:
    """Whether the topology of each change (state, chains: array of arrays, nulls for missing nodes) is one the state may have."""
    first = F.element_at("chains", 1)
    bad = (F.size("chains") > 2) | (F.size("chains") < 1) | F.exists("chains", lambda c: (F.size(c) < 1) | (F.size(c) > 4)) | first[0].isNull() | F.exists("chains", lambda c: F.size(F.array_distinct(F.filter(c, lambda n: n.isNotNull()))) < F.size(F.filter(c, lambda n: n.isNotNull())))
    return changes.withColumn("status", F.when(F.col("chains").isNull(), "success").when((F.col("state") != "active") | bad, "invalid_arguments").otherwise("success"))


def details(log: DataFrame, as_of: int) -> DataFrame:
    """Operational counts per partition: creations, updates, deletions, expiries due, bytes and clock."""
    created = (F.col("rev") == 1) & ~F.col("deleted")
    return log.groupBy("vb").agg(
        F.count_if(created).alias("creates"),
        F.count_if(~created & ~F.col("deleted")).alias("updates"),
        F.count_if("deleted").alias("deletes"),
        F.count_if((F.col("exptime") != 0) & (F.col("exptime") < as_of)).alias("expired"),
        F.sum(F.octet_length("value")).cast("long").alias("bytes"),
        F.max("cas").alias("max_cas"),
        F.count_distinct("checkpoint_id").alias("checkpoints"),
    )


def visit_order(partitions: DataFrame) -> DataFrame:
    """partitions (vb, state, pageable) numbered as an eviction run visits them: replicas before others, then most memory first."""
    order = Window.orderBy((F.col("state") != "replica").cast("int"), F.desc("pageable"), "vb")
    return partitions.withColumn("visit", F.row_number().over(order).cast("long"))


def map_counts(configs: DataFrame) -> DataFrame:
    """configs (bucket, body: JSON with a list of servers and, per partition, of node numbers, -1 for none) as active and replica counts per node.

    The map to come is taken if there is one.
    """
    shape = "vBucketServerMap struct<serverList:array<string>,vBucketMap:array<array<int>>,vBucketMapForward:array<array<int>>>"
    own = configs.select("bucket", F.from_json("body", shape)["vBucketServerMap"].alias("m"))
    chain = F.explode(F.coalesce("m.vBucketMapForward", "m.vBucketMap")).alias("chain")
    each = own.select("bucket", F.col("m.serverList").alias("servers"), chain).select("bucket", "servers", F.posexplode("chain").alias("place", "node")).where("node >= 0")
    return each.groupBy("bucket", F.get("servers", F.col("node")).alias("server")).agg(F.count_if(F.col("place") == 0).alias("active"), F.count_if(F.col("place") > 0).alias("replica"))


def clock_attribute(now_ns: Column, logical: Column) -> Column:
    """The virtual attribute of a partition's clock, as JSON."""
    return F.to_json(F.struct(F.struct(F.struct(F.floor(now_ns / 1_000_000_000).cast("long").cast("string").alias("now"), F.when(logical, "logical").otherwise("real").alias("mode")).alias("HLC")).alias("$vbucket")))
