"""The change feed in batch form: snapshots, deduplication, filters, resumption."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators.reads import KEY, latest

SYNC_ONLY_OPS = ("pending_sync_write", "abort_sync_write")


def dedup(log: DataFrame, within: list[str], history: Column | None = None) -> DataFrame:
    """Newest row per document within each snapshot; rows for which history holds are all kept."""
    if history is None:
        return latest(log, [*within, *[k for k in KEY if k not in within]])
    newest = latest(log.where(~history), [*within, *[k for k in KEY if k not in within]])
    return newest.unionByName(log.where(history))


def snapshot_ranges(log: DataFrame) -> DataFrame:
    """One marker per checkpoint: start, end, rows and distinct keys after deduplication."""
    kept = dedup(log, ["vb", "checkpoint_id"])
    return kept.groupBy("vb", "checkpoint_id").agg(F.min("seqno").alias("snap_start"), F.max("seqno").alias("snap_end"), F.count("*").alias("items"))


def gaps(rows: DataFrame) -> DataFrame:
    """Sequence numbers missing between consecutive rows of a partition."""
    before = F.lag("seqno").over(Window.partitionBy("vb").orderBy("seqno"))
    return rows.withColumn("gap", F.col("seqno") - before - 1).where("gap > 0").select("vb", "seqno", "gap")


def remaining(log: DataFrame, cursors: DataFrame) -> DataFrame:
    """Items after each cursor (name, vb, cursor_seqno)."""
    joined = cursors.join(log.select("vb", "seqno"), "vb").where(F.col("seqno") > F.col("cursor_seqno"))
    return joined.groupBy("name", "vb").agg(F.count("*").alias("remaining"))


def filtered(rows: DataFrame, *, collections: DataFrame | None = None, scope: str | None = None, sync_writes: bool = False) -> DataFrame:
    """Rows a stream shows: of live collections (of a scope), and prepares and aborts only to who asked for them.

    collections has cid, scope, start_seqno; a row older than its collection's start belongs to a dropped one.
    """
    if not sync_writes:
        rows = rows.where(~F.col("op").isin(*SYNC_ONLY_OPS))
    if collections is None:
        return rows
    wanted = collections if scope is None else collections.where(F.col("scope") == scope)
    found = rows.join(wanted.select("cid", "start_seqno"), "cid")
    return found.where(F.col("seqno") >= F.col("start_seqno")).drop("start_seqno")


def logically_deleted(rows: DataFrame, collections: DataFrame) -> DataFrame:
    """Rows whose collection is gone or was restarted after them."""
    found = rows.join(collections.select("cid", "start_seqno"), "cid", "left")
    return found.where(F.col("start_seqno").isNull() | (F.col("seqno") < F.col("start_seqno"))).drop("start_seqno")


def backfill_and_memory(disk: DataFrame, memory: DataFrame, boundary: Column) -> DataFrame:
    """A stream's history up to the boundary and what came after, without overlap."""
    return disk.where(F.col("seqno") <= boundary).unionByName(memory.where(F.col("seqno") > boundary))


def transfer_budget(docs: DataFrame, budget: int) -> DataFrame:
    """Per partition, documents in seqno order until the first that is larger than what is left of the budget."""
    order = Window.partitionBy("vb").orderBy("seqno")
    size = F.octet_length("value")
    used = F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return docs.withColumn("used", used.cast("long")).where(F.col("used") <= budget)


def flow_control(messages: DataFrame, buffer: int) -> DataFrame:
    """Running unacknowledged bytes of a stream and whether the producer pauses after each message."""
    order = Window.partitionBy("vb").orderBy("seqno").rowsBetween(Window.unboundedPreceding, 0)
    sent = F.sum("bytes").over(order) - F.sum("acked").over(order)
    return messages.withColumn("unacked", sent.cast("long")).withColumn("paused", F.col("unacked") >= buffer)


def branches(failover: DataFrame) -> DataFrame:
    """History branches as half-open seqno ranges: (vb, uuid, low, high), high null on the newest."""
    return failover.select("vb", "uuid", F.col("by_seqno").alias("low"), F.lead("by_seqno").over(Window.partitionBy("vb").orderBy("by_seqno", "idx")).alias("high"))


def branch_of(rows: DataFrame, failover: DataFrame) -> DataFrame:
    """Each row with the uuid of the branch that its seqno is on. An equi-join on vb with a range check."""
    b = branches(failover)
    return rows.join(b, "vb").where((F.col("seqno") >= F.col("low")) & (F.col("high").isNull() | (F.col("seqno") < F.col("high")))).drop("low", "high")


def rollback_decision(requests: DataFrame, failover: DataFrame) -> DataFrame:
    """rollback_seqno for each request, null where the stream may resume.

    requests: request_id, vb, start_seqno, uuid, snap_start, snap_end, high_seqno (local), purge_seqno, remote_purge_seqno,
    strict, collection_high (nullable). The consumer's history is common up to the start of the branch that follows its
    own, or to the local high seqno on the newest branch.
    """
    found = branches(failover).select("vb", F.col("uuid").alias("known"), F.col("high").alias("next_seqno"))
    r = requests.join(found, (requests["vb"] == found["vb"]) & (requests["uuid"] == found["known"]), "left").drop(found["vb"])
    upper = F.coalesce(F.col("next_seqno"), F.col("high_seqno"))
    complete = (F.col("start_seqno") >= F.col("collection_high")) & (F.col("collection_high") <= F.col("purge_seqno"))
    purged = (F.col("start_seqno") < F.col("purge_seqno")) & (F.col("start_seqno") != 0) & ~F.coalesce(complete, F.lit(False)) & (F.col("remote_purge_seqno") != F.col("purge_seqno"))
    nothing_yet = (F.col("start_seqno") == 0) & (~F.col("strict") | (F.col("uuid") == 0))
    snap_end = F.when(F.col("start_seqno") == F.col("snap_start"), F.col("start_seqno")).otherwise(F.col("snap_end"))
    snap_start = F.when(F.col("start_seqno") == snap_end, F.col("start_seqno")).otherwise(F.col("snap_start"))
    decision = F.when(nothing_yet, None).when(purged, 0).when(F.col("known").isNull(), 0).when(snap_end <= upper, None).otherwise(F.least(upper, snap_start))
    return r.select("request_id", decision.cast("long").alias("rollback_seqno"))


#: What a checkpoint holds for its own sake, never shown to a reader.
META_OPS = ("empty", "checkpoint_start", "checkpoint_end", "set_vbucket_state")


def without_meta(rows: DataFrame) -> DataFrame:
    return rows.where(~F.col("op").isin(*META_OPS))


def dedup_order(rows: DataFrame) -> DataFrame:
    """Rows numbered per partition in the order that a flush removes duplicates in: by key, prepares before the rest, newest first."""
    order = Window.partitionBy("vb").orderBy("cid", "key", (F.col("op") != "pending_sync_write").cast("int"), F.desc("seqno"))
    return rows.withColumn("place", F.row_number().over(order).cast("long"))
