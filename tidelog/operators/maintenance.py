"""Batch rewrites: compaction, expiry, purge, eviction."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators.reads import expired, latest


def compaction(state: DataFrame, collections: DataFrame, *, purge_before_ts: int, purge_before_seq: int = 0, drop_deletes: bool = False, expire_from: int, retain_erroneous: bool = False) -> DataFrame:
    """state (newest rows, with delete_time for tombstones) and verdict: keep, drop_collection, purge_tombstone or expire.

    The newest row of a partition and of a collection in it is never purged, whatever its age.
    """
    joined = state.join(collections.select("cid", "start_seqno"), "cid", "left")
    tops = state.groupBy("vb").agg(F.max("seqno").alias("vb_high"))
    collection_tops = state.groupBy("vb", "cid").agg(F.max("seqno").alias("collection_high"))
    joined = joined.join(tops, "vb").join(collection_tops, ["vb", "cid"])
    top = (F.col("seqno") == F.col("vb_high")) | (F.col("seqno") == F.col("collection_high"))
    old = F.col("delete_time") < purge_before_ts
    if purge_before_seq:
        old = old & (F.col("seqno") <= purge_before_seq)
    if retain_erroneous:
        old = old & (F.col("delete_time") != 0)
    purge = F.col("deleted") & ~top & (F.lit(drop_deletes) | old)
    gone = F.col("start_seqno").isNull() | (F.col("seqno") < F.col("start_seqno"))
    verdict = F.when(gone, "drop_collection").when(purge, "purge_tombstone").when(~F.col("deleted") & expired(expire_from), "expire").otherwise("keep")
    return joined.withColumn("verdict", verdict).select(*state.columns, "verdict")


def expiry_tombstones(state: DataFrame, as_of: int) -> DataFrame:
    """Tombstones that an expiry run appends: the body goes, rev grows, the delete time is the run's."""
    due = state.where(~F.col("deleted") & expired(as_of))
    return due.withColumns({"deleted": F.lit(True), "value": F.lit(None).cast("string"), "rev": F.col("rev") + 1, "exptime": F.lit(as_of).cast("long"), "delete_source": F.lit("ttl")})


def purged_tombstones(state: DataFrame, before: int) -> DataFrame:
    """Tombstones of in-memory data that are old enough, but for the newest row of each collection."""
    high = F.max("seqno").over(Window.partitionBy("vb", "cid"))
    return state.withColumn("high", high).where(F.col("deleted") & (F.col("delete_time") < before) & (F.col("seqno") != F.col("high"))).drop("high")


def age(log: DataFrame) -> DataFrame:
    """Age of each newest row: how far its clock lies behind the partition's newest, in units of the logical range."""
    newest = latest(log)
    top = log.groupBy("vb").agg(F.max("cas").alias("top_cas"))
    return newest.join(top, "vb").withColumn("age", F.shiftright(F.greatest(F.lit(0), F.col("top_cas") - F.col("cas")), 16)).drop("top_cas")


#: Bins that a column's range is cut into per pass when a threshold is searched.
BINS = 4096


def threshold(rows: DataFrame, column: str, percent: float) -> int | None:
    """The smallest value that at least `percent` of all rows (rounded down, one at least) do not exceed; null for no rows.

    The range is cut into BINS equal bins, counted with a partial step, and the bin that holds the wanted row is cut again,
    so each pass brings at most BINS counts together, whatever the values are.
    """
    low, high, total = rows.agg(F.min(column), F.max(column), F.count(column)).first()
    if not total:
        return None
    wanted, below = max(1, math.floor(total * percent / 100)), 0
    while low < high:
        width = -(-(high - low + 1) // BINS)
        at = F.floor((F.col(column) - low) / width)
        for r in sorted(rows.where(F.col(column).between(low, high)).groupBy(at.alias("bin")).agg(F.count("*").alias("n")).collect()):
            if below + r["n"] >= wanted:
                low, high = low + r["bin"] * width, min(high, low + (r["bin"] + 1) * width - 1)
                break
            below += r["n"]
    return low


def eviction(rows: DataFrame, *, frequency_percent: float, age_percent: float, exempt_frequency: int) -> DataFrame:
    """rows (frequency, age) with evict: cold enough, and old enough unless colder than the exempt frequency."""
    cold, old = (F.lit(threshold(rows, c, p)) for c, p in (("frequency", frequency_percent), ("age", age_percent)))
    return rows.withColumn("evict", (F.col("frequency") <= cold) & ((F.col("age") >= old) | (F.col("frequency") < exempt_frequency)))


def decayed(frequency: Column, evict: Column) -> Column:
    """Use frequency after a visit that kept the row."""
    return F.when(evict, frequency).otherwise(F.greatest(frequency - 1, F.lit(0)))


def eviction_ratios(memory: DataFrame, to_free: int) -> DataFrame:
    """Share of evictable memory to free in replicas first, then in the rest; memory: replica, evictable."""
    sums = memory.agg(F.coalesce(F.sum(F.when(F.col("replica"), F.col("evictable"))), F.lit(0)).cast("double").alias("r"), F.coalesce(F.sum(F.when(~F.col("replica"), F.col("evictable"))), F.lit(0)).cast("double").alias("a"))
    left = F.greatest(F.lit(0.0), F.lit(float(to_free)) - F.col("r"))
    return sums.select(F.round(F.least(F.lit(1.0), F.try_divide(F.lit(float(to_free)), F.col("r"))), 9).alias("replica_ratio"), F.round(F.least(F.lit(1.0), F.coalesce(F.try_divide(left, F.col("a")), F.lit(0.0))), 9).alias("active_ratio"))
