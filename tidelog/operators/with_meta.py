"""Writes that bring their own metadata, as replication between sites sends them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.operators import conflict
from tidelog.operators.reads import live

META = ["cas", "rev", "exptime", "flags"]


def options_status(strategy: str) -> Column:
    """Whether the options of a write agree: a new cas needs the conflict check off; by last write, forcing must be said, by revision it may not be."""
    regenerated = F.col("regenerate_cas") & F.col("check_conflicts")
    forced = ~F.col("force_accept") if strategy == "lww" else F.col("force_accept")
    return F.when(regenerated | forced, "invalid_arguments").otherwise("success")


def write(ops: DataFrame, state: DataFrame, strategy: str, as_of: int, *, delete: bool = False, allow_existing: bool = True) -> DataFrame:
    """ops with status and the document's cas, rev, exptime, flags and deleted afterwards, as a reader of metadata sees them.

    ops: op_id, cid, key, META, has_xattr, check_conflicts, force_accept, regenerate_cas, new_cas (the clock's next value).
    state: newest rows with has_xattr, tombstones included. One operation a key meets the state; a series of them on one
    key is a merge (conflict.merge_sites). With allow_existing false a live document refuses; what the conflict rules turn
    down leaves the document as it is. The join is of two exchanges on the key, so a hot key is split.
    """
    mine = ops.select("op_id", "cid", "key", F.struct(*META, "has_xattr").alias("i"), "check_conflicts", "force_accept", "regenerate_cas", "new_cas")
    theirs = state.select("cid", "key", F.struct(*META, "has_xattr", "deleted").alias("e"), live(as_of).alias("alive"))
    both = mine.join(theirs.hint("merge"), ["cid", "key"], "left")
    verdict = F.when(~F.col("check_conflicts"), "accept").otherwise(conflict.outcome(strategy, delete=delete))
    refused = F.col("alive") if not allow_existing else F.lit(False)
    status = F.when(options_status(strategy) != "success", options_status(strategy)).when(F.coalesce(refused, F.lit(False)), "key_already_exists").when(verdict == "accept", "success").otherwise("key_already_exists")
    both = both.withColumn("status", status)
    done = F.col("status") == "success"
    cas = F.when(F.col("regenerate_cas"), F.col("new_cas")).otherwise(F.col("i.cas"))
    after = [F.when(done, cas).otherwise(F.col("e.cas")).alias("cas")] + [F.when(done, F.col(f"i.{m}")).otherwise(F.col(f"e.{m}")).alias(m) for m in META[1:]]
    return both.select("op_id", "cid", "key", "status", *after, F.when(done, F.lit(delete)).otherwise(F.col("e.deleted")).alias("deleted"))


def patched(value: Column, at: Column, number: Column) -> Column:
    """value with 0x and the number's sixteen hexadecimal digits put over the 18 characters from offset `at` (from 0); null leaves it."""
    text = F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(number)), 16, "0"))
    return F.when(at.isNull(), value).otherwise(F.concat(F.substr(value, F.lit(1), at), text, F.substr(value, at + 19)))


def mutate(ops: DataFrame) -> DataFrame:
    """ops (value, cas, seqno, cas_offsets, seqno_offsets: arrays) with the write's cas and seqno patched into the body at the offsets.

    status is invalid_arguments, and the body stays, if an offset leaves no room for a placeholder's 18 characters.
    """
    every = F.concat(F.coalesce("cas_offsets", F.array().cast("array<int>")), F.coalesce("seqno_offsets", F.array().cast("array<int>")))
    fits = F.forall(every, lambda x: (x >= 0) & (x + 18 <= F.length("value")))

    def put(value: Column, offsets: str, number: Column) -> Column:
        return F.aggregate(F.coalesce(offsets, F.array().cast("array<int>")), value, lambda v, at: patched(v, at, number))

    body = put(put(F.col("value"), "cas_offsets", F.col("cas")), "seqno_offsets", F.col("seqno"))
    return ops.withColumn("status", F.when(fits, "success").otherwise("invalid_arguments")).withColumn("value", F.when(fits, body).otherwise(F.col("value")))
