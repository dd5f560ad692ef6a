"""Mutations applied to a state, and what they write."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators.reads import live

#: Relative expiry times reach this far; larger ones are absolute.
RELATIVE_LIMIT = 30 * 24 * 3600
COUNTER_RANGE = 1 << 64


def absolute_expiry(t: Column, now: int) -> Column:
    return F.when(t == 0, F.lit(0)).when(t <= RELATIVE_LIMIT, t + now).otherwise(t).cast("long")


def capped_expiry(exptime: Column, collection_ttl: Column, bucket_ttl: int, now: int) -> Column:
    """The collection's limit if it has one, else the bucket's; a limit of 0 does not bind."""
    limit = F.coalesce(collection_ttl, F.lit(bucket_ttl))
    return F.when((limit > 0) & ((exptime == 0) | (exptime > limit + now)), limit + now).otherwise(exptime).cast("long")


def first_per_key(ops: DataFrame, order: str) -> DataFrame:
    rest = [c for c in ops.columns if c not in ("cid", "key")]
    return ops.groupBy("cid", "key").agg(F.min_by(F.struct(*rest), F.col(order)).alias("row")).select("cid", "key", "row.*")


def add(ops: DataFrame, state: DataFrame, as_of: int) -> DataFrame:
    """Operations that insert: the first of a key whose document is absent, deleted or expired."""
    return first_per_key(ops, "event_id").join(state.where(live(as_of)).select("cid", "key"), ["cid", "key"], "left_anti")


def replace(ops: DataFrame, state: DataFrame, as_of: int) -> DataFrame:
    """Operations on keys whose document is live."""
    return ops.join(state.where(live(as_of)).select("cid", "key"), ["cid", "key"], "left_semi")


def cas_verdict() -> Column:
    """status of a conditional write from op_cas, have (the document's cas, null if absent) and alive."""
    return F.when(F.col("have").isNull() | ~F.col("alive"), F.when(F.col("op_cas") == 0, "success").otherwise("no_such_key")).when((F.col("op_cas") == 0) | (F.col("op_cas") == F.col("have")), "success").otherwise("key_already_exists")


def cas_status(ops: DataFrame, state: DataFrame, as_of: int) -> DataFrame:
    """status of a conditional write: op_cas against the document's cas."""
    have = state.select("cid", "key", F.col("cas").alias("have"), live(as_of).alias("alive"))
    return ops.join(have, ["cid", "key"], "left").withColumn("status", cas_verdict())


def touch_runs(log: DataFrame) -> DataFrame:
    """Each row with the newest body before a touch: rows without a body carry the last one forward."""
    before = Window.partitionBy("vb", "cid", "key").orderBy("seqno").rowsBetween(Window.unboundedPreceding, 0)
    return log.withColumn("value", F.last("value", ignorenulls=True).over(before))


def counters(ops: DataFrame) -> DataFrame:
    """Final value of each counter of ops (cid, key, seqno, delta, initial): adding wraps at 2**64, taking away stops at 0.

    Order matters, so a key's steps are folded in order; a step is a few bytes, and a run of steps of one sign is summed
    before the shuffle would only be right between clamps, so none is.
    """
    step = F.struct("seqno", F.col("delta").cast("decimal(20,0)").alias("delta"), F.col("initial").cast("decimal(20,0)").alias("initial"))
    wide = "decimal(38,0)"
    fold = F.aggregate(
        F.slice("steps", 2, F.greatest(F.size("steps") - 1, F.lit(1))),
        F.element_at("steps", 1)["initial"].cast(wide),
        lambda have, s: F.when(s["delta"] >= 0, F.pmod(have + s["delta"].cast(wide), F.lit(Decimal(COUNTER_RANGE)).cast(wide)).cast(wide)).otherwise(F.greatest(have + s["delta"].cast(wide), F.lit(0).cast(wide)).cast(wide)).cast(wide),
    )
    grouped = ops.groupBy("cid", "key").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    return grouped.select("cid", "key", fold.alias("counter"))


def appended(ops: DataFrame, *, before: bool = False) -> DataFrame:
    """Bodies after appends in seqno order, or after prepends if `before`."""
    each = F.struct("seqno", F.coalesce("value", F.lit("")).alias("value"))
    grouped = ops.groupBy("cid", "key").agg(F.array_sort(F.collect_list(each)).alias("steps"))
    return grouped.select("cid", "key", F.array_join(F.transform(F.reverse("steps") if before else F.col("steps"), lambda s: s["value"]), "").alias("value"))


def prune_attributes(attributes: Column) -> Column:
    """What a delete keeps of a map of extended attributes: system ones; null if none."""
    kept = F.map_filter(attributes, lambda k, _: k.startswith("_"))
    return F.when(F.size(kept) > 0, kept)


def lock_intervals(requests: DataFrame, seconds: int) -> DataFrame:
    """Which lock requests (key, at) find the key locked: each granted lock lasts `seconds` from its request.

    A request within the last granted lock is refused and does not extend it, so the grants are a fold per key.
    """
    steps = F.array_sort(F.collect_list(F.col("at")))
    fold = F.aggregate("steps", F.struct(F.lit(None).cast("long").alias("until"), F.lit(0).cast("long").alias("granted"), F.lit(0).cast("long").alias("refused")), lambda a, t: F.when(a["until"].isNull() | (t >= a["until"]), F.struct((t + seconds).cast("long").alias("until"), (a["granted"] + 1).cast("long").alias("granted"), a["refused"].alias("refused"))).otherwise(F.struct(a["until"].alias("until"), a["granted"].alias("granted"), (a["refused"] + 1).cast("long").alias("refused"))))
    return requests.groupBy("key").agg(steps.alias("steps")).select("key", fold.alias("f")).select("key", "f.granted", "f.refused")


def unlock_status() -> Column:
    """status of an unlock with op_cas against have (the document's cas, null if absent), alive, and locked_cas (null if not locked)."""
    gone = F.col("have").isNull() | ~F.col("alive")
    return F.when(gone, "no_such_key").when(F.col("locked_cas").isNull(), "not_locked").when(F.col("op_cas") != F.col("locked_cas"), "locked_temporary_failure").otherwise("success")


def unlock(ops: DataFrame, state: DataFrame, as_of: int) -> DataFrame:
    """ops (op_id, cid, key, op_cas) with the status of unlocking state (with locked_cas, locked_until); a lock that ran out is none."""
    held = F.when(F.col("locked_until") > as_of, F.col("locked_cas"))
    have = state.select("cid", "key", F.col("cas").alias("have"), live(as_of).alias("alive"), held.alias("locked_cas"))
    return ops.join(have.hint("merge"), ["cid", "key"], "left").withColumn("status", unlock_status())


def get_and_touch(ops: DataFrame, state: DataFrame, as_of: int) -> DataFrame:
    """ops (op_id, cid, key, exptime: absolute) with the live document's value and rev after the touch, and status.

    A touch that does not change the expiry writes nothing: rev stays.
    """
    have = state.where(live(as_of)).select("cid", "key", "value", F.col("rev").alias("had_rev"), F.col("exptime").alias("had"))
    joined = ops.join(have.hint("merge"), ["cid", "key"], "left")
    found = F.col("had_rev").isNotNull()
    return joined.select("op_id", "cid", "key", F.when(found, "success").otherwise("no_such_key").alias("status"), "value", F.when(found, F.col("exptime")).alias("exptime"), (F.col("had_rev") + (F.col("exptime") != F.col("had")).cast("long")).alias("rev"))


def kept_expiry(log: DataFrame, preserve: Column) -> DataFrame:
    """log with the expiry of each row that says to preserve it taken from the newest earlier row of its life that does not.

    A row after a delete has nothing to preserve and keeps its own.
    """
    order = Window.partitionBy("vb", "cid", "key").orderBy("seqno")
    fresh = F.coalesce(F.lag("deleted").over(order), F.lit(True))
    own = log.withColumn("__life", F.sum(fresh.cast("long")).over(order)).withColumn("__set", F.when(~preserve | fresh, F.col("exptime")))
    last = Window.partitionBy("vb", "cid", "key", "__life").orderBy("seqno").rowsBetween(Window.unboundedPreceding, 0)
    return own.withColumn("exptime", F.last("__set", ignorenulls=True).over(last)).drop("__life", "__set")
