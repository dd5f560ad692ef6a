"""Scopes and collections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a name may look like, and its longest form.
NAME = "^[A-Za-z0-9_%-]+$"
NAME_LENGTH = 251


def lookup(collections: DataFrame, path: str) -> DataFrame:
    """The collection of a `scope.collection` path; an empty part is the default."""
    scope, _, collection = path.partition(".")
    return collections.where((F.col("scope") == (scope or "_default")) & (F.col("collection") == (collection or "_default"))).select("sid", "cid")


def violations(collections: DataFrame) -> DataFrame:
    """Rules that a manifest breaks, with the offending id."""
    bad_name = collections.where(~F.col("collection").rlike(NAME) | (F.octet_length("collection") > NAME_LENGTH)).select("cid", F.lit("name").alias("rule"))
    reserved = collections.where((F.col("cid") > 1) & (F.col("cid") < 8)).select("cid", F.lit("reserved_id").alias("rule"))
    twice = collections.groupBy("cid").agg(F.count("*").alias("n")).where("n > 1").select("cid", F.lit("duplicate_id").alias("rule"))
    names = collections.groupBy("scope", "collection").agg(F.count("*").alias("n"), F.max("cid").alias("cid")).where("n > 1").select("cid", F.lit("duplicate_name").alias("rule"))
    return bad_name.unionByName(reserved).unionByName(twice).unionByName(names)


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """What changes between two manifests: create, drop, modify or flush per collection."""
    a, b = old.alias("a"), new.alias("b")
    change = F.when(F.col("a.cid").isNull(), "create").when(F.col("b.cid").isNull(), "drop").when(F.col("b.start_seqno") > F.col("a.start_seqno"), "flush").when(~F.col("a.max_ttl").eqNullSafe(F.col("b.max_ttl")) | (F.col("a.history") != F.col("b.history")), "modify")
    joined = a.join(b, F.col("a.cid") == F.col("b.cid"), "full_outer")
    return joined.select(F.coalesce("a.cid", "b.cid").alias("cid"), change.alias("change")).where("change is not null")


def partition_split(partitions: DataFrame, parts: int) -> DataFrame:
    """Partitions dealt round-robin, in order, to min(parts, their number) filters; partitions are a short list."""
    from pyspark.sql import Window

    total = partitions.agg(F.least(F.lit(parts), F.count("*")).alias("n"))
    number = F.row_number().over(Window.orderBy("vb")) - 1
    return partitions.withColumn("at", number).join(F.broadcast(total), F.lit(True)).select("vb", F.pmod("at", F.col("n")).cast("long").alias("part"))


def successor(old: DataFrame, new: DataFrame, old_uid: int, new_uid: int) -> DataFrame:
    """What keeps a manifest from following another, one row per fault (rule, id); none if it may.

    A smaller uid may not follow; with an equal uid nothing may differ; with a larger one a scope that stays keeps its
    name, and a collection that stays its name, scope and metering. The faults of other uids are not looked for then.
    """
    spark = old.sparkSession
    fault = lambda df, rule, name: df.select(F.lit(rule).alias("rule"), F.col(name).cast("long").alias("id")).distinct()
    if new_uid < old_uid:
        return spark.range(1).select(F.lit("uid_goes_back").alias("rule"), F.lit(new_uid).cast("long").alias("id"))
    if new_uid == old_uid:
        columns = ["sid", "scope", "cid", "collection", "max_ttl", "history"]
        a, b = old.select(*columns), new.select(*columns)
        return fault(a.exceptAll(b).union(b.exceptAll(a)), "changed_with_same_uid", "cid")
    a, b = old.alias("a"), new.alias("b")
    scopes = a.select("sid", "scope").distinct().alias("a").join(b.select("sid", "scope").distinct().alias("b"), F.col("a.sid") == F.col("b.sid")).where("a.scope <> b.scope").select("a.sid")
    same = a.join(b, F.col("a.cid") == F.col("b.cid")).where("a.collection <> b.collection or a.sid <> b.sid").select("a.cid")
    return fault(scopes, "scope_renamed", "sid").union(fault(same, "collection_changed", "cid"))


def system_events(old: DataFrame, new: DataFrame, new_uid: int, seqnos: DataFrame) -> DataFrame:
    """The events that a new manifest writes into each partition (vb, high_seqno): change, cid, uid and the seqno after the high one.

    Drops come before creations, each in order of cid; a created or flushed collection starts at its event's seqno.
    """
    from pyspark.sql import Window

    rank = F.when(F.col("change") == "drop", 0).when(F.col("change") == "create", 1).otherwise(2)
    changes = diff(old, new).withColumn("rank", rank).withColumn("at", F.row_number().over(Window.orderBy("rank", "cid")))
    each = seqnos.select("vb", "high_seqno").join(F.broadcast(changes), F.lit(True))  # a manifest is a short list, and every partition gets it
    seqno = (F.col("high_seqno") + F.col("at")).cast("long")
    return each.select("vb", "cid", "change", F.lit(new_uid).cast("long").alias("uid"), seqno.alias("seqno"), F.when(F.col("change").isin("create", "flush"), seqno).alias("start_seqno"))
