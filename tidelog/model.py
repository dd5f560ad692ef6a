"""The mutation log: one row per change of a document, ordered by seqno within a partition (vb).

The log's own columns are vb, seqno, cid, key, op, value, cas, rev, flags, exptime, deleted, checkpoint_id. Test tables
are mapped to it here, by the same rule that the SQL in tidelog.plans states.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Partitions of the mapped log, and rows in one of its checkpoints.
PARTITIONS, CHECKPOINT_ROWS = 16, 50
#: Ids up to this are reserved for built-in collections.
RESERVED_COLLECTIONS = 8
#: The instant that expiry and age are judged at in the registered queries: a constant, never the clock.
AS_OF = 1_706_000_000
#: A hybrid clock value keeps its low bits for a logical counter.
LOGICAL_BITS = 16


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt by a distinct key: ahead of work that costs much a row, since a file of one row group is read by one task.

    Adaptive execution makes the tasks as many as there are cores, or one for each megabyte of keys if those are fewer.
    """
    return rows.repartition(key)


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone, read as UTC; free of the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def masked_clock(nanos: Column) -> Column:
    """A physical time in nanoseconds with the logical bits cleared."""
    return nanos.bitwiseAND(F.lit(-(1 << LOGICAL_BITS)))


def mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log that the events table stands for. A real log carries seqno and rev; here they are numbered."""
    e = read(spark, sf_dir, "events")
    by_vb = Window.partitionBy("vb").orderBy("event_id")
    by_key = Window.partitionBy("user_id").orderBy("event_id")
    micros = epoch_micros(F.col("ts"))
    own = e.select("event_id", "user_id", "event_type", "props", "value", micros.alias("us"), F.pmod("user_id", F.lit(PARTITIONS)).alias("vb"))
    own = own.withColumn("seqno", F.row_number().over(by_vb).cast("long")).withColumn("rev", F.row_number().over(by_key).cast("long"))
    deleted = F.col("event_type") == "error"
    return own.select(
        "vb",
        "seqno",
        (F.lit(RESERVED_COLLECTIONS) + F.pmod("user_id", F.lit(4))).cast("long").alias("cid"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("key"),
        F.lit("mutation").alias("op"),
        F.col("props").alias("value"),
        masked_clock(F.col("us") * 1000).alias("cas"),
        "rev",
        F.lit(0).cast("long").alias("flags"),
        F.when(F.col("event_type") == "view", F.floor(F.col("us") / 1_000_000).cast("long") + 86_400).otherwise(0).cast("long").alias("exptime"),
        deleted.alias("deleted"),
        F.floor((F.col("seqno") - 1) / CHECKPOINT_ROWS).cast("long").alias("checkpoint_id"),
        "event_id",
        "event_type",
        F.col("value").alias("amount"),
        "us",
    )


def collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scopes and collections of the region and nation tables: sid, scope, cid, collection, start_seqno, max_ttl, history."""
    region, nation = read(spark, sf_dir, "region"), read(spark, sf_dir, "nation")
    joined = nation.join(region, nation["n_regionkey"] == region["r_regionkey"])
    return joined.select(
        F.col("r_regionkey").cast("long").alias("sid"),
        F.col("r_name").alias("scope"),
        (F.col("n_nationkey") + RESERVED_COLLECTIONS).cast("long").alias("cid"),
        F.col("n_name").alias("collection"),
        (F.col("n_nationkey") * 10).cast("long").alias("start_seqno"),
        F.when(F.col("n_nationkey") % 3 == 0, 3600).cast("long").alias("max_ttl"),
        (F.col("n_nationkey") % 4 == 1).alias("history"),
    )
