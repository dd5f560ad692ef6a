"""Logs, snapshots, manifests and tool output in files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "uid string, scopes array<struct<name string, uid string, collections array<struct<name string, uid string, maxTTL bigint, history boolean, metered boolean>>>>"


def write_log(log: DataFrame, path: str, *, partitions: int | None = None) -> None:
    """Appends a log, laid out so that key and seqno ranges prune row groups: range-partitioned and sorted by vb and seqno."""
    dealt = log.repartitionByRange(partitions, "vb", "seqno") if partitions else log.repartitionByRange("vb", "seqno")
    dealt.sortWithinPartitions("vb", "seqno").write.mode("append").option("compression", "zstd").parquet(path)


def write_snapshot(docs: DataFrame, path: str) -> DataFrame:
    """Writes a state once, in key order, and returns its manifest: file, rows. An existing snapshot is an error."""
    docs.repartitionByRange("cid", "key").sortWithinPartitions("cid", "key").write.mode("errorifexists").parquet(path)
    written = docs.sparkSession.read.parquet(path)
    return written.groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("rows"))


def read_fragment(spark: SparkSession, path: str, offset: int, length: int) -> DataFrame:
    """Bytes of each file under path from an offset on."""
    return spark.read.format("binaryFile").load(path).select("path", F.substring("content", F.lit(offset + 1), F.lit(length)).alias("fragment"))


def read_manifest(spark: SparkSession, text: DataFrame) -> DataFrame:
    """Collections of JSON manifests (column value): uid, sid, scope, cid, collection, max_ttl, history, metered. Ids are hexadecimal."""
    as_id = lambda c: F.conv(c, 16, 10).cast("long")
    m = text.select(F.from_json("value", MANIFEST).alias("m")).select(as_id("m.uid").alias("uid"), F.explode("m.scopes").alias("s"))
    c = m.select("uid", as_id("s.uid").alias("sid"), F.col("s.name").alias("scope"), F.explode("s.collections").alias("c"))
    return c.select("uid", "sid", "scope", as_id("c.uid").alias("cid"), F.col("c.name").alias("collection"), F.col("c.maxTTL").alias("max_ttl"), F.coalesce("c.history", F.lit(False)).alias("history"), F.coalesce("c.metered", F.lit(False)).alias("metered"))


def read_stat_lines(spark: SparkSession, path: str) -> DataFrame:
    """`name: value` lines of statistics tools, in natural order of their names."""
    lines = spark.read.text(path)
    found = lines.select(F.trim(F.regexp_extract("value", r"^\s*(\S+):\s+(.*)$", 1)).alias("name"), F.trim(F.regexp_extract("value", r"^\s*(\S+):\s+(.*)$", 2)).alias("stat")).where("name <> ''")
    return found.withColumn("number", F.regexp_extract("name", r"(\d+)", 1).try_cast("long")).withColumn("stem", F.regexp_replace("name", r"\d+", ""))


def natural_order(stats: DataFrame) -> DataFrame:
    return stats.orderBy("stem", "number", "name")
