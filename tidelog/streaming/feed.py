"""The change feed as a stream: a growing folder of Parquet log files in, state and statistics out.

Order is by seqno within a partition. Every file holds whole rows and offsets live in Spark's checkpoint, so a stream
that stops resumes where it was, and a batch that is replayed changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidelog.operators.reads import latest

LOG_SCHEMA = "vb long, seqno long, cid long, key string, op string, value string, cas long, rev long, flags long, exptime long, deleted boolean, checkpoint_id long, ts timestamp"


def read_log(spark: SparkSession, path: str, *, files_per_batch: int = 64, schema: str = LOG_SCHEMA) -> DataFrame:
    """New rows of the log as they arrive; files_per_batch bounds what one batch takes on."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def write_state(spark: SparkSession, changes: DataFrame, path: str, checkpoint: str):
    """Keeps the newest row per document as versions of a table under path, one per batch; returns the finished query.

    A version is written whole beside the last one and read by its number, so a replayed batch rewrites its own version
    and a reader never sees half of one.
    """

    def apply(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        rows = batch.drop("ts")
        if number:
            rows = rows.unionByName(session.read.schema(rows.schema).parquet(f"{path}/version={number - 1}"))
        latest(rows).select(*rows.columns).write.mode("overwrite").parquet(f"{path}/version={number}")

    query = changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def first_seen(changes: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each (vb, seqno) once, when a producer sends rows again after a restart."""
    return changes.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["vb", "seqno"])


def rates(changes: DataFrame, window: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Mutations and tombstones per event-time window; a window is closed once the watermark has passed it."""
    each = changes.withWatermark("ts", delay).groupBy(F.window("ts", window))
    return each.agg(F.count("*").alias("rows"), F.count_if("deleted").alias("tombstones")).select(F.unix_seconds(F.col("window.start")).alias("start_s"), "rows", "tombstones")


def matched_prepares(changes: DataFrame, delay: str = "10 minutes", within: str = "10 minutes") -> DataFrame:
    """Prepares joined with their commit or abort, stream to stream, within a time."""
    own = changes.withWatermark("ts", delay)
    prepare = own.where("op = 'pending_sync_write'").select(F.col("vb").alias("p_vb"), F.col("key").alias("p_key"), F.col("seqno").alias("prepare_seqno"), F.col("ts").alias("p_ts"))
    done = own.where("op in ('commit_sync_write', 'abort_sync_write')").select("vb", "key", "op", "seqno", "ts", F.col("flags").alias("of"))
    on = (F.col("p_vb") == F.col("vb")) & (F.col("p_key") == F.col("key")) & (F.col("prepare_seqno") == F.col("of")) & (F.col("ts") >= F.col("p_ts")) & (F.col("ts") <= F.col("p_ts") + F.expr(f"interval {within}"))
    return prepare.join(done, on).select("vb", "key", "prepare_seqno", "seqno", "op")


LOCK_OUT = "key string, granted long, refused long"


def lock_grants(requests: DataFrame, seconds: int, delay: str = "10 minutes") -> DataFrame:
    """Locks per key over a stream of requests (key, ts): state is the end of the last granted lock, kept until the watermark passes it."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        until = state.get[0] if state.exists else None
        granted = refused = 0
        for at in sorted(t for b in batches for t in b["at"]):
            if until is None or at >= until:
                until, granted = at + seconds, granted + 1
            else:
                refused += 1
        state.update((until,))
        state.setTimeoutTimestamp(max(until * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": [key[0]], "granted": [granted], "refused": [refused]})

    own = requests.withWatermark("ts", delay).select("key", "ts", F.unix_seconds("ts").alias("at"))
    return own.groupBy("key").applyInPandasWithState(step, LOCK_OUT, "until long", "append", GroupStateTimeout.EventTimeTimeout)
