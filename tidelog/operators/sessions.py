"""Stream requests, queues, labels, access control and configuration as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def request_status(requests: DataFrame) -> DataFrame:
    """Whether a stream request (request_id, start_seqno, end_seqno, snap_start, snap_end, high_seqno) is well formed."""
    bad = (F.col("start_seqno") > F.col("end_seqno")) | (F.col("snap_start") > F.col("start_seqno")) | (F.col("start_seqno") > F.col("snap_end"))
    status = F.when(bad, "out_of_range").when(F.col("start_seqno") > F.col("high_seqno"), "out_of_range").otherwise("success")
    return requests.select("request_id", status.alias("status"))


def observe_seqno(requests: DataFrame, branches: DataFrame, seqnos: DataFrame) -> DataFrame:
    """Current and persisted seqno for each (vb, uuid) asked about; on an old branch also where it ended; unknown ones are missing."""
    own = requests.join(branches.select("vb", "uuid", F.lit(True).alias("known"), F.col("high").alias("branch_end")), ["vb", "uuid"], "left").join(seqnos, "vb", "left")
    status = F.when(F.col("known").isNull(), "no_such_key").otherwise("success")
    shown = lambda c: F.when(F.col("known"), F.col(c))
    return own.select("vb", "uuid", status.alias("status"), shown("high_seqno").alias("current"), shown("persisted_seqno").alias("persisted"), "branch_end")


def takeover_estimate(log: DataFrame, cursors: DataFrame, persisted: DataFrame) -> DataFrame:
    """Items that a stream still has to send before it can hand over: behind its cursor, and tombstones not yet persisted."""
    joined = log.join(cursors, "vb").join(persisted, "vb")
    return joined.groupBy("vb").agg(F.count_if(F.col("seqno") > F.col("cursor_seqno")).alias("items"), F.count_if(F.col("deleted") & (F.col("seqno") > F.col("persisted_seqno"))).alias("deletes"))


def queue(log: DataFrame, persisted: DataFrame, now_us: int) -> DataFrame:
    """The dirty queue per vb: rows past the persisted seqno, their bytes and total age in seconds."""
    dirty = log.join(persisted, "vb").where(F.col("seqno") > F.col("persisted_seqno"))
    return dirty.groupBy("vb").agg(F.count("*").alias("queued"), F.sum(F.octet_length("value")).alias("bytes"), F.floor(F.sum(F.lit(now_us) - F.col("us")) / 1_000_000).cast("long").alias("age_s"))


def flush_state(log: DataFrame, batch: Column) -> DataFrame:
    """What a flush of each batch persists about its partition."""
    visible = F.col("op").isin("mutation", "commit_sync_write", "system_event")
    return log.groupBy("vb", batch.alias("batch")).agg(F.min("seqno").alias("range_start"), F.max("seqno").alias("range_end"), F.max(F.when(visible, F.col("seqno"))).alias("max_visible"), F.max("cas").alias("max_cas"), F.coalesce(F.max(F.when(F.col("deleted"), F.col("rev"))), F.lit(0)).alias("max_deleted_rev"))


def revisions(log: DataFrame) -> DataFrame:
    """Rows with life, how often the document was made anew, and rev_in_life, its number in that life; seeded_revisions() gives rev."""
    by_key = Window.partitionBy("vb", "cid", "key").orderBy("seqno")
    fresh = F.coalesce(F.lag("deleted").over(by_key), F.lit(True))
    lives = F.sum(fresh.cast("long")).over(by_key)
    own = log.withColumn("life", lives)
    return own.withColumn("rev_in_life", F.row_number().over(Window.partitionBy("vb", "cid", "key", "life").orderBy("seqno")).cast("long"))


def seeded_revisions(log: DataFrame) -> DataFrame:
    """rev of each row: one more than the document's last; a document made anew starts above any deleted rev seen in its partition.

    A life's seed depends on the deletes before it in the partition, and those on their own seeds, so a partition's lives
    are read in order of seqno. A task keeps the seed of open lives that a delete will end, and the largest deleted rev.
    """
    import pyarrow as pa

    names = log.columns
    life = Window.partitionBy("vb", "cid", "key", "life")
    own = revisions(log).withColumn("__ends", F.bool_or("deleted").over(life))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in log.schema if f.name != "rev") + ", rev long"
    kept = [c for c in names if c != "rev"]

    def run(batches):
        vb, top, seeds = None, 0, {}
        for batch in batches:
            out = []
            for here, cid, key, number, deleted, ends in zip(*(batch.column(c).to_pylist() for c in ("vb", "cid", "key", "rev_in_life", "deleted", "__ends")), strict=True):
                if here != vb:
                    vb, top, seeds = here, 0, {}
                if number == 1:
                    seeds[cid, key] = top
                seed = seeds.pop((cid, key)) if deleted and ends else seeds[cid, key]
                out.append(seed + number)
                if deleted:
                    top = max(top, seed + number)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(out, pa.int64())], names=[*kept, "rev"])

    return own.repartition("vb").sortWithinPartitions("vb", "seqno").mapInArrow(run, schema)


def valid_clocks(rows: DataFrame, now_ns: int, max_future_s: int) -> DataFrame:
    """Rows with what a strict, a lenient and a replacing strategy make of a cas that lies too far ahead."""
    bad = F.col("cas") >= now_ns + max_future_s * 1_000_000_000
    return rows.withColumns({"valid": ~bad, "replaced_cas": F.when(bad, F.lit(now_ns).bitwiseAND(F.lit(-65536))).otherwise(F.col("cas"))})


def keep_attributes(log: DataFrame) -> DataFrame:
    """Attributes that a plain set carries over from the newest earlier row that has them."""
    before = Window.partitionBy("vb", "cid", "key").orderBy("seqno").rowsBetween(Window.unboundedPreceding, 0)
    return log.withColumn("xattrs", F.last("xattrs", ignorenulls=True).over(before))


def store_if(ops: DataFrame, state: DataFrame, predicate: Column) -> DataFrame:
    """Operations with the status of a caller's predicate on the document they meet; absent documents pass."""
    have = state.select("cid", "key", F.struct(*[c for c in state.columns if c not in ("cid", "key")]).alias("doc"))
    joined = ops.join(have, ["cid", "key"], "left")
    return joined.withColumn("status", F.when(F.col("doc").isNull() | predicate, "success").otherwise("predicate_failed")).drop("doc")


def audit_filter(rows: DataFrame, *, enabled: list[int], include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Audit rows of enabled events, of included users if any are named, and not of excluded ones."""
    kept = rows.where(F.col("event_kind").isin(enabled))
    if include:
        kept = kept.where(F.col("user").isin(include))
    return kept.where(~F.col("user").isin(exclude)) if exclude else kept


def permitted(rows: DataFrame, grants: DataFrame) -> DataFrame:
    """Rows (user, sid, cid) covered by a grant for the bucket (null scope), the scope (null collection) or the collection."""
    r, g = rows.alias("r"), grants.alias("g")
    on = (F.col("r.user") == F.col("g.user")) & (F.col("g.sid").isNull() | ((F.col("r.sid") == F.col("g.sid")) & (F.col("g.cid").isNull() | (F.col("r.cid") == F.col("g.cid")))))
    return r.join(g, on, "left_semi")


def partition_slice(partitions: DataFrame, start: int, stride: int) -> DataFrame:
    """Every stride-th partition from a start, in order."""
    number = F.row_number().over(Window.orderBy("vb")) - 1
    return partitions.withColumn("at", number).where((F.col("at") >= start) & ((F.col("at") - start) % stride == 0)).select("vb")


def checkpoint_numbers(rows: list[tuple[int, bool]], limit: int) -> list[int]:
    """Checkpoint of each (bytes, must_open) row in order: one closes once it holds `limit` bytes, or when a row may not join it."""
    out, number, held = [], 0, 0
    for size, must_open in rows:
        if held and (held >= limit or must_open):
            number, held = number + 1, 0
        out.append(number)
        held += size
    return out


def assign_checkpoints(log: DataFrame, limit: int) -> DataFrame:
    """checkpoint_id by bytes: a sum that starts again at each boundary, so each partition is read in order, as a stream of batches."""
    import pyarrow as pa

    names = [c for c in log.columns if c != "checkpoint_id"]
    own = log.select(*names).withColumn("__bytes", F.octet_length("value"))
    schema = ", ".join(f"`{c}` {log.schema[c].dataType.simpleString()}" for c in names) + ", checkpoint_id long"

    def run(batches):
        held: dict[int, tuple[int, int]] = {}
        for batch in batches:
            ids = []
            for vb, size in zip(batch.column("vb").to_pylist(), batch.column("__bytes").to_pylist(), strict=True):
                number, have = held.get(vb, (0, 0))
                if have >= limit:
                    number, have = number + 1, 0
                ids.append(number)
                held[vb] = (number, have + (size or 0))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(ids, pa.int64())], names=[*names, "checkpoint_id"])

    return own.repartition("vb").sortWithinPartitions("vb", "seqno").mapInArrow(run, schema)


def failover_table(entries: DataFrame, most: int) -> DataFrame:
    """The newest `most` entries per partition, newest first."""
    rank = F.row_number().over(Window.partitionBy("vb").orderBy(F.desc("by_seqno"), "idx"))
    return entries.withColumn("idx", (rank - 1).cast("long")).where(F.col("idx") < most)


def series(rows: DataFrame, label: str, value: str) -> DataFrame:
    """Mean, maximum and 99th percentile of a series per label."""
    return rows.groupBy(label).agg(F.round(F.avg(value), 6).alias("mean"), F.max(value).alias("most"), F.round(F.percentile(value, 0.99), 6).alias("p99"))


def long_form(rows: DataFrame, labels: list[str], values: list[str]) -> DataFrame:
    """One row per label set and statistic: name, labels, value."""
    pairs = F.array(*[F.struct(F.lit(v).alias("name"), F.col(v).cast("double").alias("value")) for v in values])
    return rows.select(F.concat_ws(":", *[F.col(c).cast("string") for c in labels]).alias("labels"), F.explode(pairs).alias("s")).select("labels", "s.name", "s.value")


def newest_config(configs: DataFrame) -> DataFrame:
    """Of each bucket's versions the one with the largest (epoch, rev)."""
    return configs.groupBy("bucket").agg(F.max_by("body", F.struct("epoch", "rev")).alias("body"), F.max(F.struct("epoch", "rev")).alias("v")).select("bucket", "body", "v.epoch", "v.rev")


def replicated_prepares(snapshots: DataFrame, prepares: DataFrame) -> DataFrame:
    """High prepared seqno of a replica per vb, from received snapshots (vb, end_seqno, disk, persisted).

    A prepare counts once its snapshot lets its level through: a persisted snapshot passes all levels, one in memory those
    up to level 2, an unpersisted one from disk none. Prepares count in order, so the mark stops before the first that
    does not.
    """
    s = snapshots.withColumn("start_seqno", F.coalesce(F.lag("end_seqno").over(Window.partitionBy("vb").orderBy("end_seqno")), F.lit(0)))
    passes = F.when(F.col("persisted"), 3).when(~F.col("disk"), 2).otherwise(0)
    joined = prepares.join(s, "vb").where((F.col("seqno") > F.col("start_seqno")) & (F.col("seqno") <= F.col("end_seqno"))).withColumn("ok", F.col("level") <= passes)
    stopped = joined.groupBy("vb").agg(F.min(F.when(~F.col("ok"), F.col("seqno"))).alias("stop"))
    return joined.join(stopped, "vb").where(F.col("stop").isNull() | (F.col("seqno") < F.col("stop"))).groupBy("vb").agg(F.max("seqno").alias("high_prepared"))
