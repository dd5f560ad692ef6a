"""Streams finish with the rows of their batch forms."""

import pytest
from pyspark.sql import functions as F

from tidelog.model import mutations
from tidelog.operators import reads, writes
from tidelog.sources import files, generator
from tidelog.streaming import feed


@pytest.fixture(scope="module")
def log(spark, sf):
    return mutations(spark, sf).withColumn("ts", F.timestamp_micros("us")).select(*[c.split()[0] for c in feed.LOG_SCHEMA.split(", ")])


@pytest.fixture(scope="module")
def folder(log, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("log"))
    for part in range(3):
        files.write_log(log.where(F.pmod(F.floor("seqno"), F.lit(3)) == part), path, partitions=2)
    return path


def finished(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_state_follows_the_feed(spark, log, folder, tmp_path):
    changes = feed.read_log(spark, folder, files_per_batch=2)
    feed.write_state(spark, changes, str(tmp_path / "state"), str(tmp_path / "cp"))
    last = max(int(p.name.split("=")[1]) for p in (tmp_path / "state").glob("version=*"))
    got = {(r.vb, r.cid, r.key): r.seqno for r in spark.read.parquet(str(tmp_path / f"state/version={last}")).collect()}
    assert last > 0 and got == {(r.vb, r.cid, r.key): r.seqno for r in reads.latest(log).collect()}


def test_rows_sent_again_are_dropped(spark, log, tmp_path):
    path = str(tmp_path / "twice")
    files.write_log(log.limit(50), path, partitions=1)
    files.write_log(log.limit(50), path, partitions=1)
    assert finished(feed.first_seen(feed.read_log(spark, path), "400 days"), "once").count() == 50


def test_rates(spark, log, folder):
    got = {r.start_s: (r["rows"], r.tombstones) for r in finished(feed.rates(feed.read_log(spark, folder), "1 hour", "1 day"), "rates", "complete").collect()}
    want = {}
    for r in log.collect():
        s = int(r.ts.timestamp()) // 3600 * 3600
        n, d = want.get(s, (0, 0))
        want[s] = (n + 1, d + r.deleted)
    assert got == want


def test_locks(spark, log, tmp_path):
    requests = log.select("key", F.unix_seconds("ts").alias("at"))
    path = str(tmp_path / "requests")
    log.select("key", "ts").coalesce(1).write.parquet(path)
    stream = spark.readStream.schema("key string, ts timestamp").parquet(path)
    got = {r.key: (r.granted, r.refused) for r in finished(feed.lock_grants(stream, 1800), "locks").collect()}
    assert got == {r.key: (r.granted, r.refused) for r in writes.lock_intervals(requests, 1800).collect()}


def test_prepares_meet_commits(spark, tmp_path):
    rows = [(0, 1, "a", "pending_sync_write", 0, 0), (0, 2, "a", "commit_sync_write", 1, 60), (0, 3, "b", "pending_sync_write", 0, 60), (0, 4, "b", "abort_sync_write", 3, 7200)]
    path = str(tmp_path / "sync")
    df = spark.createDataFrame(rows, "vb long, seqno long, key string, op string, flags long, s long").withColumn("ts", F.timestamp_seconds(F.col("s") + 1_706_000_000))
    df.coalesce(1).write.parquet(path)
    stream = spark.readStream.schema("vb long, seqno long, key string, op string, flags long, ts timestamp").parquet(path)
    got = finished(feed.matched_prepares(stream, "1 day"), "matched").collect()
    assert [(r.key, r.prepare_seqno, r.seqno, r.op) for r in got] == [("a", 1, 2, "commit_sync_write")]


def test_generator(spark):
    generator.register(spark)
    df = spark.read.format("tidelog_load").option("rows", 1001).option("partitions", 3).load()
    assert df.count() == 1001 and df.select("vb", "seqno").distinct().count() == 1001
    stream = spark.readStream.format("tidelog_load").option("rows", 1001).option("partitions", 3).option("step", 100).load()
    q = stream.writeStream.format("memory").queryName("loaded").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(spark.table("loaded").select("vb", "seqno").collect()) == sorted(df.select("vb", "seqno").collect())
    state = reads.latest(df)
    assert state.count() == state.select("vb", "cid", "key").distinct().count()


def test_manifest_and_snapshot(spark, tmp_path):
    text = '{"uid":"1f","scopes":[{"name":"_default","uid":"0","collections":[{"name":"_default","uid":"0"},{"name":"tides","uid":"c"}]},{"name":"north","uid":"b","collections":[{"name":"gauges","uid":"1a","maxTTL":90},{"name":"buoys","uid":"10"}]}]}'
    m = files.read_manifest(spark, spark.createDataFrame([(text,)], "value string"))
    assert sorted((r.uid, r.sid, r.cid, r.collection, r.max_ttl) for r in m.collect()) == [(31, 0, 0, "_default", None), (31, 0, 12, "tides", None), (31, 11, 16, "buoys", None), (31, 11, 26, "gauges", 90)]
    docs = spark.range(100).select(F.lit(8).alias("cid"), F.col("id").cast("string").alias("key"))
    assert files.write_snapshot(docs, str(tmp_path / "s")).agg(F.sum("rows")).first()[0] == 100
    (tmp_path / "x").write_bytes(b"0123456789")
    assert bytes(files.read_fragment(spark, str(tmp_path / "x"), 3, 4).first().fragment) == b"3456"
    (tmp_path / "stats.txt").write_text(" vb_10: active\n vb_2: replica\nnoise\n")
    assert [r.name for r in files.natural_order(files.read_stat_lines(spark, str(tmp_path / "stats.txt"))).collect()] == ["vb_2", "vb_10"]
