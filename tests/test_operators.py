"""Operators against stated cases."""

import itertools
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidelog.functions import scalars, subdoc
from tidelog.operators import catalog, conflict, durability, feed, maintenance, partitions, reads, sessions, stats, with_meta, writes

SIDE = "cas long, rev long, exptime long, flags long, has_xattr boolean"


def expected_outcome(strategy, delete, mine, theirs, mine_x, theirs_x):
    order = {"lww": ["cas", "rev", "exptime", "flags"], "rev": ["rev", "cas", "exptime", "flags"]}[strategy]
    for f in order[:2] if delete else order:
        if mine[f] != theirs[f]:
            return "accept" if mine[f] > theirs[f] else "reject_behind"
    return "accept" if not delete and mine_x and not theirs_x else "reject_identical"


@pytest.mark.parametrize("strategy", ["lww", "rev"])
@pytest.mark.parametrize("delete", [False, True])
def test_conflict_matrix(spark, strategy, delete):
    rows, want = [], []
    theirs = {"cas": 1000, "rev": 1000, "exptime": 1000, "flags": 1000}
    for k, (values, xattrs) in enumerate(itertools.product(itertools.product([999, 1000, 1001], repeat=4), itertools.product([True, False], repeat=2))):
        mine = dict(zip(theirs, values, strict=True))
        rows.append((k, tuple(values) + (xattrs[0],), (1000, 1000, 1000, 1000, xattrs[1])))
        want.append((k, expected_outcome(strategy, delete, mine, theirs, *xattrs)))
    df = spark.createDataFrame(rows, f"k int, i struct<{SIDE.replace(' ', ':').replace(',:', ',')}>, e struct<{SIDE.replace(' ', ':').replace(',:', ',')}>")
    got = df.select("k", conflict.outcome(strategy, delete=delete).alias("o")).orderBy("k").collect()
    assert [(r.k, r.o) for r in got] == want and len(want) == 324


def test_conflict_without_existing_accepts(spark):
    df = spark.createDataFrame([((1, 1, 1, 1, False), None)], f"i struct<{SIDE.replace(' ', ':').replace(',:', ',')}>, e struct<{SIDE.replace(' ', ':').replace(',:', ',')}>")
    assert df.select(conflict.outcome("lww").alias("o")).first().o == "accept"


def rollback(spark, start, local_high, uuid, snap_start, snap_end, strict, purge=0, remote_purge=0):
    failover = spark.createDataFrame([(0, 0, 77, 5)], "vb int, idx int, uuid long, by_seqno long")
    r = spark.createDataFrame([(1, 0, start, uuid, snap_start, snap_end, local_high, purge, remote_purge, strict, None)], "request_id int, vb int, start_seqno long, uuid long, snap_start long, snap_end long, high_seqno long, purge_seqno long, remote_purge_seqno long, strict boolean, collection_high long")
    return feed.rollback_decision(r, failover).first().rollback_seqno


def test_rollback_cases(spark):
    high = 105
    assert rollback(spark, 0, 0, 0, 0, 0, False) is None
    assert rollback(spark, 10, 0, 1, 0, 0, False) == 0
    assert rollback(spark, 10, high, 77, 0, 20, False) is None
    assert rollback(spark, high - 80, high, 77, high - 90, high + 20, False) == high - 90
    assert rollback(spark, 0, 0, 0, 0, 0, True) is None
    assert rollback(spark, 0, 0, 0xABCD, 0, 0, True) == 0
    assert rollback(spark, 0, 0, 0xABCD, 0, 0, False) is None
    assert rollback(spark, 10, high, 77, 10, 20, False, purge=30) == 0
    assert rollback(spark, 10, high, 77, 10, 20, False, purge=30, remote_purge=30) is None


def test_key_range(spark):
    """Keys just below, at, between and just above the bounds, under each of the four kinds of bounds."""
    keys = ["", "lark", "larj~", "lark!", "lark-3", "larkspur", "larl", "lar", "mole", "molf", "5", "6", "7", "8"]
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    for low, high in (("lark", "mole"), ("5", "8"), ("x", "a")):
        for after_low, before_high in itertools.product([False, True], repeat=2):
            want = {k for k in keys if (k > low or k == low and not after_low) and (k < high or k == high and not before_high)}
            assert {r.key for r in reads.key_range(df, low, high, after_low=after_low, before_high=before_high).collect()} == want


LOG = "vb long, seqno long, cid long, key string, op string, value string, cas long, rev long, flags long, exptime long, deleted boolean, checkpoint_id long"


def log(spark, rows):
    return spark.createDataFrame([(0, s, 8, k, "mutation", v, s * 65536, s, 0, e, d, c) for s, k, v, e, d, c in rows], LOG)


def test_checkpoint_dedup(spark):
    df = log(spark, [(1, "A", "x", 0, False, 0), (2, "B", "x", 0, False, 0), (3, "A", "y", 0, False, 0)])
    assert sorted((r.seqno, r.key) for r in feed.dedup(df, ["vb", "checkpoint_id"]).collect()) == [(2, "B"), (3, "A")]
    marker = feed.snapshot_ranges(df).first()
    assert (marker.snap_start, marker.snap_end, marker["items"]) == (2, 3, 2)
    kept = feed.dedup(df, ["vb", "checkpoint_id"], F.lit(True))
    assert kept.count() == 3


def test_expiry_is_strict(spark):
    df = log(spark, [(1, "a", "v", 100, False, 0), (2, "b", "v", 99, False, 0), (3, "c", "v", 0, False, 0), (4, "d", None, 0, True, 0)])
    assert sorted(r.key for r in reads.current(df, 100).collect()) == ["a", "c"]
    due = maintenance.expiry_tombstones(reads.latest(df), 100).collect()
    assert [(r.key, r.value, r.deleted, r.rev) for r in due] == [("b", None, True, 3)]


def test_absolute_expiry(spark):
    now = 1_700_000_000
    cases = {0: 0, 100: now + 100, 2592000: now + 2592000, 2592001: 2592001, now + 5: now + 5}
    df = spark.createDataFrame([(t,) for t in cases], "t long")
    assert {r.t: r.e for r in df.select("t", writes.absolute_expiry(F.col("t"), now).alias("e")).collect()} == cases
    caps = spark.createDataFrame([(0, 10), (now + 100, 99), (now + 100, None), (now - 5, 10)], "e long, ttl long")
    got = [r[0] for r in caps.select(writes.capped_expiry(F.col("e"), F.col("ttl"), 0, now)).collect()]
    assert got == [now + 10, now + 99, now + 100, now - 5]


def test_counters_wrap_and_clamp(spark):
    top = (1 << 64) - 1
    rows = [(1, "up", s, 1, 0) for s in range(102)] + [(1, "down", 0, 0, 5), (1, "down", 1, -9, 5), (1, "down", 2, 4, 5)]
    df = spark.createDataFrame(rows, "cid long, key string, seqno long, delta long, initial long")
    wrap = spark.createDataFrame([(1, "wrap", 0, Decimal(0), Decimal(top)), (1, "wrap", 1, Decimal(2), Decimal(top))], "cid long, key string, seqno long, delta decimal(20,0), initial decimal(20,0)")
    got = {r.key: int(r.counter) for r in writes.counters(df).collect() + writes.counters(wrap).collect()}
    assert got == {"up": 101, "down": 4, "wrap": 1}


def test_hybrid_clock(spark):
    times = [1 << 20, 5 << 20, 2 << 20, 5 << 20, (6 << 20) + 77]
    df = spark.createDataFrame([(0, k, t) for k, t in enumerate(times)], "vb int, arrival long, now_ns long")
    last, want = 0, []
    for t in times:
        last = conflict.next_clock(last, t)
        want.append(last)
    assert [r.cas for r in conflict.assign_clocks(df).orderBy("arrival").collect()] == want


def test_locks(spark):
    df = spark.createDataFrame([("k", 0), ("k", 5), ("k", 10), ("k", 12), ("j", 3)], "key string, at long")
    assert {r.key: (r.granted, r.refused) for r in writes.lock_intervals(df, 10).collect()} == {"k": (2, 2), "j": (1, 0)}


def test_top_keys_capped(spark):
    df = spark.createDataFrame([(f"k{i}", i) for i in range(100)], "key string, at long")
    row = stats.capped_keys(df, "key", "at", 1).first()
    assert (row.collected, row.omitted) == (1, 99)


@pytest.mark.parametrize(("counts", "half"), [({100: 10}, 100), ({100: 10, 110: 10}, 100), ({100: 10, 110: 11}, 110)])
def test_percentile_bins(spark, counts, half):
    df = spark.createDataFrame([(v,) for v, n in counts.items() for _ in range(n)], "v long")
    got = {r.percent: r.bin for r in stats.percentile_bin(df, F.col("v"), [0.0, 50.0, 100.0], rounded=True).collect()}
    assert got == {0.0: min(counts), 50.0: half, 100.0: max(counts)}


def test_bloom_sizes(spark):
    want = {1: (10, 7), 10: (96, 7), 100: (959, 7), 1000: (9585, 7), 10000: (95851, 7), 100000: (958506, 7)}
    df = spark.createDataFrame([(n,) for n in want], "n long")
    bits, hashes = scalars.bloom_size(F.col("n"), F.lit(0.01))
    got = {r.n: (r.b, r.h) for r in df.select("n", bits.alias("b"), hashes.alias("h")).collect()}
    assert {n: b for n, (b, _) in got.items()} == {n: b for n, (b, _) in want.items()}
    assert all(got[n][1] == want[n][1] for n in want)


def test_partition_of(spark):
    row = spark.sql("select '123456789' as k").select(F.crc32("k").alias("c"), scalars.partition_of(F.col("k"), 1024).alias("p")).first()
    assert row.c == 3421780262 and row.p == ((3421780262 >> 16) & 0x7FFF) % 1024


def test_commit_frontier(spark):
    df = spark.createDataFrame([(0, "a", True, 10), (0, "b", False, 8), (0, "c", False, 3), (1, "a", True, 2), (1, "b", False, 9)], "vb int, node string, active boolean, seqno long")
    assert {r.vb: r.frontier for r in durability.commit_frontier(df).collect()} == {0: 8, 1: 2}
    far = df.withColumn("seqno", F.col("seqno") + (1 << 40))
    assert {r.vb: r.frontier for r in durability.commit_frontier(far).collect()} == {0: (1 << 40) + 8, 1: (1 << 40) + 2}


def test_eviction_threshold_is_exact(spark):
    rng = random.Random(4)
    values = [rng.choice([rng.randrange(1 << 45), rng.randrange(300)]) for _ in range(500)] + [7] * 50
    df = spark.createDataFrame([(v,) for v in values], "age long").repartition(3)
    for percent in (0.0, 0.1, 33.3, 50.0, 99.9, 100.0):
        assert maintenance.threshold(df, "age", percent) == sorted(values)[max(1, int(len(values) * percent / 100)) - 1]
    assert maintenance.threshold(df.limit(0), "age", 50) is None


def test_seeded_revisions(spark):
    """Against a loop over the partition: a document made anew starts above the largest deleted rev before it."""
    rng = random.Random(5)
    steps = [(s, rng.choice("abcde"), rng.random() < 0.3) for s in range(1, 300)]
    rev, dead, top, want = {}, {}, 0, []
    for s, k, gone in steps:
        rev[k] = (top if dead.get(k, True) else rev[k]) + 1
        dead[k] = gone
        top = max(top, rev[k]) if gone else top
        want.append((s, rev[k]))
    df = log(spark, [(s, k, "v", 0, gone, 0) for s, k, gone in steps]).repartition(4)
    assert sorted((r.seqno, r.rev) for r in sessions.seeded_revisions(df).collect()) == want


def test_leb128(spark):
    cases = {0: "00", 127: "7f", 128: "8001", 555: "ab04", 0x7F00: "80fe01", 0xFFFFFFFF: "ffffffff0f"}
    df = spark.createDataFrame(list(cases.items()), "n long, t string")
    assert all(r.t == r.e and r.n == r.d for r in df.select("*", scalars.leb128(F.col("n")).alias("e"), scalars.from_leb128(F.col("t")).alias("d")).collect())
    bad = spark.createDataFrame([("",), ("80",), ("8000",), ("0100",)], "t string")
    assert [r.d for r in bad.select(scalars.from_leb128(F.col("t")).alias("d")).collect()] == [None] * 4


def test_patched_bodies(spark):
    rows = [("a" * 20, 255, 16, [2], []), ("b" * 40, 1, 2, [0], [22]), ("c" * 10, 1, 2, [0], []), ("d", 1, 2, None, None), ("e" * 20, 1, 2, [-1], None)]
    df = spark.createDataFrame(rows, "value string, cas long, seqno long, cas_offsets array<int>, seqno_offsets array<int>")
    got = [(r.status, r.value) for r in with_meta.mutate(df).collect()]
    assert got == [("success", "aa0x00000000000000ff"), ("success", "0x0000000000000001bbbb0x0000000000000002"), ("invalid_arguments", "c" * 10), ("success", "d"), ("invalid_arguments", "e" * 20)]


def test_manifests_that_may_follow(spark):
    schema = "sid long, scope string, cid long, collection string, max_ttl long, history boolean, start_seqno long"
    now = spark.createDataFrame([(8, "s", 9, "c", None, False, 0), (10, "t", 11, "d", 5, True, 0)], schema)
    other = now.withColumn("max_ttl", F.lit(7).cast("long"))
    faults = lambda new, uid: sorted((r.rule, r.id) for r in catalog.successor(now, new, 3, uid).collect())
    assert faults(now, 3) == [] and faults(other, 4) == [] and faults(now.limit(0), 4) == []
    assert faults(now, 2) == [("uid_goes_back", 2)] and faults(other, 3) == [("changed_with_same_uid", 9), ("changed_with_same_uid", 11)]
    assert faults(now.withColumn("scope", F.lit("z")), 4) == [("scope_renamed", 8), ("scope_renamed", 10)]


def test_topologies(spark):
    rows = [("active", [["a", "b"]]), ("active", [["a", None, "c"], ["a", "d"]]), ("active", [[None, "b"]]), ("replica", [["a"]]), ("active", [["a", "a"]]), ("active", []), ("replica", None)]
    df = spark.createDataFrame(rows, "state string, chains array<array<string>>")
    assert [r.status for r in partitions.topology_status(df).collect()] == ["success", "success"] + ["invalid_arguments"] * 4 + ["success"]


DOC = '[ 0, "one", 2.0 ]'
OBJECT = '{"int":1,"string":"two","true":true,"false":false}'


@pytest.mark.parametrize(
    ("doc", "path", "want"),
    [(DOC, "[0]", "0"), (DOC, "[1]", '"one"'), (DOC, "[2]", "2.0"), (DOC, "[-1]", "2.0"), (DOC, "[3]", "path_missing"), (DOC, "[2].nothing_here", "path_mismatch"), (OBJECT, "int", "1"), (OBJECT, "string", '"two"'), (OBJECT, "true", "true"), (OBJECT, "missing_key", "path_missing"), (OBJECT, "[0]", "path_mismatch"), (OBJECT, "int.nothing_here", "path_mismatch"), ('{"a.b":{"c`d":[1]}}', "`a.b`.`c``d`[0]", "1"), ("x", "a", "doc_not_json")],
)
def test_subdoc_get(doc, path, want):
    status, _, _, results = subdoc.apply_all(doc, [{"op": "get", "path": path}])
    assert (results[0] if status == "success" else status) == want


def edit(doc, *ops):
    return subdoc.apply_all(doc, [dict(zip(("op", "path", "value", "flags"), o, strict=False)) for o in ops])[:3]


def test_subdoc_edits():
    assert edit("{}", ("upsert", "a.b", "1", 1), ("add", "a.c", "2.50")) == ("success", '{"a":{"b":1,"c":2.50}}', None)
    assert edit('{"a":1}', ("add", "a", "2")) == ("path_exists", '{"a":1}', 0)
    assert edit('{"a":1}', ("upsert", "b", "2"), ("replace", "c", "2")) == ("path_missing", '{"a":1}', 1)
    assert edit("[1]", ("push_first", "", "0"), ("push_last", "", "2,3"), ("insert", "[4]", "4")) == ("success", "[0,1,2,3,4]", None)
    assert edit("[1]", ("insert", "[3]", "4")) == ("path_missing", "[1]", 0)
    assert edit("[1]", ("add_unique", "", "1.0"), ("add_unique", "", "1"))[0] == "path_exists"
    assert edit("[1]", ("add_unique", "", "{}"))[0] == "value_cannot_insert"
    assert edit('{"n":5}', ("counter", "n", "-7"), ("counter", "m", "3")) == ("success", '{"n":-2,"m":3}', None)
    assert edit('{"n":1.5}', ("counter", "n", "1"))[0] == "path_mismatch"
    assert edit('{"n":9223372036854775807}', ("counter", "n", "1"))[0] == "value_overflow"
    assert edit('{"n":1}', ("counter", "n", "0"))[0] == "delta_invalid"
    assert edit('{"a":[1,2,3]}', ("delete", "a[1]")) == ("success", '{"a":[1,3]}', None)
    assert edit("{}", *[("upsert", f"k{i}", "1") for i in range(17)])[0] == "too_many_paths"
    assert edit("{}", ("get", ".".join("abcdefghij" * 4)))[0] == "path_too_deep"


def test_subdoc_fold(spark):
    df = spark.createDataFrame([('{"a":1}',), (None,)], "doc string")
    got = df.select(subdoc.fold(F.col("doc"), F.array(subdoc.operation("counter", "a", "2"))).alias("r")).select("r.*").collect()
    assert [(r.status, r.doc) for r in got] == [("success", '{"a":3}'), ("doc_not_json", None)]


def test_subdoc_fold_of_a_batch(spark):
    """Lists of their own per row, a null list, null values and flags: as apply_all gives them, in one batch that does not start at the array's first row."""
    lists = [[("upsert", "b", '"é\\n"', 0)], None, [("upsert", "x.y", "[1.50,true,null]", 1), ("get", "x", None, None)], [], [("delete", "a", None, None), ("delete", "a", "", 0)]] * 40
    rows = [('{"a":1}', ops) for ops in lists]
    df = spark.createDataFrame(rows, "doc string, ops array<struct<op string, path string, value string, flags int>>").coalesce(1)
    got = df.select(subdoc.fold(F.col("doc"), F.col("ops")).alias("r")).select("r.*").collect()
    names = ("op", "path", "value", "flags")
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(subdoc.apply_all(t, [dict(zip(names, o, strict=True)) for o in ops or []])) for t, ops in rows)


def test_edits_of_one_row_group_are_spread(spark, tmp_path):
    """A file of one row group is read by one task; the edits of its rows are not left to it. Adaptive execution is off so that its few bytes are not put together again."""
    from tidelog.plans import registry

    spark.range(4000).selectExpr("id AS event_id", "current_timestamp()::timestamp_ntz AS ts", "id % 7 AS user_id", "'view' AS event_type", "1.0D AS value", "'{\"k\": 7}' AS props").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for name in ("subdoc_add_delete", "subdoc_whole_document", "subdoc_counter", "subdoc_push_last", "subdoc_add_unique", "subdoc_dict_upsert"):
            found = registry.QUERIES[name](spark, str(tmp_path)).groupBy(F.spark_partition_id().alias("p")).count().collect()
            assert len(found) == 4 and max(r["count"] for r in found) < 1500, name
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
