"""Scan sessions, checkpoints by bytes, configuration."""

import base64
from collections import defaultdict

import pytest

from tidelog.operators import scans, sessions

LOG = "vb long, seqno long, cid long, key string, op string, value string, cas long, rev long, flags long, exptime long, deleted boolean"


def b64(text):
    return base64.b64encode(text.encode()).decode()


@pytest.fixture(scope="module")
def log(spark):
    return spark.createDataFrame([(0, i, 8, f"k{i:03d}", "mutation", "v" * (i % 40), i, 1, 0, 0, i % 10 == 0) for i in range(1, 101)], LOG)


@pytest.mark.parametrize("pinned", [False, True])
def test_a_scan_pages_through(log, tmp_path, pinned):
    scan = scans.create(log, 8, {"range": {"start": b64("k010"), "end": b64("k050")}, "key_only": True}, 0, pin_to=f"file://{tmp_path}/scan" if pinned else None)
    assert bool(scan.rows.inputFiles()) == pinned
    keys = []
    while page := scan.proceed(7):
        keys += [r.key for r in page]
    assert keys == [f"k{i:03d}" for i in range(10, 51) if i % 10] and scan.rows.columns == ["cid", "key"]
    scan.cancel()
    with pytest.raises(scans.ScanError, match="range_scan_cancelled"):
        scan.proceed(1)


@pytest.mark.parametrize(
    ("request_", "status"),
    [
        ({"range": {"start": b64("a"), "excl_start": b64("a"), "end": b64("b")}}, "invalid_arguments"),
        ({"range": {"end": b64("b")}}, "invalid_arguments"),
        ({}, "invalid_arguments"),
        ({"range": {"start": b64("x"), "end": b64("z")}}, "no_such_key"),
        ({"range": {"start": b64("a"), "end": b64("z")}, "snapshot_requirements": {"vb_uuid": "5", "seqno": 1}}, "vbuuid_not_equal"),
        ({"range": {"start": b64("a"), "end": b64("z")}, "snapshot_requirements": {"vb_uuid": "7", "seqno": 500}}, "temporary_failure"),
        ({"range": {"start": b64("a"), "end": b64("z")}, "snapshot_requirements": {"vb_uuid": "7", "seqno": 0, "seqno_exists": True}}, "not_stored"),
    ],
)
def test_scans_that_cannot_be_had(log, request_, status):
    with pytest.raises(scans.ScanError, match=status):
        scans.create(log, 8, request_, 0, newest_uuid=7, persisted=100)


def test_sampling(log):
    assert scans.create(log, 8, {"sampling": {"samples": 1000}}, 0).rows.count() == 90
    assert 5 < scans.create(log, 8, {"sampling": {"samples": 30, "seed": 3}}, 0).rows.count() < 60


def test_checkpoints_by_bytes(log):
    per_vb = defaultdict(list)
    for r in sessions.assign_checkpoints(log, 100).collect():
        per_vb[r.vb].append((r.seqno, r.checkpoint_id))
    rows = sorted((r.seqno, len(r.value)) for r in log.collect())
    assert [c for _, c in sorted(per_vb[0])] == sessions.checkpoint_numbers([(n, False) for _, n in rows], 100)
    assert sessions.checkpoint_numbers([(5, False), (5, True), (5, False)], 100) == [0, 1, 1]


def test_newest_config(spark):
    df = spark.createDataFrame([("b", "old", 1, 9), ("b", "new", 2, 0), ("c", "x", 1, 1)], "bucket string, body string, epoch long, rev long")
    assert sorted((r.bucket, r.body, r.epoch, r.rev) for r in sessions.newest_config(df).collect()) == [("b", "new", 2, 0), ("c", "x", 1, 1)]
