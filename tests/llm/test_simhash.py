import hashlib

import pytest
from pyspark.sql import functions as F

from tidelog.llm import simhash


def check(df):
    rows = [(r.doc_id, r.text or "") for r in df.collect()]
    rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0), [-b for b in r[1].encode()] + [1]))
    got = simhash.document_fingerprints(df).collect()
    fps = {}
    for r in got:
        fps.setdefault((r.doc_id, r.edited_sha256), r)
    want = []
    for k, (i, text) in enumerate(rows):
        after, cut = rows[(k + 1) % len(rows)][1], len(text) // 3
        want.append((i, len(text), hashlib.sha256((text[: len(text) - cut] + after[:cut]).encode()).hexdigest()))
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=repr) == sorted(want, key=repr)
    near = lambda a, b: 1 - bin(int(a, 16) ^ int(b, 16)).count("1") / 64
    of = {w[0:1] + w[2:]: w for w in want}
    text_fp = {}
    for r in got:
        assert r.near_edited == near(r.fingerprint, r.edited_fingerprint)
        assert (r.doc_id, r.edited_sha256) in of
    for (i, text), w in zip(rows, want, strict=True):
        r = fps[i, w[2]]
        assert text_fp.setdefault(text, r.fingerprint) == r.fingerprint
    for k, w in enumerate(want):
        assert fps[w[0], w[2]].near_next == near(text_fp[rows[k][1]], text_fp[rows[(k + 1) % len(rows)][1]])
    for r in got:
        if r.doc_id is not None and r.doc_id % 20 == 0:
            assert r.n_near == sum(near(r.fingerprint, x.fingerprint) >= 1 - 3 / 64 for x in got) - 1
        else:
            assert r.n_near is None
    return got


@pytest.mark.parametrize("run_rows", [2, 64])
def test_rows(odd, documents, monkeypatch, run_rows):
    monkeypatch.setattr(simhash, "RUN_ROWS", run_rows)
    check(odd)
    got = check(documents)
    assert sum(r.near_edited > r.near_next for r in got) > 0.9 * len(got)


def test_few_rows(nothing, spark):
    assert simhash.document_fingerprints(nothing).count() == 0
    one = check(spark.createDataFrame([(40, "a b c d e f")], "doc_id long, text string"))
    assert one[0].near_next == 1.0


def test_search_finds_every_pair(spark):
    base = 0x0123456789ABCDEF
    flips = [0, 1, 1 << 63, 7, (1 << 5) | (1 << 20) | (1 << 40), 15, (1 << 1) | (1 << 2) | (1 << 60) | (1 << 61)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(base ^ f),) for f in flips], "fp long")
    pairs = simhash.within_radius(df, df).collect()
    want = {(signed(base ^ a), signed(base ^ b)) for a in flips for b in flips if bin(a ^ b).count("1") <= 3}
    assert len(pairs) == len(want) and {(r.q, r.fp) for r in pairs} == want


def test_no_python_on_the_main_path(documents):
    plan = simhash.edited_fingerprints(documents)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert F is not None
