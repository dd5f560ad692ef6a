import hashlib
import re

from tests.oracle import connect, rows_of, rows_of_sql
from tidelog.llm import queries, secrets

A = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
K, H = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")


def base(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in A.finditer(text) if len(m[2]) >= 6] + [(m.start(), 1, m.end()) for m in K.finditer(text) if len(m[0]) >= 20] + [(m.start(), 2, m.end()) for m in H.finditer(text) if len(m[0]) >= 24]
    names = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))
    return tuple(sum(x[1] == k for x in found) for k in range(3)) + (hashlib.sha256(names.encode()).hexdigest(),), names


def check(df):
    rows = secrets.secret_report(df).collect()
    assert sorted(((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in rows), key=repr) == sorted(((r.doc_id, *base(r.text)[0]) for r in df.collect()), key=repr)
    for r in rows:
        own = [s for s in r.spans.split(",") if s]
        assert hashlib.sha256(",".join(s for s in own if s.split(":")[0] in ("assign", "access", "hex")).encode()).hexdigest() == r.base_sha256
    return rows


def test_rows(odd, nothing, documents):
    check(odd)
    check(documents)
    assert secrets.secret_report(nothing).count() == 0


KEY = "0cf1bbc67ab39b2ddebadc809bed189ed8c6ac4d"


def owned(spark):
    rows = [(i, f"🙂 token = '{KEY}'", "en", f"s{i}", 1) for i in range(4)] + [(10, f"password: 'ZxY{KEY}' secret=ZxY{KEY}", "en", "s0", 1), (11, "token=aaaaaaaaaaaaaaaaaaaaaaa", "en", "s0", 1), (12, "plain", None, None, 5)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_ownership(spark):
    rows = {r.doc_id: r for r in check(owned(spark))}
    assert rows[0].n_shared == 1 and rows[0].n_live == 0 and f"shared:11:{11 + len(KEY)}" in rows[0].spans
    assert rows[10].n_live == 2 and rows[10].n_shared == 2  # the bare hex runs in it are the shared key
    assert rows[11].n_live == 0 and rows[11].n_shared == 0 and rows[12].spans == ""


def test_masking(spark, odd, nothing):
    out = {r.doc_id: r for r in secrets.mask_live(owned(spark)).collect()}
    assert out[10].text == "password: '[secret]' secret=[secret]" and out[10].n_chars == len(out[10].text)
    assert KEY in out[0].text and out[12].text == "plain" and out[12].n_chars == 5
    masked = secrets.mask_live(odd)
    assert masked.columns == odd.columns and masked.count() == odd.count()
    assert secrets.mask_live(nothing).count() == 0


def test_repositories_decide(spark):
    """Two owners share a value: over five repositories of theirs it is widely copied, over two it is not; one owner's many repositories do not matter."""
    other, third = KEY[::-1], "9" + KEY[1:]
    rows = [(i, f"token = {KEY}", f"l{i}", f"s{i % 2}", 1) for i in range(5)] + [(10 + i, f"token = {other}", "en", f"s{i}", 1) for i in range(2)] + [(20 + i, f"token = {third}", f"l{i}", "s0", 1) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: r for r in secrets.secret_report(docs).collect()}
    assert (out[0].n_shared, out[0].most_owners, out[0].most_repositories) == (1, 2, 5)
    assert out[0].n_shared and not out[10].n_shared and not out[10].n_live and out[20].n_live and not out[20].n_shared
    assert (out[10].most_owners, out[10].most_repositories, out[20].most_repositories) == (2, 2, 6)
    masked = {r.doc_id: r.text for r in secrets.mask_live(docs).collect()}
    assert masked[0] == f"token = {KEY}" and masked[10] == masked[20] == "token = [secret]"


def test_no_value_is_written(spark):
    rows, spans = secrets.scan(owned(spark))
    assert "value" not in spans.columns and all(KEY not in str(r) for r in spans.collect())


def test_sql(spark, sf):
    name = "op5_secret_ownership"
    assert rows_of(queries.QUERIES[name](spark, sf)) == rows_of_sql(connect(sf), queries.ORACLE_SQL[name])
