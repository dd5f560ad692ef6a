from tests.llm.test_secrets import KEY
from tidelog.llm import secrets


def test_two_owners_and_short_values_are_masked(spark):
    texts = [(1, f"token = {KEY}", "a"), (2, f"token = {KEY}", "b"), (3, "password = x9Kq2w", "a"), (4, "password = letmein", "a")]
    texts += [(10 + k, "secret = q7Zp4mW1", f"s{k}") for k in range(3)]
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in texts], "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: r.text for r in secrets.mask_live(docs).collect()}
    assert out[1] == out[2] == "token = [secret]" and out[3] == "password = [secret]"
    assert out[4] == "password = letmein" and out[10] == "secret = q7Zp4mW1"
