import hashlib
import zlib

from pyspark.sql import functions as F

from tidelog.llm import media


def expected(text):
    b = (text or "").encode()
    p = b + b" " * (max(192, -(-len(b) // 192) * 192) - len(b))
    png = media.to_png(p)
    return (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(png), hashlib.sha256(png).hexdigest(), media.feature(p))


def check(df):
    want = sorted(((r.doc_id, *expected(r.text)) for r in df.collect()), key=repr)
    out = media.document_media(df)
    assert sorted((tuple(r)[:8] for r in out.collect()), key=repr) == want
    assert {r.position for r in out.where("n_bytes > 3").collect()} <= {0, 1}


def test_rows(odd, nothing, documents):
    check(odd)
    check(documents)
    assert media.document_media(nothing).count() == 0


def test_png_round_trip():
    for n in (192, 384, 192 * 777):
        p = bytes(i * 7 % 256 for i in range(n))
        assert media.from_png(media.to_png(p)) == p


def test_sequence():
    page = '<head><title>no</title></head><p>a <b>b</b><img src="x" alt="q  r"><p>c<script>no()</script><figure><figcaption>cap</figcaption></figure><figure><img src=k><img src=l><figcaption>k&amp;l</figcaption></figure>z'
    assert media.sequence(page) == [(0, "text", "a b", None, None), (1, "image", None, "x", "q r"), (2, "text", "c", None, None), (3, "text", "cap", None, None), (4, "image", None, "k", "k&l"), (5, "image", None, "l", "k&l"), (6, "text", "z", None, None)]
    assert media.sequence(None) == []


def test_positions_and_captions_stay_aligned(spark):
    pages = spark.createDataFrame([(1, f'<p>t<img src="{media.SCHEME}{"a" * 64}" alt=one>u<img src="other" alt=two>'), (2, None)], "id int, html string")
    items = media.sequences(pages).select("id", F.explode("items").alias("x")).select("id", "x.*")
    found = media.resolve(items, spark.createDataFrame([("a" * 64, 5)], "digest string, media_bytes long"))
    assert sorted((r.position, r.kind, r.caption, r.media_bytes) for r in found.collect()) == [(0, "text", None, None), (1, "image", "one", 5), (2, "text", None, None), (3, "image", "two", None)]
