"""Near copies of texts: word SimHashes that are alike in a run of bits propose pairs, exact Jaccard similarity decides."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm import vptree
from tidelog.llm.common import materialize, small_join
from tidelog.llm.graph import connected_components

SEED, SHINGLE, SIMILAR = 42, 5, 0.8
#: Word fingerprints of a text, each searched apart from the others, and the bits in which those of near copies may differ. Texts of
#: five-word similarity 0.8 share nearly all their words, so these fingerprints are closer than those of shingles.
TABLES, RADIUS = 4, 4
#: Bits of a text's sketch.
SKETCH = 512
#: Words whose hashes are kept in each worker.
CACHE_WORDS = 200_000


def normal(text: str | None) -> bytes:
    """Bytes A-Z lower-cased, one space between words."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())


def shingles(joined: bytes) -> set[bytes]:
    """The distinct runs of SHINGLE words; a shorter text is one run."""
    words = joined.split(b" ")
    return {b" ".join(words[k : k + SHINGLE]) for k in range(max(1, len(words) - SHINGLE + 1))}


def similarity(a: set[bytes], b: set[bytes]) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both)


def sketch(cut: set[bytes]) -> np.ndarray:
    """SKETCH bits: bit k tells whether an odd number of the shingles fall to it. Two texts' differ in no more bits than shingles are in one text alone."""
    slots = np.fromiter((xxhash.xxh3_64_intdigest(x, SEED) % SKETCH for x in cut), np.int64, len(cut))
    return np.packbits(np.bincount(slots, minlength=SKETCH) & 1, bitorder="little").view("<u8")


def may_be_similar(size: np.ndarray, sketches: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """False only for pairs whose similarity is below SIMILAR: of so many shingles, too many must be in one text alone."""
    both = size[i] + size[j]
    apart = np.abs(size[i] - size[j])
    for lo in range(0, len(i), 1 << 16):
        at = slice(lo, lo + (1 << 16))
        bits = np.bitwise_count(sketches[i[at]] ^ sketches[j[at]]).sum(axis=1, dtype=np.int64)
        apart[at] = np.maximum(apart[at], bits)
    return apart * (1 + SIMILAR) <= both * (1 - SIMILAR) + 1e-6


class WordHashes(dict):
    """64 * TABLES bits of a word, as bytes, 128 to a hash; made when first asked for."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = b"".join([xxhash.xxh128_digest(word, k) for k in range(TABLES // 2)])
        return self[word]


def word_fingerprints(joined: bytes, hashes: WordHashes) -> np.ndarray:
    """TABLES SimHashes of the words, each weighing the root of its number. Zeros for a text without words."""
    if not joined:
        return np.zeros(TABLES, np.uint64)
    counts = Counter(joined.split(b" "))
    weight = np.sqrt(np.fromiter(counts.values(), np.float32, len(counts)))
    total = np.zeros(64 * TABLES, np.float32)
    words = list(counts)
    for lo in range(0, len(words), 512):
        raw = np.frombuffer(b"".join([hashes[w] for w in words[lo : lo + 512]]), np.uint8).reshape(-1, 8 * TABLES)
        total += weight[lo : lo + 512] @ np.unpackbits(raw, axis=1, bitorder="little").astype(np.float32)
    return np.packbits(2 * total > weight.sum(), bitorder="little").view("<u8")


def _node(joined: bytes) -> int:
    return xxhash.xxh64_intdigest(joined, SEED)


def _long(values) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def whole(docs: DataFrame) -> Column:
    """A digest of all columns of a row: rows with the same one are the same."""
    return F.md5(F.to_json(F.struct(*docs.columns)))


def _signed(docs: DataFrame, text_col: str) -> DataFrame:
    """doc_id, whole, node, fps: the row's id, a digest of all its columns, a 64-bit hash of its normal text and its word fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            node, fps = [], [np.zeros(0, np.uint64)]
            for t in b.column(2):
                joined = normal(t.as_py())
                node.append(_node(joined))
                fps.append(word_fingerprints(joined, hashes))
            lists = pa.ListArray.from_arrays(pa.array(range(0, TABLES * len(node) + 1, TABLES), pa.int32()), _long(np.concatenate(fps)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _long(node), lists], names=["doc_id", "whole", "node", "fps"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole(docs).alias("whole"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, whole string, node long, fps array<long>")


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [normal(t.as_py()) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([_long([_node(t) for t in texts]), pa.array(texts, pa.binary())], names=["node", "body"])

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "node long, body binary")


def _sketched(texts: DataFrame) -> DataFrame:
    """node, size, sketch: the number of distinct shingles and their sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, rows = [], [np.zeros(0, np.uint64)]
            for t in b.column(1):
                cut = shingles(t.as_py())
                size.append(len(cut))
                rows.append(sketch(cut))
            lists = pa.ListArray.from_arrays(pa.array(range(0, SKETCH // 64 * len(size) + 1, SKETCH // 64), pa.int32()), _long(np.concatenate(rows)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), lists], names=["node", "size", "sketch"])

    return texts.select("node", "body").mapInArrow(run, "node long, size long, sketch array<long>")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose five-word similarity is at least SIMILAR, exactly. Both sides are written tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            right = [similarity(shingles(x.as_py()), shingles(y.as_py())) >= SIMILAR for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(right, pa.bool_()))

    left = texts.select(F.col("node").alias("a"), F.col("body").alias("x"))
    right = texts.select(F.col("node").alias("b"), F.col("body").alias("y"))
    both = pairs.select("a", "b").join(left.hint("merge"), "a").join(right.hint("merge"), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _highest(fps: np.ndarray, key: np.ndarray, shard: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return vptree.highest(fps, np.ones(len(fps), bool), RADIUS, shard.column("rank").to_numpy(), key)


def _likely(pairing) -> vptree.Linker:
    """Links of vptree.forest or vptree.apart between texts of different labels that may be similar."""

    def link(fps: np.ndarray, key: np.ndarray, shard: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        size = shard.column("size").to_numpy()
        sketches = shard.column("sketch").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(size), -1)
        return pairing(fps, np.ones(len(fps), bool), RADIUS, shard.column("label").to_numpy(), lambda i, j: may_be_similar(size, sketches, i, j), key)

    return link


def near_copies(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """doc_id, whole, node, component for each row: texts joined up by pairs that are equal or at least SIMILAR alike.

    Null and blank texts are equal; texts of fewer than five words are one shingle; rows that repeat are one text; an empty
    table gives no rows. Candidates are texts of which one of TABLES word fingerprints differs in at most RADIUS bits. All
    candidates are settled: they are found similar, or joined by others, or dissimilar by count or by a bound on it.

    First each text is compared with the candidate whose fingerprints are the most frequent, as the original's are among its
    copies; this joins up most of a large group at one comparison a text. Then, of the candidates still apart that size and
    sketch let be similar, a forest is compared, and at last every such pair.
    """
    signed = materialize(_signed(docs, text_col), "signed")
    items = materialize(signed.groupBy("node").agg(F.first("fps").alias("fps")).select("node", F.posexplode("fps").alias("t", "fp")), "items")
    frequency = items.groupBy("t", "fp").agg(F.count("*").alias("n")).where("n > 1")
    often = items.join(materialize(frequency, "frequency").hint("merge"), ["t", "fp"]).groupBy("node").agg(F.sum("n").alias("rank"))
    each = items.join(often.hint("merge"), "node", "left").select("t", "node", "fp", F.coalesce("rank", F.lit(0)).cast("long").alias("rank"))
    each = materialize(each, "each")
    # One text holds each fingerprint; the others that have it are compared with that one.
    first = F.min(F.struct((-F.col("rank")).alias("low"), "node"))
    holders = materialize(each.groupBy("t", "fp").agg(first.alias("x")).select("t", "fp", "x.node", (-F.col("x.low")).alias("rank")), "holders")
    held = each.where("rank > 0").select("t", "fp", F.col("node").alias("a")).join(holders.select("t", "fp", F.col("node").alias("b")).hint("merge"), ["t", "fp"]).select("a", "b")
    pairs = materialize(vptree.search_alike(holders, RADIUS, _highest, tables=TABLES).union(held).where("a <> b").distinct(), "pairs")
    ranked = pairs.join(materialize(often, "often").withColumnRenamed("node", "b").hint("merge"), "b", "left")
    top = ranked.groupBy("a").agg(F.max(F.struct(F.coalesce("rank", F.lit(0)).alias("rank"), F.bitwise_not("b").alias("b"))).alias("x")).select("a", F.bitwise_not("x.b").alias("b"))
    met = materialize(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "met")
    texts = materialize(small_join(_texts(docs, text_col), met, "node", "inner").dropDuplicates(["node"]), "texts")
    each = materialize(items.join(materialize(_sketched(texts), "sketched").hint("merge"), "node"), "each")
    links = materialize(verified(materialize(_ordered(top), "top"), texts), "links")
    component = connected_components(links)
    for pairing in (vptree.forest, vptree.apart):
        labelled = materialize(each.join(component.hint("merge"), "node", "left").select(*each.columns, F.coalesce("component", "node").alias("label")), "labelled")
        pairs = materialize(_ordered(vptree.search_alike(labelled, RADIUS, _likely(pairing), tables=TABLES)), "pairs")
        links = materialize(links.union(verified(pairs, texts)), "links")
        component = connected_components(links)
    return signed.drop("fps").join(component.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))


def keep_first(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """One row of docs for each component: that of the smallest doc_id, then of the smallest digest; null ids come last."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "whole")
    kept = materialize(classes.groupBy("component").agg(F.min(order).alias("least")).select(F.col("least.whole").alias("__whole")), "kept")
    found = docs.withColumn("__whole", whole(docs)).join(kept.hint("merge"), "__whole").dropDuplicates(["__whole"])
    return found.select(*docs.columns)
