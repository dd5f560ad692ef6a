"""Point and range reads over a log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["vb", "cid", "key"]


def expired(as_of: int, exptime: str = "exptime") -> Column:
    """Expiry is strict: a document lives through its last second; 0 never expires."""
    return (F.col(exptime) != 0) & (F.col(exptime) < F.lit(as_of))


def live(as_of: int) -> Column:
    return ~F.col("deleted") & ~expired(as_of)


def latest(log: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The newest row per document. One aggregate with a partial step before the shuffle, whatever the number of versions."""
    keys = keys or KEY
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("seqno")).alias("row")).select(*keys, "row.*")


def current(log: DataFrame, as_of: int) -> DataFrame:
    """Documents as a reader sees them: newest versions that are neither deleted nor expired."""
    return latest(log).where(live(as_of))


def get_multi(log: DataFrame, wanted: DataFrame, as_of: int) -> DataFrame:
    """wanted (cid, key) with the document's columns and status. The log is cut to wanted keys before it is aggregated."""
    found = current(log.join(wanted, ["cid", "key"], "left_semi"), as_of)
    return wanted.join(found, ["cid", "key"], "left").withColumn("status", F.when(F.col("seqno").isNull(), "no_such_key").otherwise("success"))


def get_meta(log: DataFrame) -> DataFrame:
    """Metadata of every document, tombstones included; bodies are not read."""
    return latest(log.select(*KEY, "seqno", "deleted", "flags", "exptime", "rev", "cas"))


def get_if(log: DataFrame, predicate: Column, as_of: int) -> DataFrame:
    """Documents whose metadata passes; bodies come from a join with the few that pass."""
    meta = get_meta(log).where(live(as_of) & predicate).select("vb", "seqno")
    return log.join(meta, ["vb", "seqno"], "left_semi")


def observe(log: DataFrame, wanted: DataFrame, persisted: DataFrame) -> DataFrame:
    """State of each wanted (cid, key) given persisted (vb, persisted_seqno)."""
    found = latest(log.join(wanted, ["cid", "key"], "left_semi")).join(persisted, "vb", "left")
    state = F.when(F.col("seqno").isNull(), "not_found").when(F.col("deleted"), "logically_deleted").when(F.col("seqno") > F.col("persisted_seqno"), "not_persisted").otherwise("persisted")
    return wanted.join(found, ["cid", "key"], "left").select("cid", "key", "cas", state.alias("state"))


def compare(memory: DataFrame, disk: DataFrame) -> DataFrame:
    """First difference between two copies of each document, in the fixed order of fields."""
    a, b = memory.alias("a"), disk.alias("b")
    fields = [("flags", "flags_mismatch"), ("value", "data_mismatch"), ("rev", "revseqno_mismatch"), ("cas", "cas_mismatch")]
    state = F.when(F.col("a.seqno").isNull() | F.col("b.seqno").isNull(), "item_deleted")
    for name, says in (fields[0], ("value", "data_size_mismatch"), *fields[2:], fields[1]):
        left, right = F.col(f"a.{name}"), F.col(f"b.{name}")
        state = state.when(F.octet_length(left) != F.octet_length(right) if says == "data_size_mismatch" else ~left.eqNullSafe(right), says)
    joined = a.join(b, KEY, "full_outer")
    return joined.select(*KEY, state.otherwise("valid").alias("status"))


def key_range(docs: DataFrame, low: str, high: str, *, after_low: bool = False, before_high: bool = False) -> DataFrame:
    """Keys between two bounds, each kept or left out. The comparisons reach the scan where docs is a table of documents; over reads.latest they stay below its aggregate, and above a window that numbers the log."""
    key = F.col("key")
    return docs.where(((key > low) if after_low else (key >= low)) & ((key < high) if before_high else (key <= high)))


def page(docs: DataFrame, size: int, after: tuple[int, str] | None = None) -> DataFrame:
    """The next `size` documents in (cid, key) order: a bounded top-k, not a global sort."""
    if after is not None:
        docs = docs.where((F.col("cid") > after[0]) | ((F.col("cid") == after[0]) & (F.col("key") > after[1])))
    return docs.orderBy("cid", "key").limit(size)


def byte_limit(docs: DataFrame, limit: int, *, group: str = "vb", size: Column | None = None) -> DataFrame:
    """Per group, documents in key order until the first that reaches the limit, that one included."""
    size = size if size is not None else F.octet_length("value")
    before = Window.partitionBy(group).orderBy("cid", "key").rowsBetween(Window.unboundedPreceding, -1)
    return docs.withColumn("bytes_before", F.coalesce(F.sum(size).over(before), F.lit(0)).cast("long")).where(F.col("bytes_before") < limit)


def sample(docs: DataFrame, probability: float, seed: int = 0) -> DataFrame:
    """A Bernoulli sample; the same for the same seed only over the same partitioning of docs. hash_sample is the same always."""
    return docs.sample(False, probability, seed)


def hash_sample(docs: DataFrame, hexits: str) -> DataFrame:
    """Documents whose key's MD5 is below a threshold of leading hex digits: a sample that every engine repeats."""
    return docs.where(F.md5("key") < hexits)


def by_seqno(log: DataFrame, start: int, *, deletes: bool = True) -> DataFrame:
    """Newest versions from a sequence number on."""
    found = latest(log).where(F.col("seqno") >= start)
    return found if deletes else found.where(~F.col("deleted"))


def history(log: DataFrame, start: int) -> DataFrame:
    """Every retained version from a sequence number on."""
    return log.where(F.col("seqno") >= start)


def all_keys(docs: DataFrame, start: str, count: int, cid: int) -> DataFrame:
    return docs.where((F.col("cid") == cid) & (F.col("key") >= start)).select("key").orderBy("key").limit(count)


def state_at(log: DataFrame, seqno: int) -> DataFrame:
    """Newest versions as of a sequence number: the state after a rollback to it."""
    return latest(log.where(F.col("seqno") <= seqno))
