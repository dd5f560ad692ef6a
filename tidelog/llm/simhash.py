"""SimHash document fingerprints and their search by permuted block tables, in DataFrame functions only."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import materialize

#: Radius of the search; blocks that a fingerprint is cut into. Pairs within the radius agree on BLOCKS - RADIUS of them.
RADIUS, BLOCKS = 3, 6
#: Heaviest term; a term weighs as many as the bytes of its two words.
HEAVIEST = 24
#: Consecutive documents that are ordered together, and most such runs (their bounds travel with the plan).
RUN_ROWS, RUNS = 64, 1 << 16


def words(text: Column) -> Column:
    found = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), "")
    return F.when(F.size(found) == 0, F.array(F.lit(""))).otherwise(found)


def simhash(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys and fp, a 64-bit SimHash of `text`, for each distinct value of keys.

    Terms are pairs of neighbouring lower-cased words (a lone word stands for itself; a blank text is one empty term), each
    as often as it occurs, weighted by its length. A bit is 1 if terms of over half the weight have it. Two 32-bit counters
    share a long, so one pass sums 32 columns, partly before any shuffle.
    """
    term = rows.select(*keys, words(F.col(text)).alias("w")).select(*keys, "w", F.posexplode("w").alias("p", "word"))
    term = term.where(F.col("p") < F.greatest(F.size("w") - 1, F.lit(1)))
    after = F.get("w", F.col("p") + 1)
    term = term.select(*keys, F.xxhash64("word", after).alias("h"), F.greatest(F.lit(1), F.least(F.lit(HEAVIEST), F.octet_length("word") + F.coalesce(F.octet_length(after), F.lit(0)))).cast("long").alias("weight"))
    sums = [F.sum(F.shiftrightunsigned("h", i).bitwiseAND(F.lit(0x100000001)) * F.col("weight")).alias(f"s{i}") for i in range(32)]
    votes = term.groupBy(*keys).agg(*sums, F.sum("weight").alias("total"))
    bits = []
    for i in range(32):
        low, high = F.col(f"s{i}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(f"s{i}", 32)
        bits.append(F.shiftleft((2 * low > F.col("total")).cast("long"), i))
        bits.append(F.shiftleft((2 * high > F.col("total")).cast("long"), i + 32))
    return votes.select(*keys, reduce(lambda a, b: a.bitwiseOR(b), bits).alias("fp"))


def likeness(a: Column, b: Column) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def as_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def _run_of(doc_id: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are below doc_id, by binary search; -1 for null."""
    steps = [1 << k for k in range(max(1, len(bounds)).bit_length() - 1, -1, -1)]
    array = F.array(*[F.lit(b).cast("long") for b in bounds]) if len(bounds) <= 64 else F.from_json(F.lit("[" + ",".join(map(str, bounds)) + "]"), "array<bigint>")
    found = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda at, step: F.when((at + step <= len(bounds)) & (F.get(array, at + step - 1) < doc_id), at + step).otherwise(at))
    return F.when(doc_id.isNull(), F.lit(-1)).otherwise(found)


def with_next(docs: DataFrame) -> DataFrame:
    """run, pos, guest, doc_id, text, edited for documents (doc_id, text), in falling order of doc_id.

    The edited text has its last third replaced by the start of the next document, the last document being followed by the
    first. Documents are dealt to runs of neighbouring ids (bounds from approximate percentiles over all ids), and each
    run also gets, as its guest, the document that follows it. Equal ids follow one another in falling order of text;
    null ids come last. Null texts are empty.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = docs.count()
    runs = max(1, min(RUNS, total // RUN_ROWS))
    bounds: list[int] = []
    if runs > 1:
        share = ",".join(f"{k / runs!r}" for k in range(1, runs))
        found = docs.select(F.expr(f"percentile_approx(doc_id, array({share}), {10 * runs})").alias("b")).first()["b"]
        bounds = sorted(set(found or []))
    run = _run_of(F.col("doc_id"), bounds)
    tops = docs.select("doc_id", run.alias("run")).groupBy("run").agg(F.max("doc_id").alias("top"))
    above = Window.orderBy(F.desc("run"))
    every = Window.partitionBy()
    guests = tops.select("top", F.coalesce(F.lag("run").over(above), F.min("run").over(every)).alias("host"))
    dealt = docs.withColumn("run", run).join(F.broadcast(guests), F.col("doc_id").eqNullSafe(F.col("top")), "left")
    own = F.struct(F.col("run").alias("run"), F.lit(0).alias("guest"))
    guest = F.struct(F.col("host").alias("run"), F.lit(1).alias("guest"))
    dealt = dealt.select("doc_id", "text", F.explode(F.when(F.col("host").isNull(), F.array(own)).otherwise(F.array(own, guest))).alias("at"))
    dealt = dealt.select("at.*", "doc_id", "text")
    order = Window.partitionBy("run").orderBy("guest", F.desc_nulls_last("doc_id"), F.desc("text"))
    cut = F.floor(F.length("text") / 3).cast("int")
    following = dealt.withColumn("pos", F.row_number().over(order)).withColumn("after", F.lead("text").over(order))
    edited = F.concat(F.expr("left(text, length(text) - int(floor(length(text) / 3)))"), F.substring(F.coalesce("after", F.lit("")), F.lit(1), cut))
    return following.select("run", "pos", "guest", "doc_id", "text", F.when(F.col("guest") == 0, edited).alias("edited"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fp, edited_fp, next_fp: one row per document, see with_next. One shuffle of the texts."""
    follow = with_next(docs)
    both = follow.select("run", "pos", "guest", "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("t")), F.struct(F.lit(1).alias("side"), F.col("edited").alias("t")))).alias("x"))
    both = both.where("x.t is not null").select("run", "pos", "guest", "doc_id", "n_chars", "edited_sha256", "x.side", "x.t")
    keys = ["run", "pos", "guest", "doc_id", "n_chars", "edited_sha256"]
    votes = simhash(both, [*keys, "side"], "t")
    pair = votes.groupBy(*keys).agg(F.max(F.when(F.col("side") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("side") == 1, F.col("fp"))).alias("edited_fp"))
    order = Window.partitionBy("run").orderBy("pos")
    return pair.withColumn("next_fp", F.lead("fp").over(order)).where("guest = 0").select("doc_id", "n_chars", "edited_sha256", "fp", "edited_fp", "next_fp")


def _masks() -> list[int]:
    """One mask per choice of the blocks that stay equal."""
    edges = [64 * k // BLOCKS for k in range(BLOCKS + 1)]
    block = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:], strict=False)]
    return [sum(block[k] for k in chosen) for chosen in combinations(range(BLOCKS), BLOCKS - RADIUS)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def within_radius(queries: DataFrame, base: DataFrame) -> DataFrame:
    """q and base's columns, for distinct fingerprints q of queries and fp of base at most RADIUS bits apart, exactly once each.

    Every choice of BLOCKS - RADIUS blocks makes a table keyed by those blocks' bits, about half of the fingerprint. A pair
    may meet in several tables and is taken in the first.
    """
    masks = _masks()
    table = F.posexplode(F.array(*[F.lit(_signed(m)) for m in masks]))

    def keyed(rows: DataFrame, name: str) -> DataFrame:
        own = rows.withColumnRenamed("fp", name)
        return own.select(*own.columns, table.alias("t", "m")).withColumn("k", F.col(name).bitwiseAND(F.col("m"))).drop("m")

    left, right = keyed(queries.select("fp"), "q").alias("l"), keyed(base, "fp").alias("r")
    apart = F.col("q").bitwiseXOR(F.col("fp"))
    first = F.coalesce(*[F.when(apart.bitwiseAND(F.lit(_signed(m))) == 0, F.lit(k)) for k, m in enumerate(masks)])
    on = (F.col("l.t") == F.col("r.t")) & (F.col("l.k") == F.col("r.k")) & (F.bit_count(apart) <= RADIUS) & (F.col("l.t") == first)
    return left.join(right.hint("merge"), on).select("q", *base.columns)


def document_fingerprints(docs: DataFrame, every: int = 20) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_near.

    n_near, for documents whose id is divisible by `every`, is the number of other documents whose fingerprint is at most
    RADIUS bits away; it is null elsewhere. An empty table gives no rows; a null id gives a row with a null id.
    """
    rows = materialize(edited_fingerprints(docs), "edited")
    base = materialize(rows.groupBy("fp").agg(F.count("*").alias("n")), "base")
    queries = materialize(rows.where(F.col("doc_id") % every == 0).select("fp").distinct(), "queries")
    counted = materialize(within_radius(queries, base).groupBy(F.col("q").alias("fp")).agg((F.sum("n") - 1).alias("n_near")), "counted")
    out = rows.join(counted.hint("merge"), "fp", "left")
    return out.select("doc_id", "n_chars", "edited_sha256", as_hex(F.col("fp")).alias("fingerprint"), as_hex(F.col("edited_fp")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"), F.when(F.col("doc_id") % every == 0, F.col("n_near")).alias("n_near"))
