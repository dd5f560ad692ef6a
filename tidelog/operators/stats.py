"""Statistics aggregates over a log or a state. All have a partial step before their shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators.reads import expired

VISIBLE_OPS = ("mutation", "commit_sync_write", "system_event")


def by_state(docs: DataFrame, state: Column) -> DataFrame:
    """Items, tombstones and bytes per partition state."""
    return docs.groupBy(state.alias("vb_state")).agg(F.count_if(~F.col("deleted")).alias("items"), F.count_if("deleted").alias("tombstones"), F.sum(F.octet_length("value")).alias("bytes"), F.max("seqno").alias("high_seqno"))


def datatype(value: Column) -> Column:
    """Bit 0: the body is JSON."""
    return F.when(F.try_parse_json(value).isNotNull(), 1).otherwise(0).cast("long")


def datatype_counts(docs: DataFrame) -> DataFrame:
    return docs.groupBy(datatype(F.col("value")).alias("datatype")).agg(F.count("*").alias("docs"))


def collection_stats(state: DataFrame) -> DataFrame:
    return state.groupBy("cid").agg(F.count_if(~F.col("deleted")).alias("item_count"), F.sum(F.octet_length("value")).alias("data_size"), F.max("seqno").alias("high_seqno"))


def scope_rollup(docs: DataFrame, measure: Column) -> DataFrame:
    """Per collection, per scope and in all; totals have null labels."""
    return docs.rollup("scope", "collection").agg(F.count("*").alias("item_count"), F.sum(measure).alias("total"))


def vb_seqnos(log: DataFrame) -> DataFrame:
    visible = F.col("op").isin(*VISIBLE_OPS)
    return log.groupBy("vb").agg(F.max("seqno").alias("high_seqno"), F.max(F.when(visible, F.col("seqno"))).alias("max_visible"), F.min("seqno").alias("low_seqno"), F.max("cas").alias("max_cas"))


def collection_details(log: DataFrame) -> DataFrame:
    return log.groupBy("vb", "cid").agg(F.min("seqno").alias("start_seqno"), F.max("seqno").alias("high_seqno"), F.count("*").alias("items"), F.sum(F.octet_length("value")).alias("disk_size"))


def octave_bins(value: Column, parts: int = 4) -> Column:
    """Lower edge of the value's bin: every power of two is cut into `parts` equal bins; values below one share a bin."""
    power = F.floor(F.log2(F.greatest(value, F.lit(1.0))))
    base = F.pow(F.lit(2.0), power)
    return F.when(value < 1, 0.0).otherwise(base + F.floor((value - base) / base * parts) * base / parts)


def histogram(rows: DataFrame, bin_of: Column) -> DataFrame:
    """bin, n and the share of rows up to each bin; the running sum is over bins, whose number is bounded."""
    bins = rows.groupBy(bin_of.alias("bin")).agg(F.count("*").alias("n"))
    return bins.select("bin", "n", F.sum("n").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)).alias("cumulative"))


def percentile_bin(rows: DataFrame, bin_of: Column, percents: list[float], *, rounded: bool) -> DataFrame:
    """The first bin at which the running count reaches each percentage of all rows, at least one row.

    Array histograms round the wanted count, eviction thresholds truncate it; `rounded` picks.
    """
    bins = histogram(rows, bin_of)
    total = bins.agg(F.max("cumulative").alias("total"))
    wanted = rows.sparkSession.createDataFrame([(float(p),) for p in percents], "percent double")
    raw = F.col("percent") / 100 * F.col("total")
    need = F.greatest(F.lit(1), F.floor(raw + 0.5) if rounded else F.floor(raw))
    joined = bins.join(F.broadcast(total), F.lit(True)).join(F.broadcast(wanted), F.col("cumulative") >= need)
    return joined.groupBy("percent").agg(F.min("bin").alias("bin"))


def interval_rates(log: DataFrame, seconds: int) -> DataFrame:
    """Operations and total amount per fixed interval of arrival, lookups and mutations kept apart."""
    start = (F.floor(F.col("us") / (seconds * 1_000_000)) * seconds).cast("long")
    lookup = F.col("event_type").isin("click", "view")
    return log.groupBy(start.alias("start_s")).agg(F.count_if(lookup).alias("lookups"), F.count_if(~lookup).alias("mutations"))


def top_keys(accesses: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The n most accessed keys; ties by key. Counts are partial before the shuffle and the order is a bounded top-k."""
    return accesses.groupBy(*keys).agg(F.count("*").alias("accesses")).orderBy(F.desc("accesses"), *keys).limit(n)


def capped_keys(accesses: DataFrame, key: str, arrival: str, limit: int) -> DataFrame:
    """collected and omitted accesses when only the first `limit` distinct keys are tracked."""
    per_key = accesses.groupBy(key).agg(F.min(arrival).alias("first"), F.count("*").alias("n"))
    cut = per_key.orderBy("first").limit(limit).agg(F.max("first").alias("cut"))
    return per_key.join(F.broadcast(cut), F.lit(True)).agg(F.sum(F.when(F.col("first") <= F.col("cut"), F.col("n")).otherwise(0)).alias("collected"), F.sum(F.when(F.col("first") > F.col("cut"), F.col("n")).otherwise(0)).alias("omitted"))


def throttle(rows: DataFrame, seconds: int, limit: int) -> DataFrame:
    """Write and read units per interval, and what passes the limit. A unit of writing is 1024 bytes begun, of reading 4096."""
    start = (F.floor(F.col("us") / (seconds * 1_000_000)) * seconds).cast("long")
    units = rows.groupBy(start.alias("start_s")).agg(F.sum(F.ceil(F.col("bytes") / 1024)).cast("long").alias("write_units"), F.sum(F.ceil(F.col("bytes") / 4096)).cast("long").alias("read_units"))
    return units.withColumn("throttled", F.greatest(F.lit(0), F.col("write_units") - limit).cast("long"))


def resident_ratio(docs: DataFrame, resident: Column) -> DataFrame:
    return docs.groupBy("vb").agg(F.round(F.count_if(resident) * 100.0 / F.count("*"), 6).alias("resident_percent"))


def expiry_counts(docs: DataFrame, as_of: int) -> DataFrame:
    return docs.groupBy("cid").agg(F.count_if(F.col("exptime") != 0).alias("with_expiry"), F.count_if(expired(as_of)).alias("expired"))


def connection_totals(connections: DataFrame, separator: str = ":") -> DataFrame:
    """Sums per kind of change-feed connection: what stands before the first separator; names without one count in the total only."""
    sums = [F.count("*").alias("count"), F.sum("items_sent").alias("items_sent"), F.sum("bytes").alias("bytes")]
    kind = F.regexp_extract("name", f"^([^{separator}]*){separator}", 1)
    named = connections.where(F.col("name").contains(separator)).groupBy(kind.alias("kind")).agg(*sums)
    return named.unionByName(connections.agg(*sums).withColumn("kind", F.lit(":total")))


def merged_histograms(parts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One histogram (bin, n) of many, bin by bin."""
    return parts.groupBy(*(keys or []), "bin").agg(F.sum("n").alias("n"))


def timing_bin(nanos: Column) -> Column:
    """The fixed bin of a time: below one microsecond together, tens of microseconds below a millisecond, milliseconds below 50, then half seconds below five, then whole seconds up to ten steps."""
    us, ms = F.floor(nanos / 1_000), F.floor(nanos / 1_000_000)
    half = F.floor(nanos / 500_000_000)
    return F.when(us < 1, "ns").when(us < 1000, F.concat(F.lit("us"), F.lpad((F.floor(us / 10) * 10).cast("string"), 3, "0"))).when(ms < 50, F.concat(F.lit("ms"), F.lpad(ms.cast("string"), 2, "0"))).when(half < 10, F.concat(F.lit("half"), half.cast("string"))).otherwise("wayout")


def expected_counter(n: Column, factor: float, most: int = 255) -> Column:
    """What a counter shows, on average to the nearest step below, after n increments that count with chance 1 / (c * c * factor + 1).

    From c it takes c * c * factor + 1 increments to the next step, so c steps take their sum.
    """
    needed = lambda c: (c - 1) * c * (2 * c - 1) / 6 * factor + c
    steps = F.sequence(F.lit(1), F.lit(most))
    return F.size(F.filter(steps, lambda c: needed(c) <= n)).cast("long")


def merged_compaction(configs: DataFrame) -> DataFrame:
    """One compaction request per vb of many: switches stay on, bounds take the largest, keys are joined."""
    return configs.groupBy("vb").agg(F.bool_or("drop_deletes").alias("drop_deletes"), F.bool_or("retain_erroneous").alias("retain_erroneous"), F.max("purge_before_ts").alias("purge_before_ts"), F.max("purge_before_seq").alias("purge_before_seq"))
