"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from collections.abc import Mapping
from decimal import MAX_EMAX, MIN_EMIN, Decimal, getcontext

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import materialize, small_join

SEED = 17
#: Without given weights, a source's weight is its number of documents to this power, so small sources are repeated more.
SMOOTHING = 0.5
#: Rates are rounded to so many decimals, which makes their tables few and equal in every engine; those outside PLAIN_RATES
#: to so many significant digits, so that none is cut off or vanishes.
RATE_DECIMALS, RATE_DIGITS = 3, 4
PLAIN_RATES = (0.1, 10.0)
#: From this mean a table starts so many standard deviations below it; what lies further down is under 2**-UNIFORM_BITS.
LARGE_MEAN, SPREAD = 1_000, 12
#: Rows with one key are dealt to so many places.
SALTS = 64
#: Bits of the uniform number that a document's hash gives.
UNIFORM_BITS = 52


def poisson_start(rate: float) -> int:
    """The count that the table of a mean starts at: 0 but for large means."""
    return int(rate - SPREAD * rate**0.5) if rate > LARGE_MEAN else 0


def poisson_steps(rate: float) -> list[int]:
    """P(count <= k) for k = poisson_start(rate), ... in units of 2**-UNIFORM_BITS, exactly rounded down, until they are all one."""
    context = getcontext()
    context.prec, context.Emin, context.Emax = 60, MIN_EMIN, MAX_EMAX
    mean, unit = Decimal(str(rate)), Decimal(2) ** UNIFORM_BITS
    k = poisson_start(rate)
    term = (-mean).exp() if not k else (k * mean.ln() - mean - _log_factorial(k)).exp()
    total, out = term, [int(term * unit)]
    while unit - out[-1] > 1:
        k += 1
        term *= mean / k
        total += term
        out.append(int(total * unit))
        if term * unit < Decimal("1e-6") and k > mean:
            break
    return out


def _log_factorial(k: int) -> Decimal:
    """By Stirling's series, whose rest is below 1e-30 for k from 500."""
    n, pi = Decimal(k), Decimal("3.14159265358979323846264338327950288419716939937510582097494")
    series = sum(Decimal(a) / (b * n**e) for a, b, e in ((1, 12, 1), (-1, 360, 3), (1, 1260, 5), (-1, 1680, 7), (1, 1188, 9), (-691, 360360, 11)))
    return n * n.ln() - n + (2 * pi * n).ln() / 2 + series


def rounded_rate(rate: Column) -> Column:
    digits = F.pow(F.lit(10.0), F.lit(RATE_DIGITS - 1) - F.floor(F.log10(rate)))
    plain = (rate >= PLAIN_RATES[0]) & (rate < PLAIN_RATES[1])
    return F.when(rate <= 0, 0.0).when(plain, F.round(rate, RATE_DECIMALS)).otherwise(F.round(rate * digits, 0) / digits)


def uniform(identity: Column, copy_of: Column, seed: int = SEED) -> Column:
    """The leading UNIFORM_BITS bits of the MD5 of seed, a document's identity and a distinguishing text, as a long."""
    key = F.concat_ws(":", F.lit(str(seed)), identity, copy_of)
    return F.conv(F.substring(F.md5(key), 1, UNIFORM_BITS // 4), 16, 10).cast("long")


def repetition_rates(docs: DataFrame, weights: Mapping[str, float] | None = None, size: float | None = None) -> DataFrame:
    """source, n, rate: the mean number of times that a document of each source is repeated.

    A source's share of the mixture is its weight over the sum of weights; the mixture has `size` documents, as many as the
    input by default. Sources without a weight get rate 0 where weights are given. Counted over all documents, with a
    partial sum before the shuffle; the null source counts as the empty one. No rate is capped; rounding moves one by half a
    percent of itself at most, so n * rate tells what each source gets.
    """
    sizes = docs.groupBy(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("mix")).agg(F.count("*").alias("n"))
    sizes = materialize(sizes, "sizes")
    if weights is None:
        weighted = sizes.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(SMOOTHING)))
    else:
        spark = docs.sparkSession
        given = spark.createDataFrame([(k, float(v)) for k, v in weights.items()], "mix string, weight double")
        weighted = sizes.join(given, "mix", "left").fillna(0.0, ["weight"])
    total = weighted.agg(F.sum("n").alias("n"), F.sum(F.round("weight", 6).cast("decimal(38,6)")).cast("double").alias("weight")).first()
    wanted, scale = float(size if size is not None else total["n"] or 0), float(total["weight"] or 1.0) or 1.0
    rate = rounded_rate(F.col("weight") * F.lit(wanted) / F.lit(scale) / F.col("n"))
    return weighted.select("mix", "n", rate.alias("rate"))


def poisson_mix(docs: DataFrame, *, weights: Mapping[str, float] | None = None, size: float | None = None, seed: int = SEED) -> DataFrame:
    """The columns of docs, repeated, with copy (from 0), n_copies and shuffle_key, in a globally random order.

    A document's count is the Poisson quantile, at its source's rate, of a uniform number hashed from seed and doc_id. Each
    copy gets a key hashed from seed, doc_id and copy; copies are dealt to partitions by it and sorted by it there, so a
    third of all rows in one source or one document's many copies spread like any other. Rows that repeat
    or lack an id have the same count and keys, and are dealt out by their place in the input too. docs needs doc_id and
    source; an empty table gives no rows. The quantile tables belong to sources; they are joined by a broadcast if few, else by a
    shuffle of counts that adaptive execution may split.
    """
    names = docs.columns
    rates = repetition_rates(docs, weights, size)
    distinct = [float(r["rate"]) for r in rates.select("rate").distinct().orderBy("rate").collect()]
    tables = docs.sparkSession.createDataFrame([(r, poisson_start(r), poisson_steps(r)) for r in distinct], "rate double, start int, steps array<bigint>")
    rates = materialize(rates.join(F.broadcast(tables), "rate").select(F.col("mix").alias("__mix"), "start", "steps"), "rates")
    own = docs.select(F.struct(*names).alias("__doc"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("__mix"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("__id"), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).alias("__salt"))
    drawn = small_join(own, rates, "__mix").withColumn("__u", uniform(F.col("__id"), F.lit("count"), seed))
    count = F.coalesce(F.col("start") + F.size(F.filter("steps", lambda x: x <= F.col("__u"))), F.lit(0))
    counted = drawn.select("__doc", "__id", "__salt", count.alias("__n")).where("__n > 0")
    each = counted.select("__doc", "__id", "__salt", "__n", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)).alias("__k"))
    keyed = each.withColumn("__key", uniform(F.col("__id"), F.concat(F.lit("copy:"), F.col("__k").cast("string")), seed))
    dealt = keyed.repartition("__key", "__salt").sortWithinPartitions("__key")
    used = set(names)
    extra = [("copy", "__k"), ("n_copies", "__n"), ("shuffle_key", "__key")]
    return dealt.select(*[F.col("__doc")[c].alias(c) for c in names], *[F.col(c).alias(n if n not in used else f"mix_{n}") for n, c in extra])
