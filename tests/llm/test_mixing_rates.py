import math

from pyspark.sql import functions as F

from tidelog.llm import mixing


def rates(df, **options):
    return {r.mix: r.rate for r in mixing.repetition_rates(df, **options).collect()}


def mixture(spark, sizes):
    sources = F.explode(F.flatten(F.array(*[F.array_repeat(F.lit(s), n) for s, n in sizes.items()])))
    return spark.range(1).select(sources.alias("source")).withColumn("doc_id", F.monotonically_increasing_id())


def test_a_rare_source_gets_its_weight(spark):
    df = mixture(spark, {"big": 3000, "rare": 3})
    rate = rates(df)["rare"]
    assert abs(rate - math.sqrt(3) * 3003 / (math.sqrt(3000) + math.sqrt(3)) / 3) < 0.01 and rate > 8
    mixed = mixing.poisson_mix(df, weights={"big": 1.0, "rare": 1.0}, size=6000).groupBy("source").count().collect()
    assert all(abs(r["count"] - 3000) < 6 * math.sqrt(3000) for r in mixed) and len(mixed) == 2


def test_a_small_rate_does_not_vanish(spark):
    df = mixture(spark, {"big": 20_000, "other": 10})
    got = rates(df, weights={"big": 1.0, "other": 1.0}, size=8)
    assert got == {"big": 0.0002, "other": 0.4}
    assert rates(df, weights={"big": 1.0}, size=8) == {"big": 0.0004, "other": 0.0}


def test_tables_of_large_means():
    for mean in (39.2, 999.0, 1001.0, 20_000.0):
        start, steps = mixing.poisson_start(mean), mixing.poisson_steps(mean)
        log = [k * math.log(mean) - mean - math.lgamma(k + 1) for k in range(start, start + len(steps))]
        total, worst = 0.0, 0.0
        for s, x in zip(steps, log, strict=True):
            total += math.exp(x)
            worst = max(worst, abs(s / 2**52 - total))
        assert worst < 1e-8 and steps[0] < 2**20 and 2**52 - steps[-1] <= 2
