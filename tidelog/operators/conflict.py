"""Which of two versions of a document wins, and hybrid clocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields in the order they are compared, for sets and for deletes.
FIELDS = {"lww": ["cas", "rev", "exptime", "flags"], "rev": ["rev", "cas", "exptime", "flags"]}


def merge_sites(rows: DataFrame, strategy: str, keys: list[str], tie: list[str]) -> DataFrame:
    """The winning version per key of rows from any number of sites: the largest tuple of the strategy's fields.

    Structs compare field by field, so the winner is one max_by with a partial step before the shuffle.
    """
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*FIELDS[strategy], *tie)).alias("row")).select(*keys, "row.*")


def outcome(strategy: str, *, incoming: str = "i", existing: str = "e", delete: bool = False, attributes: bool = True) -> Column:
    """accept, reject_behind or reject_identical for a pair of aliased rows; a missing existing row always accepts."""
    fields = FIELDS[strategy][: 2 if delete else 4]
    mine = F.struct(*[F.col(f"{incoming}.{f}").alias(f) for f in fields])
    theirs = F.struct(*[F.col(f"{existing}.{f}").alias(f) for f in fields])
    state = F.when(F.col(f"{existing}.{fields[0]}").isNull(), "accept").when(mine > theirs, "accept").when(mine < theirs, "reject_behind")
    if attributes and not delete:
        state = state.when(F.col(f"{incoming}.has_xattr") & ~F.col(f"{existing}.has_xattr"), "accept")
    return state.otherwise("reject_identical")


def drift(rows: DataFrame, ahead_us: int, behind_us: int) -> DataFrame:
    """Per vb: total and number of differences between a remote clock and the local one, and how many pass the limits."""
    off = (F.col("remote_cas") - F.col("local_cas")) / 1000
    return rows.groupBy("vb").agg(F.floor(F.sum(F.abs(F.col("remote_cas") - F.col("local_cas"))) / 1000).cast("long").alias("drift_us"), F.count("*").alias("updates"), F.count_if(off > ahead_us).alias("ahead"), F.count_if(off < -behind_us).alias("behind"))


def next_clock(previous: int, now_ns: int) -> int:
    """The next hybrid clock value: the masked physical time if it is newer, else one logical step."""
    masked = now_ns & ~0xFFFF
    return masked if masked > previous else previous + 1


def assign_clocks(arrivals: DataFrame) -> DataFrame:
    """vb, arrival, cas for arrivals (vb, arrival, now_ns) in order of arrival.

    The fold next_clock has a closed form: the value is the largest, over arrivals so far, of a masked time plus the steps
    since, so a running maximum gives it without a loop.
    """
    from pyspark.sql import Window

    order = Window.partitionBy("vb").orderBy("arrival")
    n = F.row_number().over(order).cast("long")
    own = arrivals.withColumn("n", n).withColumn("lead", F.col("now_ns").bitwiseAND(F.lit(-65536)) - F.col("n"))
    return own.select("vb", "arrival", (F.max("lead").over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.col("n")).alias("cas"))
