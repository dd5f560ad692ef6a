"""What the operators of this package share: the shared folder, written tables, and joins that survive hot keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of at most this many rows may be broadcast; its size is always counted first.
BROADCAST_ROWS = 20_000

_own_folder: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, in local mode only, one of our own where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local") or spark.conf.get("spark.master").startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir is unset: executors of a cluster need a folder that they share")
    if not _own_folder:
        _own_folder.append("file://" + tempfile.mkdtemp(prefix="tidelog-"))
    return _own_folder[0]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: cuts the lineage, and a lost executor costs nothing that was written."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_join(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "left", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Joins with a materialised right side, which is broadcast only if a count shows at most `limit` rows.

    Beyond that both sides are shuffled on the key, directly below the join, so that adaptive execution can split a hot key.
    """
    if right.limit(limit + 1).count() <= limit:
        return left.join(F.broadcast(right), on, how)
    return left.join(right.hint("merge"), on, how)
