"""Synchronous writes: quorums, the commit frontier, timeouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def majority(nodes: Column) -> Column:
    """Of all configured nodes, missing ones included."""
    return F.floor(nodes / 2).cast("long") + 1


def prepare_outcomes(log: DataFrame) -> DataFrame:
    """Each prepare with its completion by (vb, key, prepare_seqno): committed, aborted or pending."""
    prepares = log.where("op = 'pending_sync_write'").select("vb", "cid", "key", "seqno")
    done = log.where("op in ('commit_sync_write', 'abort_sync_write')").select("vb", "key", F.col("prepare_seqno").alias("seqno"), F.col("op").alias("done_op"), F.col("seqno").alias("done_seqno"))
    outcome = F.when(F.col("done_op") == "commit_sync_write", "committed").when(F.col("done_op") == "abort_sync_write", "aborted").otherwise("pending")
    return prepares.join(done, ["vb", "key", "seqno"], "left").select("vb", "cid", "key", F.col("seqno").alias("prepare_seqno"), "done_seqno", outcome.alias("outcome"))


def commit_frontier(acks: DataFrame) -> DataFrame:
    """vb, frontier: the seqno up to which prepares commit, from acks (vb, node, active, seqno).

    A node's acknowledgement is its largest. A prepare commits when a majority of nodes and the active itself have
    reached it, so the frontier is the majority-th largest acknowledgement, capped by the active's.
    """
    per_node = acks.groupBy("vb", "node").agg(F.max("seqno").alias("ack"), F.max("active").alias("active"))
    grouped = per_node.groupBy("vb").agg(F.sort_array(F.collect_list("ack"), asc=False).alias("acks"), F.max(F.when(F.col("active"), F.col("ack"))).alias("own"))
    at = majority(F.size("acks")).cast("int")
    return grouped.select("vb", F.least(F.element_at("acks", at), F.coalesce("own", F.lit(0))).alias("frontier"))


def timed_out(prepares: DataFrame, as_of_ms: int) -> DataFrame:
    """Unresolved prepares whose time ran out: started, plus their timeout, strictly before the instant."""
    return prepares.where((F.col("outcome") == "pending") & (F.col("start_ms") + F.col("timeout_ms") < as_of_ms))


def counters(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("vb").agg(F.count("*").alias("accepted"), F.count_if(F.col("outcome") == "committed").alias("committed"), F.count_if(F.col("outcome") == "aborted").alias("aborted"))


def high_marks(log: DataFrame) -> DataFrame:
    """High prepared and high completed seqno per vb."""
    return log.groupBy("vb").agg(F.max(F.when(F.col("op") == "pending_sync_write", F.col("seqno"))).alias("high_prepared"), F.max(F.when(F.col("op").isin("commit_sync_write", "abort_sync_write"), F.col("prepare_seqno"))).alias("high_completed"))


def outstanding(log: DataFrame) -> DataFrame:
    """Prepares without a completion, to load after a restart."""
    done = log.where("op in ('commit_sync_write', 'abort_sync_write')").select("vb", "key", F.col("prepare_seqno").alias("seqno"))
    return log.where("op = 'pending_sync_write'").join(done, ["vb", "key", "seqno"], "left_anti")


def possible(chains: DataFrame) -> DataFrame:
    """Whether each topology (vb, chain, nodes: array with nulls for missing ones) can meet a majority in every chain."""
    present = F.size(F.filter("nodes", lambda x: x.isNotNull()))
    return chains.groupBy("vb").agg(F.bool_and(present >= majority(F.size("nodes"))).alias("possible"))
