"""Connected components of an edge table, without collecting links or components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of edges (a, b: long); component is the smallest node reachable.

    Each round gives a node the smallest label among its neighbours and itself, then the label of its label. Both joins
    are of two written tables, so a node with very many links or a label with very many nodes is a skewed join that
    adaptive execution splits; the minimum is taken before the shuffle. Rounds go on until no label changes.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = materialize(both, "links")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    total = _total(labels)
    while total is not None:
        near = both.join(labels.select(F.col("node").alias("b"), "label").hint("merge"), "b").select(F.col("a").alias("node"), "label")
        hooked = materialize(near.union(labels).groupBy("node").agg(F.min("label").alias("label")), "labels")
        up = hooked.select(F.col("node").alias("label"), F.col("label").alias("next"))
        labels = materialize(hooked.join(up.hint("merge"), "label").select("node", F.col("next").alias("label")), "labels")
        before, total = total, _total(labels)
        if before == total:
            break
    return labels.select("node", F.col("label").alias("component"))


def _total(labels: DataFrame):
    """Labels only ever get smaller, so an equal sum means that none changed; None for no nodes."""
    return labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
