"""Connected components of a link table, as Spark joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import Tables


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``links``; the component is its smallest node.

    Rounds of taking the smallest label of all neighbours, then the label's own label, until
    nothing changes. Each round is written, so a lost executor costs one round. Labels combine
    map-side, so a node with very many links gathers nothing. Null ends are no links.
    """
    both = links.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("_from"), F.col(b).alias("_to")).where("_from <> _to")
    links_, rounds = Tables(links.sparkSession), [Tables(links.sparkSession)]
    both = links_.written(both.union(both.select("_to", "_from")).distinct(), "links")
    labels = rounds[0].written(both.groupBy("_from").agg(F.min("_to").alias("_to")).select(
        F.col("_from").alias("node"), F.least("_from", "_to").alias("component")), "labels")
    while True:
        near = (both.join(labels.select(F.col("node").alias("_to"), "component"), "_to")
                .groupBy("_from").agg(F.min("component").alias("_near")))
        lower = labels.join(near, labels["node"] == near["_from"]).select("node", F.least("component", "_near").alias("_label"), F.col("component").alias("_old"))
        jump = labels.select(F.col("node").alias("_at"), F.col("component").alias("_further"))
        rounds.append(Tables(links.sparkSession))
        moved = rounds[-1].written(lower.join(jump, lower["_label"] == jump["_at"], "left").select(
            "node", F.least("_label", F.coalesce("_further", "_label")).alias("component"), "_old"), "labels")
        labels = moved.select("node", "component")
        rounds.pop(0).drop()
        if moved.where("component <> _old").isEmpty():
            links_.drop()
            return labels
