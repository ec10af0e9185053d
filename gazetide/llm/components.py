"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazetide.session import cut_lineage


def connected_components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the smallest node reachable) for every node of the links
    ``a``, ``b``. Each round gives every node the smallest label among its neighbours and
    then the label of that label, so paths shorten by half and more; rounds end when no
    label changes. Labels are checkpointed. A node with very many links is folded map-side
    first, and its side of a join can be split."""
    both = cut_lineage(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct())
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("component")))
    while True:
        nearest = (
            both.join(labels.select(F.col("node").alias("b"), "component"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("component").alias("near"))
        )
        hooked = labels.join(nearest, "node").select(
            "node", F.least("component", "near").alias("next"), F.col("component").alias("was")
        )
        of = labels.select(F.col("node").alias("next"), F.col("component").alias("root"))
        step = cut_lineage(
            hooked.join(of, "next", "left").select(
                "node", F.least("next", F.coalesce("root", "next")).alias("component"), "was"
            )
        )
        labels = step.select("node", "component")
        if step.where("component <> was").isEmpty():
            return labels
