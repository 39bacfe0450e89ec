"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stash


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of links (u, v), both long and not null; root is the smallest node that can be reached.

    Each round takes the smallest label among the neighbours and then follows the
    label's own label (pointer jumping), so long chains halve. Only minima are
    aggregated, never a list of neighbours, so a node with very many links is
    combined before the shuffle. Every round is written to the shared folder.
    No links give no rows.
    """
    spark = links.sparkSession
    stash = Stash(spark)
    ways = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    both = links.where("u <> v").select(F.explode(ways).alias("way")).select("way.u", "way.v").distinct()
    both = stash.keep(both, "links")
    labels = stash.keep(both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("node"), F.min("v")).alias("root")), "labels")
    for _ in range(rounds):
        near = (
            both.join(labels, both.v == labels.node)
            .groupBy(F.col("u").alias("node"))
            .agg(F.min("root").alias("near"))
        )
        hooked = labels.join(near, "node").select("node", "root", F.least("root", "near").alias("to"))
        # The old root hears of the smaller label too, so a whole tree moves at once.
        told = hooked.where("to < root").groupBy(F.col("root").alias("node")).agg(F.min("to").alias("told"))
        step = stash.keep(
            hooked.join(told, "node", "left").select("node", "root", F.least("to", F.coalesce("told", "to")).alias("to")), "step"
        )
        up = step.select(F.col("node").alias("parent"), F.col("to").alias("above"))
        jumped = step.join(up, step["to"] == up["parent"], "left").select(
            "node", F.least("to", F.coalesce("above", "to")).alias("root"), (F.least("to", F.coalesce("above", "to")) < F.col("root")).alias("moved")
        )
        labels = stash.keep(jumped, "labels")
        stash.drop("step")
        stash.drop("labels", but=1)
        if labels.where("moved").isEmpty():
            return labels.select("node", "root")
        labels = labels.select("node", "root")
    raise RuntimeError(f"labels still move after {rounds} rounds")
