"""Connected components of a link table, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def _compressed(parent: DataFrame) -> DataFrame:
    """Follows parents to their roots; each pass doubles the distance."""
    while True:
        up = parent.select(F.col("node").alias("root"), F.col("root").alias("above"))
        parent = checkpoint(parent.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"), (F.coalesce("above", "root") != F.col("root")).alias("moved")))
        if parent.filter("moved").isEmpty():
            return parent.select("node", "root")
        parent = parent.select("node", "root")


def connected(links: DataFrame) -> DataFrame:
    """links: a, b (long). Returns node, root: the smallest node reachable, for each node that has a link.

    Each round hangs every node under its smallest neighbour, follows those parents to their
    roots and contracts the links; the number of nodes at least halves. A node with very many
    links is only ever aggregated with partial sums or joined on as a splittable key.
    """
    links = checkpoint(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    nodes = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    label = nodes.select("node", F.col("node").alias("root"))
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root"))
        parent = _compressed(parent)
        to = parent.select(F.col("node").alias("root"), F.col("root").alias("above"))
        label = checkpoint(label.join(to, "root", "left").select("node", F.coalesce("above", "root").alias("root")))
        for end in ("a", "b"):
            links = links.join(parent.select(F.col("node").alias(end), F.col("root").alias("_r")), end).drop(end).withColumnRenamed("_r", end)
        links = checkpoint(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return label
