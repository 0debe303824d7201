"""Connected components of a table of links, without bringing links to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import remove, written


def connected(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """id, label of every end of a link (a, b): the smallest id that can be reached from it.

    Each round takes the least label of the neighbours and then the label's own label, so chains halve.
    A round is written to the shared folder, and the one before is removed; the labels change in a number of rounds that
    grows with the logarithm of the longest chain. After `rounds`, ids with one label are connected, though others may be
    too. Self links and repeated links do no harm; no links give no rows.
    """
    both = written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "id"))
    done = 0
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("label").alias("near"))
        first = labels.join(near, labels["id"] == near["a"]).select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        over = labels.select(F.col("id").alias("label"), F.col("label").alias("jump"))
        rows = written(first.join(over, "label").select("id", "old", F.least("label", "jump").alias("label")))
        done += 1
        if done == rounds or rows.where("old <> label").isEmpty():
            remove(both)
            return rows.select("id", "label")
        remove(labels)
        labels = rows
