"""Connected components of a graph of long node ids, by minimum labels with hooked roots and pointer jumping; all on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): root is the smallest node that can be reached; only nodes with a link appear.

    Each round a label takes the least label near it, hands it to its own label's node too (so whole trees move,
    not only their edge), and jumps to its label's label. Shuffled chains of 1,000 to 100,000 nodes take 9 to 16
    rounds. Labels only fall, so it ends; it goes on until none moves, when neighbours have one label.
    """
    edges = staged(links.select(F.col(a).alias("u"), F.col(b).alias("v")).union(links.select(F.col(b), F.col(a))).where("u <> v").distinct(), "edges")
    labels = staged(edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("root")).withColumnRenamed("u", "node"), "labels")
    moved = True
    while moved:
        seen = edges.join(labels, edges.v == labels.node).groupBy("u").agg(F.min("root").alias("near"))
        low = staged(labels.join(seen, labels.node == seen.u).select("node", F.col("root").alias("old"), F.least("root", "near").alias("root")), "labels")
        hooks = low.where("root < old").groupBy(F.col("old").alias("hooked")).agg(F.min("root").alias("hook"))
        up = low.join(hooks, low.node == hooks.hooked, "left").select(F.col("node").alias("at"), F.least("root", "hook").alias("far"))
        new = staged(low.join(up, low.root == up.at, "left").select("node", "old", F.least("root", "far").alias("root")), "labels")
        moved = new.where("root <> old").limit(1).count()
        discard(labels, low)
        labels, path = new.select("node", "root"), new.staged_path
        labels.staged_path = path
    discard(edges)
    return labels
