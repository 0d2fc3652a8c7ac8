"""Connected components of a table of links, by contraction: every node hooks onto its smallest smaller neighbour, pointers are
followed twice, links are renamed to their ends' new names, and links inside a node vanish. Local minima are no neighbours of each
other, so few rounds remain. All tables stay distributed and are written to the shared folder each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def components(links: DataFrame) -> DataFrame:
    """node, root (smallest node of its component) for all ends of links (a, b)."""
    e = staged(links.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).filter("u < v").distinct(), "links")
    nodes = staged(e.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("root", F.col("node")), "nodes")
    while not e.isEmpty():
        up = staged(e.groupBy(F.col("v").alias("n")).agg(F.min("u").alias("p")), "parents")
        jumped = up
        for _ in range(2):
            above = jumped.select(F.col("n").alias("_n"), F.col("p").alias("_p"))
            jumped = jumped.join(above, F.col("p") == F.col("_n"), "left").select("n", F.coalesce("_p", "p").alias("p"))
        up = staged(jumped, "parents")
        nodes = staged(nodes.join(up, F.col("root") == F.col("n"), "left").select("node", F.coalesce("p", "root").alias("root")), "nodes")
        renamed = e
        for end in ("u", "v"):
            renamed = renamed.join(up, F.col(end) == F.col("n"), "left").withColumn(end, F.coalesce("p", end)).drop("n", "p")
        e = staged(renamed.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u < v").distinct(), "links")
    return nodes
