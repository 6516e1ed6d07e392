"""Connected components of a table of links, by minimum labels and pointer jumping.

Every step is a join and a partially aggregated minimum, written to the shared
folder; nothing but the number of changed labels reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulens.session import written_table


def connected_components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of the links (a, b): the label is the smallest node of its component.

    Links may repeat, point either way or at their own node; no links give no rows.
    """
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    edges = written_table(both.union(both.select("v", "u")).where("u <> v").distinct())
    labels = written_table(edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m"))
                           .select("node", F.least("node", "m").alias("label")))
    while True:
        near = (edges.join(labels.withColumnRenamed("node", "v"), "v")
                .groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near")))
        stepped = (labels.withColumnRenamed("label", "old").join(near, "node")
                   .select("node", "old", F.least("old", "near").alias("to")))
        # pointer jumping: the label of the label
        jump = labels.select(F.col("node").alias("to"), F.col("label").alias("further"))
        out = written_table(stepped.join(jump, "to", "left")
                            .select("node", "old", F.least("to", F.coalesce("further", "to")).alias("label")))
        changed = out.where("old <> label").limit(1).count()
        labels = out.select("node", "label")
        if not changed:
            return labels
