"""Connected components of a link table, without collecting it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volumetra.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v) -> (node, root): root is the smallest node of each component.

    Each round, a node takes the smallest label among its neighbours', and then its label's label; minima are
    combined before the shuffle, so a node with very many links costs no more than others. Rounds grow with the
    logarithm of a component's width.
    """
    both = cut(edges.select("u", "v").union(edges.select("v", "u")).where("u != v").distinct())
    labels = cut(both.groupBy(F.col("u").alias("node")).agg(F.least("node", F.min("v")).alias("root")))
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "root"), "v").groupBy(F.col("u").alias("node")).agg(F.min("root").alias("near"))
        lower = labels.join(near, "node").select("node", "root", F.least("root", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("root").alias("far"))
        after = cut(lower.join(jump, "low", "left").select("node", F.least("low", F.coalesce("far", "low")).alias("root"), F.col("root").alias("was")))
        labels = after.select("node", "root")
        if after.where("root != was").isEmpty():
            return labels
