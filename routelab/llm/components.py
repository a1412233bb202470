"""Connected components of an edge table by least labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routelab.llm.common import stable


def components(edges: DataFrame) -> DataFrame:
    """v, label (the least v of its component) for every vertex of edges (a, b), both bigint.

    Each round a vertex takes the least label among itself and its neighbours, then the label of that label, so chains halve. Sums are
    combined before the shuffle and both join sides are tables, so Spark can split a vertex with very many edges. Rounds are written to
    the checkpoint folder; the number of rounds grows with the logarithm of the longest chain.
    """
    both = stable(edges.select("a", "b").union(edges.select("b", "a")).where("a != b").distinct())
    labels = stable(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("label")))
    while True:
        near = both.join(labels.select(F.col("v").alias("b"), "label"), "b").groupBy(F.col("a").alias("v")).agg(F.min("label").alias("near"))
        hop = labels.join(near, "v").select("v", "label", F.least("label", "near").alias("next"))
        jump = hop.join(labels.select(F.col("v").alias("next"), F.col("label").alias("far")), "next")
        new = stable(jump.select("v", F.least("next", "far").alias("label"), (F.least("next", "far") < F.col("label")).alias("moved")))
        labels = new.select("v", "label")
        if new.where("moved").isEmpty():
            return labels
