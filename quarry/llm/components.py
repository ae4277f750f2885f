"""Connected components of an edge table, by label passing with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import HOT_ROWS, join_common


def connected_components(edges: DataFrame) -> DataFrame:
    """(v, label) for every vertex of edges (a, b): label is the smallest vertex of its component. Each round takes the
    smallest label among a vertex and its neighbours, then that label's own label; it ends when no label changes, which
    comes to pass as labels only fall. Edges of hubs and vertices of common labels meet their labels by broadcast. The
    driver sees only numbers of changes. Lineage is cut by checkpoint() each round."""
    both = edges.select("a", "b").where("a <> b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b")).distinct()
    both = both.checkpoint()
    labels = both.groupBy(F.col("a").alias("v")).agg(F.least(F.col("a"), F.min("b")).alias("label"), F.count("*").alias("n")).checkpoint()
    total, size = both.count(), labels.count()
    changed = size
    while changed:
        near = join_common(both, labels.withColumnRenamed("v", "b"), "b", total=total).groupBy(F.col("a").alias("v")).agg(F.min("label").alias("near"))
        step = labels.join(near, "v").select("v", "n", F.least("label", "near").alias("label"), F.col("label").alias("was")).checkpoint()
        jump = labels.select(F.col("v").alias("label"), F.col("label").alias("further"))
        if size > HOT_ROWS:
            jump = jump.join(step.groupBy("label").agg(F.count("*").alias("members")), "label")
        else:
            jump = jump.withColumn("members", F.lit(1))
        step = join_common(step, jump, "label", "members", size).select("v", "n", F.least("label", "further").alias("label"), "was").checkpoint()
        changed = step.where("label <> was").count()
        labels = step.select("v", "label", "n")
    return labels.select("v", "label")
