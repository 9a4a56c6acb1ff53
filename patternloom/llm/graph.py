"""Connected components of a link table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patternloom.session import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every end of the links (a, b): the smallest id that can be reached.

    Every round takes the smallest label among the neighbours and then the label of that label, so
    the distance covered doubles. Minima are combined before they are shuffled; the tables of a round are
    written to the shared folder.
    """
    ends = cut_lineage(links.select(F.col("a").alias("id"), F.col("b").alias("other")).union(links.select("b", "a")).distinct())
    labels = cut_lineage(ends.groupBy("id").agg(F.least(F.col("id"), F.min("other")).alias("component")))
    while True:
        other = labels.select(F.col("id").alias("other"), F.col("component").alias("_theirs"))
        near = ends.join(other, "other").groupBy("id").agg(F.min("_theirs").alias("_near"))
        step = labels.join(near, "id").select("id", F.col("component").alias("_was"), F.least("component", "_near").alias("_label"))
        jump = labels.select(F.col("id").alias("_label"), F.col("component").alias("_jump"))
        new = cut_lineage(step.join(jump, "_label").select("id", "_was", F.least("_label", "_jump").alias("component")))
        labels = new.select("id", "component")
        if new.where("component <> _was").isEmpty():
            return labels
