"""Contiguous row numbers in partition order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patternloom.session import cut_lineage


def with_row_index(df: DataFrame, offset: int = 0, name: str = "index") -> DataFrame:
    """Add ``name`` = offset, offset + 1, ... in partition order.

    Rows are numbered inside their partition without moving and written to the shared
    folder, so that ``df`` is evaluated once and may be of any kind; then one count per
    partition is gathered and turned into starting points.
    """
    local = cut_lineage(df.withColumn("_id", F.monotonically_increasing_id()))
    local = local.withColumns(
        {"_part": F.shiftright("_id", 33), "_row": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))}
    ).drop("_id")
    counts = local.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition of the input, not per row of it.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    indexed = local.join(F.broadcast(starts), "_part")
    return indexed.select((F.col("_start") + F.col("_row") + F.lit(offset)).alias(name), *df.columns)
