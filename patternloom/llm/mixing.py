"""Mixing sources to target weights: capped water-filling, then whole and fractional repetitions.

The sources share a number of words by weight. A source that would get more than its cap is clamped to
it, and what it cannot take is shared again by weight among the rest, until none is above. A document is
repeated as often as its source's target holds the source; of the fraction that is left, documents are
taken in a seeded order until their words reach it, in buckets of a source of bounded size. Text is
read once and never moved; all steps are DataFrame expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patternloom.llm.spread import numbered
from patternloom.session import cut_lineage

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2.0
BUCKET = 10_000  # documents that are put in order together, about


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """Add ``rank`` from 0 by code point, null last, through one count per partition of the sorted table."""
    order = [F.col("source").isNull(), F.col("source")]
    sorted_ = cut_lineage(
        sizes.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    )
    part = F.shiftright("_at", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    counts = sorted_.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    ranked = sorted_.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return ranked.withColumn("rank", F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop(
        "_at", "_part", "_start"
    )


def water_fill(sources: DataFrame, total: float) -> DataFrame:
    """Add ``target`` to a table with ``weight`` and ``cap``; the targets add up to ``total`` if the caps allow it.

    Every round fixes the sources whose share of what is left exceeds their cap; only two sums come back.
    """
    level = 0.0
    while True:
        capped = F.col("weight") * F.lit(level) >= F.col("cap")
        left, weight = sources.agg(
            F.lit(float(total)) - F.coalesce(F.sum(F.when(capped, F.col("cap"))), F.lit(0.0)),
            F.sum(F.when(~capped, F.col("weight"))),
        ).first()
        if not weight or left / weight <= level * (1 + 1e-15):
            break
        level = left / weight
    return sources.withColumn("target", F.least(F.col("weight") * F.lit(level), F.col("cap")))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    cap: float = CAP,
    seed: str = "mix",
    bucket: int = BUCKET,
) -> DataFrame:
    """``docs`` with size, source_size, target, whole, part and taken for every row.

    ``size`` counts words; sources in code-point order (null is a source, the last) have the ``weights``
    in turn, share ``share`` times all words and stop at ``cap`` times their own. The mix takes a document
    ``whole`` times and ``part`` words of it once more, ``taken`` words in all; the parts of a source add up
    to what its target leaves after whole repetitions, but for rounding in each bucket. Null and empty texts have size 0
    and are never taken. The order is a hash of seed and id, so reruns and other partitionings agree;
    rows that repeat an id, or a text without id, are in one place of the order and share what is left there. Input columns named like
    an output are replaced. A table without rows gives none.
    """
    out = ("size", "source_size", "target", "whole", "part", "taken")
    # Rows without id take their places by their text.
    name = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit(":"), F.xxhash64(F.col(text_col)).cast("string")))
    key = F.md5(F.concat_ws(":", F.lit(seed), name).cast("binary"))
    sized, fields, names = numbered(docs, out, size=word_count(F.col(text_col)), _mix_key=key, _mix_source=F.col(source_col))
    columns = [f.name for f in fields]
    slim = cut_lineage(sized.select("_mix_source", "size", "_mix_key"))
    sizes = slim.groupBy(F.col("_mix_source").alias("source")).agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_docs"))
    place = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights)).cast("int"))
    ranked = cut_lineage(
        ranked_sources(sizes).select(
            "source", "source_size", "_docs", place.alias("weight"), (F.col("source_size") * F.lit(float(cap))).alias("cap")
        )
    )
    total = (ranked.agg(F.sum("source_size")).first()[0] or 0) * share
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = water_fill(ranked, total).select(
        F.col("source").alias("_source"), "source_size", "target", F.floor(rate).alias("whole"),
        (rate - F.floor(rate)).alias("_rest"), F.ceil(F.col("_docs") / F.lit(bucket)).alias("_buckets"),
    )
    targets = cut_lineage(targets)

    def placed(rows: DataFrame) -> DataFrame:
        number = F.conv(F.substring("_mix_key", 1, 8), 16, 10).cast("long")
        return rows.join(targets, F.col("_mix_source").eqNullSafe(F.col("_source"))).withColumn("_mix_bucket", number % F.col("_buckets"))

    # In each bucket: the key up to which documents are taken once more, and how much of the one there.
    in_bucket = Window.partitionBy("_mix_source", "_mix_bucket")
    ordered = in_bucket.orderBy("_mix_key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    keys = placed(slim).groupBy("_mix_source", "_mix_bucket", "_mix_key", "_rest").agg(F.sum("size").alias("_size"), F.count(F.lit(1)).alias("_rows"))
    keys = keys.withColumns({"_upto": F.sum("_size").over(ordered), "_all": F.sum("_size").over(in_bucket)})
    goal = F.floor(F.col("_all") * F.col("_rest") + 0.5)
    cuts = keys.where((F.col("_upto") >= goal) & (F.col("_upto") - F.col("_size") < goal)).select(
        F.col("_mix_source").alias("_cut_source"), F.col("_mix_bucket").alias("_cut_bucket"), F.col("_mix_key").alias("_cut"),
        F.floor((goal - F.col("_upto") + F.col("_size")) / F.col("_rows")).alias("_left"),
    )
    cuts = cut_lineage(cuts)
    same = F.col("_mix_source").eqNullSafe(F.col("_cut_source")) & (F.col("_mix_bucket") == F.col("_cut_bucket"))
    part = (
        F.when(F.col("_cut").isNull() | (F.col("_mix_key") > F.col("_cut")), F.lit(0))
        .when(F.col("_mix_key") < F.col("_cut"), F.col("size"))
        .otherwise(F.least("size", "_left"))
    )
    mixed = placed(sized).join(cuts, same, "left").withColumn("part", part.cast("long"))
    mixed = mixed.withColumn("taken", F.col("whole") * F.col("size") + F.col("part"))
    return mixed.select(*columns, *out).toDF(*names, *out)
