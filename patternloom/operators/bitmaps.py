"""Rule operators on feature bitmaps, for tables with very many attributes.

Everything is grouped by bucket (32768 rows), the unit the bitmaps are partitioned
by; only counts and rule ids leave a bucket.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patternloom.model import TableModel
from patternloom.operators.coverage import coverage_bitmaps
from patternloom.operators.encode import encode_items, feature_lut
from patternloom.operators.selection import keep_winners, token_order

ATTRIBUTE_CHUNK = 80
BUCKET_ROWS = 32768


def wide_lut(df: DataFrame, model: TableModel, rid: str, n_partitions: int | None = None) -> DataFrame:
    """Feature bitmaps built in slices of the attributes.

    Each slice scans only its own columns, so no projection or aggregate grows with the
    width of the table.
    """
    parts = []
    attrs = model.attributes
    for start in range(0, len(attrs), ATTRIBUTE_CHUNK):
        chunk = attrs[start : start + ATTRIBUTE_CHUNK]
        local = replace(
            model,
            attributes=tuple(replace(a, pos=i) for i, a in enumerate(chunk)),
            classes=model.classes if start == 0 else (),
        )
        lut = feature_lut(encode_items(df, local, keep=[rid]), local, rid)
        shifted = F.when(F.col("var") >= 0, F.col("var") + F.lit(start)).otherwise(F.col("var"))
        parts.append(lut.withColumn("var", shifted))
    if len(parts) == 1:
        return parts[0]
    whole = reduce(lambda a, b: a.unionByName(b), parts)
    return whole.repartition(n_partitions, "bucket") if n_partitions else whole.repartition("bucket")


def class_bitmaps(lut: DataFrame, model: TableModel) -> DataFrame:
    """``bucket, cls, members``."""
    classes = F.array(*[F.lit(c) for c in model.classes])
    return lut.where("var = -1").select("bucket", F.element_at(classes, F.col("val") + 1).alias("cls"), F.col("bits").alias("members"))


def token_competition_bitmap(
    lut: DataFrame, scored: DataFrame, model: TableModel, max_rules: int | None = None
) -> DataFrame:
    """Token competition by running unions: a rule is kept iff its rows add a bit somewhere."""
    ordered = token_order(scored, model)
    bare = ordered.select("rule_id", "cls", "masks", "token_rank")
    cover = coverage_bitmaps(lut, bare, model, max_rules, ("cls", "token_rank")).where("positive is not null")
    line = Window.partitionBy("bucket", "cls").orderBy("token_rank")
    upto = line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tokens = cover.withColumn("_tokens", F.bitmap_count(F.bitmap_or_agg("positive").over(upto)))
    added = tokens.withColumn("_new", F.col("_tokens") - F.coalesce(F.lag("_tokens").over(line), F.lit(0)))
    winners = added.where("_new > 0").select("cls", "token_rank").distinct()
    return keep_winners(ordered, winners).select(*scored.columns)


def cover_bitmap(lut: DataFrame, rules: DataFrame, model: TableModel, max_rules: int | None = None) -> DataFrame:
    """``rule_cls, bucket, covered``: the rows that some rule of a class covers."""
    cover = coverage_bitmaps(lut, rules.select("rule_id", "cls", "masks"), model, max_rules, ("cls",))
    return cover.groupBy(F.col("cls").alias("rule_cls"), "bucket").agg(F.bitmap_or_agg("covered").alias("covered"))


def added_bitmap(before: DataFrame, now: DataFrame) -> DataFrame:
    """``rule_cls, n``: rows of one cover that another one lacks."""
    both = before.withColumn("_old", F.lit(1)).unionByName(now.withColumn("_old", F.lit(0)))
    old = F.coalesce(F.bitmap_count(F.bitmap_or_agg(F.when(F.col("_old") == 1, F.col("covered")))), F.lit(0))
    per_bucket = both.groupBy("rule_cls", "bucket").agg((F.bitmap_count(F.bitmap_or_agg("covered")) - old).alias("n"))
    return per_bucket.groupBy("rule_cls").agg(F.sum("n").alias("n")).where("n > 0")


def newly_covered_bitmap(
    lut: DataFrame, previous: DataFrame, now: DataFrame, model: TableModel, max_rules: int | None = None
) -> DataFrame:
    """``rule_cls, n``: rows a class's rules cover now and did not before."""
    return added_bitmap(*(cover_bitmap(lut, rules, model, max_rules) for rules in (previous, now)))


def covered_rows_bitmap(cover: DataFrame) -> DataFrame:
    """``rule_id, cls, row`` of every set bit of ``rule_id, cls, bucket, covered``, rows numbered as the bitmaps were."""

    def run(batches):
        for batch in batches:
            places = [np.flatnonzero(np.unpackbits(np.frombuffer(b, np.uint8), bitorder="little")) for b in batch.column("covered").to_pylist()]
            sizes = [len(p) for p in places]
            first = (np.array(batch.column("bucket").to_pylist(), np.int64) - 1) * BUCKET_ROWS + 1
            take = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            rows = np.concatenate([p + f for p, f in zip(places, first)]) if places else np.zeros(0, np.int64)
            kept = [batch.column(c).take(take) for c in ("rule_id", "cls")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(rows, pa.int64())], ["rule_id", "cls", "row"])

    wanted = cover.select("rule_id", "cls", "bucket", "covered")
    return wanted.mapInArrow(run, "rule_id bigint, cls string, row bigint")


def _has_bit(bits: str, row: str) -> str:
    """SQL test of bit ``row`` (from 0) of a bitmap."""
    byte = f"cast(conv(hex(substring({bits}, cast({row} / 8 as int) + 1, 1)), 16, 10) as int)"
    return f"(shiftright({byte}, cast({row} % 8 as int)) & 1) = 1"


def first_uncovered_bitmap(
    lut: DataFrame, rules: DataFrame, model: TableModel, classes, max_rules: int | None = None
) -> DataFrame:
    """``cls, bucket, row`` of the first row of each class that no rule of the class covers; a class without one is absent."""
    classes = [classes] if isinstance(classes, str) else list(classes)
    wanted = F.col("cls").isin(classes)
    members = class_bitmaps(lut, model).where(wanted).select("cls", "bucket", F.col("members").alias("bits"), F.lit(1).alias("_m"))
    cover = cover_bitmap(lut, rules.where(wanted), model, max_rules)
    tagged = members.unionByName(cover.select(F.col("rule_cls").alias("cls"), "bucket", F.col("covered").alias("bits"), F.lit(0).alias("_m")))
    per_bucket = tagged.groupBy("cls", "bucket").agg(
        F.bitmap_or_agg(F.when(F.col("_m") == 1, F.col("bits"))).alias("members"),
        F.bitmap_or_agg(F.when(F.col("_m") == 0, F.col("bits"))).alias("covered"),
        F.bitmap_count(F.bitmap_or_agg("bits")).alias("_both"),
    )
    # A bucket has uncovered members iff adding them to the covered rows adds bits.
    open_buckets = per_bucket.where("members is not null and _both > coalesce(bitmap_count(covered), 0)")
    first = open_buckets.groupBy("cls").agg(F.min_by(F.struct("bucket", "members", "covered"), "bucket").alias("_b")).select("cls", "_b.*")
    rows = first.select("*", F.explode(F.sequence(F.lit(0), F.lit(BUCKET_ROWS - 1))).alias("row"))
    missing = f"{_has_bit('members', 'row')} and (covered is null or not ({_has_bit('covered', 'row')}))"
    return rows.where(missing).groupBy("cls", "bucket").agg(F.min("row").alias("row"))


def uncovered_pairs_bitmap(
    lut: DataFrame, rules: DataFrame, model: TableModel, classes, max_rules: int | None = None
) -> DataFrame:
    """``cls, var, val``: features of the first row of each class its rules leave uncovered, all classes at once."""
    at = first_uncovered_bitmap(lut, rules, model, classes, max_rules)  # one row per class at most
    here = lut.where(F.col("var") >= 0).join(F.broadcast(at), "bucket")
    return here.where(_has_bit("bits", "row")).select("cls", "var", "val")
