"""Exact deduplication by progressive refinement: length, then a hash of the beginning, then a hash of all.

Each step leaves only rows whose key occurs more than once. What occurs more than once is kept in a
bitmap of fixed size (see ``sieve``), so the next scan tests rows where they are: a row whose length or
beginning is unique is never hashed in full nor shuffled, and texts are not moved at all. A collision
in the bitmap only lets a unique row through to the next step. All steps are DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patternloom.llm.spread import attach, numbered, passes, sieve
from patternloom.session import cut_lineage

PREFIX = 64  # characters under the second hash
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """The text with A-Z lowered and nothing else changed; null is empty."""
    text = F.coalesce(text, F.lit(""))
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _keys(text_col: str) -> tuple[Column, Column]:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return F.octet_length(text).cast("long"), F.xxhash64(F.octet_length(text), normalised(F.substring(text, 1, PREFIX)))


def _sieves(docs: DataFrame, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Lengths, and beginnings with their length, that more than one row has; written, as they serve several scans."""
    length, begins = _keys(text_col)

    def repeated(keys: DataFrame) -> DataFrame:
        return cut_lineage(sieve(keys.groupBy(keys.columns[0]).count().where("count > 1").drop("count")))

    lengths = repeated(docs.select(length.alias("_key")))
    sized = passes(docs, length, lengths, "_exact_sized")
    return lengths, repeated(sized.where("_exact_sized").select(begins.alias("_key")))


def _suspects(docs: DataFrame, text_col: str, sieves: tuple[DataFrame, DataFrame]) -> DataFrame:
    """``docs`` with ``_exact_suspect``: whether another row may have the same length and beginning."""
    # A unique length makes a unique beginning, since the length is part of its key.
    return passes(docs, _keys(text_col)[1], sieves[1], "_exact_suspect")


def _sha(text_col: str) -> Column:
    return F.sha2(normalised(F.col(text_col)).cast("binary"), 256)


def _digests(docs: DataFrame, id_col: str, text_col: str, every: bool) -> DataFrame:
    full = _sha(text_col)
    digest = full if every else F.when(F.col("_exact_suspect"), full)
    flagged = _suspects(docs, text_col, _sieves(docs, text_col))
    return cut_lineage(flagged.select(F.col(id_col).alias("_id"), "_exact_suspect", digest.alias("digest")))


def find_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every_digest: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, digest.

    Rows are equal if their texts are, after A-Z is lowered; null counts as empty, and empty texts are
    equal. The largest id of a group is its keep_id; nulls are smaller than any id. Rows that repeat the
    kept id are one document and all kept. ``digest`` is the SHA-256 of the normalised text, null for rows
    that an earlier step found unique unless ``every_digest``. Other columns are not read; a table
    without rows gives none.
    """
    rows = _digests(docs, id_col, text_col, every_digest)
    suspects = rows.where("_exact_suspect")
    groups = suspects.groupBy("digest").agg(F.max("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    found = attach(suspects, groups, "digest", "group_size", rows.count())
    alone = rows.where("not _exact_suspect").withColumns({"keep_id": F.col("_id"), "group_size": F.lit(1).cast("long")})
    return found.unionByName(alone).select(
        F.col("_id").alias(id_col), "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest"
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that ``find_copies`` does not keep; only texts with a suspect are moved."""
    rows, fields, names = numbered(docs, id=F.col(id_col), text=F.col(text_col))
    own = [f.name for f in fields]
    flagged = _suspects(rows, "text", _sieves(rows, "text"))
    suspects = flagged.where("_exact_suspect").withColumn("digest", _sha("text"))
    keep = cut_lineage(suspects.groupBy("digest").agg(F.max("id").alias("_keep"))).withColumnRenamed("digest", "_digest")
    kept = suspects.join(keep, (F.col("digest") == F.col("_digest")) & F.col("id").eqNullSafe(F.col("_keep")), "left_semi")
    return flagged.where("not _exact_suspect").select(own).unionByName(kept.select(own)).toDF(*names)
