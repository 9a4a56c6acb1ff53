"""Joins on keys of which a few may hold most rows, and filters of fixed size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HOT = 200  # a key with at least this fraction (1 / HOT) of all rows is hot; there are at most HOT of them
SIEVE_BITS = 1 << 25  # 4 MB when broadcast, whatever the number of keys


def numbered(df: DataFrame, without=(), **own: Column) -> tuple[DataFrame, list[T.StructField], list[str]]:
    """The columns as c0, c1, ... and own ones beside them, which no name of the table can clash with.

    Columns named (in lower case) in ``without`` are left out. Also the fields c0, c1, ... and the names they had.
    """
    kept = [f for f in df.schema if f.name.lower() not in without]
    plain = [F.col("`" + f.name.replace("`", "``") + "`").alias(f"c{k}") for k, f in enumerate(kept)]
    fields = [T.StructField(f"c{k}", f.dataType) for k, f in enumerate(kept)]
    return df.select(*plain, *[c.alias(n) for n, c in own.items()]), fields, [f.name for f in kept]


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with the one row of their group, spread over all tasks.

    ``groups`` has one row per key and the number of rows of each in ``size``; these add up to
    ``total`` at most, so that at most ``HOT`` groups hold ``total / HOT`` rows or more. These
    go to every task (a proven bound), and only rows of smaller groups are shuffled.
    """
    is_hot = F.col(size) * F.lit(HOT) >= F.lit(total)
    hot = F.broadcast(groups.where(is_hot))
    rest = rows.join(F.broadcast(groups.where(is_hot).select(key)), key, "left_anti")
    return rows.join(hot, key).unionByName(rest.join(groups.where(~is_hot), key))


def sieve(keys: DataFrame, bits: int = SIEVE_BITS) -> DataFrame:
    """A bitmap of the hashes in the only column of ``keys``: at most ``bits`` / 32768 rows of 4 KB."""
    slot = F.pmod(keys[keys.columns[0]], F.lit(bits)) + 1
    return (
        keys.select(slot.alias("slot"))
        .groupBy(F.bitmap_bucket_number("slot").alias("_sieve_bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("_sieve_bits"))
    )


def passes(rows: DataFrame, key: Column, held: DataFrame, name: str, bits: int = SIEVE_BITS) -> DataFrame:
    """Add the boolean ``name``: false where the hash ``key`` is surely not among those of ``held``."""
    slot = F.pmod(key, F.lit(bits))
    rows = rows.withColumn("_sieve_slot", slot)
    joined = rows.join(F.broadcast(held), F.floor(F.col("_sieve_slot") / 32768) + 1 == F.col("_sieve_bucket"), "left")
    at = F.col("_sieve_slot") % 32768
    byte = F.conv(F.hex(F.substring("_sieve_bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.coalesce(byte.bitwiseAND(F.pow(F.lit(2), at % 8).cast("int")) > 0, F.lit(False))
    return joined.withColumn(name, bit).drop("_sieve_slot", "_sieve_bucket", "_sieve_bits")
