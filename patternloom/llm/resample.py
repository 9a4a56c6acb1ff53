"""Importance resampling towards a target: hashed features, one array of gains, a distributed quickselect.

A feature is a run of consecutive words, hashed into buckets. The buckets of all documents and of all
texts of the target are counted; the log ratio of the two shares is the gain of a bucket, and the weight of a
document is the sum of the gains of its features, looked up in one array. A seeded Gumbel term makes the best
scores a draw without replacement. The k-th best key is found by quickselect: random pivots, exact counts of
what lies before, on and behind each, and one interval that is left for the next round. Only the
winners are sorted and ranked; the others stay where they are.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patternloom.llm.words import LOWER, WORD_CHARS, slices, utf8, words
from patternloom.session import cut_lineage, ship
from patternloom.sources.row_index import with_row_index

BUCKETS = 10_000
PIVOTS = 32  # a round leaves about this fraction of the rows
SHORT = 48  # bytes of a feature up to which all features are hashed together, byte by byte


def _crc_table() -> np.ndarray:
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = np.where(value & 1, (value >> 1) ^ np.uint32(0xEDB88320), value >> 1)
    return value.astype(np.uint32)


CRC = _crc_table()


def crc32_runs(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The CRC-32 of each run of bytes; one table look-up for the k-th byte of all runs that have one."""
    lengths = ends - starts
    order = np.argsort(-lengths, kind="stable")
    sizes = -lengths[order]  # ascending
    out = np.zeros(len(starts), np.uint32)
    long = int(np.searchsorted(sizes, -SHORT, "left"))
    for k in order[:long]:
        out[k] = zlib.crc32(buf[starts[k] : ends[k]])
    order, sizes = order[long:], sizes[long:]
    crc, first = np.full(len(order), 0xFFFFFFFF, np.uint32), starts[order]
    for j in range(int(-sizes[0]) if len(sizes) else 0):
        m = int(np.searchsorted(sizes, -j, "left"))
        here = crc[:m]
        crc[:m] = CRC[(here ^ buf[first[:m] + j]) & 0xFF] ^ (here >> np.uint32(8))
    out[order] = ~crc
    return out


def feature_buckets(buf: np.ndarray, offsets: np.ndarray, order: int, buckets: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Buckets of all runs of 1 to ``order`` words by length of the run, their documents' first and last + 1 word.

    A run of k words that begins at word i is there if word i + k - 1 belongs to the same document.
    """
    starts, ends, _ = words(buf, offsets, WORD_CHARS, hashes=False)
    begin, stop = np.searchsorted(starts, offsets[:-1]), np.searchsorted(starts, offsets[1:])
    low = LOWER[buf]
    if order > 1:  # words side by side with one space between them
        lengths = ends - starts
        moved = np.cumsum(lengths + 1) - lengths - 1
        joined = np.full(int((lengths + 1).sum()), 32, np.uint8)
        at = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        joined[np.repeat(moved, lengths) + at] = low[np.repeat(starts, lengths) + at]
        low, starts, ends = joined, moved, moved + lengths
    found = []
    for k in range(1, order + 1):
        first = np.arange(len(starts) - k + 1) if len(starts) >= k else np.zeros(0, np.int64)
        found.append((crc32_runs(low, starts[first], ends[first + k - 1]) % np.uint32(buckets)).astype(np.int64))
    return found, begin, stop


def _count(order: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(buckets, np.int64)
        for batch in batches:
            buf, offsets = utf8(batch.column("text"))
            for lo, hi in slices(offsets):
                own = offsets[lo : hi + 1]
                found, begin, stop = feature_buckets(buf[own[0] : own[-1]], own - own[0], order, buckets)
                for k, values in enumerate(found, 1):
                    if k == 1:
                        held += np.bincount(values, minlength=buckets)
                    else:
                        inside = np.zeros(len(values) + 1, np.int64)
                        np.add.at(inside, begin, stop - k >= begin)
                        np.add.at(inside, np.maximum(stop - k + 1, begin), -(stop - k >= begin).astype(np.int64))
                        held += np.bincount(values[np.cumsum(inside)[:-1] > 0], minlength=buckets)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(some, pa.int64()), "n": pa.array(held[some], pa.int64())})

    return run


def bucket_counts(texts: DataFrame, text_col: str = "text", order: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket; a task sends one sum per bucket."""
    ship(texts.sparkSession)
    parts = texts.select(F.col(text_col).alias("text")).mapInArrow(_count(order, buckets), "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most one row per bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousand times the log ratio of the shares of each bucket, smoothed by one, rounded down."""
    s, t, n = float(source.sum()), float(target.sum()), float(len(source))
    return np.array([math.floor(1000 * math.log((b + 1) * (s + n) / ((a + 1) * (t + n)))) for a, b in zip(source.tolist(), target.tolist())], np.int64)


def _weigh(shared, order: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            buf, offsets = utf8(batch.column("_resample_text"))
            for lo, hi in slices(offsets):
                own = offsets[lo : hi + 1]
                found, begin, stop = feature_buckets(buf[own[0] : own[-1]], own - own[0], order, buckets)
                weight, n = np.zeros(hi - lo, np.int64), np.zeros(hi - lo, np.int64)
                for k, values in enumerate(found, 1):
                    total = np.concatenate((np.zeros(1, np.int64), np.cumsum(gain[values])))
                    past = np.maximum(stop - k + 1, begin)
                    there = past > begin
                    weight += np.where(there, total[np.where(there, past, 0)] - total[np.where(there, begin, 0)], 0)
                    n += past - begin
                part = batch.slice(lo, hi - lo)
                columns = {name: part.column(name) for name in part.schema.names if name != "_resample_text"}
                yield pa.RecordBatch.from_pydict(columns | {"n_words": pa.array(stop - begin), "n_features": pa.array(n), "weight": pa.array(weight)})

    return run


def gumbel(id_col: Column, seed: str) -> Column:
    """A thousand times a standard Gumbel number from the hash of seed and id, rounded down."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def kth_key(rows: DataFrame, keys: list[str], k: int, pivots: int = PIVOTS):
    """The k-th smallest key (k from 1) of a table, as a Row; None if it has fewer rows.

    Keys are compared column by column, null first. Every round draws random keys as pivots, counts exactly what
    is before and on each, and goes on with the rows between two of them, which are written; so all rounds
    together read little more than the table once or twice, and only pivots and counts come to the driver.
    """
    if k < 1:
        return None
    key, level, left = F.struct(*keys), 0, rows.select(*keys)
    fields = rows.select(*keys).schema.fields
    while True:
        level += 1
        draw = F.xxhash64(*[F.col(c).cast("string") for c in keys], F.lit(level))
        drawn = left.orderBy(draw).limit(pivots).distinct().orderBy(*keys).collect()
        if not drawn:
            return None
        at = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(p, fields)]) for p in drawn]
        counts = left.agg(
            F.array(*[F.count(F.when(key < p, 1)) for p in at]).alias("before"), F.array(*[F.count(F.when(key == p, 1)) for p in at]).alias("on"), F.count(F.lit(1)).alias("n")
        ).first()
        if k > counts["n"]:
            return None
        place = sum(k > b + o for b, o in zip(counts["before"], counts["on"]))  # pivots behind which the key lies
        if place < len(at) and k > counts["before"][place]:
            return drawn[place]
        low = key > at[place - 1] if place else F.lit(True)
        high = key < at[place] if place < len(at) else F.lit(True)
        left = cut_lineage(left.where(low & high))
        k -= counts["before"][place - 1] + counts["on"][place - 1] if place else 0


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text",
    order: int = 1, buckets: int = BUCKETS, least: int = 20, percent: int = 10, seed: str = "2024",
) -> DataFrame:
    """One row per row of ``docs``: its id, n_words, n_features, weight, score and rank.

    Words are runs of digits, letters and characters beyond ASCII, with A-Z lowered; a null or empty text has none
    and weight 0. Of the rows with ``least`` words or more, ``percent`` in a hundred with the best scores are drawn
    (rounded down); rank counts them from 1, null for all others. Ties go to the smaller id (null first), then to
    the smaller hash of the text; of rows that are equal in all of these any one is drawn, each as often as
    it is there. Other columns are not read; a table without rows gives none, an empty target only smooths.
    """
    spark = docs.sparkSession
    gain = gains(bucket_counts(docs, text_col, order, buckets), bucket_counts(target, target_text_col, order, buckets))
    shared = spark.sparkContext.broadcast(gain)
    kept = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("tie"), F.col(text_col).alias("_resample_text"))
    schema = T.StructType([*kept.schema.fields[:2], *[T.StructField(n, T.LongType()) for n in ("n_words", "n_features", "weight")]])
    weighed = kept.mapInArrow(_weigh(shared, order, buckets), schema)
    scored = cut_lineage(weighed.withColumn("score", F.col("weight") + gumbel(F.col("id"), seed)))
    able = scored.where(F.col("n_words") >= least)
    drawn = able.count() * percent // 100
    keys = {"_less": -F.col("score"), "id": F.col("id"), "tie": F.col("tie")}
    last = kth_key(able.select(*[c.alias(n) for n, c in keys.items()]), list(keys), drawn)
    out = ("id", "n_words", "n_features", "weight", "score")
    unranked = F.lit(None).cast("long").alias("rank")
    if last is None:
        return scored.select(*out, unranked).withColumnRenamed("id", id_col)
    limit = F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(last, able.select(*[c.alias(n) for n, c in keys.items()]).schema.fields)])
    wins = (F.col("n_words") >= least) & (F.struct(*[c.alias(n) for n, c in keys.items()]) <= limit)
    line = [F.desc("score"), F.asc("id"), F.asc("tie")]
    first = scored.where(wins).repartitionByRange(*line).sortWithinPartitions(*line)
    ranked = with_row_index(first, 1, "rank").withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return ranked.select(*out, "rank").unionByName(scored.where(~wins).select(*out, unranked)).withColumnRenamed("id", id_col)
