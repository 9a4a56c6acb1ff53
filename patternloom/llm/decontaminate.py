"""Benchmark decontamination: every shard of documents gets an FM-index that the test windows are searched in.

Words are maximal runs of digits, letters and characters beyond ASCII, with A-Z lowered. A test item
gives one window for every ``window`` consecutive words, or a single shorter one if it has fewer words.
A task cuts its documents into shards, writes the words of each as numbers of the benchmark's vocabulary
(a stretch of other words becomes one separator, which no window crosses), indexes them, searches all
windows backwards through wavelet ranks, locates the hits by sampled suffix positions and merges them
into spans. Nothing is shuffled. The benchmark is handled in blocks of bounded size, one pass each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patternloom.llm.fmindex import FMIndex
from patternloom.llm.words import WORD_CHARS, hash_words, slices, text_words, utf8, words
from patternloom.session import ship

WINDOW = 13
BLOCK_BYTES = 16 << 20  # of benchmark text searched in one pass
SHARD_BYTES = 2 << 20  # of document text under one index
LOCATE = 1 << 18  # hits located at once
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
SPANS_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


class Windows:
    """The windows of a block of items as numbers of its vocabulary, which start at 1."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        names, owners = sorted({i for i, _ in items if i is not None}), {}
        number = {name: k for k, name in enumerate(names)}
        vocabulary: dict[bytes, int] = {}
        for name, text in items:
            ids = [vocabulary.setdefault(w, len(vocabulary)) for w in text_words(text, WORD_CHARS)]
            for at in range(max(1, len(ids) - window + 1) if ids else 0):
                owners.setdefault(tuple(ids[at : at + window]), set()).update([number[name]] if name is not None else [])
        hashes = hash_words(list(vocabulary))
        self.names = names
        self.by_hash = np.argsort(hashes)
        self.hashes = hashes[self.by_hash]
        self.lengths = np.array([len(w) for w in owners], np.int64)
        self.patterns = np.zeros((len(owners), window), np.int32)
        for k, w in enumerate(owners):
            self.patterns[k, : len(w)] = np.array(w) + 1
        self.owner = np.array([x for o in owners.values() for x in sorted(o)], np.int64)
        self.owner_from = np.concatenate(([0], np.cumsum([len(o) for o in owners.values()]))).astype(np.int64)
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(hashes >> np.uint64(48)).astype(np.int64)] = True

    def numbers(self, hashed: np.ndarray) -> np.ndarray:
        """1 + the word's number, or 0 for a word outside the vocabulary."""
        out = np.zeros(len(hashed), np.int64)
        at = np.flatnonzero(self.maybe[(hashed >> np.uint64(48)).astype(np.int64)])
        if len(at):
            near = np.minimum(np.searchsorted(self.hashes, hashed[at]), len(self.hashes) - 1)
            same = self.hashes[near] == hashed[at]
            out[at[same]] = self.by_hash[near[same]] + 1
        return out

    def hits(self, numbers: np.ndarray, doc: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """First word and window of every occurrence in a shard; ``doc`` is each word's document."""
        kept = np.flatnonzero(numbers)
        if not len(kept) or not len(self.lengths):
            return
        apart = (np.diff(kept) != 1) | (np.diff(doc[kept]) != 0)
        place = np.arange(len(kept)) + np.concatenate(([0], np.cumsum(apart)))
        text = np.zeros(place[-1] + 1, np.int64)
        text[place] = numbers[kept]
        index = FMIndex(text)
        low, high = index.search(self.patterns, self.lengths)
        found = np.flatnonzero(high > low)
        upto = np.cumsum(high[found] - low[found])
        for first in range(0, int(upto[-1]) if len(upto) else 0, LOCATE):
            nth = np.arange(first, min(first + LOCATE, int(upto[-1])))
            k = np.searchsorted(upto, nth, side="right")
            rows = low[found[k]] + nth - (upto[k] - (high - low)[found[k]])
            yield kept[np.searchsorted(place, index.locate(rows))], found[k]


def _merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted spans with overlapping and touching ones joined."""
    by = np.argsort(start, kind="stable")
    start, reach = start[by], np.maximum.accumulate(end[by])
    new = np.concatenate(([True], start[1:] > reach[:-1]))
    return start[new], reach[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(start) - 1]))]


def _shard(windows: Windows, buf: np.ndarray, offsets: np.ndarray):
    """Words per document, merged spans as (document, start, end) and items as (document, item)."""
    n = len(offsets) - 1
    starts, _, hashed = words(buf, offsets, WORD_CHARS)
    doc = np.searchsorted(offsets, starts, side="right") - 1
    count = np.bincount(doc, minlength=n)
    first = np.concatenate(([0], np.cumsum(count)))
    spans, owners = [], []
    for at, which in windows.hits(windows.numbers(hashed), doc):
        # One free number after each document, so that spans of neighbouring documents never touch.
        start = at + doc[at]
        spans.append(_merged(start, start + windows.lengths[which]))
        pairs = np.unique(doc[at] * len(windows.lengths) + which)
        d, which = pairs // len(windows.lengths), pairs % len(windows.lengths)
        size = windows.owner_from[which + 1] - windows.owner_from[which]
        nth = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        owners.append(np.repeat(d, size) * max(1, len(windows.names)) + windows.owner[np.repeat(windows.owner_from[which], size) + nth])
    owned = np.unique(np.concatenate(owners)) if owners else np.zeros(0, np.int64)
    a, b = (np.concatenate(x) for x in zip(*spans)) if spans else (np.zeros(0, np.int64),) * 2
    if len(a):
        a, b = _merged(a, b)
        d = np.searchsorted(first + np.arange(n + 1), a, side="right") - 1
        a, b = a - d - first[d], b - d - first[d]
    else:
        d = a
    return count, (d, a, b), (owned // max(1, len(windows.names)), owned % max(1, len(windows.names)))


def _lists(rows: int, row: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(rows + 1)), pa.int32()), values)


def _scan(shared, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = shared.value
        names = np.array(windows.names, dtype=object)
        for batch in batches:
            buf, offsets = utf8(batch.column("text"))
            for lo, hi in slices(offsets, SHARD_BYTES):
                part, own = batch.slice(lo, hi - lo), offsets[lo : hi + 1]
                count, (d, a, b), (owned_by, item) = _shard(windows, buf[own[0] : own[-1]], own - own[0])
                if "spans" in part.schema.names:  # of earlier blocks
                    had = part.column("spans")
                    was = np.repeat(np.arange(len(part)), np.diff(np.asarray(had.offsets)))
                    flat = had.flatten()
                    old_a, old_b = (np.asarray(flat.field(f)) for f in ("start", "end"))
                    base = np.concatenate(([0], np.cumsum(count + 1)))
                    d2 = np.concatenate((d, was))
                    if len(d2):
                        a, b = _merged(base[d2] + np.concatenate((a, old_a)), base[d2] + np.concatenate((b, old_b)))
                        d = np.searchsorted(base, a, side="right") - 1
                        a, b = a - base[d], b - base[d]
                    items = [sorted({*x, *y}) for x, y in zip(part.column("items").to_pylist(), _lists(len(part), owned_by, pa.array(names[item], pa.string())).to_pylist())]
                    items = pa.array(items, pa.list_(pa.string()))
                else:
                    items = _lists(len(part), owned_by, pa.array(names[item], pa.string()))
                spans = _lists(len(part), d, pa.StructArray.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["start", "end"]))
                columns = {"id": part.column("id")} | ({"text": part.column("text")} if keep_text else {})
                columns |= {"n_words": pa.array(count, pa.int64()), "spans": spans, "items": items}
                yield pa.RecordBatch.from_pydict(columns)

    return run


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    share: float = 0.05,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_hit, spans, items, contaminated.

    ``spans`` are the words to remove (merged, numbered from 0, end exclusive), ``items`` the sorted ids
    (as strings) of items with a window in the document; ``contaminated`` means that words are hit and
    make up at least ``share`` of all. Null and empty texts have no words and are clean. Repeated rows
    are judged one by one; repeated item ids are one item; an item without id hits but isn't named. With
    an empty benchmark every document is clean. Other columns are not read.
    """
    spark = docs.sparkSession
    ship(docs.sparkSession)
    size = benchmark.agg(F.sum(F.octet_length(item_text_col))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text"))
    part = F.pmod(F.xxhash64("item", "text"), F.lit(blocks))
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = T.StructType([out.schema["id"], out.schema["text"], T.StructField("n_words", T.LongType()), T.StructField("spans", SPANS), T.StructField("items", T.ArrayType(T.StringType()))])
    for b in range(blocks):
        # A block is bounded by block_bytes, whatever the size of the benchmark.
        held = [tuple(r) for r in items.where(part == b).collect()]
        shared = spark.sparkContext.broadcast(Windows(held, window))
        last = b == blocks - 1
        out = out.mapInArrow(_scan(shared, not last), T.StructType([f for f in kind if not (last and f.name == "text")]))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return out.select(F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), "spans", "items").withColumn(
        "contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") >= F.col("n_words") * F.lit(share))
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the contaminated rows, columns unchanged."""
    rows = docs.select(F.struct("*").alias("_row"), F.col(text_col).alias("_text"))
    judged = find_contamination(rows, benchmark, "_row", "_text", **options)
    return judged.where("not contaminated").select("_row.*")
