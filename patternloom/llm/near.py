"""Near-duplicate groups: one-permutation MinHash, banded buckets, star-shaped candidates, exact confirmation.

1. Every document becomes its set of distinct shingles (64-bit hashes). One permutation: the top bits of a
   hash choose one of ``BINS`` bins, the smallest hash of a bin is its value, and an empty bin takes the value of
   the first filled one in a random order of its own (optimal densification).
2. Documents with equal sets are one class, which the smallest id stands for.
3. ``BANDS`` bands of the signature put classes into buckets. In each bucket the smallest id is joined with
   every other member: a star, so that candidates grow with the members and not with their square.
4. Candidates are confirmed on the full sets, and the links joined to components.
5. A star may miss a link between two members that are not similar to its centre. Buckets whose members
   are still in several components are therefore compared in full, in blocks of bounded size, by products of
   incidence matrices inside the tasks; only links that join components leave a task.

A pair with similarity 0.8 shares no band with probability (1 - 0.8 ** 4) ** 32 = 5e-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patternloom.llm.graph import components
from patternloom.llm.spread import attach, numbered, passes, sieve
from patternloom.llm.words import NOT_SPACE, mix, slices, utf8, words
from patternloom.session import cut_lineage, ship

BINS = 128
BANDS = 32
SHINGLE = 5
SIMILARITY = 0.8
BLOCK_DOCS = 512  # members of a bucket compared in one block, about
BLOCK_SHINGLES = 1 << 19  # shingles of a block, about
COLUMNS = 4096  # of an incidence matrix

_SPREAD = np.random.default_rng(2017).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_EDGES = (np.arange(BINS + 1, dtype=np.uint64)[:-1]) << np.uint64(64 - BINS.bit_length() + 1)
_PROBES = np.argsort(np.random.default_rng(1733).random((BINS, BINS)), axis=1)


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every document of a slice; all its words are one if they are fewer."""
    starts, _, hashed = words(buf, offsets, NOT_SPACE)
    doc = np.searchsorted(offsets, starts, side="right") - 1
    first = np.searchsorted(doc, np.arange(len(offsets)))
    n = max(0, len(hashed) - width + 1)
    joined = np.zeros(n, np.uint64)
    for j in range(width):
        joined += mix(hashed[j : n + j] + _SPREAD[j % 64])
    joined = mix(joined)
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= width:
            yield np.unique(joined[a : b - width + 1])
        elif b > a:
            short = (hashed[a:b] * _SPREAD[np.arange(b - a) % 64]).sum(dtype=np.uint64) + np.uint64(b - a)
            yield mix(np.array([short], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """One value per bin of a sorted set that is not empty."""
    at = np.searchsorted(shingles, _EDGES)
    filled = np.diff(np.append(at, len(shingles))) > 0
    values = shingles[np.minimum(at, len(shingles) - 1)]
    empty = np.flatnonzero(~filled)
    if len(empty):
        probes = _PROBES[empty]
        values[empty] = values[probes[np.arange(len(empty)), filled[probes].argmax(axis=1)]]
    return values


def bands(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit bucket per band for every row of signatures."""
    rows = BINS // BANDS
    cells = signatures.reshape(-1, BANDS, rows)
    total = (cells * _SPREAD[:rows]).sum(axis=2, dtype=np.uint64) + _SPREAD[rows] * np.arange(BANDS, dtype=np.uint64)
    return mix(total).view(np.int64)


def _sign(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = utf8(batch.column("text"))
            for lo, hi in slices(offsets):
                own = offsets[lo : hi + 1]
                size, key, sign = [], [], []
                for s in shingle_sets(buf[own[0] : own[-1]], own - own[0], width):
                    size.append(len(s))
                    key.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    if len(s):
                        sign.append(signature(s))
                cells = bands(np.array(sign)) if sign else np.zeros((0, BANDS), np.int64)
                ends = np.concatenate(([0], np.cumsum(np.array(size) > 0))) * BANDS
                yield pa.RecordBatch.from_pydict(
                    {
                        "id": batch.column("id").slice(lo, hi - lo),
                        "n": pa.array(size, pa.int64()),
                        "set_key": pa.array(key, pa.binary()),
                        "bands": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(cells.ravel())),
                    }
                )

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = utf8(batch.column("text"))
            for lo, hi in slices(offsets):
                own = offsets[lo : hi + 1]
                sets = [s.tobytes() for s in shingle_sets(buf[own[0] : own[-1]], own - own[0], width)]
                yield pa.RecordBatch.from_pydict({"id": batch.column("id").slice(lo, hi - lo), "set": pa.array(sets, pa.binary())})

    return run


def linked(shared: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes with so many common members are linked."""
    return 100 * shared >= percent * (size_a + size_b - shared)


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [[np.frombuffer(x, np.uint64) for x in batch.column(c).to_pylist()] for c in ("set_a", "set_b")]
            shared = np.array([len(np.intersect1d(a, b, assume_unique=True)) for a, b in zip(*sets)], np.int64)
            sizes = [np.array([len(x) for x in s], np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(
                pa.array(linked(shared, *sizes, percent), pa.bool_())
            )

    return run


def common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of 0/1 matrices (exact below 2 ** 24)."""
    of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = count > 1
    column = np.cumsum(often) - 1
    kept = often[at]
    of, column = of[kept], column[at[kept]]
    by = np.argsort(column, kind="stable")
    of, column = of[by], column[by]
    out = np.zeros((len(sets), len(sets)), np.int64)
    last = int(column[-1]) + 1 if len(column) else 0
    for start in range(0, last, COLUMNS):
        a, b = np.searchsorted(column, (start, start + COLUMNS))
        cells = np.zeros((len(sets), min(COLUMNS, last - start)), np.float32)
        cells[of[a:b], column[a:b] - start] = 1
        out += (cells @ cells.T).astype(np.int64)
    return out


def _joins(ids: list, component: list, block: list, sets: list[np.ndarray], percent: int) -> list[tuple]:
    """Links of a unit that join different components, a spanning forest of them."""
    if len(set(component)) < 2:
        return []
    size = np.array([len(s) for s in sets], np.int64)
    name = {c: k for k, c in enumerate(dict.fromkeys(component))}
    group = np.array([name[c] for c in component])
    side = np.array(block)
    wanted = np.triu(linked(common(sets), size[:, None], size[None, :], percent), 1) & (group[:, None] != group[None, :])
    if side.min() != side.max():  # two different blocks: pairs inside one belong to another unit
        wanted &= side[:, None] != side[None, :]
    parent = np.arange(len(name))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(wanted)):
        a, b = root(group[i]), root(group[j])
        if a != b:
            parent[a] = b
            out.append((ids[i], ids[j]))
    return out


def _compare(percent: int, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held = None, ([], [], [], [])

        def done():
            rows = _joins(*held, percent) if len(held[0]) > 1 else []
            return pa.RecordBatch.from_pydict({"a": pa.array([r[0] for r in rows], kind), "b": pa.array([r[1] for r in rows], kind)})

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("unit", "id", "component", "block", "set")]
            for u, *row in zip(*columns):
                if u != unit:
                    if len(held[0]) > 1 and (out := done()).num_rows:
                        yield out
                    unit, held = u, ([], [], [], [])
                for h, x in zip(held, (*row[:3], np.frombuffer(row[3], np.uint64))):
                    h.append(x)
        if len(held[0]) > 1 and (out := done()).num_rows:
            yield out

    return run


def _rest(buckets: DataFrame, joined: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between members of a bucket that are in different components."""
    label = joined.select("id", F.col("component").alias("_component"))
    rows = buckets.join(label, "id", "left").withColumn("component", F.coalesce("_component", "id")).drop("_component")
    rows = cut_lineage(rows.select("key", "id", "n", "component"))
    open_ = rows.groupBy("key").agg(
        F.min("component").alias("_low"), F.max("component").alias("_high"), F.sum("n").alias("_shingles"), F.count(F.lit(1)).alias("_members")
    )
    blocks = F.greatest(F.ceil(F.col("_members") / BLOCK_DOCS), F.ceil(F.col("_shingles") / BLOCK_SHINGLES))
    open_ = cut_lineage(open_.where("_low <> _high").select("key", "_members", blocks.cast("long").alias("_blocks")))
    members = attach(rows, open_, "key", "_members", rows.count())
    block = F.pmod(F.xxhash64("id", F.lit(7)), F.col("_blocks"))
    members = members.withColumn("block", block).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    unit = F.xxhash64("key", F.least("block", "_other"), F.greatest("block", "_other"))
    units = members.select(unit.alias("unit"), "id", "component", "block").join(sets, "id")
    kind = units.schema["id"].dataType
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])
    ordered = units.repartition("unit").sortWithinPartitions("unit")
    return ordered.mapInArrow(_compare(percent, _arrow(kind)), schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY
) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, kept.

    Words are runs of characters other than ASCII white space, with A-Z lowered; a document's set are its
    distinct shingles of ``shingle`` words, or all its words as one if there are fewer. Documents whose sets
    have a Jaccard similarity of at least ``similarity`` (in whole percent) are linked, ``component_id`` is the
    smallest id that links lead to, and the row with that id is kept. A null or empty text has no set and no
    link. Rows that repeat an id are one document; a row without id joins the component of an
    equal set and never stands for one. Other columns are not read.
    """
    percent = round(similarity * 100)
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_field, long_field = T.StructField("id", kind), T.StructField("n", T.LongType())
    binary = T.StructField("set_key", T.BinaryType())
    signed = cut_lineage(
        texts.mapInArrow(_sign(shingle), T.StructType([id_field, long_field, binary, T.StructField("bands", T.ArrayType(T.LongType()))]))
    )
    total = signed.count()
    classes = cut_lineage(
        signed.where("n > 0").groupBy("set_key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("_size"))
    )
    reps = signed.join(classes.select("set_key", F.col("rep").alias("id")), ["set_key", "id"], "left_semi")
    banded = reps.select("id", "n", F.explode("bands").alias("key"))
    repeated = banded.groupBy("key").agg(F.min(F.struct("id", "n")).alias("centre"), F.count(F.lit(1)).alias("_members"))
    repeated = cut_lineage(repeated.where("_members > 1"))
    near = passes(banded, F.col("key"), sieve(repeated.select("key")), "_shared").where("_shared").drop("_shared")
    buckets = cut_lineage(attach(near, repeated, "key", "_members", total * BANDS))

    involved = sieve(buckets.select(F.xxhash64("id").alias("key")).distinct())
    wanted = passes(texts.where(F.col("id").isNotNull()), F.xxhash64("id"), involved, "_wanted").where("_wanted")
    sets = wanted.select("id", "text").mapInArrow(_sets(shingle), T.StructType([id_field, T.StructField("set", T.BinaryType())]))
    sets = cut_lineage(sets)

    small, large = F.least("n", "centre.n"), F.greatest("n", "centre.n")
    stars = buckets.where((F.col("id") != F.col("centre.id")) & (100 * small >= percent * large))
    stars = stars.select(F.col("centre.id").alias("a"), F.col("id").alias("b")).distinct()
    stars = stars.join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b")
    stars = stars.join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a")
    link = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])
    links = cut_lineage(stars.select("a", "b", "set_a", "set_b").mapInArrow(_confirm(percent), link))
    more = cut_lineage(_rest(buckets, components(links), sets, percent))
    joined = components(links.union(more))

    label = joined.select(F.col("id").alias("rep"), "component")
    groups = classes.join(label, "rep", "left").select("set_key", "_size", F.coalesce("component", "rep").alias("component_id"))
    with_set = attach(signed.where("n > 0").select("id", "n", "set_key"), cut_lineage(groups), "set_key", "_size", total)
    alone = signed.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    found = with_set.select("id", "n", "component_id").unionByName(alone)
    return found.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def drop_near(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` with one document of each component, and all rows without id; only texts whose id may be dropped are moved."""
    groups = cut_lineage(near_groups(docs, id_col, **options))
    dropped = groups.where(F.expr("not kept") & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_near_id")).distinct()
    held = sieve(dropped.select(F.xxhash64("_near_id").alias("key")))
    rows, fields, names = numbered(docs, id=F.col(id_col))
    flagged = passes(rows, F.xxhash64("id"), held, "_near_maybe")
    maybe = flagged.where("_near_maybe").join(dropped, F.col("id").eqNullSafe(F.col("_near_id")), "left_anti")
    own = [f.name for f in fields]
    return flagged.where("not _near_maybe").select(own).unionByName(maybe.select(own)).toDF(*names)
