"""Token counts as delta-maintained rollups.

Totals by source, language and tokenizer version are additive: an insert adds a document and its tokens, a
delete takes them away, a revised count adds the difference. A batch of such changes is summed and
added to the last totals as a new generation; then a ledger entry names the batch. Only generations in
the ledger count, and a batch already in it changes nothing, so a commit may be repeated at any time, also after a crash.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patternloom.session import ship

KEYS = ("source", "lang", "version")
TOTALS = "source string, lang string, version string, n_docs long, n_tokens long"
#: Fixed value: how byte-level BPE cuts a text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@dataclass(frozen=True)
class Runs:
    """Tokens are matches of a regular expression, counted in SQL."""

    pattern: str


@dataclass(frozen=True)
class BytePairs:
    """Byte-level BPE by a file of ranks (base64 token and rank per line)."""

    path: str
    pattern: str = PATTERN


_built: dict[str, object] = {}


def _encoding(path: str, pattern: str, lines: bytes):
    key = f"{path} {pattern}"
    if key not in _built:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines.splitlines() if x)}
        _built[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _built[key]


def _encode(shared, tokenizer: BytePairs):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(tokenizer.path, tokenizer.pattern, shared.value)
        for batch in batches:
            counts = [len(encoding.encode_ordinary(t)) if t else 0 for t in batch.column("_text").to_pylist()]
            columns = {n: batch.column(n) for n in batch.schema.names if n != "_text"}
            yield pa.RecordBatch.from_pydict(columns | {"n_tokens": pa.array(counts, pa.int64())})

    return run


def count_tokens(
    docs: DataFrame, tokenizers: Mapping[str, Runs | BytePairs], id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang",
    carry: Mapping[str, Column] | None = None,
) -> DataFrame:
    """One row per row of ``docs`` and tokenizer: id, source, lang, version, n_tokens (0 for a null text), and what is to be carried along.

    Columns to carry may refer to those of ``docs`` and to ``version``. Repeated rows and rows without id are counted one by one.
    """
    spark = docs.sparkSession
    ship(spark)
    own = [F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.col(lang_col).cast("string").alias("lang")]
    carried = [c.alias(n) for n, c in (carry or {}).items()]
    parts = []
    for version, tokenizer in tokenizers.items():
        rows = docs.withColumn("version", F.lit(version)).select(*own, "version", *carried, F.col(text_col).alias("_text"))
        if isinstance(tokenizer, Runs):
            n = F.coalesce(F.regexp_count("_text", F.lit(tokenizer.pattern)), F.lit(0)).cast("long")
            parts.append(rows.withColumn("n_tokens", n).drop("_text"))
        else:
            lines = spark.sparkContext.broadcast(Path(tokenizer.path).read_bytes())  # a vocabulary, of fixed size
            schema = T.StructType([f for f in rows.schema if f.name != "_text"] + [T.StructField("n_tokens", T.LongType())])
            parts.append(rows.mapInArrow(_encode(lines, tokenizer), schema))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _signed(counts: DataFrame, docs: Column, tokens: Column) -> DataFrame:
    return counts.select(*KEYS, docs.cast("long").alias("n_docs"), tokens.cast("long").alias("n_tokens"))


def inserts(counts: DataFrame) -> DataFrame:
    return _signed(counts, F.lit(1), F.col("n_tokens"))


def deletes(counts: DataFrame) -> DataFrame:
    return _signed(counts, F.lit(-1), -F.col("n_tokens"))


def revisions(counts: DataFrame) -> DataFrame:
    """Changes of rows with ``n_tokens`` as counted before and ``new_tokens`` as counted now."""
    return _signed(counts, F.lit(0), F.col("new_tokens") - F.col("n_tokens"))


class Rollup:
    """Totals kept in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    @classmethod
    def create(cls, spark: SparkSession, folder: str) -> Rollup:
        """An empty rollup; a folder that holds one is emptied."""
        rollup = cls(spark, folder)
        spark.createDataFrame([], TOTALS).write.mode("overwrite").parquet(f"{folder}/totals/0")
        rollup._enter(0, "")
        return rollup

    def _enter(self, generation: int, batch: str) -> None:
        row = self.spark.range(1).select(F.lit(generation).cast("long").alias("generation"), F.lit(batch).alias("batch"))
        row.coalesce(1).write.mode("overwrite" if generation == 0 else "append").parquet(f"{self.folder}/ledger")

    def ledger(self) -> DataFrame:
        """(generation, batch) of every commit."""
        return self.spark.read.schema("generation long, batch string").parquet(f"{self.folder}/ledger")

    def generation(self) -> int:
        return self.ledger().agg(F.max("generation")).first()[0]

    def totals(self) -> DataFrame:
        """source, lang, version, n_docs, n_tokens of the last generation."""
        return self.spark.read.schema(TOTALS).parquet(f"{self.folder}/totals/{self.generation()}")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch of signed changes; false if the ledger has it already. One writer at a time.

        Groups without documents and tokens vanish. Nulls in the keys are groups of their own.
        """
        if not self.ledger().where(F.col("batch") == batch).isEmpty():
            return False
        delta = changes.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        summed = self.totals().unionByName(delta).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        generation = self.generation() + 1
        # An attempt that died before its ledger entry is overwritten.
        summed.where("n_docs <> 0 or n_tokens <> 0").write.mode("overwrite").parquet(f"{self.folder}/totals/{generation}")
        self._enter(generation, batch)
        return True
