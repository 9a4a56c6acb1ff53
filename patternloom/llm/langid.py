"""Language identification: averaged hashed subword embeddings under a linear softmax, with calibrated rejection.

Subwords are the byte n-grams of each word with its borders, hashed into ``BUCKETS``. A document is the
average of their embeddings; a linear layer and a softmax give the languages. Embeddings and layer are
trained together by stochastic gradient descent in numpy on the driver. Every language that has a row is
learnt, from about ``sample`` of its rows, or fewer so that all samples together stay about ``total`` rows. The
executors write each as at most ``BUCKETS`` counts of its whole text, and the driver reads one batch of them at
a time. A temperature fitted on a fifth of the sample makes the score a probability; below ``reject`` a
document is rejected. For prediction the layer is folded into the embeddings of few languages, so that a
document costs one sum over its subwords.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patternloom.llm.spread import numbered
from patternloom.llm.words import LOWER, slices, utf8
from patternloom.session import cut_lineage, ensure_checkpoint_dir, ship

BITS = 14
BUCKETS = 1 << BITS
LENGTHS = (2, 3, 4)
DIMENSIONS = 16
SAMPLE = 800  # rows of a language, about
TOTAL = 160_000  # rows of all languages, about
BATCH = 400  # rows read by the driver at once, about
KEPT = 64 << 20  # bytes of batches that the driver holds between epochs
EPOCHS = 6
REJECT = 0.5
UNKNOWN = "und"

_code = np.arange(256)
LETTERS = np.where(((LOWER >= 97) & (LOWER <= 122)) | (_code >= 128), LOWER, 0).astype(np.uint32)
HAS_LETTER = re.compile(r"[^\W\d_]")  # a first test, as it takes characters like \u00bd too


def has_letter(text: str) -> bool:
    """Whether some character is a letter by its Unicode category."""
    return any(unicodedata.category(m[0])[0] == "L" for m in HAS_LETTER.finditer(text))


def subwords(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of a slice, in document order, and where each document's begin."""
    padded = np.concatenate(([0], np.insert(LETTERS[buf], offsets[1:-1], 0), [0])).astype(np.uint32)
    at = offsets + np.arange(len(offsets))  # a border goes before each document
    letter = padded > 0
    found, begins = [], []
    value, inner = padded, np.ones(len(padded), bool)
    for n in range(2, max(LENGTHS) + 1):
        value = value[:-1] * np.uint32(0x01000193) + padded[n - 1 :]
        if n > 2:  # all but the first and last byte are letters
            inner = inner[:-1] & letter[n - 2 : len(padded) - 1]
        else:
            inner = letter[:-1] | letter[1:]
        if n in LENGTHS:
            where = np.flatnonzero(inner)
            hashed = (value[where] ^ (value[where] >> np.uint32(15))) * np.uint32(0x9E3779B1)
            found.append((hashed >> np.uint32(32 - BITS)).astype(np.int32))
            begins.append(np.searchsorted(where, at))
    return found, begins


def document_counts(buf: np.ndarray, offsets: np.ndarray) -> Iterator[list[np.ndarray]]:
    """For every document of a slice its buckets, one array per n-gram length."""
    found, begins = subwords(buf, offsets)
    for d in range(len(offsets) - 1):
        yield [f[b[d] : b[d + 1]] for f, b in zip(found, begins)]


Example = tuple[np.ndarray, np.ndarray, int, bool]  # buckets, counts, language number, only for calibration


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # BUCKETS x languages: embeddings times layer; or the embeddings
    layer: np.ndarray | None
    bias: np.ndarray
    temperature: float
    reject: float

    def logits(self, summed: np.ndarray, n: int) -> np.ndarray:
        return (summed if self.layer is None else summed @ self.layer) / max(1, n) + self.bias

    def scores(self, parts: list[np.ndarray]) -> np.ndarray:
        n = sum(map(len, parts))
        if n > 2048:
            summed = sum(np.bincount(p, minlength=BUCKETS) for p in parts) @ self.table
        else:
            summed = self.table[np.concatenate(parts)].sum(axis=0)
        logits = self.logits(summed, n) / self.temperature
        e = np.exp(logits - logits.max())
        return e / e.sum()


def train(batches: list[Callable[[], list[Example]]], size: int, languages: list[str], seed: int = 7, reject: float = REJECT) -> Model:
    """Fit on batches of ``size`` examples in all, read anew in every epoch; those for calibration are not learnt."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1, 1, (BUCKETS, DIMENSIONS)) / DIMENSIONS
    layer, bias = np.zeros((DIMENSIONS, len(languages))), np.zeros(len(languages))
    steps, done = EPOCHS * max(1, size), 0
    for _ in range(EPOCHS):
        for b in rng.permutation(len(batches)):
            examples = batches[b]()
            for k in rng.permutation(len(examples)):
                buckets, counts, y, aside = examples[k]
                rate = 0.5 * (1 - done / steps)
                done += 1
                if aside:
                    continue
                share = counts / counts.sum()
                hidden = share @ vectors[buckets]
                logits = hidden @ layer + bias
                p = np.exp(logits - logits.max())
                p /= p.sum()
                p[y] -= 1
                back = layer @ p
                layer -= rate * np.outer(hidden, p)
                bias -= 0.1 * rate * p
                # The average divides the gradient among all subwords; scaled by their number it keeps one pace.
                vectors[buckets] -= rate * np.minimum(1.0, share * len(share))[:, None] * back
    folded = len(languages) <= DIMENSIONS
    model = Model(
        languages, (vectors @ layer if folded else vectors).astype(np.float32), None if folded else layer.astype(np.float32), bias.astype(np.float32), 1.0, reject
    )
    temperatures = np.geomspace(0.2, 20, 60)
    losses, held = np.zeros(len(temperatures)), 0
    for batch in batches:
        for buckets, counts, y, aside in batch():
            if aside:
                logits = model.logits(counts @ model.table[buckets], counts.sum()).astype(np.float64)
                z = logits - logits.max()
                losses += [np.log(np.exp(z / t).sum()) - z[y] / t for t in temperatures]
                held += 1
    if held:
        model.temperature = float(temperatures[losses.argmin()])
    return model


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, offsets = utf8(batch.column("text"))
        for lo, hi in slices(offsets):
            own = offsets[lo : hi + 1]
            buckets, counts = [], []
            for parts in document_counts(buf[own[0] : own[-1]], own - own[0]):
                b, c = np.unique(np.concatenate(parts), return_counts=True)
                buckets.append(b.astype(np.int32))
                counts.append(c.astype(np.int32))
            part = batch.slice(lo, hi - lo)
            yield pa.RecordBatch.from_pydict(
                {
                    **{n: part.column(n) for n in part.schema.names if n != "text"},
                    "buckets": pa.array(buckets, pa.list_(pa.int32())),
                    "counts": pa.array(counts, pa.list_(pa.int32())),
                }
            )


def fit(
    labelled: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    sample: int = SAMPLE,
    total: int = TOTAL,
    reject: float = REJECT,
) -> Model | None:
    """Train on about ``sample`` rows of each language; None if no row has a text with a letter and a language.

    The rows are chosen by the hash of their id and text, so reruns train alike; repeated rows count once.
    If ``sample`` rows of each language are more than ``total``, all have an equal share of it, and one row at least.
    """
    ship(labelled.sparkSession)
    spark = labelled.sparkSession
    rows = labelled.select(
        F.xxhash64(F.col(id_col), F.col(text_col), F.lit(11)).alias("place"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")
    ).where("lang is not null and text is not null and text rlike '[A-Za-z]|[^\\\\x00-\\\\x7F]'")
    sizes = cut_lineage(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("least")))
    names = sorted(r[0] for r in sizes.select("lang").collect())
    if not names:
        return None
    each = max(1, min(sample, total // len(names)))
    parts = -(-sizes.agg(F.sum(F.least("n", F.lit(each)))).first()[0] // BATCH)
    least = F.col("place") == F.col("least")  # of every language one row is chosen and learnt
    chosen = rows.join(F.broadcast(sizes), "lang").where((F.pmod("place", F.lit(1 << 30)) < float(1 << 30) * each / F.col("n")) | least)
    aside = (F.pmod("place", F.lit(5)) == 4) & ~least
    batch = F.pmod(F.shiftright("place", 30), F.lit(parts)).cast("int")
    chosen = chosen.select("place", "lang", aside.alias("aside"), batch.alias("batch"), "text").dropDuplicates(["place", "lang"])
    schema = "place long, lang string, aside boolean, batch int, buckets array<int>, counts array<int>"
    path = f"{ensure_checkpoint_dir(spark)}/langid/{uuid.uuid4().hex}"
    chosen.mapInArrow(_count, schema).repartition("batch").write.partitionBy("batch").parquet(path)
    written = spark.read.schema(schema).parquet(path)
    held = {r[0]: r[1] for r in written.groupBy("batch").count().collect()}
    number = {n: k for k, n in enumerate(names)}
    kept: dict[int, list[Example]] = {}
    room = KEPT

    def load(b: int) -> list[Example]:
        nonlocal room
        if b in kept:
            return kept[b]
        got = written.where(F.col("batch") == b).drop("batch").toArrow().sort_by([("place", "ascending"), ("lang", "ascending")])
        values = [[np.asarray(x.values) for x in got.column(c)] for c in ("buckets", "counts")]
        # Views of the received buffers, not copies.
        examples = [(x, c, number[y], a) for x, c, y, a in zip(*values, *(got.column(c).to_pylist() for c in ("lang", "aside")))]
        if got.nbytes <= room:
            room -= got.nbytes
            kept[b] = examples
        return examples

    return train([lambda b=b: load(b) for b in sorted(held)], sum(held.values()), names, reject=reject)


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model | None = shared.value
        for batch in batches:
            text = batch.column("text")
            buf, offsets = utf8(text)
            for lo, hi in slices(offsets):
                own = offsets[lo : hi + 1]
                chosen, scores = [], []
                raw = buf[own[0] : own[-1]]
                for d, parts in enumerate(document_counts(raw, own - own[0])):
                    letters = any(map(len, parts)) and has_letter(raw[own[d] - own[0] : own[d + 1] - own[0]].tobytes().decode())
                    p = model.scores(parts) if letters and model else np.zeros(1)
                    k = int(p.argmax())
                    chosen.append(model.languages[k] if letters and model else UNKNOWN)
                    scores.append(float(p[k]))
                part = batch.slice(lo, hi - lo)
                columns = {n: part.column(n) for n in part.schema.names if n != "text"}
                rejected = [c == UNKNOWN or s < model.reject for c, s in zip(chosen, scores)]
                yield pa.RecordBatch.from_pydict(
                    columns | {"lang_pred": pa.array(chosen, pa.string()), "score": pa.array(scores, pa.float64()), "rejected": pa.array(rejected, pa.bool_())}
                )

    return run


def identify(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and rejected, from the whole text alone.

    A null text or one without a letter is ``und`` with score 0 and rejected, as is every text without a
    model. Input columns named like an output are replaced. Repeated rows are predicted alike.
    """
    ship(docs.sparkSession)
    out = {"lang_pred": T.StringType(), "score": T.DoubleType(), "rejected": T.BooleanType()}
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows, fields, names = numbered(docs, out, text=F.col(text_col))
    return rows.mapInArrow(_predict(shared), T.StructType([*fields, *[T.StructField(n, k) for n, k in out.items()]])).toDF(*names, *out)


def held_out(id_col: Column) -> Column:
    """The quarter of the ids that is never learnt from."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))
