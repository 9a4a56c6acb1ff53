"""Toxicity: a hashed linear classifier of sentences, kept fair by counterfactual pairs.

A text is cut into sentences (of ``MOST_WORDS`` words at most); the features of a sentence are its different words and
the byte n-grams inside them. The score of a document is that of its worst sentence, so one insult counts in a text
of any length. Only documents are labelled: log odds of the features in a sample give first weights, by which executors pick
the most suspicious sentences of each document, and stochastic gradient descent lets the worst of them
carry the label. In sentences that name a group of people the term is swapped for another one of its list, and
the squared change of the score is a part of the loss: a mention alone then earns nothing, whatever the labels
suggest. A fifth of the sample calibrates the score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patternloom.llm.words import LOWER, WORD_CHARS, hash_words, mix, slices, utf8, words
from patternloom.session import cut_lineage, ship

BITS = 17
BUCKETS = 1 << BITS
LENGTHS = (4, 5, 6)  # bytes of an n-gram, a border included
MOST_WORDS = 32  # of a sentence; a longer one is cut
MOST_BYTES = 64  # of a word; a longer one is cut
SAMPLE = 4000  # labelled documents of each class, about
SUSPECTS = 6  # sentences of a document in the sample
EPOCHS = 10
RATE, DECAY = 0.02, 1e-4
FAIRNESS = 1.0  # weight of a squared change of the score
LEAST_Z = 4.0  # standard deviations from which log odds are taken as first weights
SCALE = 1 << 20  # weights are integers of this unit when they are summed, so sums do not depend on their order
PREDICTED = 0.3  # score from which a document is predicted toxic

SENTENCE_ENDS = np.isin(np.arange(256), list(b".!?\n"))
LETTERS = np.where(WORD_CHARS, LOWER, 0).astype(np.uint32)

#: Terms for groups of people that may stand for each other; the first of a list is neutral.
IDENTITY = (
    "people women men girls boys muslims jews christians hindus buddhists atheists catholics immigrants refugees foreigners"
    " gays lesbians africans asians europeans americans mexicans arabs indians veterans teenagers pensioners",
    "person woman man girl boy jew hindu buddhist atheist immigrant refugee foreigner lesbian teenager pensioner",
    "local black white asian african european american mexican chinese indian arab jewish muslim christian catholic gay straight"
    " transgender bisexual disabled deaf blind young old female male",
    "menschen frauen männer juden muslime christen ausländer flüchtlinge türken araber schwule lesben behinderte",
    "personnes femmes hommes juifs musulmans chrétiens étrangers réfugiés arabes africains homosexuels lesbiennes handicapés",
    "personas mujeres hombres judíos musulmanes cristianos extranjeros refugiados gitanos africanos homosexuales lesbianas discapacitados",
)
TERMS = [group.split() for group in IDENTITY]
PLACE = {term: (g, k) for g, group in enumerate(TERMS) for k, term in enumerate(group)}
NAMED = re.compile(r"(?<![^\W_])(" + "|".join(sorted(PLACE, key=len, reverse=True)) + r")(?![^\W_])")


def swapped(sentence: str, by: int) -> str:
    """The sentence in lower case with every identity term replaced by the ``by``-th other one of its list."""

    def other(m: re.Match) -> str:
        g, k = PLACE[m[0]]
        return TERMS[g][(k + 1 + by % (len(TERMS[g]) - 1)) % len(TERMS[g])]

    return NAMED.sub(other, sentence.lower())


@dataclass
class Sentences:
    """The sentences of a slice of documents: where their words and n-grams begin, and the buckets of both."""

    starts: np.ndarray  # of words, in bytes
    ends: np.ndarray
    words: np.ndarray  # buckets
    hashes: np.ndarray
    fresh: np.ndarray  # not a repetition in its sentence
    first: np.ndarray  # first word of each sentence
    at: np.ndarray  # first n-gram of each sentence
    doc: np.ndarray  # document of each sentence
    grams: list[tuple[np.ndarray, np.ndarray]]  # buckets and which of them lie in one word, by length

    def buckets(self, k: int) -> np.ndarray:
        """All features of one sentence."""
        a, b = self.first[k], self.first[k + 1] if k + 1 < len(self.first) else len(self.words)
        p, q = self.at[k], self.at[k + 1] if k + 1 < len(self.at) else None
        return np.concatenate([self.words[a:b][self.fresh[a:b]], *[v[p:q][ok[p:q]] for v, ok in self.grams]]).astype(np.int32)

    def sums(self, weights: np.ndarray) -> np.ndarray:
        """The summed integer weights of every sentence."""
        if not len(self.first):
            return np.zeros(0, np.int64)
        total = np.add.reduceat(np.where(self.fresh, weights[self.words], 0), self.first)
        for value, ok in self.grams:
            total += np.add.reduceat(np.where(ok, weights[value], 0), self.at)
        return total


def sentences(buf: np.ndarray, offsets: np.ndarray) -> Sentences:
    starts, ends, hashes = words(buf, offsets, WORD_CHARS)
    parts = -(-(ends - starts) // MOST_BYTES)
    if len(parts) and parts.max() > 1:
        whole = np.repeat(np.arange(len(parts)), parts)
        k = np.arange(len(whole)) - np.repeat(np.cumsum(parts) - parts, parts)
        starts, ends, hashes = starts[whole] + MOST_BYTES * k, np.minimum(ends[whole], starts[whole] + MOST_BYTES * (k + 1)), mix(hashes[whole] + k.astype(np.uint64))
    doc = np.searchsorted(offsets[1:-1], starts, "right")
    number = np.cumsum(SENTENCE_ENDS[buf])[starts] if len(starts) else starts
    line = np.arange(len(starts))
    new = np.ones(len(starts), bool)
    new[1:] = (number[1:] != number[:-1]) | (doc[1:] != doc[:-1])
    new |= (line - np.maximum.accumulate(np.where(new, line, 0))) % MOST_WORDS == 0
    first = np.flatnonzero(new)
    key = hashes ^ mix(np.cumsum(new).astype(np.uint64))
    order = np.argsort(key, kind="stable")
    fresh = np.ones(len(starts), bool)
    fresh[order[1:][key[order[1:]] == key[order[:-1]]]] = False
    # A border goes before, between and behind the documents.
    padded = np.concatenate(([0], np.insert(LETTERS[buf], offsets[1:-1], 0), np.zeros(max(LENGTHS), np.uint32))).astype(np.uint32)
    size = len(padded) - max(LENGTHS) + 1
    cover = np.zeros(size + 1, np.int8)  # n-grams begin at the border before a word or in it
    again = ~fresh
    cover[starts[again] + doc[again]] += 1
    cover[ends[again] + doc[again]] -= 1
    value, inner, grams = padded[:size].copy(), np.cumsum(cover[:-1], dtype=np.int8) == 0, []
    for n in range(2, max(LENGTHS) + 1):
        if n > 2:
            inner = inner & (padded[n - 2 : n - 2 + size] > 0)
        value = value * np.uint32(0x01000193) + padded[n - 1 : n - 1 + size]
        if n in LENGTHS:
            mixed = (value ^ (value >> np.uint32(15))) * np.uint32(0x9E3779B1)
            grams.append(((mixed >> np.uint32(32 - BITS)).astype(np.int32), inner))
    bucket = (hashes >> np.uint64(64 - BITS)).astype(np.int32)
    return Sentences(starts, ends, bucket, hashes, fresh, first, starts[first] + doc[first], doc[first], grams)


def worst(seen: Sentences, weights: np.ndarray, n_docs: int) -> np.ndarray:
    """The largest sum of the sentences of each document; 0 without words."""
    out = np.zeros(n_docs, np.int64)
    if len(seen.doc):
        begin = np.flatnonzero(np.diff(seen.doc, prepend=-1))
        out[seen.doc[begin]] = np.maximum.reduceat(seen.sums(weights), begin)
    return out


@dataclass
class Model:
    weights: np.ndarray  # integers, in units of 1 / SCALE
    bias: float
    slope: float
    shift: float

    def scores(self, sums: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * (sums / SCALE + self.bias) + self.shift)


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


@dataclass
class Example:
    label: int
    aside: bool  # only for calibration
    found: list[np.ndarray]  # features of suspicious sentences
    pairs: list[tuple[np.ndarray, np.ndarray]]  # of a sentence with and without its terms swapped


def log_odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """First weights: log odds of the documents with a feature, where they are surely not zero."""
    a, b = (toxic + 0.5) / (n_toxic + 1), (clean + 0.5) / (n_clean + 1)
    ratio = np.log(a / (1 - np.minimum(a, 0.999))) - np.log(b / (1 - np.minimum(b, 0.999)))
    error = np.sqrt(1 / (toxic + 0.5) + 1 / (n_toxic - toxic + 0.5) + 1 / (clean + 0.5) + 1 / (n_clean - clean + 0.5))
    return np.where(np.abs(ratio) >= LEAST_Z * error, np.clip(ratio, -1, 4), 0)


def train(examples: list[Example], start: np.ndarray, prior: float, fairness: float = FAIRNESS, seed: int = 3) -> Model:
    """Descent on the worst sentence of each document, and on the change of scores by swaps; then a calibrated score.

    ``prior`` is the share of toxic documents that the calibration assumes.
    """
    rng = np.random.default_rng(seed)
    w, bias = 0.2 * start, -1.0
    learnt, aside = [e for e in examples if not e.aside and e.found], [e for e in examples if e.aside]
    steps, done = EPOCHS * max(1, len(learnt)), 0
    flat = [(np.concatenate(e.found), np.cumsum([0, *map(len, e.found[:-1])])) for e in learnt]
    for _ in range(EPOCHS):
        for k in rng.permutation(len(learnt)):
            e, (values, begin) = learnt[k], flat[k]
            rate = RATE * (1 - done / steps)
            done += 1
            sums = np.add.reduceat(w[values], begin)
            top = e.found[int(sums.argmax())]
            g = float(sigmoid(sums.max() + bias)) - e.label
            w[top] -= rate * (g + DECAY * w[top])
            bias -= rate * g
            for one, two in e.pairs if fairness else ():
                change = w[one].sum() - w[two].sum()
                size = max(1, len(np.setxor1d(one, two)))
                pull = min(1.0, 10 * rate * fairness) * change / size
                only = np.setdiff1d(one, two)
                w[only] -= pull
                only = np.setdiff1d(two, one)
                w[only] += pull
    weights = np.round(w * SCALE).astype(np.int64)
    held = aside if len({e.label for e in aside}) == 2 else [e for e in examples]
    z = np.array([max((int(weights[f].sum()) for f in e.found), default=0) / SCALE + bias for e in held])
    y = np.array([e.label for e in held], np.float64)
    slope, shift = calibrate(z, y, prior)
    return Model(weights, bias, slope, shift)


def calibrate(z: np.ndarray, y: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and shift of a logistic curve with smoothed targets; the classes weigh as ``prior`` says."""
    n_toxic, n_clean = y.sum(), (1 - y).sum()
    if not n_toxic or not n_clean:  # one class only: the score is its smoothed share
        share = (n_toxic + 1) / (len(y) + 2)
        return 0.0, float(np.log(share / (1 - share)))
    goal = np.where(y > 0, (n_toxic + 1) / (n_toxic + 2), 1 / (n_clean + 2))
    weight = np.where(y > 0, prior / n_toxic, (1 - prior) / n_clean) * len(y)
    slope, shift = 1.0, 0.0
    for _ in range(100):
        p = sigmoid(slope * z + shift)
        g, h = weight * (p - goal), np.maximum(weight * p * (1 - p), 1e-9)
        a = np.array([[(h * z * z).sum() + 1e-3, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(a, [(g * z).sum() + 1e-3 * slope, g.sum()])
        step *= min(1.0, 1.0 / max(1e-12, np.abs(step).max()))
        slope, shift = slope - step[0], shift - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(max(slope, 0.0)), float(shift)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        buf, offsets = utf8(batch.column("text"))
        labels = np.asarray(batch.column("label").to_pylist())
        for lo, hi in slices(offsets):
            own = offsets[lo : hi + 1] - offsets[lo]
            seen = sentences(buf[offsets[lo] : offsets[hi]], own)
            begin = np.searchsorted(seen.doc, np.arange(hi - lo + 1))
            for d in range(hi - lo):
                found = [seen.buckets(k) for k in range(begin[d], begin[d + 1])]
                if found:
                    held[labels[lo + d], np.unique(np.concatenate(found))] += 1
    some = np.flatnonzero(held.any(axis=0))
    yield pa.RecordBatch.from_pydict({"bucket": pa.array(some, pa.int64()), "clean": pa.array(held[0, some]), "toxic": pa.array(held[1, some])})


EXAMPLE = "place long, label int, found array<array<int>>, one array<array<int>>, two array<array<int>>"


def _suspects(shared, terms: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        lists = pa.list_(pa.list_(pa.int32()))
        schema = pa.schema([("place", pa.int64()), ("label", pa.int32()), ("found", lists), ("one", lists), ("two", lists)])
        for batch in batches:
            buf, offsets = utf8(batch.column("text"))
            places, labels = batch.column("place").to_pylist(), batch.column("label").to_pylist()
            for lo, hi in slices(offsets):
                own, raw = offsets[lo : hi + 1] - offsets[lo], buf[offsets[lo] : offsets[hi]]
                seen = sentences(raw, own)
                sums, begin, rows = seen.sums(weights), np.searchsorted(seen.doc, np.arange(hi - lo + 1)), []
                stop = np.append(seen.first[1:], len(seen.words))
                total = np.concatenate(([0], np.cumsum(np.isin(seen.hashes, terms))))
                named = total[stop] > total[seen.first]
                for d in range(hi - lo):
                    place, mine = places[lo + d], np.arange(begin[d], begin[d + 1])
                    best = mine[np.argsort(-sums[mine], kind="stable")]
                    one, two = [], []
                    for k in best[named[best]][:SUSPECTS]:
                        text = raw[seen.starts[seen.first[k]] : seen.ends[stop[k] - 1]].tobytes().decode(errors="replace")
                        other = np.frombuffer(swapped(text, place + int(k)).encode(), np.uint8)
                        changed = sentences(other, np.array([0, len(other)]))
                        one.append(seen.buckets(k))
                        two.append(np.concatenate([changed.buckets(j) for j in range(len(changed.first))]))
                    rows.append({"place": place, "label": labels[lo + d], "found": [seen.buckets(k) for k in best[:SUSPECTS]], "one": one, "two": two})
                yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    sample: int = SAMPLE, fairness: float = FAIRNESS,
) -> Model | None:
    """Train on about ``sample`` documents of each class, chosen by hash; None if no label other than null has a document.

    A label above 0 is toxic; an id with several labels is toxic if one of them says so. Rows with a null id or text are
    not learnt from. Documents that share an id are different examples with the same label.
    """
    spark = docs.sparkSession
    ship(spark)
    toxic = (F.col(label_col) > 0).cast("int")
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(toxic).alias("label"))
    known = cut_lineage(known)
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if not sizes:
        return None

    def chosen(rows: DataFrame, place, n: dict[int, int]) -> DataFrame:
        most = F.when(F.col("label") == 1, F.lit(sample / max(1, n.get(1, 0)))).otherwise(F.lit(sample / max(1, n.get(0, 0))))
        return rows.where(F.pmod(place, F.lit(1 << 30)) < F.lit(float(1 << 30)) * most)

    drawn = chosen(known, F.xxhash64("_id", F.lit(13)), sizes)  # about 2 * sample ids
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null").join(F.broadcast(drawn), F.col("id") == F.col("_id"))
    rows = rows.select(F.xxhash64("id", "text", F.lit(17)).alias("place"), "label", "text")
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    rows = cut_lineage(chosen(rows, F.shiftright("place", 20), counts))
    got = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if not got:
        return None
    held = np.zeros((2, BUCKETS))
    parts = rows.select("label", "text").mapInArrow(_frequencies, "bucket long, clean long, toxic long").groupBy("bucket")
    table = parts.agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()  # at most one row per bucket
    for k, name in enumerate(("clean", "toxic")):
        held[k, table["bucket"].to_numpy()] = table[name].to_numpy()
    start = log_odds(held[1], held[0], got.get(1, 0), got.get(0, 0))
    shared = spark.sparkContext.broadcast(np.round(start * SCALE).astype(np.int64))
    terms = np.unique(hash_words([t.encode() for t in PLACE]))
    found = rows.mapInArrow(_suspects(shared, terms), EXAMPLE).toArrow().sort_by([("place", "ascending"), ("label", "ascending")])
    examples = []
    for batch in found.to_batches(max_chunksize=200):
        for r in batch.to_pylist():
            lists = [[np.array(x, np.int32) for x in r[c]] for c in ("found", "one", "two")]
            examples.append(Example(r["label"], r["place"] % 5 == 4, lists[0], list(zip(lists[1], lists[2]))))
    return train(examples, start, (sizes.get(1, 0) + 1) / (sum(sizes.values()) + 2), fairness)


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model | None = shared.value
        for batch in batches:
            buf, offsets = utf8(batch.column("text"))
            out = np.zeros(batch.num_rows)
            for lo, hi in slices(offsets) if model else ():
                own = offsets[lo : hi + 1] - offsets[lo]
                out[lo:hi] = model.scores(worst(sentences(buf[offsets[lo] : offsets[hi]], own), model.weights, hi - lo))
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "score": pa.array(out, pa.float64())})

    return run


def score_toxicity(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", predicted: float = PREDICTED) -> DataFrame:
    """One row per row of ``docs``: id, score and predicted (1 from a score of ``predicted``), from the whole text alone.

    A null text and one without words have the score of a sentence without features; without a model all scores
    are 0. Repeated rows are scored alike. Other columns are not read.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("score", T.DoubleType())])
    scored = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_score(shared), schema)
    return scored.select(F.col("id").alias(id_col), "score", (F.col("score") >= predicted).cast("int").alias("predicted"))
