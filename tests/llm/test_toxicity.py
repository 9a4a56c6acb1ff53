"""Toxicity: held-out accuracy, scores against a plain restatement, the effect of the counterfactual pairs, odd rows."""

import random
import re

import numpy as np
import pytest

from patternloom.llm.queries import op13_toxicity
from patternloom.llm.toxicity import (
    BITS, BUCKETS, LENGTHS, MOST_WORDS, PLACE, SCALE, TERMS, Model, calibrate, fit_toxicity, score_toxicity, sentences, sigmoid, swapped, worst,
)
from patternloom.llm.words import hash_words

SCHEMA = "doc_id long, text string, score string, label int, _id int, `a.b` int"


def corpus(n, seed, mention):
    """Sentences of filler; toxic ones have an insult, and ``mention`` of them a group of people too."""
    rng = random.Random(seed)
    filler = [f"wo{chr(97 + k % 26)}{k}" for k in range(200)]
    rows = []
    for k in range(n):
        toxic = k % 3 == 0
        lines = [[rng.choice(filler) for _ in range(rng.randrange(4, 12))] for _ in range(rng.randrange(1, 8))]
        if toxic:
            line = rng.choice(lines)
            line.insert(rng.randrange(len(line)), rng.choice(["blorkhead", "blorky", "Snagface"]))
            if rng.random() < mention:
                line.insert(0, "muslims")
        elif rng.random() < 0.05:
            rng.choice(lines).insert(0, "women")
        rows.append((k, ". ".join(" ".join(x) for x in lines) + ".", int(toxic)))
    return rows


def tables(spark, rows):
    docs = spark.createDataFrame([(i, t, "s", 7, 1, 2) for i, t, _ in rows], SCHEMA).repartition(3)
    return docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    known = spark.read.parquet(f"{sf}/labels.parquet").join(spark.read.parquet(f"{sf}/documents.parquet").where("lang = 'en'"), "doc_id")
    rows = op13_toxicity(spark, sf).join(known.select("doc_id", "toxic"), "doc_id", "left").collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out and r.toxic is not None]
    assert sum(r.predicted for r in held if r.toxic) >= 0.9 * sum(r.toxic for r in held)
    assert sum(r.predicted for r in held if not r.toxic) <= 0.05 * sum(1 - r.toxic for r in held)


def test_pairs_make_mentions_neutral(spark):
    docs, labels = tables(spark, corpus(900, 1, mention=0.9))
    neutral = spark.createDataFrame([(1, "Muslims woa0 wob1."), (2, "People woa0 wob1."), (3, "woc2 blorkhead wod3."), (4, "Women and the blorkish wod3")], "doc_id long, text string")
    fair, unfair = (
        {r.doc_id: r for r in score_toxicity(neutral, fit_toxicity(docs, labels, fairness=f)).collect()} for f in (1.0, 0.0)
    )
    assert unfair[1].predicted == 1  # the labels suggest it
    assert fair[1].predicted == 0 and abs(fair[1].score - fair[2].score) < 0.1 and fair[3].predicted == 1


def plain_sum(text, weights):
    """Every feature of every sentence, one at a time."""
    best = None
    for sentence in re.split(r"[.!?\n]", text):
        ws = re.findall(rb"[0-9A-Za-z\x80-\xff]+", sentence.encode())
        for at in range(0, len(ws), MOST_WORDS):
            total = 0
            for w in {bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in ws[at : at + MOST_WORDS]}:
                total += int(weights[int(hash_words([w])[0]) >> (64 - BITS)])
                padded = b"\0" + w + b"\0"
                for n in LENGTHS:
                    for i in range(len(padded) - n + 1):
                        value = 0
                        for c in padded[i : i + n]:
                            value = (value * 0x01000193 + c) & 0xFFFFFFFF
                        total += int(weights[((value ^ (value >> 15)) * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - BITS)])
            best = total if best is None else max(best, total)
    return best or 0


def test_scores_against_plain_sums():
    rng, draw = np.random.default_rng(2), random.Random(2)
    weights = rng.integers(-SCALE, SCALE, BUCKETS)
    texts = ["", "é", "...", "One two. THREE four!\nfive", "ab " * 100, "x" * 60 + " y"]
    texts += ["".join(draw.choice("aBé9 .,\n!-") for _ in range(draw.randrange(80))) for _ in range(40)]
    data = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, data)])
    buf = np.frombuffer(b"".join(data), np.uint8)
    got = worst(sentences(buf, offsets), weights, len(texts))
    assert got.tolist() == [plain_sum(t, weights) for t in texts]


def test_odd_rows(spark):
    docs, labels = tables(spark, corpus(60, 3, mention=0.0))
    long = "wob1 " * 100_000
    odd = [(None, "blorkhead"), (100, None), (101, ""), (102, " .. "), (103, long), (104, long + "blorkhead"), (105, "Q" * 200_000), (3, "blorkhead wob1"), (3, "wob1 wob1")]
    docs = docs.unionByName(spark.createDataFrame([(i, t, "s", 7, 1, 2) for i, t in odd], SCHEMA))
    more = spark.createDataFrame([(None, 1), (0, None), (100, 1), (500, 1), (6, 0)], "doc_id long, toxic int")
    model = fit_toxicity(docs, labels.unionByName(more))
    got = score_toxicity(docs, model)
    rows = {(r.doc_id, k): r for k, r in enumerate(got.collect())}
    assert got.columns == ["doc_id", "score", "predicted"] and len(rows) == 69 and all(0 <= r.score <= 1 for r in rows.values())
    score = {i: r.score for (i, _), r in rows.items()}
    assert score[100] == score[101] == score[102] < 0.3 and score[104] > score[103] and score[None] > score[101]
    assert score_toxicity(docs.limit(0), model).count() == 0
    assert fit_toxicity(docs, labels.limit(0)) is None and fit_toxicity(docs.limit(0), labels) is None
    assert {r.score for r in score_toxicity(docs, None).collect()} == {0.0}
    alike = score_toxicity(docs, fit_toxicity(docs, labels.where("toxic = 0"))).collect()
    assert len({r.score for r in alike}) == 1 and alike[0].predicted == 0


def test_swaps():
    assert all(len(set(g)) == len(g) for g in TERMS) and len(PLACE) == sum(map(len, TERMS))
    for by in range(40):
        other = swapped("The Women, and womens' men", by).split()
        assert other[0] == "the" and other[1].rstrip(",") in set(TERMS[0]) - {"women"} and other[3] == "womens'" and other[4] in set(TERMS[0]) - {"men"}


@pytest.mark.parametrize("prior", [0.1, 0.5])
def test_calibration(prior):
    rng = np.random.default_rng(4)
    y = np.arange(2000) % 2
    z = rng.normal(3 * y - 1, 2)
    slope, shift = calibrate(z, y.astype(float), prior)
    p = sigmoid(slope * z + shift)
    weight = np.where(y, prior, 1 - prior)
    assert slope > 0 and abs((weight * p).sum() / weight.sum() - prior) < 0.01
    assert Model(np.zeros(1), 0.0, slope, shift).scores(np.array([5 * SCALE]))[0] > prior
