"""Importance resampling against brute force, with the odd cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from patternloom.llm.resample import crc32_runs, kth_key, resample

SCHEMA = "doc_id long, text string, score string, rank int, tie double, `a.b` int"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def runs(text, order):
    ws = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(ws), [" ".join(ws[i : i + k]) for k in range(1, order + 1) for i in range(len(ws) - k + 1)]


def brute(docs, target, order, buckets, least, percent, seed):
    place = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(place(f) for _, t in docs for f in runs(t, order)[1])
    t = Counter(place(f) for x in target for f in runs(x, order)[1])
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + buckets) / ((s[b] + 1) * (sum(t.values()) + buckets)))) for b in range(buckets)}
    out = []
    for i, text in docs:
        n, found = runs(text, order)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[place(f)] for f in found)
        out.append((i, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    drawn = len(able) * percent // 100
    return Counter([(*r, k + 1) for k, r in enumerate(able[:drawn])] + [(*r, None) for r in able[drawn:]] + [(*r, None) for r in out if r[1] < least])


@pytest.mark.parametrize("order, least, percent", [(1, 5, 30), (2, 1, 50), (3, 0, 100), (1, 10**9, 10)])
def test_against_brute_force(spark, order, least, percent):
    rng = random.Random(order)
    vocabulary = ["One", "two", "é", "thr33", "x" * 60, "Ünd", "a"]
    docs = [(k, "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n"]) for _ in range(rng.randrange(30)))) for k in range(60)]
    docs += [(None, "one two é"), (61, None), (62, ""), (63, " .. "), (64, "one two " * 20_000), (65, "Y" * 5000), (3, docs[3][1]), (3, docs[3][1])]
    target = ["two é", None, "", "thr33 " * 9, "zzz a"]
    frame = spark.createDataFrame([(i, t, "s", 1, 0.5, 2) for i, t in docs], SCHEMA).repartition(3)
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    got = resample(frame, bench, order=order, buckets=64, least=least, percent=percent, seed="s")
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert Counter(tuple(r) for r in got.collect()) == brute(docs, target, order, 64, least, percent, "s")


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame([(1, "one two", "s", 1, 0.5, 2)], SCHEMA)
    assert resample(none, some).count() == 0
    assert [tuple(r) for r in resample(some, none, least=1, percent=100, buckets=8).select("doc_id", "n_words", "rank").collect()] == [(1, 2, 1)]


@pytest.mark.parametrize("pivots", [2, 32])
def test_kth_key_of_ties_and_nulls(spark, pivots):
    rng = random.Random(pivots)
    rows = [(rng.choice([None, 1, 2, 3]), rng.choice(["a", "b", None])) for _ in range(50)]
    frame = spark.createDataFrame(rows, "x long, y string").repartition(3)
    ordered = sorted(rows, key=lambda r: tuple((v is not None, v or 0 if i == 0 else v or "") for i, v in enumerate(r)))
    for k in (1, 17, 50):
        assert tuple(kth_key(frame, ["x", "y"], k, pivots)) == ordered[k - 1]
    assert kth_key(frame, ["x", "y"], 51, pivots) is None and kth_key(frame, ["x", "y"], 0, pivots) is None
    assert kth_key(frame.limit(0), ["x", "y"], 1, pivots) is None


def test_crc_of_runs():
    rng = np.random.default_rng(1)
    buf = rng.integers(0, 256, 5000, dtype=np.uint8)
    starts = rng.integers(0, 4000, 300)
    ends = starts + rng.integers(0, 90, 300)
    assert crc32_runs(buf, starts, ends).tolist() == [zlib.crc32(buf[a:b].tobytes()) for a, b in zip(starts, ends)]
