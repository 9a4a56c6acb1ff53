import base64
import random
import re
from collections import Counter

import tiktoken

from patternloom.llm import queries
from patternloom.llm.rollup import KEYS, PATTERN, Rollup, deletes, inserts, revisions

SCHEMA = "source string, lang string, version string, n_tokens long, new_tokens long"


def test_batches_against_counting(spark, tmp_path):
    rng = random.Random(8)
    rollup, want = Rollup.create(spark, str(tmp_path / "rollup")), Counter()
    held = [(rng.choice(["a", "b", None]), rng.choice(["x", None]), "1", rng.randrange(9), rng.randrange(9)) for _ in range(40)]
    frame = spark.createDataFrame(held, SCHEMA)
    assert rollup.commit("one", inserts(frame)) and not rollup.commit("one", inserts(frame))
    assert Rollup(spark, rollup.folder).commit("two", revisions(frame.limit(40)))
    gone = spark.createDataFrame([(*r[:3], r[4], 0) for r in held if r[0] == "a"], SCHEMA)
    rollup.commit("three", deletes(gone))
    assert not rollup.commit("two", revisions(frame)) and rollup.generation() == 3
    for r in held:
        if r[0] != "a":
            want[r[:3]] += r[4]
    got = {tuple(r[k] for k in KEYS): (r.n_docs, r.n_tokens) for r in rollup.totals().collect()}
    assert {k: v[1] for k, v in got.items()} == want
    assert sum(v[0] for v in got.values()) == sum(r[0] != "a" for r in held)
    # An attempt that died before its ledger entry counts for nothing.
    frame.select(*KEYS).limit(0).selectExpr("*", "1L as n_docs", "1L as n_tokens").write.parquet(f"{rollup.folder}/totals/4")
    assert {tuple(r[k] for k in KEYS) for r in rollup.totals().collect()} == set(got)
    assert rollup.commit("four", inserts(frame.limit(0))) and rollup.totals().count() == len(got)


def test_query_against_counting(spark):
    sf = "/root/testdata/sf0.001"
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(queries.TOKENIZER, "rb"))}
    bpe = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    last = {re.sub("[A-Z]", lambda m: m[0].lower(), r.text): r.doc_id for r in sorted(rows)}
    want = Counter()
    for r in rows:
        if r.doc_id in last.values():
            want[r.source, r.lang, "bpe-50k"] += len(bpe.encode_ordinary(r.text))
            want[r.source, r.lang, "words"] += len(re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", r.text))
    got = {tuple(r[k] for k in KEYS): r.n_tokens for r in queries.op7_token_rollup(spark, sf).collect()}
    assert got == dict(want)


def test_query_with_repeated_and_missing_ids(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.choice([None, *range(6)]), rng.choice(["a b", "A b", "x-y z", "", None, "q " * 20]), rng.choice(["s", None]), "en") for _ in range(50)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    lowered = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    best = {}
    for i, t, *_ in rows:
        best[lowered(t)] = max(best.get(lowered(t), -1), -1 if i is None else i)
    kept = [r for r in rows if (-1 if r[0] is None else r[0]) == best[lowered(r[1])]]
    want = {s: (sum(r[2] == s for r in kept), sum(len(re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", r[1] or "")) for r in kept if r[2] == s)) for s in ("s", None)}
    got = {r.source: (r.n_docs, r.n_tokens) for r in queries.op7_token_rollup(spark, str(tmp_path)).where("version = 'words'").collect()}
    assert got == want
