"""Operators on documents against brute force, with the odd cases."""

import hashlib
import random
import re
from itertools import combinations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from patternloom.llm import near
from patternloom.llm.decontaminate import drop_contaminated, find_contamination
from patternloom.llm.exact import drop_copies, find_copies
from patternloom.llm.langid import fit, held_out, identify
from patternloom.llm.licenses import TEMPLATES, align, increasing, scan_licenses
from patternloom.llm.mixing import mix_sources, water_fill
from patternloom.llm.near import drop_near, near_groups
from patternloom.llm.pii import find_personal_data, train_field
from patternloom.llm.rollup import Runs, count_tokens

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, kept string, n_words string, _key string, rejected int"
LONG = " ".join(f"w{k % 5000}" for k in range(60_000))


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, names of outputs."""
    rows = [
        (0, "One two three four five six", "en", "a"), (0, "One two three four five six", "en", "a"), (1, "one TWO three four five six", "fr", None),
        (2, None, None, "b"), (3, "", "en", "b"), (None, "one two three four five six", None, None), (None, None, None, None),
        (4, LONG, "en", "a"), (5, LONG + " end", "en", "a"), (6, " \t\n", "de", "c"), (7, "ÉÈ é", "fr", "c"), (8, "9 + 9", "en", "c"), (9, "word", "en", "é"),
    ]
    data = [(i, t, lang, s, None, "7", "x", None, "k", 1) for i, t, lang, s in rows]
    return spark.createDataFrame(data, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_contamination_of_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([("i1", "TWO three"), ("i2", "w3 " * 20), (None, "é"), ("i3", None), ("i1", "four")], "item_id string, text string")
    long_item = " ".join(f"w{k}" for k in range(20))
    bench = bench.union(spark.createDataFrame([("i9", long_item)], bench.schema))
    for blocks in (1 << 20, 40):  # in one pass, and in several
        got = {(r.doc_id, r.n_words): r for r in find_contamination(odd, bench, block_bytes=blocks).collect()}
        assert got[0, 6].items == ["i1"] and got[0, 6].n_hit == 3 and got[0, 6].contaminated
        assert [tuple(s) for s in got[0, 6].spans] == [(1, 4)]
        assert got[None, 6].n_hit == 3 and got[None, 0].n_hit == 0
        assert got[4, 60_000].n_hit == 20 * 12 and got[4, 60_000].items == ["i9"] and not got[4, 60_000].contaminated
        assert got[7, 2].n_hit == 1 and got[7, 2].items == []
        assert got[2, 0].n_words == 0 and not got[2, 0].contaminated and got[2, 0].items == []
    assert find_contamination(none, bench).count() == 0
    assert find_contamination(odd, bench.limit(0)).where("contaminated").count() == 0
    kept = drop_contaminated(odd, bench)
    assert kept.columns == odd.columns and kept.where("doc_id = 0").count() == 0 and kept.where("doc_id = 4").count() == 1


def test_windows_that_touch_across_documents(spark):
    a, b = (" ".join(f"{c}{k}" for k in range(13)) for c in "xy")
    texts = [a, b, a + " tail", "head " + b, a, b + " " + "filler " * 400, "", a, b + " " + a]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame([("i1", a), ("i2", b)], "item_id string, text string")
    want = [[(0, 13)], [(0, 13)], [(0, 13)], [(1, 14)], [(0, 13)], [(0, 13)], [], [(0, 13)], [(0, 26)]]
    for blocks in (1 << 20, 40):
        got = {r.doc_id: r for r in find_contamination(docs, bench, block_bytes=blocks).collect()}
        assert [[tuple(s) for s in got[k].spans] for k in range(len(texts))] == want
        assert all(r.n_hit == sum(e - s for s, e in r.spans) <= r.n_words for r in got.values())
        assert [k for k in got if not got[k].contaminated] == [5, 6]
    assert sorted(r.doc_id for r in drop_contaminated(docs, bench).collect()) == [5, 6]


def test_copies_of_odd_rows(spark, odd, none):
    rows = odd.collect()
    got = find_copies(odd, every_digest=True).collect()
    groups = {}
    for r in rows:
        groups.setdefault(lowered(r.text), []).append(r.doc_id)
    want = sorted(
        (str(i), str(max((x for x in ids if x is not None), default=None)), len(ids), hashlib.sha256(t.encode()).hexdigest())
        for t, ids in groups.items()
        for i in ids
    )
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.digest) for r in got) == want
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)
    kept = drop_copies(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 5, 6, 7, 8, 9]
    assert find_copies(none).count() == drop_copies(none).count() == 0


def shingles(text, width):
    w = lowered(text).encode().split()
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def brute_components(rows, width, percent=80):
    sets = {i: shingles(t, width) for i, t in rows}
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            label[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize("blocks, width", [(512, 4), (4, 5)])
def test_near_copies_against_all_pairs(spark, monkeypatch, blocks, width):
    """Families whose members are just above and below the threshold, linked in chains."""
    monkeypatch.setattr(near, "BLOCK_DOCS", blocks)
    rng = random.Random(3)
    rows = []
    for _ in range(4):
        words = [f"v{rng.randrange(4000)}" for _ in range(rng.choice([9, 40, 160]))]
        for _ in range(30):
            if rng.random() < 0.5:
                k = rng.randrange(len(words))
                words = words[:k] + [f"v{rng.randrange(4000)}"] + words[k + 1 :]
            copy = [w if rng.random() > 0.01 else "edit" for w in words]
            rows.append((len(rows), " ".join(copy).upper() if rng.random() < 0.3 else "  ".join(copy)))
    rows += [(len(rows) + k, t) for k, t in enumerate(["", None, "a", "A", "a b", "a b c d", "a b c d e"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_groups(docs, shingle=width).collect()}
    assert got == brute_components(rows, width)
    assert len({c for _, c in got.values()}) < len(rows)


def test_near_copies_of_odd_rows(odd, none):
    got = near_groups(odd).collect()
    assert len(got) == 13
    assert {(r.doc_id, r.component_id) for r in got if r.n_shingles == 2} == {(0, 0), (1, 0), (None, 0)}
    assert {(r.doc_id, r.component_id) for r in got if r.n_shingles > 100} == {(4, 4), (5, 4)}
    assert all(r.doc_id == r.component_id for r in got if r.n_shingles == 0)
    kept = drop_near(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {0, 2, 3, None, 4, 6, 7, 8, 9}
    assert near_groups(none).count() == drop_near(none).count() == 0


def test_mix_of_odd_rows(spark, odd, none):
    out = mix_sources(odd)
    assert set(out.columns) == {*odd.columns, "source_size", "target", "whole", "part", "taken"}
    rows = out.collect()
    assert len(rows) == 13 and all(0 <= r.taken <= 2 * r.size for r in rows)
    sizes = {}
    for r in odd.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(lowered(r.text).encode().split())
    assert {r.source: r.source_size for r in rows} == sizes
    again = mix_sources(odd.repartition(5)).collect()
    key = lambda r: (str(r.doc_id), r.size, r.taken)
    assert sorted(map(key, rows)) == sorted(map(key, again))
    assert mix_sources(none).count() == 0


def test_mix_meets_targets_in_small_buckets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for bucket in (10_000, 7):
        got = mix_sources(docs, bucket=bucket).groupBy("source").agg(
            F.first("target").alias("target"), F.sum("taken").alias("taken"), F.max(F.expr("taken / size")).alias("most"), F.first("source_size").alias("size")
        )
        rows = got.collect()
        assert abs(sum(r.target for r in rows) - 1.5 * sum(r["size"] for r in rows)) < 1e-3
        assert all(abs(r.taken - r.target) <= 50 / bucket + 2 and r.most <= 2 for r in rows)


def test_water_fill_against_bisection(spark):
    rng = random.Random(1)
    rows = [(k, float(rng.choice([5, 2, 1])), float(rng.randrange(0, 1000))) for k in range(60)]
    total = 0.7 * sum(r[2] for r in rows)
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(w * mid, c) for _, w, c in rows) < total else (low, mid)
    got = {r.k: r.target for r in water_fill(spark.createDataFrame(rows, "k int, weight double, cap double"), total).collect()}
    assert all(abs(got[k] - min(w * low, c)) < 1e-6 for k, w, c in rows)


def test_language_on_held_out_rows(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    rows = identify(docs.where(held_out(F.col("doc_id"))), model).collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    assert sum(r.rejected for r in rows) <= 0.02 * len(rows)
    right = [r.lang == r.lang_pred for r in rows]
    assert abs(sum(r.score for r in rows) / len(rows) - sum(right) / len(right)) < 0.05
    again = identify(docs.repartition(3), fit(docs.repartition(5).where(~held_out(F.col("doc_id"))))).where(held_out(F.col("doc_id")))
    assert {(r.doc_id, r.lang_pred) for r in rows} == {(r.doc_id, r.lang_pred) for r in again.collect()}
    out = identify(odd, model)
    assert set(out.columns) == {*odd.columns, "lang_pred", "score"}
    for r in out.collect():
        none_found = not re.search(r"[^\W\d_]", r.text or "")
        assert (r.lang_pred == "und" and r.score == 0 and r.rejected) if none_found else r.lang_pred in model.languages
    assert fit(none) is None and identify(none, model).count() == 0
    assert {r.lang_pred for r in identify(odd, None).collect()} == {"und"}


def test_every_language_is_learnt(spark):
    """More languages than one sample can treat alike, rare ones beside a large one, and one row repeated without an id."""
    words = {f"l{n:03}": [f"{chr(97 + n // 26 % 26)}{chr(97 + n % 26)}{x}" for x in ("qua", "zem", "tro")] for n in range(230)}
    rows = [(n * 10 + k, " ".join(w[k % 3 :] + w) * 4, lang) for n, (lang, w) in enumerate(words.items()) for k in range(6)]
    rows += [(100_000 + k, f"{k} xylo phon {k % 7}", "many") for k in range(3000)] + [(None, "vlk vlk vlk", "same")] * 900
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = fit(docs)
    assert model.languages == sorted({*words, "many", "same"})
    got = identify(docs, model).collect()
    got = [r for r in got if r.lang != "same"]
    assert {r.lang_pred for r in got if r.lang == r.lang_pred} == {*words, "many"}
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)
    few = fit(docs, total=300)  # one row of each: all are still there
    assert few.languages == model.languages


def test_personal_data_of_odd_rows(odd, none):
    assert all(r.spans == [] for r in find_personal_data(odd, train_field(odd)).collect())
    assert train_field(none) is None and find_personal_data(none, None).count() == 0


def test_patience():
    rng = random.Random(2)
    for _ in range(200):
        values = [rng.randrange(12) for _ in range(rng.randrange(9))]
        best = max((len(c) for n in range(len(values) + 1) for c in combinations(values, n) if list(c) == sorted(set(c))), default=0)
        places = increasing(values)
        assert len(places) == best and [values[p] for p in places] == sorted({values[p] for p in places})
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(12))] for _ in range(2))
        pairs = align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p < r and q < s for (p, q), (r, s) in zip(pairs, pairs[1:]))
        assert len(align(a, a)) == len(a)


def test_licenses(spark, odd, none):
    header = TEMPLATES["Apache-2.0-header"]
    texts = {
        1: "xx " * 500 + "released UNDER the mit\nlicense. " + "yy " * 300 + "Released under the MIT License.",
        2: header.replace("agreed", "agred").replace("AS IS", "as  is") + " tail",
        3: "the license under version of the work", 4: " ".join(TEMPLATES.values()), 5: "",
    }
    got = {r.doc_id: r for r in scan_licenses(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert [(x.license, x.coverage, x.start, x.end) for x in got[1].licenses] == [("MIT", 1.0, 500, 505), ("MIT", 1.0, 805, 810)]
    assert {x.license for x in got[2].licenses} == {"Apache-2.0", "Apache-2.0-header"}
    assert max(x.coverage for x in got[2].licenses if x.license == "Apache-2.0-header") > 0.97
    assert got[3].licenses == [] and got[5].licenses == [] and got[5].n_words == 0
    assert {x.license for x in got[4].licenses} == set(TEMPLATES)
    assert all(r.licenses == [] for r in scan_licenses(odd).collect()) and scan_licenses(none).count() == 0
    assert scan_licenses(odd, {}).count() == 13


def test_token_counts_of_odd_rows(odd, none):
    rows = count_tokens(odd, {"words": Runs(r"\S+")}).collect()
    assert sorted(r.n_tokens for r in rows) == sorted(len((r.text or "").split()) for r in odd.collect())
    assert count_tokens(none, {"words": Runs(r"\S+")}).count() == 0


def test_stages_take_odd_and_no_rows(spark, odd, none):
    for docs in (odd, none):
        documents = docs.select("doc_id", "text", "lang", "source", "n_chars")
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, documents, SF)
            assert out.columns[:5] == documents.columns or name == "mixing"
            assert out.count() <= documents.count()


def test_pipeline_against_brute_force(spark):
    """All stages but the trained one, recomputed in Python from what the first leaves."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = corpus_pipeline.known_language(spark, docs, sf).collect()
    assert len(first) >= 0.99 * docs.count()
    last = {}
    for r in first:
        last[lowered(r.text)] = max(r.doc_id, last.get(lowered(r.text), -1))
    rows = {r.doc_id: r.text for r in first if last[lowered(r.text)] == r.doc_id}
    rows = {i: rows[i] for i, (_, c) in brute_components(list(rows.items()), 5).items() if i == c}
    windows = {}
    pattern = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    for item in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = pattern.findall(lowered(item.text))
        for k in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(len(w[k : k + 13]), set()).add(tuple(w[k : k + 13]))
    clean = {}
    for i, t in rows.items():
        w = pattern.findall(lowered(t))
        hit = {k + j for n, found in windows.items() for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in found for j in range(n)}
        if not hit or 20 * len(hit) < len(w):
            clean[i] = t
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id: r.text for r in got} == clean
    assert {r.doc_id: r["size"] for r in got} == {i: len(t.encode().split()) for i, t in clean.items()}
    assert abs(sum(r.taken for r in got) - 1.5 * sum(r["size"] for r in got)) < 100


CLASHES = "doc_id long, text string, lang string, source string, _source int, _rest int, _buckets int, _cut int, _mix_key int, _keep int, _near_id int, _lang_text int, _html int, id int, c0 int, digest int, `a.b` int"


def test_columns_of_any_name_in_every_stage(spark):
    texts = ["one two three four five six seven"] * 3 + ["One two three four five six seven", "eight nine ten eleven twelve", "w " * 30]
    rows = [(k, t, "en", "a", *range(13)) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, CLASHES)
    bench = spark.createDataFrame([("i", "x y z")], "item_id string, text string")
    for out in (drop_copies(docs), drop_near(docs), drop_contaminated(docs, bench), identify(docs, fit(docs)).drop("lang_pred", "score", "rejected")):
        assert out.columns == docs.columns and all(tuple(r)[4:] == tuple(range(13)) for r in out.collect())
    mixed = mix_sources(docs)
    assert mixed.columns[: len(docs.columns)] == docs.columns and mixed.count() == 6
    assert sorted(r.doc_id for r in drop_copies(docs).collect()) == [3, 4, 5]


def test_drop_copies_keeps_what_find_copies_keeps(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, *range(8)]), rng.choice(["x", "X", "y", "zz", "zZ", "", None, "long " * 50])) for _ in range(60)] + [(5, "x"), (9, "x"), (5, "y"), (3, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = sorted(str(r.doc_id) for r in find_copies(docs).where("kept").collect())
    left = drop_copies(docs).collect()
    assert sorted(str(r.doc_id) for r in left) == kept
    best = {}
    for i, t in rows:
        best[lowered(t)] = max(best.get(lowered(t), -1), -1 if i is None else i)
    assert all((-1 if r.doc_id is None else r.doc_id) == best[lowered(r.text)] for r in left)


def test_mix_meets_its_target_without_ids(spark):
    rows = [(None, " ".join(f"w{k}" for k in range(1 + n % 13)), "a") for n in range(200)] + [(n, "x y z", s) for n, s in enumerate("bbbcccc")]
    rows += [(7000, "one two three four", "a")] * 20
    got = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for source in "abc":
        mine = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 30 and all(r.taken <= 2 * r["size"] for r in mine)


def test_letters():
    from patternloom.llm.langid import has_letter

    assert all(map(has_letter, ["a", "½ é", "9漢"])) and not any(map(has_letter, ["", "½", "² 9", "_", "①"]))


def test_long_words_that_the_polynomial_cannot_part(spark):
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, f"{word} {word}x"), (2, f"{other} {other}x"), (3, f"{word} {word}x")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_groups(docs).collect()} == {1: 1, 2: 2, 3: 1}
    bench = spark.createDataFrame([("i", word)], "item_id string, text string")
    assert {r.doc_id: r.n_hit for r in find_contamination(docs, bench).collect()} == {1: 1, 2: 0, 3: 1}
