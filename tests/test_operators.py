"""Operators against brute force on small fixtures, and plans against each other."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from patternloom.functions.measures import MEASURES, measure_violations, register_measure, with_measures
from patternloom.operators import coverage as cov
from patternloom.operators import ranking
from patternloom.operators.bitmaps import (
    first_uncovered_bitmap,
    newly_covered_bitmap,
    token_competition_bitmap,
    uncovered_pairs_bitmap,
    wide_lut,
)
from patternloom.operators.contingency import contingency, contingency_bitmap, score
from patternloom.operators.encode import compact, encode_items, signatures
from patternloom.operators.generate import init_random
from patternloom.operators.profile import build_model
from patternloom.operators.rules import mask_predicate, pair_rules, rule_predicate, rules_table, single_rules
from patternloom.operators.selection import token_competition
from patternloom.plans.layout import BitmapLayout, RowLayout

COUNTS = ("tp", "fp", "tn", "fn")


@pytest.fixture(scope="module")
def table(spark):
    """Three numeric columns, a nominal one of 130 values, gaps, and a class tied to x."""
    rnd = random.Random(3)
    rows = []
    for i in range(1, 601):
        x, y = rnd.random(), rnd.randint(0, 8)
        kind = "hot" if x > 0.7 and y > 3 else rnd.choice(["cold", "mild"])
        rows.append(
            (i, None if i % 11 == 0 else x, float(y), float("nan") if i % 13 == 0 else rnd.gauss(0, 1),
             None if i % 17 == 0 else f"v{rnd.randint(0, 129):03d}", kind)
        )
    return spark.createDataFrame(rows, "no long, x double, y double, z double, tag string, kind string").repartition(5).cache()


@pytest.fixture(scope="module")
def model(table):
    return build_model(table, "kind", ["x", "y", "z"], ["tag"])


@pytest.fixture(scope="module")
def rows(table, model):
    return [r.asDict() for r in encode_items(table, model, ["no"]).orderBy("no").collect()]


def listed_rules(model, n=60, seed=5):
    rnd = random.Random(seed)
    out = [("hot", {}), ("mild", {0: [0, 1, 2]})]
    while len(out) < n:
        cond = {}
        for v in rnd.sample(range(4), rnd.randint(1, 3)):
            k = model.attributes[v].n_values
            cond[v] = sorted(rnd.sample(range(k), rnd.randint(1, max(1, k * 2 // 3))))
        out.append((rnd.choice(model.classes), cond))
    return out


def covers(model, masks, row):
    some = False
    for a in model.attributes:
        words = model.var_words[a.pos]
        chosen = sum(bin(masks[i]).count("1") for i in words)
        if not 0 < chosen < a.n_values:
            continue
        some = True
        if not any(masks[i] & row[f"m{i}"] for i in words):
            return False
    return some


def brute_counts(model, listed, rows):
    out = []
    for cls, cond in listed:
        masks = model.mask(cond)
        cell = dict.fromkeys(COUNTS, 0)
        for r in rows:
            hit, own = covers(model, masks, r), r["cls"] == cls
            cell["tp" if hit and own else "fp" if hit else "fn" if own else "tn"] += 1
        out.append(tuple(cell[c] for c in COUNTS))
    return out


def ordered(df, cols=COUNTS):
    return [tuple(r[c] for c in cols) for r in df.orderBy("rule_id").collect()]


def test_long_domain_is_split(model):
    assert model.attributes[3].n_values == 130
    assert [w.bits for w in model.words] == [3, 3, 3, 44, 43, 43]


def test_missing_values_are_wildcards(model, rows):
    assert rows[10]["m0"] == 7 and rows[12]["m2"] == 7
    assert [rows[16][f"m{i}"] for i in (3, 4, 5)] == [w.full for w in model.words[3:]]


def test_counts_of_all_layouts(spark, table, model, rows):
    listed = listed_rules(model)
    rules = rules_table(spark, model, listed)
    want = brute_counts(model, listed, rows)
    encoded = encode_items(table, model, ["no"])
    assert ordered(contingency(encoded, rules, model)) == want
    assert ordered(contingency(signatures(encoded, model), rules, model)) == want
    assert ordered(contingency(compact(table, model), rules, model)) == want
    lut = wide_lut(table, model, "no").cache()
    assert ordered(contingency_bitmap(lut, rules, model, encoded=encoded)) == want


def test_large_rule_index_is_broadcast_in_slices(spark, table, model, rows, monkeypatch):
    listed = listed_rules(model)
    rules = rules_table(spark, model, listed)
    monkeypatch.setattr(cov, "BROADCAST_LIMIT", len(listed) * cov.index_expansion(model) * (64 + 8 * model.n_words) // 3)
    encoded = encode_items(table, model)
    assert ordered(contingency(encoded, rules, model)) == brute_counts(model, listed, rows)
    plan = cov.match_rules(encoded, rules, model)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") >= 4 and "hashpartitioning" not in plan  # rows are not moved


def test_many_rules_are_taken_in_slices_of_bitmaps(spark, table, model, rows, monkeypatch):
    listed = listed_rules(model)
    rules = rules_table(spark, model, listed)
    monkeypatch.setattr(cov, "BROADCAST_LIMIT", len(listed) * sum(a.n_values for a in model.attributes) * 15)
    lut = wide_lut(table, model, "no").cache()
    got = contingency_bitmap(lut, rules, model, class_totals=dict(zip(model.classes, model.class_counts)))
    assert ordered(got) == brute_counts(model, listed, rows)


def test_attributes_in_several_chunks(spark, table, model, rows, monkeypatch):
    from patternloom.operators import bitmaps

    monkeypatch.setattr(bitmaps, "ATTRIBUTE_CHUNK", 2)
    listed = listed_rules(model)
    got = contingency_bitmap(
        wide_lut(table, model, "no"), rules_table(spark, model, listed), model, encoded=encode_items(table, model)
    )
    assert ordered(got) == brute_counts(model, listed, rows)


def test_unseen_values_and_classes(spark, table, model):
    other = table.limit(5).withColumn("tag", F.lit("never")).withColumn("kind", F.lit("new"))
    rules = rules_table(spark, model, [("hot", {3: [1]}), ("hot", {3: list(range(130))}), ("hot", {0: [0, 1]})])
    got = ordered(contingency(encode_items(other, model), rules, model))
    assert got[0] == (0, 0, 5, 0) and got[1] == (0, 0, 5, 0)
    assert got[2][0] == 0 and got[2][3] == 0


def test_raw_predicate_equals_mask_predicate(spark, table, model):
    encoded = encode_items(table, model, ["no"])
    for cls, cond in listed_rules(model, 12):
        masks = model.mask(cond)
        a = {r[0] for r in table.where(rule_predicate(model, masks)).select("no").collect()}
        b = {r[0] for r in encoded.where(mask_predicate(model, masks)).select("no").collect()}
        assert a == b, cond


def test_raw_predicate_reaches_the_scan(spark, table, model, tmp_path):
    table.write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = df.where(rule_predicate(model, model.mask({1: [2], 3: [4]}), nan_free=True))
    text = plan._jdf.queryExecution().executedPlan().toString()
    pushed = text[text.index("PushedFilters") :]
    assert "GreaterThanOrEqual(y" in pushed and "tag" in pushed


def sequential_tokens(model, scored, rows):
    kept = set()
    for cls in model.classes:
        mine = sorted(
            (r for r in scored if r["cls"] == cls),
            key=lambda r: (-round(r["WRAccNorm"], 12), r["_active"], r["rule_id"]),
        )
        tokens, won = set(), []
        for r in mine:
            own = {x["no"] for x in rows if x["cls"] == cls and covers(model, r["masks"], x)}
            if own - tokens:
                won.append(r["rule_id"])
            tokens |= own
        kept |= set(won or [m["rule_id"] for m in mine[:1]])
    return kept


def test_token_competition_is_the_sequential_loop(spark, table, model, rows):
    listed = listed_rules(model, 80, 9)
    scored = score(compact(table, model), rules_table(spark, model, listed), model)
    local = [r.asDict() for r in scored.collect()]
    for r in local:
        used = [
            sum(bin(r["masks"][i]).count("1") for i in model.var_words[a.pos]) for a in model.attributes
        ]
        r["_active"] = sum(c for c, a in zip(used, model.attributes) if 0 < c < a.n_values)
    want = sequential_tokens(model, local, rows)
    got = {r["rule_id"] for r in token_competition(compact(table, model), scored, model).collect()}
    lut = wide_lut(table, model, "no").cache()
    bitmap = {r["rule_id"] for r in token_competition_bitmap(lut, scored, model).collect()}
    assert got == want and bitmap == want


def test_newly_covered_and_first_uncovered(spark, table, model, rows):
    listed = [r for r in listed_rules(model, 40) if r[1]]
    rules = rules_table(spark, model, listed)
    old, now = rules.where("rule_id < 8"), rules.where("rule_id >= 8 and rule_id < 16")
    want = {}
    for cls in model.classes:
        hit = lambda part: {
            r["no"] for r in rows for c, cond in part if c == cls and covers(model, model.mask(cond), r)
        }
        if fresh := hit(listed[8:16]) - hit(listed[:8]):
            want[cls] = len(fresh)
    lut = wide_lut(table, model, "no").cache()
    assert {r["rule_cls"]: r["n"] for r in newly_covered_bitmap(lut, old, now, model).collect()} == want
    for encoded, merged in ((compact(table, model), True), (encode_items(table, model), False)):
        layout = RowLayout(encoded, model, {}, merged)
        assert {r["rule_cls"]: r["n"] for r in layout.newly_covered(old, now).collect()} == want
    flags = [cov.cover_flags(e, {"old": old, "now": now}, model) for e in (compact(table, model), encode_items(table, model))]
    summed = [sorted(map(tuple, f.groupBy("cls", "old", "now").agg(F.sum("n")).collect())) for f in flags]
    assert summed[0] == summed[1]

    cls = "cold"
    own = [model.mask(cond) for c, cond in listed[:8] if c == cls]
    free = [r for r in rows if r["cls"] == cls and not any(covers(model, m, r) for m in own)]
    mine = old.where(F.col("cls") == cls)
    first = cov.first_uncovered(compact(table, model, "no"), mine, model, cls).head()[0]
    assert first == free[0]["no"]
    at = first_uncovered_bitmap(lut, mine, model, cls).head()
    assert (at["bucket"] - 1) * 32768 + at["row"] + 1 == first
    features = {
        (w.var, w.first + b) for i, w in enumerate(model.words) for b in range(w.bits) if free[0][f"m{i}"] >> b & 1
    }
    for layout in (RowLayout(compact(table, model, "no"), model, {}), BitmapLayout(lut, model, {})):
        pairs = layout.uncovered_pairs(old, [cls]).collect()
        assert {(r["var"], r["val"]) for r in pairs if r["cls"] == cls} == features
    assert uncovered_pairs_bitmap(lut, old, model, []).count() == 0


# -- ranking -----------------------------------------------------------------


def points(spark, n, k, seed, groups=("a", "b"), grid=8):
    rnd = random.Random(seed)
    rows = [(i, rnd.choice(groups), *[rnd.randint(0, grid) / grid for _ in range(k)]) for i in range(n)]
    names = [f"o{i}" for i in range(k)]
    schema = "rule_id long, cls string, " + ", ".join(f"{x} double" for x in names)
    return spark.createDataFrame(rows, schema), rows, names


def brute_ranks(rows):
    dom = lambda a, b: all(x >= y for x, y in zip(a, b)) and any(x > y for x, y in zip(a, b))
    out, left, level = {}, list(rows), 0
    while left:
        front = [r for r in left if not any(s[1] == r[1] and dom(s[2:], r[2:]) for s in left)]
        out.update({r[0]: level for r in front})
        done = {r[0] for r in front}
        left = [r for r in left if r[0] not in done]
        level += 1
    return out


@pytest.mark.parametrize("k", [1, 2, 3])
def test_fronts_and_ranks(spark, k, monkeypatch):
    df, rows, names = points(spark, 250, k, k)
    want = brute_ranks(rows)
    front = {r["rule_id"] for r in ranking.pareto_front(df, names).collect()}
    assert front == {i for i, level in want.items() if level == 0}
    for bound in (None, 250):
        got = {r["rule_id"]: r["rank"] for r in ranking.nondominated_rank(df, names, group_bound=bound).collect()}
        assert got == want
    monkeypatch.setattr(ranking, "GROUP_LIMIT", 5)
    monkeypatch.setattr(ranking, "PAIR_LIMIT", 9)
    if k < 3:  # sorted and, with two objectives, piled in slices that cut groups
        got = {r["rule_id"]: r["rank"] for r in ranking.nondominated_rank(df, names).collect()}
        assert got == want
    front = {r["rule_id"] for r in ranking.pareto_front(df, names).collect()}
    assert front == {i for i, level in want.items() if level == 0}
    peeled = ranking.nondominated_rank(df, names, max_rank=1)
    assert {r["rule_id"]: r["rank"] for r in peeled.collect() if r["rank"] is not None} == {
        i: level for i, level in want.items() if level <= 1
    }


def test_minimised_objective(spark):
    df, rows, names = points(spark, 120, 2, 11)
    turned = [(*r[:3], -r[3]) for r in rows]
    got = {r["rule_id"] for r in ranking.pareto_front(df, names, minimise=("o1",)).collect()}
    assert got == {i for i, level in brute_ranks(turned).items() if level == 0}


# -- measures ------------------------------------------------------------------


TABLES = [
    (0, 0, 0, 0), (5, 0, 0, 0), (0, 5, 0, 0), (0, 0, 5, 5), (5, 0, 5, 0), (5, 5, 0, 0), (1, 2, 3, 4), (10**9,) * 4,
]


def test_degenerate_measures(spark):
    df = spark.createDataFrame(TABLES, "tp long, fp long, tn long, fn long")
    got = {tuple(r[c] for c in COUNTS): r for r in with_measures(df, MEASURES).collect()}
    assert got[(5, 0, 5, 0)]["GrowthRate"] == float("inf") and got[(5, 0, 5, 0)]["IsGrowthRate"] == 1.0
    assert got[(5, 0, 0, 0)]["FPR"] == 1.0 and got[(5, 0, 0, 0)]["WRAccNorm"] == 0.0
    assert got[(0, 0, 5, 5)]["Confidence"] == 0.0 and got[(0, 0, 5, 5)]["GrowthRate"] == 0.0
    general = got[(1, 2, 3, 4)]
    assert general["TPR"] == pytest.approx(0.2) and general["FPR"] == pytest.approx(0.4)
    assert general["WRAccNorm"] == pytest.approx(general["AUC"]) == pytest.approx((1 + general["SuppDiff"]) / 2)
    assert got[(10**9,) * 4]["Accuracy"] == 0.5
    assert measure_violations(with_measures(df, MEASURES)).count() == 0


def test_violations(spark):
    df = spark.createDataFrame([(-1, 0, 1, 1), (1, 2, 3, 4)], "tp long, fp long, tn long, fn long")
    found = measure_violations(with_measures(df, MEASURES)).collect()
    assert {r["tp"] for r in found} == {-1} and "counts" in {r["measure"] for r in found}


def test_registered_measure(spark):
    register_measure("Lift", lambda tp, fp, tn, fn: MEASURES["Confidence"](tp, fp, tn, fn) * 2.0, hi=2.0)
    try:
        df = spark.createDataFrame([(1, 1, 1, 1)], "tp long, fp long, tn long, fn long")
        assert with_measures(df, ["Lift"]).head()["Lift"] == 1.0
    finally:
        MEASURES.pop("Lift")


# -- labels and candidates -------------------------------------------------------


def test_custom_labels(spark, table, model):
    """A caller's own labels replace the uniform ones and may overlap freely."""
    own = spark.createDataFrame(
        [(1, 0, "DecreasingLine", 0.0, 8.0, None), (1, 1, "IncreasingLine", 0.0, 8.0, None), (1, 2, "Triangular", 3.0, 4.0, 5.0)],
        "var int, label int, shape string, x0 double, x1 double, x2 double",
    )
    changed = model.with_labels(own)
    rows = [r.asDict() for r in encode_items(table, changed, ["no", "y"]).orderBy("no").collect()]
    assert {r["m1"] for r in rows if r["y"] == 4.0} == {4} and {r["m1"] for r in rows if r["y"] == 0.0} == {1}
    listed = listed_rules(changed, 25)
    got = ordered(contingency(encode_items(table, changed), rules_table(spark, changed, listed), changed))
    assert got == brute_counts(changed, listed, rows)


def test_candidates_do_not_depend_on_partitions(spark, model):
    a = init_random(spark, model, 200, 3).orderBy("rule_id").collect()
    b = init_random(spark, model, 200, 3).repartition(13).orderBy("rule_id").collect()
    assert a == b
    for r in a:
        assert all(0 <= m <= w.full for m, w in zip(r["masks"], model.words))


def test_rule_lists(model):
    n = sum(a.n_values for a in model.attributes)
    assert len(single_rules(model)) == n * 3
    pairs = sum(
        a.n_values * b.n_values for a, b in itertools.combinations(model.attributes, 2)
    )
    assert len(pair_rules(model)) == pairs * 3


def test_key_like_column_is_refused(table):
    with pytest.raises(ValueError, match="more than"):
        build_model(table.withColumn("id", F.col("no").cast("string")), "kind", ["x"], ["id"], max_domain=100)


def test_predicates_work_on_streams(spark, table, model, tmp_path):
    path = str(tmp_path / "s")
    table.write.parquet(path)
    masks = model.mask({1: [2]})
    stream = spark.readStream.schema(table.schema).parquet(path).where(rule_predicate(model, masks))
    q = stream.writeStream.format("memory").queryName("hits").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("hits").count() == table.where(rule_predicate(model, masks)).count() > 0


def test_many_distinct_vectors_of_one_effective_objective(spark):
    """Every vector is a front of its own; ranks come from bounded work."""
    n = 100_000
    df = spark.range(n).select(F.col("id").alias("rule_id"), F.lit("a").alias("cls"), (F.col("id") / n).alias("x"), (F.col("id") / (2 * n)).alias("y"))
    for objectives in (("x", "y"), ("x",)):
        ranked = ranking.nondominated_rank(df, objectives)
        assert ranked.where(F.col("rank") != n - 1 - F.col("rule_id")).count() == 0
        assert ranking.nondominated_rank(df, objectives, max_rank=2).where("rank is not null").count() == 3


def test_large_front_of_three_is_sieved_in_slices(spark, monkeypatch):
    rnd = random.Random(9)
    points = [(i, rnd.choice("ab"), *(rnd.randrange(12) / 8 for _ in range(3))) for i in range(400)]
    df = spark.createDataFrame(points, "rule_id long, cls string, x double, y double, z double").repartition(4)
    want = {
        p[0]
        for p in points
        if not any(o[1] == p[1] and all(a >= b for a, b in zip(o[2:], p[2:])) and o[2:] != p[2:] for o in points)
    }
    for limit in (20_000, 20):
        monkeypatch.setattr(ranking, "GROUP_LIMIT", limit)
        assert {r["rule_id"] for r in ranking.pareto_front(df, ("x", "y", "z")).collect()} == want
