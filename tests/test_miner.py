"""Whole runs: the planted rule is found, runs repeat, both layouts work."""

import os
import random
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from patternloom.operators.profile import build_model
from patternloom.operators.rules import rules_table
from patternloom.plans.layout import prepare
from patternloom.plans.miner import PatternMiner


@pytest.fixture(scope="module")
def planted(spark):
    rnd = random.Random(1)
    rows = []
    for i in range(1, 1501):
        a, b, c = rnd.random(), rnd.random(), rnd.choice("pqr")
        rows.append((i, a, b, rnd.gauss(0, 1), c, "hot" if a > 0.75 and c == "q" else "cold"))
    return spark.createDataFrame(rows, "no long, a double, b double, d double, c string, kind string").cache()


def miner(**kw):
    args = dict(numeric=["a", "b", "d"], nominal=["c"], individuals=25, evaluations=300, seed=4)
    return PatternMiner("kind", **{**args, **kw})


def rows(result):
    cols = ["cls", "masks", "tp", "fp", "tn", "fn"]
    return sorted(tuple(map(str, r)) for r in result.rules.select(cols).collect())


def test_finds_the_plant_and_repeats(planted):
    first = miner().fit(planted)
    best = max(r["WRAccNorm"] for r in first.rules.collect() if r["cls"] == "hot")
    assert best > 0.95
    assert {r["cls"] for r in first.rules.collect()} == {"hot", "cold"}
    again = miner().fit(planted.repartition(3, "b"))
    assert rows(first) == rows(again)
    measured = first.evaluate(planted).collect()
    assert sorted((r["rule_id"], r["tp"], r["fp"]) for r in measured) == sorted(
        (r["rule_id"], r["tp"], r["fp"]) for r in first.rules.collect()
    )
    hits = first.match(planted, ["no", "kind"])
    assert hits.count() == sum(r["tp"] + r["fp"] for r in first.rules.collect())


def test_bitmap_layout_gives_the_same_counts(planted):
    found = miner(layout="bitmaps", rid="no", evaluations=200).fit(planted)
    got = sorted((r["rule_id"], r["tp"], r["fp"], r["tn"], r["fn"]) for r in found.rules.collect())
    again = sorted((r["rule_id"], r["tp"], r["fp"], r["tn"], r["fn"]) for r in found.evaluate(planted).collect())
    assert got == again


def test_layouts_and_partitions_restart_alike(planted):
    """Without row numbers too, every layout restarts from the same uncovered row."""
    df = planted.drop("no")
    model = build_model(df, "kind", ["a", "b", "d"], ["c"], 3)
    rules = rules_table(df.sparkSession, model, [("hot", {0: [2]}), ("cold", {3: [1]})])
    found = set()
    for layout in ("rows", "bitmaps"):
        for frame in (df, df.repartition(7)):
            laid = prepare(frame, model, layout)
            pairs = laid.uncovered_pairs(rules, model.classes).collect()
            found.add(tuple(sorted(map(tuple, pairs))))
            laid.release()
    assert len(found) == 1 and len(next(iter(found))) >= 4


def test_input_of_any_kind_is_numbered_once(spark, planted):
    """A shuffled join and more features than one slice holds."""
    keys = spark.range(1, 1501).select(F.col("id").alias("no"), F.concat(F.lit("v"), F.col("id") % 300).alias("v"))
    df = planted.repartition(5).join(keys.repartition(3), "no").drop("no")
    model = build_model(df, "kind", ["a"], ["c", "v"], 3)
    rules = rules_table(spark, model, [("hot", {2: list(range(0, 300, 2)), 0: [2]}), ("cold", {1: [1], 2: [5, 299]}), ("hot", {1: [1]})])
    got = [sorted(map(tuple, prepare(df, model, k).counts(rules).drop("masks").collect())) for k in ("rows", "bitmaps")]
    assert got[0] == got[1]


def test_workers_far_from_the_source_have_the_package(tmp_path):
    """A job started from another folder, without the source on its workers' path."""
    root = Path(__file__).resolve().parents[1]
    code = (
        f"import sys; sys.path.insert(0, {str(root)!r})\n"
        "from patternloom.session import local_session\n"
        "from patternloom.operators.ranking import nondominated_rank\n"
        "spark = local_session(1)\n"
        "df = spark.createDataFrame([(1, 'a', 1.0, 2.0), (2, 'a', 0.5, 1.0)], 'rule_id long, cls string, x double, y double')\n"
        "print(sorted(r['rank'] for r in nondominated_rank(df, ('x', 'y'), group_bound=2).collect()))\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.stdout.strip().endswith("[0, 1]"), done.stderr[-2000:]


def test_unknown_start_is_refused(planted):
    with pytest.raises(KeyError):
        miner(init="anything").fit(planted)


def test_wide_tables_are_evaluated_by_bitmaps(planted, monkeypatch):
    """The same counts, also on rows with unseen values and other classes."""
    from patternloom.plans import layout

    model = build_model(planted, "kind", ["a", "b", "d"], ["c"], 3)
    rules = rules_table(planted.sparkSession, model, [("hot", {0: [2], 3: [1]}), ("cold", {1: [0, 1]}), ("hot", {})])
    other = planted.where("no % 3 = 0").withColumn("c", F.when(F.col("no") % 5 == 0, "new").otherwise(F.col("c")))
    other = other.withColumn("kind", F.when(F.col("no") % 7 == 0, "warm").otherwise(F.col("kind")))
    got = []
    for words in (256, 2):
        monkeypatch.setattr(layout, "WIDE_WORDS", words)
        got.append(sorted(map(tuple, layout.evaluate_rules(other, rules, model).drop("masks").collect())))
    assert got[0] == got[1] and got[0][0][2] > 0
    hits = []
    for words in (256, 2):
        monkeypatch.setattr(layout, "WIDE_WORDS", words)
        hits.append(sorted(map(tuple, layout.matched_rows(other, rules, model, ["no", "kind"]).collect())))
    assert hits[0] == hits[1] and len(hits[0]) == sum(r[2] + r[3] for r in got[0])


def test_restarts_and_random_start(planted):
    found = miner(individuals=8, evaluations=200, init="random", objectives=("Confidence", "TPR")).fit(planted)
    assert found.history[-1]["evaluations"] >= 200
    assert any(h["restarted"] for h in found.history)
    assert found.rules.count() >= 2


def test_generation_follows_the_table_operators(spark, planted):
    """Children, survivors and scores of the loop are those of the operators on rule tables."""
    from patternloom.operators.contingency import score
    from patternloom.operators.encode import compact
    from patternloom.operators.generate import class_sizes, init_random, reproduce
    from patternloom.plans.miner import replace_population
    from patternloom.plans.population import Scorer, population_frame, reproduce_rules, survivors

    model = build_model(planted, "kind", ["a", "b", "d"], ["c"], 3)
    layout, rows = prepare(planted, model), compact(planted, model).cache()
    probs = {"npoint": 0.5, "hux": 0.2, "mutation": 0.3}
    for objectives, minimise in ((("Confidence", "TPR"), ()), (("WRAccNorm",), ()), (("Confidence", "TPR", "FPR"), ("FPR",))):
        search = miner(objectives=objectives, minimise=minimise, individuals=9)
        scorer = Scorer(layout, objectives, minimise, search._columns())
        first = init_random(spark, model, 18, 3).collect()
        pop = {c: [] for c in model.classes}
        for x in scorer((r["rule_id"], r["cls"], tuple(r["masks"])) for r in first):
            pop[x.cls].append(x)
        for gen in (1, 2):
            table = population_frame(pop, spark, search._schema()).cache()
            made = reproduce(table, model, probs, 7, gen, 18, class_sizes(table)).cache()
            born = reproduce_rules(pop, model, probs, 7, gen)
            assert sorted((r["rule_id"], r["cls"], tuple(r["masks"]), r["op"], r["surplus"]) for r in made.collect()) == sorted(born)
            kids = score(rows, made.where("not surplus").select("rule_id", "cls", "masks"), model, objectives).select(*search._columns())
            parents = table.select(*search._columns())
            joint = {c: list(mine) for c, mine in pop.items()}
            for x in scorer((i, c, m) for i, c, m, _, surplus in born if not surplus):
                joint[x.cls].append(x)
            pop = {c: survivors(mine, len(objectives), 9) for c, mine in joint.items()}
            want = replace_population(parents, kids, objectives, 9, minimise).select("cls", "slot", "rule_id", "rank", "crowding", *search._columns()[3:])
            got = population_frame(pop, spark, search._schema()).select(*want.columns)
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    seen = len(scorer.memo)
    assert scorer((r["rule_id"], r["cls"], tuple(r["masks"])) for r in first) and len(scorer.memo) == seen
    layout.release()


def test_front_cover_against_matching_anew(spark, planted):
    """Answers taken from earlier ones, and from kept covers, are those of matching both fronts."""
    from patternloom.plans.miner import FrontCover

    model = build_model(planted, "kind", ["a", "b", "d"], ["c"], 3)
    rng = random.Random(2)
    pool = [tuple(rng.randrange(8) if rng.random() < 0.4 else 0 for _ in range(4)) for _ in range(12)]
    for name in ("rows", "bitmaps"):
        layout = prepare(planted, model, name)
        cover, before = FrontCover(layout), {c: frozenset() for c in model.classes}
        for _ in range(8):
            now = {c: frozenset(m for m in rng.sample(pool, rng.randrange(1, 7)) if any(m)) for c in model.classes}
            tables = [
                spark.createDataFrame([(i, c, list(m)) for c in f for i, m in enumerate(f[c])], "rule_id long, cls string, masks array<long>") for f in (before, now)
            ]
            assert cover.changed(now) == {r["rule_cls"] for r in layout.newly_covered(*tables).collect()}
            before = now
        layout.release()


def test_a_search_starts_no_task_per_shuffle_partition(spark, planted):
    """Few merged rows, and covers of them, have few partitions, whatever the session gives to a shuffle."""
    model = build_model(planted, "kind", ["a", "b", "d"], ["c"], 3)
    rules = rules_table(spark, model, [("hot", {0: [2]}), ("cold", {3: [1]}), ("cold", {1: [0, 2]})])
    before, got = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (3, 300):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            layout = prepare(planted, model, "rows")
            cover = layout.cover(rules, 3).persist()
            rows = sorted(map(tuple, layout.encoded.collect())), sorted(map(tuple, cover.collect()))
            got.append((*rows, sorted(map(tuple, layout.counts(rules, 3).drop("masks").collect()))))
            assert layout.encoded.rdd.getNumPartitions() < 20
            assert cover.rdd.getNumPartitions() < 20
            cover.unpersist()
            layout.release()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1] and len(got[0][1]) > 10


def test_tables_the_driver_holds_are_part_of_the_plan(spark):
    """The same rows as a list of tuples gives, also none, and no job of as many tasks as there are cores."""
    from patternloom.session import small_table

    schema = "rule_id bigint, cls string, masks array<bigint>, x double, slot int"
    for rows in ([(1, "a", [4, 0], float("-inf"), 1), (2, None, [], None, 2), (2**62, "b", [2**60 - 1], 0.1, 3)], []):
        got, want = small_table(spark, rows, schema), spark.createDataFrame(rows, schema)
        assert got.schema == want.schema
        assert got.collect() == want.collect()
        assert "LocalTableScan" in got._jdf.queryExecution().toString()
