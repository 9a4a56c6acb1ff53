import glob

import pytest
from pyspark.sql import functions as F

from patternloom.operators.contingency import contingency, score
from patternloom.operators.encode import compact, encode_items, feature_support
from patternloom.operators.profile import build_model
from patternloom.operators.rules import pair_rules, rules_table
from patternloom.plans.miner import MinedPatterns
from patternloom.sources.arff import arff_schema, read_arff
from patternloom.sources.row_index import with_row_index

TEXT = """% a comment
@relation small
@attribute size REAL
@attribute 'two words' {red, green}
@attribute count integer
@inputs size, 'two words', count
@data

1.0, red, 1, a
2.0, 'green', 2, a
% another comment
3.0, ?, 3, b
?, red, 4, b
5.0,green,5,b
"""


@pytest.fixture
def small(spark, tmp_path):
    path = tmp_path / "small.arff"
    path.write_text(TEXT.replace("@inputs", "@attribute kind {a,b}\n@inputs"))
    return read_arff(spark, str(path))


def test_schema(spark, tmp_path):
    path = tmp_path / "h.arff"
    path.write_text(TEXT)
    fields = [(f.name, f.dataType.simpleString()) for f in arff_schema(spark, str(path)).fields]
    assert fields == [("size", "double"), ("two words", "string"), ("count", "double")]


def test_rows(small):
    assert [tuple(r) for r in small.orderBy("count").collect()] == [
        (1.0, "red", 1.0, "a"),
        (2.0, "green", 2.0, "a"),
        (3.0, None, 3.0, "b"),
        (None, "red", 4.0, "b"),
        (5.0, "green", 5.0, "b"),
    ]


def test_malformed_number_fails(spark, tmp_path):
    path = tmp_path / "bad.arff"
    path.write_text("@attribute x real\n@attribute c string\n@data\none,a\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        read_arff(spark, str(path)).collect()


def test_hand_counts(spark, small):
    """Labels of size over 1..5 have peaks 1, 3, 5; the value 2 lies on a crossover."""
    model = build_model(small, "kind")
    assert [a.name for a in model.attributes] == ["size", "two words", "count"]
    assert model.attributes[1].domain == ("green", "red")
    rows = [tuple(r) for r in encode_items(small, model, ["count"]).orderBy("count").collect()]
    assert [r[2] for r in rows] == [1, 3, 2, 7, 4]
    assert [r[3] for r in rows] == [2, 1, 3, 2, 1]
    support = {(r["var"], r["val"], r["cls"]): r["n"] for r in feature_support(compact(small, model), model).collect()}
    assert support[(0, 0, "a")] == 2 and support[(0, 1, "a")] == 1 and support[(0, 2, "b")] == 2
    rules = rules_table(spark, model, [("b", {"size": [2]}), ("a", {0: [0], "two words": [1]}), ("a", {})])
    got = [tuple(r)[3:] for r in contingency(compact(small, model), rules, model).orderBy("rule_id").collect()]
    assert got == [(2, 0, 2, 1), (1, 1, 2, 1), (0, 0, 3, 2)]


def test_row_index_over_several_partitions(spark):
    df = spark.range(0, 1000, 1, 7)
    got = with_row_index(df, 5, "no").orderBy("no").collect()
    assert [r["no"] for r in got] == list(range(5, 1005))
    assert [r["id"] for r in got] == list(range(1000))


def test_written_reports(spark, small, tmp_path):
    model = build_model(small, "kind")
    listed = pair_rules(model)
    scored = score(compact(small, model), rules_table(spark, model, listed), model)
    mined = MinedPatterns(model, scored, ("WRAccNorm", "SuppDiff"))
    mined.write(str(tmp_path / "out"), small)

    def lines(part):
        return [x for f in glob.glob(str(tmp_path / "out" / part / "part-*")) for x in open(f).read().splitlines()]

    rules = lines("rules")
    assert rules[0] == "Rule 0" and sum(x.startswith("Rule ") for x in rules) == len(listed)
    assert any(x.startswith("\tVariable size = Label 0: DecreasingLine(1.000000, 3.000000)") for x in rules)
    training = lines("training")
    assert training[0].split("\t") == ["Rule", "ID", "Consequent", "WRAcc_Norm", "SuppDiff"]
    assert len(training) == len(listed) + 1
    test = lines("test")
    assert test[0].split("\t")[:9] == "Rule Class ID NumRules NumVars TP FP TN FN".split()
    assert test[-1].startswith("------") and len(test) == len(listed) + 2


def test_model_json(spark, small):
    model = build_model(small, "kind")
    again = type(model).from_json(model.to_json())
    assert again == model
    assert again.labels_frame(spark).where(F.col("shape") == "Triangular").count() == 2


def test_folder_of_files_with_headers(spark, tmp_path):
    head = "% all\n@relation r\n@attribute a numeric\n@attribute c {x, y}\n@inputs a\n@data\n"
    folder = tmp_path / "many"
    folder.mkdir()
    (folder / "1.arff").write_text(head + "1, x\n2, y\n")
    (folder / "2.arff").write_text(head.replace("@data", "@DATA").replace("numeric", "REAL") + "3, '@x'\n% no\n\n")
    (folder / "3.arff").write_text("4, ?\n")
    got = read_arff(spark, str(folder)).collect()
    assert sorted((r.a, r.c or "") for r in got) == [(1.0, "x"), (2.0, "y"), (3.0, "@x"), (4.0, "")]
    text = tmp_path / "at.arff"
    text.write_text("@attribute c {@a, b}\n@attribute n integer\n@data\n@a, 1\nb, 2\n@data, 3\n")
    assert sorted(map(tuple, read_arff(spark, str(text)).collect())) == [("@a", 1.0), ("@data", 3.0), ("b", 2.0)]
    (folder / "4.arff").write_text(head.replace("@attribute a", "@attribute b") + "1, x\n")
    with pytest.raises(ValueError, match="different"):
        arff_schema(spark, str(folder))


def test_reports_of_several_files(spark, tmp_path, monkeypatch):
    """Numbers run on through the files of a report."""
    from patternloom.sources import reports

    model = build_model(spark.createDataFrame([(float(i), "pq"[i % 2]) for i in range(20)], "a double, k string"), "k", ["a"], [], 3)
    rules = rules_table(spark, model, [("qp"[i % 2], {0: [i % 3]}) for i in range(40)]).repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        reports.write_rules(rules, model, str(tmp_path / "rules"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted(p for p in (tmp_path / "rules").iterdir() if p.name.startswith("part"))
    text = "".join(p.read_text() for p in files)
    numbers = [int(line.split()[1]) for line in text.splitlines() if line.startswith("Rule ")]
    assert len(files) > 1 and numbers == list(range(40))
    consequents = [line for line in text.splitlines() if line.startswith("Consequent")]
    assert consequents == sorted(consequents)


def test_profile_of_a_wide_table(spark):
    """Column slices: no plan holds rows by columns."""
    from patternloom.operators.profile import profile_numeric

    names = [f"c{k}" for k in range(450)]
    df = spark.range(40).selectExpr(*[f"if(id = {k % 7}, null, cast((id * {k + 1}) % 37 as double)) as {n}" for k, n in enumerate(names)])
    found = profile_numeric(df, names)
    values = [[(i * (k + 1)) % 37 for i in range(40) if i != k % 7] for k in range(450)]
    assert {r["name"]: (r["min"], r["max"]) for r in found.collect()} == {n: (min(v), max(v)) for n, v in zip(names, values)}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Generate") <= 3


def test_domain_limit_is_exact(spark):
    from patternloom.operators.profile import profile_nominal

    df = spark.range(30).selectExpr("concat('v', id) as v", "if(id % 2 = 0, 'a', 'b') as k", "cast(id as double) as x")
    assert len(build_model(df, "k", ["x"], ["v"], 3, max_domain=30).attributes[1].domain) == 30
    assert profile_nominal(df, ["v"], 30).head()["n_values"] == 30
    with pytest.raises(ValueError, match="more than 29"):
        build_model(df, "k", ["x"], ["v"], 3, max_domain=29)
    with pytest.raises(Exception, match="more than 29"):
        profile_nominal(df, ["v"], 29).collect()
