import random

from pyspark.sql import functions as F

from patternloom.llm import spread
from patternloom.llm.graph import components


def test_components_of_chains_hubs_and_loops(spark):
    rng = random.Random(11)
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(200, 200)]
    links += [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(41, 41), (160, 100), (100, 160)]
    rng.shuffle(links)
    label = {}

    def root(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        label[y] = x
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for x in list(label)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_attach_is_an_inner_join_whatever_is_hot(spark, monkeypatch):
    rows = spark.createDataFrame([(k, "hot" if k % 3 else f"k{k % 7}") for k in range(300)] + [(999, None)], "i long, key string")
    groups = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("i").alias("first"))
    want = sorted(map(tuple, rows.join(groups, "key").collect()))
    for hot in (1, 3, 200):
        monkeypatch.setattr(spread, "HOT", hot)
        assert sorted(map(tuple, spread.attach(rows, groups, "key", "size", 301).select("key", "i", "size", "first").collect())) == want


def test_sieve_lets_all_members_through_and_few_others(spark):
    keys = spark.range(0, 3000, 3).select(F.xxhash64("id").alias("key"))
    rows = spark.range(3000).withColumn("_key", F.xxhash64("id"))
    held = spread.sieve(keys)
    assert held.count() <= spread.SIEVE_BITS // 32768
    got = {r["id"] for r in spread.passes(rows, F.col("_key"), held, "member").where("member").collect()}
    assert set(range(0, 3000, 3)) <= got and len(got) <= 1005
    none = spread.passes(rows, F.lit(None).cast("long"), held, "member")
    assert none.count() == 3000 and none.where("member").count() == 0
