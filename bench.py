"""Benchmark: prints one JSON line with seconds per query.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores. Every query is run to
the end on the noop sink or by a count, twice, and the second run is reported; a whole
mining run, with the default budget, is timed once.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import functions as F

from patternloom.functions.measures import all_measures
from patternloom.operators.bitmaps import wide_lut
from patternloom.operators.contingency import contingency, contingency_bitmap, score
from patternloom.operators.encode import compact, encode_items, feature_support
from patternloom.operators.generate import init_oriented
from patternloom.operators.ranking import crowding_distance, nondominated_rank, pareto_front, select_top
from patternloom.operators.selection import token_competition
from patternloom.plans.miner import PatternMiner
from patternloom.session import cut_lineage, local_session
from showcase.bindings import LINES, ORDERS, PLANTED, VECTORS

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
TRADE_OFF = ("Confidence", "TPR")


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = local_session(CPUS, "patternloom-bench")
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}

    def timed(name, fn, repeat=2):
        for _ in range(repeat):
            start = time.perf_counter()
            fn()
            seconds[name] = round(time.perf_counter() - start, 3)

    lines = LINES.load(spark, SF_DIR)
    timed("profile", lambda: LINES.model(lines))
    model = LINES.model(lines)
    totals = dict(zip(model.classes, model.class_counts))
    timed("encode_rows", lambda: run(encode_items(lines, model)))
    timed("encode_and_merge", lambda: run(compact(lines, model)))
    timed("feature_support", lambda: run(feature_support(compact(lines, model), model)))

    rules = {n: cut_lineage(init_oriented(spark, model, n, 1, pct=0.6)) for n in (100, 1_000, 10_000)}
    encoded = encode_items(lines, model)
    for n, table in rules.items():
        timed(
            f"score_{n}_rules",
            lambda t=table, n=n: run(all_measures(contingency(compact(lines, model), t, model, n, totals, merged=True))),
        )
    timed(
        "score_1000_rules_unmerged",
        lambda: run(contingency(encoded, rules[1_000], model, 1_000, totals)),
    )
    scored = cut_lineage(score(compact(lines, model), rules[1_000], model, TRADE_OFF, 1_000, totals))
    timed("token_competition_1000", lambda: run(token_competition(compact(lines, model), scored, model, 1_000)))
    many = cut_lineage(score(compact(lines, model), rules[10_000], model, TRADE_OFF, 10_000, totals))
    timed("pareto_front_10000", lambda: run(pareto_front(many, TRADE_OFF)))
    timed(
        "rank_and_select_10000",
        lambda: run(select_top(crowding_distance(nondominated_rank(many, TRADE_OFF, group_bound=10_000), TRADE_OFF), 100)),
    )

    vectors = VECTORS.load(spark, SF_DIR).withColumn("row_no", F.col("vec_id") + 1)
    wide = VECTORS.model(vectors)
    wide_rules = cut_lineage(init_oriented(spark, wide, 300, 1, pct=0.05))
    wide_totals = dict(zip(wide.classes, wide.class_counts))
    apart = encode_items(vectors, wide).persist()
    apart.count()
    # Rows of 64 attributes that no merging makes fewer, looked up one by one.
    timed(
        "score_300_rules_rows_that_do_not_merge",
        lambda: run(contingency(apart, wide_rules, wide, 300, wide_totals, merged=True)),
    )
    timed("bitmaps_build", lambda: run(wide_lut(vectors, wide, "row_no")))
    lut = wide_lut(vectors, wide, "row_no").persist()
    lut.count()
    timed(
        "bitmaps_score_300_rules",
        lambda: run(contingency_bitmap(lut, wide_rules, wide, 300, class_totals=wide_totals)),
    )

    orders = ORDERS.load(spark, SF_DIR)
    early = F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp")
    start = time.perf_counter()
    mined = PatternMiner(
        ORDERS.cls, list(ORDERS.numeric), list(ORDERS.nominal), objectives=TRADE_OFF
    ).fit(orders.where(early))
    seconds["fit_orders"] = round(time.perf_counter() - start, 3)
    timed("evaluate_holdout", lambda: run(mined.evaluate(orders.where(~early))))

    start = time.perf_counter()
    PatternMiner(PLANTED.cls, list(PLANTED.numeric), list(PLANTED.nominal)).fit(
        PLANTED.load(spark, SF_DIR)
    )
    seconds["fit_planted"] = round(time.perf_counter() - start, 3)

    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
