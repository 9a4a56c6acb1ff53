"""Confusion counts of rules and aggregates over rule sets."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patternloom.functions.masks import is_empty
from patternloom.functions.measures import LISTED_MEASURES, with_measures
from patternloom.model import TableModel
from patternloom.operators.coverage import coverage_bitmaps, match_rules


def _assemble(rules: DataFrame, hits: DataFrame, encoded: DataFrame, class_totals: dict | None) -> DataFrame:
    joined = rules.join(hits, "rule_id", "left")
    if class_totals is not None:
        return joined.select(*rules.columns, *confusion("cls", class_totals))
    totals = encoded.groupBy("cls").agg(F.sum("n").alias("n_cls"))
    n_total = F.coalesce(totals.agg(F.sum("n_cls")).scalar(), F.lit(0))
    joined = joined.join(totals, "cls", "left")
    return joined.select(*rules.columns, *_four(n_total, F.coalesce("n_cls", F.lit(0))))


def _four(n_total, positives) -> list:
    covered, tp = F.coalesce("covered", F.lit(0)), F.coalesce("tp", F.lit(0))
    return [tp.alias("tp"), (covered - tp).alias("fp"), (n_total - positives - covered + tp).alias("tn"), (positives - tp).alias("fn")]


def confusion(cls: str, class_totals: dict[str, int]) -> list:
    """tp, fp, tn and fn from the columns ``covered`` and ``tp`` (null: 0) and the rows of each class."""
    held = F.from_json(F.lit(json.dumps(class_totals)), "map<string,bigint>")
    positives = F.coalesce(F.try_element_at(held, F.col(cls)), F.lit(0)).cast("bigint")
    return _four(F.lit(sum(class_totals.values())).cast("bigint"), positives)


def contingency(
    encoded: DataFrame,
    rules: DataFrame,
    model: TableModel,
    max_rules: int | None = None,
    class_totals: dict | None = None,
    merged: bool = False,
) -> DataFrame:
    """Rules with tp, fp, tn, fn. Empty rules cover nothing.

    Unless the rows are ``merged`` already, equal ones are merged first, by partial sums before
    they are shuffled; then only (rule, count, count) partial sums are exchanged. ``class_totals``
    gives the rows per class where they are known; otherwise they are counted.
    """
    return _assemble(rules, covered_counts(encoded, rules, model, max_rules, merged).drop("rule_cls"), encoded, class_totals)


def covered_counts(encoded: DataFrame, rules: DataFrame, model: TableModel, max_rules: int | None = None, merged: bool = False) -> DataFrame:
    """``rule_id, rule_cls, covered, tp`` of the rules that cover some row."""
    hit = F.col("cls") == F.col("rule_cls")
    rows = encoded if merged else encoded.groupBy("cls", *model.mask_columns).agg(F.sum("n").alias("n"))
    return (
        match_rules(rows, rules, model, max_rules=max_rules)
        .groupBy("rule_id", "rule_cls")
        .agg(F.sum("n").alias("covered"), F.sum(F.when(hit, F.col("n")).otherwise(F.lit(0))).alias("tp"))
    )


def contingency_bitmap(
    lut: DataFrame,
    rules: DataFrame,
    model: TableModel,
    max_rules: int | None = None,
    encoded: DataFrame | None = None,
    class_totals: dict | None = None,
) -> DataFrame:
    """The same counts from feature bitmaps, for tables with very many attributes.

    Class totals come from ``encoded`` or from ``class_totals``.
    """
    return _assemble(rules, covered_counts_bitmap(lut, rules, model, max_rules).drop("rule_cls"), encoded, class_totals)


def covered_counts_bitmap(lut: DataFrame, rules: DataFrame, model: TableModel, max_rules: int | None = None) -> DataFrame:
    """``rule_id, rule_cls, covered, tp`` of the rules that cover some row."""
    positive = F.coalesce(F.bitmap_count("positive"), F.lit(0))
    return (
        coverage_bitmaps(lut, rules, model, max_rules, ("cls",))
        .groupBy("rule_id", F.col("cls").alias("rule_cls"))
        .agg(F.sum(F.bitmap_count("covered")).alias("covered"), F.sum(positive).alias("tp"))
    )


def penalise_empty(scored: DataFrame, model: TableModel, objectives, rank: str | None = None) -> DataFrame:
    """Empty rules get -inf objectives and the worst rank."""
    empty = is_empty("masks", model)
    cols = {o: F.when(empty, F.lit(float("-inf"))).otherwise(F.col(o)) for o in objectives}
    if rank:
        cols[rank] = F.when(empty, F.lit(2**31 - 1)).otherwise(F.col(rank))
    return scored.withColumns(cols)


def score(
    encoded: DataFrame,
    rules: DataFrame,
    model: TableModel,
    objectives=("WRAccNorm", "SuppDiff"),
    max_rules: int | None = None,
    class_totals: dict | None = None,
) -> DataFrame:
    """Counts, objectives and WRAccNorm (the diversity measure), empty rules penalised."""
    counts = contingency(encoded, rules, model, max_rules, class_totals)
    return with_objectives(counts, model, objectives)


def with_objectives(counts: DataFrame, model: TableModel, objectives) -> DataFrame:
    names = list(dict.fromkeys([*objectives, "WRAccNorm"]))
    return penalise_empty(with_measures(counts, names), model, names)


def mean_diversity(scored: DataFrame, by: str = "cls") -> DataFrame:
    """Average WRAccNorm and size of the rule set of each class."""
    return scored.groupBy(by).agg(
        F.avg("WRAccNorm").alias("mean_diversity"), F.count(F.lit(1)).alias("n_rules")
    )


def summary(measured: DataFrame, names=None) -> DataFrame:
    """One row of means over the rules; the mean of IsGrowthRate is the share above 1."""
    names = [m for m in (names or LISTED_MEASURES) if m in measured.columns]
    return measured.agg(
        F.count(F.lit(1)).alias("num_rules"),
        F.avg("num_vars").alias("num_vars"),
        *[F.avg(m).alias(m) for m in names],
    )
