"""Readable rules and measure tables as text and tab-separated files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patternloom.functions.masks import num_vars
from patternloom.functions.measures import LISTED_MEASURES, SHORT_NAMES, all_measures
from patternloom.model import TableModel
from patternloom.operators.contingency import summary
from patternloom.operators.rules import canonical_rules, rule_items
from patternloom.sources.row_index import with_row_index

NONE = "------"


def numbered(rules: DataFrame) -> DataFrame:
    """Add ``rule_no``, the position in a report: by class, then id, from 0; sorted by ranges, not in one task."""
    order = ("cls", "rule_id")
    return with_row_index(rules.repartitionByRange(*order).sortWithinPartitions(*order), 0, "rule_no")


def _six(c: Column) -> Column:
    """Six decimals; noise around zero, whose sign depends on summing order, prints as plain zero."""
    settled = F.round(c, 9) + F.lit(0.0)
    return (
        F.when(c == float("inf"), F.lit("INFINITY"))
        .when(F.isnan(c), F.lit("NaN"))
        .otherwise(F.format_string("%.6f", settled))
    )


def render_rules(rules: DataFrame, model: TableModel) -> DataFrame:
    """``rule_id, cls, rule_text``: one line per participating variable, then the consequent."""
    values = F.broadcast(model.values_frame(rules.sparkSession))
    lines = (
        rule_items(rules, model)
        .join(values, ["var", "val"])
        .groupBy("rule_id", "var", "name")
        .agg(F.array_sort(F.collect_list(F.struct("val", "value_text"))).alias("_v"))
        .select(
            "rule_id",
            "var",
            F.concat(
                F.lit("\tVariable "),
                F.col("name"),
                F.lit(" = "),
                F.array_join(F.transform("_v", lambda v: F.concat(v["value_text"], F.lit("  "))), ""),
            ).alias("line"),
        )
    )
    body = lines.groupBy("rule_id").agg(F.array_sort(F.collect_list(F.struct("var", "line"))).alias("_l"))
    text = F.array_join(
        F.concat(
            F.coalesce(F.transform("_l", lambda x: x["line"]), F.array().cast("array<string>")),
            F.array(F.concat(F.lit("Consequent: "), F.col("cls"))),
        ),
        "\n",
    )
    return rules.select("rule_id", "cls").join(body, "rule_id", "left").select("rule_id", "cls", text.alias("rule_text"))


def write_rules(rules: DataFrame, model: TableModel, path: str) -> None:
    """Rules as text, in the order of their numbers through one or more files."""
    text = F.concat(F.lit("Rule "), F.col("rule_no").cast("string"), F.lit("\n"), F.col("rule_text"), F.lit("\n\n"))
    out = numbered(render_rules(rules, model)).select("rule_no", text.alias("value"))
    out.orderBy("rule_no").select("value").write.mode("overwrite").text(path)


def training_measures(scored: DataFrame, model: TableModel, objectives) -> DataFrame:
    """Rule number, id, consequent and the objective values with six decimals."""
    keyed = numbered(canonical_rules(scored, model))
    return keyed.select(
        F.col("rule_no").cast("int").alias("Rule"),
        F.col("rule_key").alias("ID"),
        F.col("cls").alias("Consequent"),
        *[_six(F.col(o)).alias(SHORT_NAMES[o]) for o in objectives],
    )


def test_measures(measured: DataFrame, model: TableModel) -> DataFrame:
    """Counts and all listed measures per rule, and one summary row of means."""
    full = numbered(canonical_rules(measured, model)).withColumn("num_vars", num_vars("masks", model))
    if "AUC" not in full.columns:
        full = all_measures(full)
    per_rule = full.select(
        F.col("rule_no").cast("string").alias("Rule"),
        F.col("cls").alias("Class"),
        F.col("rule_key").alias("ID"),
        F.lit(NONE).alias("NumRules"),
        _six(F.col("num_vars").cast("double")).alias("NumVars"),
        *[F.col(c).cast("string").alias(c.upper()) for c in ("tp", "fp", "tn", "fn")],
        *[_six(F.col(m)).alias(SHORT_NAMES[m]) for m in LISTED_MEASURES],
    )
    means = summary(full).select(
        *[F.lit(NONE).alias(c) for c in ("Rule", "Class", "ID")],
        _six(F.col("num_rules").cast("double")).alias("NumRules"),
        _six(F.col("num_vars")).alias("NumVars"),
        *[F.lit(NONE).alias(c) for c in ("TP", "FP", "TN", "FN")],
        *[_six(F.col(m)).alias(SHORT_NAMES[m]) for m in LISTED_MEASURES],
    )
    return per_rule.unionByName(means)


def _write_tsv(df: DataFrame, path: str, order: Column) -> None:
    """Rows in order through one or more files, each with the header."""
    df.orderBy(order).write.mode("overwrite").csv(path, sep="\t", header=True)


def write_training_measures(scored: DataFrame, model: TableModel, objectives, path: str) -> None:
    _write_tsv(training_measures(scored, model, objectives), path, F.col("Rule"))


def write_test_measures(measured: DataFrame, model: TableModel, path: str) -> None:
    last = F.coalesce(F.try_to_number("Rule", F.lit("9999999999")), F.lit(10**12))
    _write_tsv(test_measures(measured, model), path, last)
