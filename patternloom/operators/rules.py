"""Rule tables: ``rule_id bigint, cls string, masks array<bigint>``."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patternloom.functions.fuzzy import assign_labels, belonging_degree
from patternloom.functions.masks import ints, is_empty, normalise, num_active, num_vars, word_owners
from patternloom.model import TableModel
from patternloom.operators.profile import quoted

RULE_SCHEMA = "rule_id bigint, cls string, masks array<bigint>"


def rules_table(spark: SparkSession, model: TableModel, rules) -> DataFrame:
    """Rules given as ``(cls, {variable: [values]})`` pairs, variables by name or position."""
    at = {a.name: a.pos for a in model.attributes}
    rows = []
    for i, (cls, conditions) in enumerate(rules):
        by_pos = {at.get(v, v): values for v, values in conditions.items()}
        rows.append((i, cls, model.mask(by_pos)))
    return spark.createDataFrame(rows, RULE_SCHEMA)


def single_rules(model: TableModel):
    """Every one-value condition for every class."""
    return [(c, {v: [j]}) for v, j in model.features() for c in model.classes]


def pair_rules(model: TableModel):
    """Every conjunction of two one-value conditions on different variables, for every class."""
    out = []
    for (v, j), (w, k) in combinations(model.features(), 2):
        if v != w:
            out += [(c, {v: [j], w: [k]}) for c in model.classes]
    return out


def rule_shape(rules: DataFrame, model: TableModel) -> DataFrame:
    """Add emptiness, participating variables and active values."""
    return rules.withColumns(
        {
            "empty": is_empty("masks", model),
            "num_vars": num_vars("masks", model),
            "num_active": num_active("masks", model),
        }
    )


def canonical_rules(rules: DataFrame, model: TableModel) -> DataFrame:
    """Don't-care variables as zero masks; ``rule_key`` is the md5 of the canonical text."""
    return rules.withColumn("masks", normalise("masks", model)).withColumn(
        "rule_key", F.md5(F.concat_ws("|", F.col("cls"), F.col("masks").cast("array<string>")))
    )


def dedupe_rules(rules: DataFrame, objectives=()) -> DataFrame:
    """One rule per class, masks and objective values: the one with the smallest id."""
    keys = ["cls", "masks", *objectives]
    rest = [c for c in rules.columns if c not in keys and c != "rule_id"]
    # A grouped minimum combines on the map side, so copies of one rule do not pile up.
    firsts = rules.groupBy(*keys).agg(
        F.min("rule_id").alias("rule_id"), *[F.min_by(c, "rule_id").alias(c) for c in rest]
    )
    return firsts.select(*rules.columns)


def rule_items(rules: DataFrame, model: TableModel, carry=("cls",)) -> DataFrame:
    """Long form ``rule_id, carry..., var, val`` over participating variables."""
    kept = list(dict.fromkeys(["rule_id", *carry]))
    firsts, sizes = ints(w.first for w in model.words), ints(max(w.bits, 1) for w in model.words)
    zipped = f"explode(arrays_zip(masks, {word_owners(model)}, {firsts}, {sizes}))"
    return (
        rules.select(*kept, normalise("masks", model).alias("masks"))
        .selectExpr(*kept, f"{zipped} as z")
        .selectExpr(*kept, "z.masks as mask", "z.`1` as var", "z.`2` as first", "z.`3` as bits")
        .where("mask <> 0")
        .selectExpr(*kept, "var", "first", "mask", "explode(sequence(0, bits - 1)) as bit")
        .where("(shiftright(mask, bit) & 1) = 1")
        .selectExpr(*kept, "var", "first + bit as val")
    )


def _selected(model: TableModel, masks) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for w, m in zip(model.words, masks):
        out.setdefault(w.var, []).extend(w.first + b for b in range(w.bits) if m >> b & 1)
    return {v: vals for v, vals in out.items() if 0 < len(vals) < model.attributes[v].n_values}


def mask_predicate(model: TableModel, masks) -> Column:
    """One rule as a filter on an encoded table; the empty rule covers nothing."""
    parts = []
    for var in _selected(model, masks):
        hits = [
            F.col(f"m{i}").bitwiseAND(F.lit(int(masks[i]))) != 0 for i in model.var_words[var] if masks[i]
        ]
        parts.append(reduce(lambda a, b: a | b, hits))
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(False)


def rule_predicate(model: TableModel, masks, nan_free: bool = False) -> Column:
    """One rule as a filter on the raw table.

    Nominal conditions become ``IN`` lists and numeric ones are wrapped in the label
    range; the exact label test follows. Both reach the file scan, numeric ranges only
    where the caller says the columns hold no NaN (a NaN matches every label, and a
    test for it cannot be pushed down).
    """
    parts = []
    for var, values in _selected(model, masks).items():
        a = model.attributes[var]
        raw = F.col(a.name)
        if not a.numeric:
            parts.append(raw.isNull() | raw.cast("string").isin([a.domain[v] for v in values]))
            continue
        name = quoted(a.name)
        x = f"cast({name} as double)"
        bits, full = sum(1 << v for v in values), (1 << a.n_values) - 1
        missing = f"{name} is null" if nan_free else f"({name} is null or isnan({name}))"
        held = assign_labels([f"({belonging_degree(x, lab)})" for lab in a.labels])
        # The test for a missing value sits inside the mask, else the optimizer would factor
        # it out of both conditions and the range could not be pushed down.
        hit = F.expr(f"(if({missing}, {full}L, {held}) & {bits}L) <> 0")
        lo, hi = _label_range(a, values)
        if lo is not None or hi is not None:
            wide = F.lit(True) if lo is None else raw >= F.lit(lo)
            parts.append(F.expr(missing) | (wide if hi is None else wide & (raw <= F.lit(hi))))
        parts.append(hit)
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(False)


def _label_range(a, values) -> tuple[float | None, float | None]:
    """Values outside this interval can hold none of the labels; shoulders are open."""
    labs = [a.labels[v] for v in values]
    lows = [None if x.shape in ("DecreasingLine", "Always") else x.x0 for x in labs]
    highs = [None if x.shape in ("IncreasingLine", "Always") else (x.x1 if x.x2 is None else x.x2) for x in labs]
    degenerate = any(len({p for p in (x.x0, x.x1, x.x2) if p is not None}) < 2 for x in a.labels)
    lo = None if degenerate or None in lows else min(lows)
    hi = None if degenerate or None in highs else max(highs)
    return lo, hi
