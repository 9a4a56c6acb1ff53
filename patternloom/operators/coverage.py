"""Which rows does a rule cover? Matching of rule tables against encoded tables.

Rows meet rules through an index instead of a row-by-rule product: every rule is
filed under the masks its most selective variable accepts, every row looks up its
own mask of each variable, and the remaining conditions are checked on the hits.
A row holds exactly one mask per variable, so each (row, rule) pair is met at most
once. Of labels the caller defines a row may hold any set: there rows are looked up under each label they
hold, and a pair counts where it meets under the lowest label both have.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patternloom.functions.masks import ints, normalise_sql, num_vars, popcounts_sql
from patternloom.model import TableModel
from patternloom.operators.rules import rule_items

# Estimated bytes up to which the rule index is broadcast.
BROADCAST_LIMIT = 64 << 20


def _pivot_words(model: TableModel) -> str:
    """Constant array: per word its variable, the row masks it can meet, the null-row mask."""
    rows = []
    for i, w in enumerate(model.words):
        several = len(model.var_words[w.var]) > 1
        plain = [m for m in model.row_masks(i) if not (several and m == w.full)]
        wild = w.full if several and model.var_words[w.var][0] == i else 0
        rows.append({"word": i, "var": w.var, "plain": plain, "wild": wild})
    schema = "array<struct<word:int,var:int,plain:array<bigint>,wild:bigint>>"
    return f"from_json('{json.dumps(rows)}', '{schema}')"


def index_expansion(model: TableModel) -> int:
    """Largest number of index entries one rule can have."""
    per_var = [sum(len(model.row_masks(i)) for i in model.var_words[a.pos]) for a in model.attributes]
    return max(per_var, default=1)


def rule_index(rules: DataFrame, model: TableModel, carry=()) -> DataFrame:
    """Non-empty rules as ``(word, wmask)`` entries with their normalised words ``r0..``.

    The most selective variable is the one with the smallest share of its values selected.
    """
    kept = ["rule_id", "rule_cls", *carry]
    sizes = ints(max(a.n_values, 1) for a in model.attributes)
    share = f"zip_with({popcounts_sql('_r', model)}, {sizes}, (_c, _n) -> if(_c > 0, cast(_c as double) / _n, 2D))"
    entries = f"""flatten(transform(filter({_pivot_words(model)}, _s -> _s.var = _pivot), _s ->
        transform(
            concat(filter(_s.plain, _m -> (_m & element_at(_r, _s.word + 1)) <> 0),
                   filter(array(_s.wild), _m -> _m <> 0)),
            _m -> struct(_s.word as word, _m as wmask))))"""
    words = [f"element_at(_r, {i + 1}) as r{i}" for i in range(model.n_words)]
    return (
        rules.selectExpr("rule_id", "cls as rule_cls", *carry, f"{normalise_sql('masks', model)} as _r")
        .where("exists(_r, _m -> _m <> 0)")
        .selectExpr(*kept, "_r", f"{share} as _share")
        .selectExpr(*kept, "_r", "cast(array_position(_share, array_min(_share)) - 1 as int) as _pivot")
        .selectExpr(*kept, "_r", f"explode({entries}) as _e")
        .selectExpr(*kept, "_e.word", "_e.wmask", *words)
    )


def _match(model: TableModel) -> Column:
    parts = []
    for a in model.attributes:
        if a.n_values < 2:
            continue
        idx = model.var_words[a.pos]
        free = " and ".join(f"r{i} = 0" for i in idx)
        hit = " or ".join(f"(m{i} & r{i}) <> 0" for i in idx)
        parts.append(f"(({free}) or {hit})")
    return F.expr(" and ".join(parts) if parts else "false")


def match_rules(
    encoded: DataFrame, rules: DataFrame, model: TableModel, keep=("cls", "n"), carry=(), max_rules: int | None = None
) -> DataFrame:
    """``keep..., rule_id, rule_cls, carry...`` for every covered (row, rule) pair.

    ``max_rules`` is a bound the caller vouches for; without it the rules are counted. The index of the rules is
    broadcast; rules whose index would pass the limit are taken in slices that keep it, each one more pass over
    the rows, which are never moved.
    """
    n = rules.count() if max_rules is None else max_rules
    size = n * index_expansion(model) * (64 + 8 * model.n_words)
    slices = 1 + size // BROADCAST_LIMIT
    if slices == 1:
        return _match_slice(encoded, rules, model, keep, carry)
    place = F.pmod(F.xxhash64("rule_id"), F.lit(slices))
    parts = [_match_slice(encoded, rules.where(place == s), model, keep, carry) for s in range(slices)]
    return reduce(lambda a, b: a.unionByName(b), parts)


def _match_slice(encoded: DataFrame, rules: DataFrame, model: TableModel, keep, carry) -> DataFrame:
    index = rule_index(rules, model, carry)
    wanted = list(dict.fromkeys([*keep, *model.mask_columns]))
    sets = [i for i, w in enumerate(model.words) if model.custom_labels and model.attributes[w.var].numeric]
    if sets:
        single = "transform(filter(sequence(0, {n}), _b -> (shiftright(m{i}, _b) & 1) = 1), _b -> struct({i} as word, shiftleft(1L, _b) as wmask))"
        parts = [
            single.format(i=i, n=max(w.bits - 1, 0)) if i in sets else f"array(struct({i} as word, m{i} as wmask))" for i, w in enumerate(model.words)
        ]
        probe = encoded.selectExpr(*wanted, f"inline(flatten(array({', '.join(parts)})))")
    else:
        probe = encoded.selectExpr(*wanted, f"posexplode(array({', '.join(model.mask_columns)})) as (word, wmask)")
    joined = probe.join(F.broadcast(index), ["word", "wmask"])
    for i in sets:
        both = f"(m{i} & r{i})"
        joined = joined.where(f"word <> {i} or ({both} & -{both}) = wmask")
    return joined.where(_match(model)).select(*keep, "rule_id", "rule_cls", *carry)


def coverage(
    df: DataFrame, rules: DataFrame, model: TableModel, rid, max_rules: int | None = None
) -> DataFrame:
    """``(rule_id, rid...)`` pairs: all rules in one pass over the table."""
    from patternloom.operators.encode import encode_items

    keys = [rid] if isinstance(rid, str) else list(rid)
    encoded = encode_items(df, model, keep=keys)
    return match_rules(encoded, rules, model, keep=keys, max_rules=max_rules).select("rule_id", *keys)


def covered_rows(cover: DataFrame, rule_id: int, rid: str) -> DataFrame:
    """Row keys one rule covers."""
    return cover.where(F.col("rule_id") == rule_id).select(rid)


# -- row-set algebra ------------------------------------------------------
# Sets are DataFrames whose columns are the row key. Binary operators count tagged
# members per key in one aggregation instead of joining the two sides.


def _tagged(a: DataFrame, b: DataFrame) -> DataFrame:
    keys = a.columns
    both = a.select(*keys, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(
        b.select(*keys, F.lit(0).alias("_a"), F.lit(1).alias("_b"))
    )
    return both.groupBy(*keys).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))


def cover_union(*sets: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), sets).distinct()


def cover_intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return _tagged(a, b).where("_a = 1 and _b = 1").drop("_a", "_b")


def cover_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return _tagged(a, b).where("_a = 1 and _b = 0").drop("_a", "_b")


def newly_covered(previous: DataFrame, now: DataFrame) -> DataFrame:
    """Rows covered now and not before."""
    return cover_difference(now, previous)


def cover_symdiff(a: DataFrame, b: DataFrame) -> DataFrame:
    return _tagged(a, b).where("_a <> _b").drop("_a", "_b")


def cover_complement(universe: DataFrame, a: DataFrame) -> DataFrame:
    return cover_difference(universe.select(*a.columns), a)


def cover_count(a: DataFrame) -> DataFrame:
    return a.agg(F.count(F.lit(1)).alias("n"))


def cover_flags(encoded: DataFrame, rule_sets: dict[str, DataFrame], model: TableModel, keep=("cls", "n"), max_rules=None):
    """For each encoded row, is it covered by some rule of each named set?

    One matching pass for all sets; rows covered by none of them are absent. Rows equal in
    ``keep`` and masks are merged first and ``n`` is their sum, so that merged and unmerged
    tables give the same.
    """
    tagged = reduce(
        lambda a, b: a.unionByName(b),
        [r.select("rule_id", "cls", "masks", F.lit(name).alias("_set")) for name, r in rule_sets.items()],
    )
    by = [k for k in dict.fromkeys([*keep, *model.mask_columns]) if k != "n"]
    merged = encoded.groupBy(*by).agg(F.sum("n").alias("n"))
    keys = [*by, "n"]
    hits = match_rules(merged, tagged, model, keep=keys, carry=("_set",), max_rules=max_rules)
    flags = [F.max((F.col("_set") == name).cast("int")).alias(name) for name in rule_sets]
    return hits.groupBy(*keys).agg(*flags)


def uncovered(encoded: DataFrame, rules: DataFrame, model: TableModel, classes, max_rules=None) -> DataFrame:
    """Encoded rows of the classes that no rule of their own class covers."""
    classes = [classes] if isinstance(classes, str) else list(classes)
    mine = encoded.where(F.col("cls").isin(classes))
    keys = ["cls", *model.mask_columns]
    own = match_rules(mine, rules, model, keep=keys, max_rules=max_rules).where(F.col("cls") == F.col("rule_cls"))
    return mine.join(own.select(*keys).distinct(), keys, "left_anti")


def first_uncovered(encoded: DataFrame, rules: DataFrame, model: TableModel, cls: str, max_rules=None) -> DataFrame:
    """Lowest ``first_rid`` of the class its rules do not cover; null if all are covered."""
    return uncovered(encoded, rules, model, cls, max_rules).agg(F.min("first_rid").alias("first_rid"))


def covering_pairs(encoded: DataFrame, model: TableModel, where: Column | None = None, keep=()) -> DataFrame:
    """``keep..., var, val``: all features of the rows the condition picks, one row per value of ``keep`` as a rule."""
    from patternloom.operators.encode import items_long

    picked = encoded if where is None else encoded.where(where)
    return items_long(picked, model, keep=keep).distinct()


# -- bitmap layout -----------------------------------------------------------


def coverage_bitmaps(
    lut: DataFrame, rules: DataFrame, model: TableModel, max_rules: int | None = None, carry=()
) -> DataFrame:
    """``rule_id, carry..., bucket, covered, positive`` bitmaps from the feature bitmaps.

    Values of a variable are OR-ed, variables are AND-ed, and the rule's class is one
    more AND for ``positive``. Everything after the lookup is grouped by bucket first,
    which is how the feature bitmaps are partitioned, so bitmaps are not exchanged. The
    rule conditions are broadcast; too many of them are taken in slices of bounded size,
    each one more pass over the bitmaps.
    """
    n = rules.count() if max_rules is None else max_rules
    size = n * sum(a.n_values for a in model.attributes) * (40 + 24 * len(carry))
    slices = 1 + size // BROADCAST_LIMIT
    if slices == 1:
        return _coverage_slice(lut, rules, model, carry)
    place = F.pmod(F.xxhash64("rule_id"), F.lit(slices))
    parts = [_coverage_slice(lut, rules.where(place == s), model, carry) for s in range(slices)]
    return reduce(lambda a, b: a.unionByName(b), parts)


def _coverage_slice(lut: DataFrame, rules: DataFrame, model: TableModel, carry) -> DataFrame:
    ids = list(dict.fromkeys(["rule_id", *carry, "_need"]))
    keep = list(dict.fromkeys([*ids, "cls"]))
    classes = F.array(*[F.lit(c) for c in model.classes])
    known = rules.select(*[c for c in keep if c != "_need"], "masks", num_vars("masks", model).alias("_need")).where("_need > 0")
    own = (F.array_position(classes, F.col("cls")) - 1).cast("int")
    items = (
        rule_items(known, model, keep)
        .select(*ids, "var", "val")
        .unionByName(known.select(*ids, F.lit(-1).alias("var"), own.alias("val")))
    )
    per_var = (
        lut.join(F.broadcast(items), ["var", "val"]).groupBy("bucket", *ids, "var").agg(F.bitmap_or_agg("bits").alias("bits"))
    )
    attr = F.col("var") >= 0
    agreed = per_var.groupBy("bucket", *ids).agg(
        F.bitmap_and_agg(F.when(attr, F.col("bits"))).alias("covered"),
        F.bitmap_and_agg("bits").alias("positive"),
        F.sum(attr.cast("int")).alias("_have"),
        F.max((~attr).cast("int")).alias("_cls"),
    )
    out = [c for c in ids if c != "_need"]
    return agreed.where("_have = _need").select(
        *out, "bucket", "covered", F.when(F.col("_cls") == 1, F.col("positive")).alias("positive")
    )
