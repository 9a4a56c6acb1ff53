"""Candidate rules: initial populations, crossover, mutation, reproduction.

All are narrow transforms of a rule table; every random choice is a hash of seed,
generation, step and rule, so nothing is shuffled to make a candidate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from patternloom.functions.hashing import pick, random_bits, uniform
from patternloom.functions.masks import full_masks, ints, n_values, popcounts_sql, word_owners
from patternloom.model import WORD_BITS, TableModel
from patternloom.operators.selection import tournament_select

CROSSOVER, HUX, MUTATION = "npoint", "hux", "mutation"
# Ids of one generation; its restarts take the upper half.
GENERATION = 1 << 40
OPERATORS = (CROSSOVER, HUX, MUTATION)


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _class_of(model: TableModel, position: str) -> str:
    classes = ", ".join(_quoted(c) for c in model.classes)
    return f"element_at(array({classes}), cast({position} % {len(model.classes)} as int) + 1)"


def _words(model: TableModel, body: str) -> str:
    """Array with ``body`` for every mask word; ``_w.w``, ``_w.v``, ``_w.f`` are word, variable, full mask."""
    index = f"sequence(0, {model.n_words - 1})"
    zipped = f"zip_with(zip_with({index}, {word_owners(model)}, (w, v) -> struct(w as w, v as v)), {full_masks(model)}, (_s, f) -> struct(_s.w as w, _s.v as v, f as f))"
    return f"transform({zipped}, _w -> {body})"


def _bit(model: TableModel, value: str) -> str:
    """Mask of ``value`` of variable ``_w.v`` within word ``_w.w``, 0 if it lies in another word."""
    first = f"element_at({ints(w.first for w in model.words)}, _w.w + 1)"
    bits = f"element_at({ints(w.bits for w in model.words)}, _w.w + 1)"
    powers = ints((1 << b for b in range(WORD_BITS)), "bigint")
    at = f"({value} - {first})"
    return f"if({at} >= 0 and {at} < {bits}, element_at({powers}, {at} + 1), 0L)"


def _ids(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).withColumnRenamed("id", "rule_id")


def init_random(spark: SparkSession, model: TableModel, n: int, seed: int, gen: int = 0) -> DataFrame:
    """Every bit at random, classes in turn."""
    bits = f"{random_bits(seed, gen, _quoted('random'), 'rule_id', '_w.w')} & _w.f"
    return _ids(spark, n).selectExpr(
        "rule_id", f"{_class_of(model, 'rule_id')} as cls", f"{_words(model, bits)} as masks"
    )


def oriented_masks(ids: DataFrame, model: TableModel, seed: int, gen: int = 0, pct: float = 0.25) -> DataFrame:
    """Add ``masks`` over 1..round(pct * variables) random variables to ``rule_id`` rows.

    Chosen variables get random bits; an empty choice gets one value, a full one loses one.
    """
    most = max(1, int(pct * model.n_vars + 0.5))
    kept = ids.columns
    rank = f"struct({uniform(seed, gen, _quoted('oriented_var'), 'rule_id', '_v')} as u, _v as v)"
    order = f"array_sort(transform(sequence(0, {model.n_vars - 1}), _v -> {rank}))"
    how_many = pick(most, seed, gen, _quoted("oriented_n"), "rule_id") + " + 1"
    bits = f"{random_bits(seed, gen, _quoted('oriented_bits'), 'rule_id', '_w.w')} & _w.f"
    size = f"element_at({n_values(model)}, _w.v + 1)"
    lucky = _bit(model, pick(size, seed, gen, _quoted("oriented_fix"), "rule_id", "_w.v"))
    word = f"""case
        when not array_contains(_vars, _w.v) then 0L
        when element_at(_pop, _w.v + 1) = 0 then element_at(_raw, _w.w + 1) | {lucky}
        when element_at(_pop, _w.v + 1) = {size} then element_at(_raw, _w.w + 1) & ~{lucky}
        else element_at(_raw, _w.w + 1) end"""
    return (
        ids.selectExpr(
            *kept,
            f"transform(slice({order}, 1, {how_many}), _x -> _x.v) as _vars",
            f"{_words(model, bits)} as _raw",
        )
        .selectExpr(*kept, "_vars", "_raw", f"{popcounts_sql('_raw', model)} as _pop")
        .selectExpr(*kept, f"{_words(model, word)} as masks")
    )


def init_oriented(
    spark: SparkSession, model: TableModel, n: int, seed: int, gen: int = 0, pct: float = 0.25
) -> DataFrame:
    """``n`` short random rules, classes in turn."""
    return oriented_masks(_ids(spark, n), model, seed, gen, pct).selectExpr(
        "rule_id", f"{_class_of(model, 'rule_id')} as cls", "masks"
    )


def covering_masks(
    ids: DataFrame, pairs: DataFrame, model: TableModel, seed: int, gen: int = 0, pct: float = 0.5
) -> DataFrame:
    """Add ``masks`` made of random (var, val) pairs to ``rule_id, cls`` rows.

    ``pairs`` (``cls, var, val``) are the features of one row per class, so there are at
    most as many per class as features. Between 1 and ceil(pct * pairs) + 1 of them are
    drawn, never more than exist; of two values of one variable the one drawn later stays.
    """
    listed = pairs.groupBy("cls").agg(F.array_sort(F.collect_list(F.struct("var", "val"))).alias("_pairs"))
    kept = ids.columns
    most = f"least(cast(ceil(size(_pairs) * {pct}D) as int) + 1, size(_pairs))"
    how_many = pick(most, seed, gen, _quoted("covering_n"), "rule_id") + " + 1"
    rank = uniform(seed, gen, _quoted("covering_pair"), "rule_id", "_p.var", "_p.val")
    order = f"array_sort(transform(_pairs, _p -> struct({rank} as u, _p.var as var, _p.val as val)))"
    word = f"aggregate(_drawn, 0L, (_acc, _d) -> if(_d.var = _w.v, {_bit(model, '_d.val')}, _acc))"
    return ids.join(listed, "cls").selectExpr(*kept, f"slice({order}, 1, {how_many}) as _drawn").selectExpr(
        *kept, f"{_words(model, word)} as masks"
    )


def init_covering(
    spark: SparkSession, pairs: DataFrame, model: TableModel, n: int, seed: int, gen: int = 0, pct: float = 0.5
) -> DataFrame:
    """``n`` rules of every class that has features ``cls, var, val`` of one of its rows, numbered class by class."""
    classes = ", ".join(_quoted(c) for c in model.classes)
    ids = _ids(spark, n * len(model.classes)).selectExpr("rule_id", f"element_at(array({classes}), cast(rule_id div {n} as int) + 1) as cls")
    return covering_masks(ids, pairs, model, seed, gen, pct)


# -- variation -------------------------------------------------------------


def _npoint(a: str, b: str, model: TableModel, key: str, seed: int, gen: int, points: int) -> tuple[str, str]:
    """Two children exchanging the variables after every second distinct cut."""
    if model.n_vars < points:
        raise ValueError("more cut points than variables")
    cuts = ", ".join(pick(model.n_vars, seed, gen, _quoted("cut"), key, i) for i in range(points))
    swap = f"size(filter(array_distinct(array({cuts})), _c -> _c < _w.v)) % 2 = 1"
    x, y = f"element_at({a}, _w.w + 1)", f"element_at({b}, _w.w + 1)"
    return _words(model, f"if({swap}, {y}, {x})"), _words(model, f"if({swap}, {x}, {y})")


def _hux(a: str, b: str, model: TableModel, key: str, seed: int, gen: int) -> tuple[str, str]:
    """Two children exchanging each differing bit with probability one half."""
    x, y = f"element_at({a}, _w.w + 1)", f"element_at({b}, _w.w + 1)"
    moved = f"(({x} ^ {y}) & {random_bits(seed, gen, _quoted('hux'), key, '_w.w')})"
    return _words(model, f"{x} ^ {moved}"), _words(model, f"{y} ^ {moved}")


def _mutated(masks: str, model: TableModel, key: str, seed: int, gen: int, prob: float = 1.0) -> str:
    """One random variable cleared or, half of the time, each of its bits flipped at random."""
    hit = (
        f"{uniform(seed, gen, _quoted('mut'), key)} <= {float(prob)}D"
        f" and _w.v = {pick(model.n_vars, seed, gen, _quoted('mut_var'), key)}"
    )
    clear = f"{uniform(seed, gen, _quoted('mut_kind'), key)} < 0.5D"
    flip = f"({random_bits(seed, gen, _quoted('mut_bits'), key, '_w.w')} & _w.f)"
    mine = f"element_at({masks}, _w.w + 1)"
    return _words(model, f"case when not ({hit}) then {mine} when {clear} then 0L else {mine} ^ {flip} end")


def _two_children(pairs: DataFrame, children: tuple[str, str]) -> DataFrame:
    keep = [c for c in pairs.columns if c not in ("a_masks", "b_masks")]
    return pairs.selectExpr(*keep, f"posexplode(array({children[0]}, {children[1]})) as (child, masks)")


def crossover_npoint(pairs: DataFrame, model: TableModel, seed: int, gen: int = 0, points: int = 2) -> DataFrame:
    """``pair_id, a_masks, b_masks`` to two children per pair."""
    return _two_children(pairs, _npoint("a_masks", "b_masks", model, "pair_id", seed, gen, points))


def crossover_hux(pairs: DataFrame, model: TableModel, seed: int, gen: int = 0) -> DataFrame:
    return _two_children(pairs, _hux("a_masks", "b_masks", model, "pair_id", seed, gen))


def mutate_dnf(rules: DataFrame, model: TableModel, seed: int, gen: int = 0, prob: float = 1.0) -> DataFrame:
    return rules.withColumn("masks", F.expr(_mutated("masks", model, "rule_id", seed, gen, prob)))


# -- adaptive choice of the variation operator --------------------------------


def operator_probs(credits: DataFrame, floor: int = 2) -> DataFrame:
    """Share of each operator ``(op, credit)`` with a minimum credit; adds ``prob``."""
    credit = F.greatest(F.col("credit"), F.lit(floor)).cast("double")
    total = credits.agg(F.sum(credit)).scalar()
    return credits.withColumn("prob", credit / total)


def choose_operator(draws: DataFrame, probs: DataFrame, u: str = "u") -> DataFrame:
    """Roulette: the first operator (by name) whose cumulative share exceeds ``u``.

    Adds ``op``; a draw past the rounded end takes the last operator.
    """
    kept = draws.columns
    wheel = probs.agg(F.array_sort(F.collect_list(F.struct("op", "prob"))).alias("w")).scalar()
    upto = "aggregate(slice(_wheel, 1, _i), 0D, (_t, _x) -> _t + _x.prob)"
    cumulative = f"transform(sequence(1, size(_wheel)), _i -> struct({upto} as c, element_at(_wheel, _i).op as op))"
    return (
        draws.withColumn("_wheel", wheel)
        .selectExpr(*kept, f"{cumulative} as _cum")
        .selectExpr(*kept, f"coalesce(get(filter(_cum, _x -> _x.c > {u}), 0).op, element_at(_cum, -1).op) as op")
    )


def events(sizes: DataFrame, probs: dict[str, float], seed: int, gen: int) -> DataFrame:
    """Variation events per class until as many children as individuals are planned.

    ``sizes`` has ``cls, size``; the result ``cls, draw, size, op, children, before``. A
    crossover gives two children, a mutation one.
    """
    u = uniform(seed, gen, _quoted("operator"), "cls", "draw")
    names, bound, arms = sorted(probs), 0.0, []
    for name in names[:-1]:
        bound += probs[name]
        arms.append(f"when {u} < {bound}D then {_quoted(name)}")
    op = f"case {' '.join(arms)} else {_quoted(names[-1])} end" if arms else _quoted(names[-1])
    drawn = (
        sizes.selectExpr("cls", "size", "explode(sequence(0, cast(size - 1 as int))) as draw")
        .selectExpr("cls", "draw", "size", f"{op} as op")
        .selectExpr("*", f"if(op = {_quoted(MUTATION)}, 1, 2) as children")
    )
    earlier = Window.partitionBy("cls").orderBy("draw").rowsBetween(Window.unboundedPreceding, -1)
    return drawn.withColumn("before", F.coalesce(F.sum("children").over(earlier), F.lit(0))).where("before < size")


def class_sizes(pop: DataFrame) -> DataFrame:
    return pop.groupBy("cls").agg(F.count(F.lit(1)).alias("size"))


def reproduce(
    pop: DataFrame,
    model: TableModel,
    probs: dict[str, float],
    seed: int,
    gen: int,
    max_rules: int | None = None,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Offspring of a population with ``cls, slot, rank, crowding, masks``.

    Every class gets as many children as it has individuals. A last crossover can make one
    child too many; the children beyond the size of the whole population, taken from the
    end, come out with ``surplus`` set, as they count for the credit of their operator.
    Result: ``rule_id, cls, masks, op, surplus``. ``max_rules`` is the size of the
    population and ``sizes`` its classes where the caller knows them.
    """
    planned = events(class_sizes(pop) if sizes is None else sizes, probs, seed, gen)
    width = 100 + 8 * model.n_words
    couples = tournament_select(pop, planned, seed, gen, 0, max_rules, width)
    couples = tournament_select(pop, couples, seed, gen, 1, max_rules, width)
    key, a, b = "concat_ws(':', cls, draw)", "p0_masks", "p1_masks"
    x1, x2 = _npoint(a, b, model, key, seed, gen, min(2, model.n_vars))
    h1, h2 = _hux(a, b, model, key, seed, gen)
    kids = f"""case op when {_quoted(MUTATION)} then array({_mutated(a, model, key, seed, gen)})
        when {_quoted(HUX)} then array({h1}, {h2}) else array({x1}, {x2}) end"""
    made = couples.selectExpr("cls", "before", "op", f"posexplode({kids}) as (child, masks)")
    # Children are numbered by class, draw and child; what the classes before make is one row per class.
    line = Window.orderBy("cls").rowsBetween(Window.unboundedPreceding, -1)
    starts = planned.groupBy("cls").agg(F.sum("children").alias("_made"))
    starts = starts.select("cls", F.coalesce(F.sum("_made").over(line), F.lit(0)).alias("_start"))
    total = F.lit(max_rules) if max_rules is not None else pop.agg(F.count(F.lit(1))).scalar()
    numbered = made.join(F.broadcast(starts), "cls").withColumn("_n", F.expr("_start + before + child + 1"))
    return numbered.withColumn("surplus", F.col("_n") > total).selectExpr(
        f"{gen}L * {GENERATION}L + _n as rule_id", "cls", "masks", "op", "surplus"
    )
