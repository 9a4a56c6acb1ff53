"""Choosing rules: tournament, token competition, measure filter, better set."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patternloom.functions.hashing import pick
from patternloom.functions.masks import num_active
from patternloom.functions.measures import measure
from patternloom.model import TableModel
from patternloom.operators.coverage import BROADCAST_LIMIT, match_rules


def with_slot(pop: DataFrame, by: str = "cls", tie: str = "rule_id") -> DataFrame:
    """Number the rules of each group from 1."""
    return pop.withColumn("slot", F.row_number().over(Window.partitionBy(by).orderBy(tie)))


def fighters(draws: DataFrame, pop: DataFrame, slot: Column, prefix: str, small: bool = False) -> DataFrame:
    """Join the individual standing at ``slot`` of the draw's class, columns prefixed."""
    side = pop.select(
        F.col("cls").alias("_c"),
        F.col("slot").alias("_s"),
        *[F.col(c).alias(f"{prefix}_{c}") for c in ("rule_id", "rank", "crowding", "masks")],
    )
    side = F.broadcast(side) if small else side
    return draws.join(side, (F.col("cls") == F.col("_c")) & (slot == F.col("_s"))).drop("_c", "_s")


def second_wins(a: str, b: str) -> Column:
    """True if the second drawn is strictly better by rank, then by crowding."""
    return (F.col(f"{b}_rank") < F.col(f"{a}_rank")) | (
        (F.col(f"{b}_rank") == F.col(f"{a}_rank")) & (F.col(f"{b}_crowding") > F.col(f"{a}_crowding"))
    )


def tournament_select(
    pop: DataFrame,
    draws: DataFrame,
    seed: int,
    gen: int,
    parent: int = 0,
    max_rules: int | None = None,
    row_bytes: int = 200,
) -> DataFrame:
    """For each draw ``(cls, draw, size)`` pick two individuals and keep the better one.

    Adds ``p{parent}_rule_id`` and ``p{parent}_masks``. ``max_rules`` is the caller's bound
    on the population and ``row_bytes`` the size of one individual; a population that
    fits the broadcast limit is broadcast.
    """
    small = max_rules is not None and max_rules * row_bytes <= BROADCAST_LIMIT

    def slot(side):
        return F.expr(pick("size", seed, gen, "'tournament'", "cls", "draw", parent, f"'{side}'") + " + 1")

    out = draws
    for side in ("a", "b"):
        out = fighters(out, pop, slot(side), side, small)
    won = second_wins("a", "b")
    return out.select(
        *draws.columns,
        *[F.when(won, F.col(f"b_{c}")).otherwise(F.col(f"a_{c}")).alias(f"p{parent}_{c}") for c in ("rule_id", "masks")],
    )


def token_order(scored: DataFrame, model: TableModel) -> DataFrame:
    """Add ``token_rank``: WRAccNorm descending, fewer active values, then id."""
    order = Window.partitionBy("cls").orderBy(
        F.round("WRAccNorm", 12).desc(), num_active("masks", model), F.col("rule_id")
    )
    return scored.withColumn("token_rank", F.row_number().over(order))


def token_competition(
    encoded: DataFrame, scored: DataFrame, model: TableModel, max_rules: int | None = None
) -> DataFrame:
    """Keep a rule iff it is the first of its class, in token order, to cover some row of the class.

    The kept ranks are the distinct minima per row. A class in which nothing is covered
    keeps its first rule.
    """
    ordered = token_order(scored, model)
    keys = ["cls", *model.mask_columns]
    hits = match_rules(encoded.select(*keys).distinct(), ordered, model, keep=keys, carry=("token_rank",), max_rules=max_rules)
    winners = (
        hits.where(F.col("cls") == F.col("rule_cls"))
        .groupBy(*keys)
        .agg(F.min("token_rank").alias("token_rank"))
        .select("cls", "token_rank")
        .distinct()
    )
    return keep_winners(ordered, winners).select(*scored.columns)


def keep_winners(ordered: DataFrame, winners: DataFrame) -> DataFrame:
    """Rules whose ``cls, token_rank`` won, and the first rule of classes without winners."""
    firsts = ordered.select("cls").distinct().select("cls", F.lit(1).alias("token_rank"), F.lit(0).alias("_won"))
    either = winners.withColumn("_won", F.lit(1)).unionByName(firsts)
    anyone = F.max("_won").over(Window.partitionBy("cls"))
    chosen = either.withColumn("_any", anyone).where("_won = 1 or _any = 0").select("cls", "token_rank")
    return ordered.join(chosen, ["cls", "token_rank"], "left_semi")


def measure_filter(
    scored: DataFrame, model: TableModel, conditions=(("Confidence", 0.6),), by: str = "cls"
) -> DataFrame:
    """Rules meeting every ``(measure, threshold)``; a class left empty keeps its best rule.

    Best means the first measure, then the token order.
    """
    ok = reduce(lambda a, b: a & b, [measure(m) >= t for m, t in conditions])
    order = F.struct(
        (-measure(conditions[0][0])).alias("_1"),
        (-F.round("WRAccNorm", 12)).alias("_2"),
        num_active("masks", model).alias("_3"),
        F.col("rule_id").alias("_4"),
    )
    judged = scored.withColumn("_ok", ok)
    # One grouped minimum per class instead of sorting the class.
    best = judged.groupBy(by).agg(F.max("_ok").alias("_any"), F.min_by("rule_id", order).alias("_best"))
    joined = judged.join(best, by)
    return joined.where("_ok or (not _any and rule_id = _best)").select(*scored.columns)


def better_set(current: DataFrame, challenger: DataFrame, by: str = "cls") -> DataFrame:
    """Per class the set with the higher mean WRAccNorm; on a tie the smaller, then the current.

    A class present on one side only keeps that side.
    """
    cols = current.columns
    both = current.select(*cols, F.lit(0).alias("_side")).unionByName(challenger.select(*cols, F.lit(1).alias("_side")))
    stats = both.groupBy(by, "_side").agg(
        F.round(F.avg("WRAccNorm"), 12).alias("_mean"), F.count(F.lit(1)).alias("_size")
    )
    choice = stats.groupBy(by).agg(
        F.max_by("_side", F.struct(F.col("_mean"), -F.col("_size"), -F.col("_side"))).alias("_pick")
    )
    return both.join(choice, by).where(F.col("_side") == F.col("_pick")).select(*cols)
