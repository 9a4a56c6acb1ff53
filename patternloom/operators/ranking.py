"""Pareto dominance, fronts, crowding and truncation of rule tables.

Objectives are maximised unless named in ``minimise``. Dominance is decided on
values rounded to twelve decimals, so floating noise makes no extra fronts, and on
distinct objective vectors, so copies of a rule cost nothing.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patternloom.session import cut_lineage, ship
from patternloom.sources.row_index import with_row_index

DECIMALS = 12
# Distinct vectors of one group that a single task may rank; beyond it, work is split.
GROUP_LIMIT = 20_000
# The same for two objectives, which need a sort and one bisection per vector; also the vectors of one slice.
PAIR_LIMIT = 1_000_000
BANDS = 64


def _keys(by) -> list[str]:
    return [by] if isinstance(by, str) else list(by)


def _goal(name: str, minimise) -> Column:
    v = F.round(F.col(name).cast("double"), DECIMALS)
    return -v if name in minimise else v


def with_vector(df: DataFrame, objectives, minimise) -> tuple[DataFrame, list[str]]:
    """Add the objectives as they are compared: rounded, and to be maximised."""
    names = [f"_o{i}" for i in range(len(objectives))]
    # Adding zero merges -0.0 with 0.0.
    cols = {n: _goal(o, minimise) + F.lit(0.0) for n, o in zip(names, objectives)}
    return df.withColumns(cols), names


def dominates(a: list[Column], b: list[Column]) -> Column:
    """``a`` is nowhere worse than ``b`` and somewhere better."""
    no_worse = reduce(lambda x, y: x & y, [p >= q for p, q in zip(a, b)])
    better = reduce(lambda x, y: x | y, [p > q for p, q in zip(a, b)])
    return no_worse & better


def _front_two(points: DataFrame, by: list[str]) -> DataFrame:
    """Front of distinct 2-vectors by a running maximum, split into bands of the first objective.

    A vector is dominated iff some vector with a larger first value has a second value at
    least as large, or one with the same first value has a larger second value.
    """
    best = points.groupBy(*by, "_o0").agg(F.max("_o1").alias("_o1"))
    edges = best.groupBy(*by).agg(
        F.percentile_approx("_o0", [i / BANDS for i in range(1, BANDS)]).alias("_edges")
    )
    banded = best.join(edges, by).withColumn(
        "_band", F.size(F.filter("_edges", lambda e: e < F.col("_o0")))
    ).drop("_edges")
    tops = banded.groupBy(*by, "_band").agg(F.max("_o1").alias("_top"))
    # At most BANDS rows per group here.
    above = Window.partitionBy(*by).orderBy(F.desc("_band")).rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.withColumn("_above", F.max("_top").over(above)).drop("_top")
    inside = Window.partitionBy(*by, "_band").orderBy(F.desc("_o0")).rowsBetween(Window.unboundedPreceding, -1)
    seen = banded.withColumn("_seen", F.max("_o1").over(inside)).join(tops, [*by, "_band"])
    limit = F.greatest(F.col("_seen"), F.col("_above"))
    return seen.where(limit.isNull() | (F.col("_o1") > limit)).select(*by, "_o0", "_o1")


def _skyline(values: np.ndarray) -> np.ndarray:
    """Flags of the non-dominated rows of a matrix of distinct vectors."""
    order = np.lexsort(tuple(-values[:, k] for k in range(values.shape[1] - 1, -1, -1)))
    keep = np.zeros(len(values), bool)
    front, size = np.empty((16, values.shape[1])), 0
    for i in order:
        if not (front[:size] >= values[i]).all(axis=1).any():
            keep[i] = True
            if size == len(front):
                front = np.concatenate((front, np.empty_like(front)))
            front[size] = values[i]
            size += 1
    return keep


def _thin(points: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """Drop vectors dominated inside their own Arrow batch: no exchange, exact but partial."""

    def run(batches):
        for pdf in batches:
            if not by:
                yield pdf[_skyline(pdf[names].to_numpy())]
                continue
            for _, part in pdf.groupby(by, dropna=False, sort=False):
                yield part[_skyline(part[names].to_numpy())]

    return points.mapInPandas(run, points.schema)


def _front_many(points: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """Front of distinct k-vectors: thin locally, then finish per group, or sieve in slices."""
    ship(points.sparkSession)
    left = cut_lineage(_thin(points, by, names))
    widest = left.groupBy(*by).count().agg(F.max("count")).head()[0] or 0
    if widest <= GROUP_LIMIT:

        def finish(pdf: pd.DataFrame) -> pd.DataFrame:
            return pdf[_skyline(pdf[names].to_numpy())]

        return left.groupBy(*by).applyInPandas(finish, left.schema)
    # A front too large for one task: every slice of bounded size sieves all vectors in turn.
    n_slices = 1 + left.count() // GROUP_LIMIT
    left = cut_lineage(left.withColumn("_slice", F.pmod(F.xxhash64(*by, *names), F.lit(n_slices))))
    result = left
    for s in range(n_slices):
        # A slice holds about GROUP_LIMIT vectors, a bound that its broadcast may rely on.
        rivals = left.where(F.col("_slice") == s).select(*[F.col(c).alias(f"_r{c}") for c in [*by, *names]])
        same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_r{k}")) for k in by], F.lit(True))
        beaten = dominates([F.col(f"_r{c}") for c in names], [F.col(c) for c in names])
        result = result.join(F.broadcast(rivals), same & beaten, "left_anti")
    return result.drop("_slice")


def _front_points(points: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    if len(names) == 1:
        return points.groupBy(*by).agg(F.max(names[0]).alias(names[0]))
    if len(names) == 2:
        return _front_two(points, by)
    return _front_many(points, by, names)


def pareto_front(df: DataFrame, objectives, by="cls", minimise=()) -> DataFrame:
    """Rows no other row of their group dominates."""
    keys = _keys(by)
    full, names = with_vector(df, objectives, minimise)
    points = full.select(*keys, *names).distinct()
    front = _front_points(points, keys, names)
    return full.join(front, [*keys, *names], "left_semi").drop(*names)


def rank_vectors(values: np.ndarray) -> np.ndarray:
    """Front number of every distinct vector: sort once, then place each in the first front it fits.

    In lexicographic order only earlier vectors can dominate a later one, and a vector
    dominated by some member of front f is dominated by some member of every front
    before f, so the front is found by bisection.
    """
    order = np.lexsort(tuple(-values[:, k] for k in range(values.shape[1] - 1, -1, -1)))
    rank = np.zeros(len(values), np.int32)
    if values.shape[1] <= 2:
        # With two objectives a front holds a vector as good iff its largest second value is as large.
        tops: list[float] = []  # negated, ascending
        for i, second in zip(order, -values[order, -1]):
            rank[i] = front = bisect_right(tops, second)
            if front == len(tops):
                tops.append(second)
            else:
                tops[front] = second
        return rank
    fronts: list[list[int]] = []
    for i in order:
        lo, hi = 0, len(fronts)
        while lo < hi:
            mid = (lo + hi) // 2
            if (values[fronts[mid]] >= values[i]).all(axis=1).any():
                lo = mid + 1
            else:
                hi = mid
        if lo == len(fronts):
            fronts.append([])
        fronts[lo].append(i)
        rank[i] = lo
    return rank


def _numbered(points: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Distinct vectors with ``_at`` from 0, group after group, each from its best first objective downwards."""
    line = [*[F.asc(k) for k in keys], *[F.desc(n) for n in names]]
    return with_row_index(points.repartitionByRange(*line).sortWithinPartitions(*line), 0, "_at")


def _rank_one(points: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Ranks of one objective: the place in the sorted table less the place where the group begins."""
    placed = cut_lineage(_numbered(points, keys, names))
    if not keys:
        return placed.withColumn("rank", F.col("_at").cast("int")).drop("_at")
    starts = placed.groupBy(*keys).agg(F.min("_at").alias("_start"))
    return placed.join(starts, keys).withColumn("rank", (F.col("_at") - F.col("_start")).cast("int")).drop("_at", "_start")


def _pile(keys: list[str], names: list[str], held: tuple | None, tops: list[float]):
    """Sorted vectors of a slice to their ranks; ``tops`` has what the fronts of the group ``held`` have reached."""

    def run(batches):
        now, piles = held, list(tops)
        for pdf in batches:
            ranks = []
            for group, second in zip(pdf[keys].itertuples(index=False, name=None), (-pdf[names[1]]).tolist()):
                if group != now:
                    now, piles = group, []
                front = bisect_right(piles, second)
                if front == len(piles):
                    piles.append(second)
                else:
                    piles[front] = second
                ranks.append(front)
            yield pdf.assign(rank=np.array(ranks, np.int32))

    return run


def _rank_two(points: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Ranks of two objectives, slice by slice of the sorted table.

    What a slice must know of those before it is the best second value of each front of the group it goes on with:
    one number per front, which is carried on. Every slice is one bounded task.
    """
    placed = cut_lineage(_numbered(points, keys, names))
    total, done, held, tops = placed.count(), [], None, []
    kept = [*keys, *names]
    schema = placed.select(*kept).withColumn("rank", F.lit(0)).schema
    for start in range(0, total, PAIR_LIMIT):
        part = placed.where((F.col("_at") >= start) & (F.col("_at") < start + PAIR_LIMIT)).coalesce(1).sortWithinPartitions("_at")
        ranked = cut_lineage(part.select(*kept).mapInPandas(_pile(keys, names, held, tops), schema))
        done.append(ranked)
        last = placed.where(F.col("_at") == min(start + PAIR_LIMIT, total) - 1).select(*keys).head()
        mine = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.lit(v)) for k, v in zip(keys, last)], F.lit(True))
        reached = {r[0]: -r[1] for r in ranked.where(mine).groupBy("rank").agg(F.max(names[1])).collect()}
        # A later vector of a front has no smaller second value than those before it.
        before = dict(enumerate(tops)) if held == tuple(last) else {}
        held, tops = tuple(last), [v for _, v in sorted((before | reached).items())]
    return reduce(lambda a, b: a.unionByName(b), done) if done else points.withColumn("rank", F.lit(0))


def nondominated_rank(
    df: DataFrame, objectives, by="cls", minimise=(), max_rank: int | None = None, group_bound: int | None = None
) -> DataFrame:
    """Add ``rank``, the number of the front, counted from 0 within each group.

    ``group_bound`` is a bound on the group size the caller vouches for; without it the distinct vectors are
    counted. One objective is sorted by ranges; two are sorted too and piled slice by slice; more are ranked by one
    task per group within GROUP_LIMIT, and larger groups are peeled front by front, each front found by a
    distributed step. Rows beyond ``max_rank`` get a null rank.
    """
    keys = _keys(by)
    ship(df.sparkSession)
    full, names = with_vector(df, objectives, minimise)
    if group_bound is not None and group_bound <= GROUP_LIMIT:
        # Small groups: whole rows go to one task each, which saves joining the ranks back.
        schema = df.withColumn("rank", F.lit(0)).schema

        def rank_rows(pdf: pd.DataFrame) -> pd.DataFrame:
            vectors, back = np.unique(pdf[names].to_numpy(), axis=0, return_inverse=True)
            ranks = rank_vectors(vectors)[back.ravel()]
            if max_rank is not None:
                ranks = pd.array(np.where(ranks <= max_rank, ranks, -1), dtype="Int32").replace(-1, pd.NA)
            return pdf.assign(rank=ranks)[schema.names]

        return full.groupBy(*keys).applyInPandas(rank_rows, schema)
    points = full.select(*keys, *names).distinct()
    if len(names) > 1 and group_bound is None:
        points = cut_lineage(points)
        group_bound = points.groupBy(*keys).count().agg(F.max("count")).head()[0] or 0
    if len(names) == 1:
        ranked = _rank_one(points, keys, names)
    elif group_bound <= (PAIR_LIMIT if len(names) == 2 else GROUP_LIMIT):
        schema = points.withColumn("rank", F.lit(0)).schema

        def rank(pdf: pd.DataFrame) -> pd.DataFrame:
            return pdf.assign(rank=rank_vectors(pdf[names].to_numpy()))

        ranked = points.groupBy(*keys).applyInPandas(rank, schema)
    elif len(names) == 2:
        ranked = _rank_two(points, keys, names)
    else:
        left, level, done = points, 0, []
        while not left.isEmpty() and (max_rank is None or level <= max_rank):
            front = cut_lineage(_front_points(left, keys, names))
            done.append(front.withColumn("rank", F.lit(level)))
            left = cut_lineage(left.join(front, [*keys, *names], "left_anti"))
            level += 1
        ranked = reduce(lambda a, b: a.unionByName(b), done)
    if max_rank is not None:
        ranked = ranked.where(F.col("rank") <= max_rank)
    return full.join(ranked, [*keys, *names], "left").drop(*names)


def crowding_distance(df: DataFrame, objectives, by="cls", rank: str = "rank", tie: str = "rule_id") -> DataFrame:
    """Add ``crowding``: per front, the sum over objectives of the gap between neighbours.

    Border rows get +inf; an objective without spread adds 0 to the others.
    """
    front = Window.partitionBy(*_keys(by), rank)
    parts = []
    for o in objectives:
        line = front.orderBy(F.col(o), F.col(tie))
        before, after = F.lag(o).over(line), F.lead(o).over(line)
        spread = F.max(o).over(front) - F.min(o).over(front)
        parts.append(
            F.when(before.isNull() | after.isNull(), F.lit(float("inf")))
            .when((spread > 0) & (spread < float("inf")), (after - before) / spread)
            .otherwise(F.lit(0.0))
        )
    total = reduce(lambda a, b: a + b, parts)
    return df.withColumn("crowding", F.when(F.isnan(total), F.lit(0.0)).otherwise(total))


def select_top(df: DataFrame, k, by="cls", rank: str = "rank", tie: str = "rule_id") -> DataFrame:
    """Best ``k`` rows per group by front, then crowding, then id; adds ``slot`` from 1."""
    order = Window.partitionBy(*_keys(by)).orderBy(F.col(rank), F.col("crowding").desc(), F.col(tie))
    return df.withColumn("slot", F.row_number().over(order)).where(F.col("slot") <= k)
