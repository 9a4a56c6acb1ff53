"""The rule population of a search between two scorings.

A population has ``individuals`` rules per class, a parameter and not a property of the data, so the steps
that only touch rules (variation, ranking, truncation) run on the driver, while rules meet rows on Spark.
They follow the operators on rule tables (``reproduce``, ``nondominated_rank``, ``crowding_distance``,
``select_top``) number by number: the same hashes decide, and the same ties win.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import cached_property
from hashlib import md5
from itertools import groupby
from math import inf, isnan

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patternloom.functions.measures import with_measures
from patternloom.model import TableModel
from patternloom.operators.contingency import confusion
from patternloom.operators.generate import GENERATION, HUX, MUTATION
from patternloom.operators.ranking import rank_vectors, with_vector
from patternloom.session import small_table

UNRANKED = 2**31 - 1
Masks = tuple[int, ...]


@dataclass
class Individual:
    rule_id: int
    cls: str
    masks: Masks
    row: tuple  # tp, fp, tn, fn and the measures of the search
    goals: tuple  # objectives as they are compared: rounded, to be maximised
    rank: int = UNRANKED
    crowding: float = 0.0


def _hex(parts: tuple) -> str:
    return md5("|".join(map(str, parts)).encode()).hexdigest()


def uniform(*parts) -> float:
    return int(_hex(parts)[:8], 16) / 4294967296.0


def pick(n: int, *parts) -> int:
    return int(uniform(*parts) * n)


def random_bits(*parts) -> int:
    return int(_hex(parts)[:15], 16)


class Scorer:
    """Scores rules, each canonical rule of a class once: what was seen comes from the memo.

    The memo has at most one entry per evaluation of the budget.
    """

    def __init__(self, layout, objectives: tuple[str, ...], minimise: tuple[str, ...], columns: list[str]):
        self.layout, self.objectives, self.minimise = layout, objectives, minimise
        self.columns = columns[3:]  # counts and measures
        self.memo: dict[tuple[str, Masks], tuple] = {}
        model = layout.model
        self.spans = [(i, i + n, a.n_values) for a in model.attributes for i, n in [(model.var_words[a.pos][0], len(model.var_words[a.pos]))]]

    def canonical(self, masks: Masks) -> Masks:
        """Words of variables that do not take part as zero."""
        out = list(masks)
        for a, b, size in self.spans:
            held = sum(m.bit_count() for m in masks[a:b])
            if held in (0, size):
                out[a:b] = [0] * (b - a)
        return tuple(out)

    def __call__(self, rules: Iterable[tuple[int, str, Masks]]) -> list[Individual]:
        rules = [(i, c, m, (c, self.canonical(m))) for i, c, m in rules]
        new = list({k: None for *_, k in rules if k not in self.memo})
        if new:
            self._learn(new)
        return [Individual(i, c, m, *self.memo[k]) for i, c, m, k in rules]


    def _learn(self, new: list[tuple[str, Masks]]) -> None:
        """Match rules with the rows in one job; rules that cover nothing are known by their class."""
        listed = [(i, c, list(m)) for i, (c, m) in enumerate(new)]
        table = small_table(self.layout.spark, listed, "rule_id bigint, cls string, masks array<bigint>")
        found = self.layout.covered(table, len(new))
        counts = found.select("rule_id", *confusion("rule_cls", self.layout.class_totals))
        held = {r[0]: (tuple(r[1]), tuple(r[2])) for r in self._measured(counts, False)}
        for i, key in enumerate(new):
            self.memo[key] = held.get(i) or self.bare[key[0], any(key[1])]

    def _measured(self, counts: DataFrame, empty: bool) -> list:
        names = list(dict.fromkeys([*self.objectives, "WRAccNorm"]))
        scored = counts.withColumns(dict.fromkeys(names, F.lit(float("-inf")))) if empty else with_measures(counts, names)
        full, goals = with_vector(scored, self.objectives, self.minimise)
        return full.select("rule_id", F.struct(*self.columns), F.struct(*goals)).collect()

    @cached_property
    def bare(self) -> dict[tuple[str, bool], tuple]:
        """What rules that cover no row have, by class and whether they have a condition."""
        totals = self.layout.class_totals
        rows = [(k, 0, 0, sum(totals.values()) - n, n) for k, n in enumerate(totals.values())]
        counts = small_table(self.layout.spark, rows, "rule_id bigint, tp bigint, fp bigint, tn bigint, fn bigint")
        names, out = list(totals), {}
        for some in (False, True):
            out |= {(names[r[0]], some): (tuple(r[1]), tuple(r[2])) for r in self._measured(counts, not some)}
        return out


def reproduce_rules(
    pop: dict[str, list[Individual]], model: TableModel, probs: dict[str, float], seed: int, gen: int
) -> list[tuple[int, str, Masks, str, bool]]:
    """(rule_id, cls, masks, operator, surplus) of the children of one generation; see ``reproduce``."""
    total, number, out = sum(map(len, pop.values())), 0, []
    names = sorted(probs)
    owner, full = [w.var for w in model.words], [w.full for w in model.words]
    for cls in sorted(pop):
        mine, made, draw = pop[cls], 0, 0
        while made < len(mine):
            u, bound, op = uniform(seed, gen, "operator", cls, draw), 0.0, names[-1]
            for name in names[:-1]:
                bound += probs[name]
                if u < bound:
                    op = name
                    break
            a, b = (_tournament(mine, seed, gen, cls, draw, parent).masks for parent in (0, 1))
            key = f"{cls}:{draw}"
            if op == MUTATION:
                kids = [_mutated(a, model.n_vars, owner, full, key, seed, gen)]
            elif op == HUX:
                moved = [(x ^ y) & random_bits(seed, gen, "hux", key, w) for w, (x, y) in enumerate(zip(a, b))]
                kids = [tuple(x ^ m for x, m in zip(a, moved)), tuple(y ^ m for y, m in zip(b, moved))]
            else:
                cuts = {pick(model.n_vars, seed, gen, "cut", key, i) for i in range(min(2, model.n_vars))}
                swap = [sum(c < v for c in cuts) % 2 for v in owner]
                kids = [tuple(y if s else x for s, x, y in zip(swap, a, b)), tuple(x if s else y for s, x, y in zip(swap, a, b))]
            for masks in kids:
                number += 1
                out.append((gen * GENERATION + number, cls, masks, op, number > total))
            made += len(kids)
            draw += 1
    return out


def _tournament(mine: list[Individual], seed: int, gen: int, cls: str, draw: int, parent: int) -> Individual:
    a, b = (mine[pick(len(mine), seed, gen, "tournament", cls, draw, parent, side)] for side in ("a", "b"))
    return b if (b.rank, -b.crowding) < (a.rank, -a.crowding) else a


def _mutated(masks: Masks, n_vars: int, owner: list[int], full: list[int], key: str, seed: int, gen: int) -> Masks:
    var = pick(n_vars, seed, gen, "mut_var", key)
    clear = uniform(seed, gen, "mut_kind", key) < 0.5
    return tuple(
        m if v != var else 0 if clear else m ^ (random_bits(seed, gen, "mut_bits", key, w) & f)
        for w, (m, v, f) in enumerate(zip(masks, owner, full))
    )


def survivors(joint: list[Individual], n_objectives: int, individuals: int) -> list[Individual]:
    """The best of one class by front, crowding and id; see ``replace_population``."""
    vectors, back = np.unique(np.array([x.goals for x in joint], float).reshape(len(joint), n_objectives), axis=0, return_inverse=True)
    for x, rank in zip(joint, rank_vectors(vectors)[back.ravel()].tolist()):
        x.rank, x.crowding = rank, 0.0
    for _, front in groupby(sorted(joint, key=lambda x: x.rank), key=lambda x: x.rank):
        front = list(front)
        for k in range(4, 4 + n_objectives):  # objectives stand after the four counts
            line = sorted(front, key=lambda x: (x.row[k], x.rule_id))
            spread = line[-1].row[k] - line[0].row[k]
            for at, x in enumerate(line):
                if at in (0, len(line) - 1):
                    x.crowding += inf
                elif 0 < spread < inf:
                    x.crowding += (line[at + 1].row[k] - line[at - 1].row[k]) / spread
        for x in front:
            x.crowding = 0.0 if isnan(x.crowding) else x.crowding
    return sorted(joint, key=lambda x: (x.rank, -x.crowding, x.rule_id))[:individuals]


def population_frame(pop: dict[str, list[Individual]], spark, schema: str) -> DataFrame:
    """The population as a rule table with slot, rank and crowding."""
    rows = [(x.rule_id, x.cls, list(x.masks), *x.row, slot, x.rank, x.crowding) for mine in pop.values() for slot, x in enumerate(mine, 1)]
    return small_table(spark, rows, schema)
