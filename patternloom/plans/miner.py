"""The whole mining run: search, reinitialisation, final selection, application.

The state of the search is a population of bounded size (individuals per class), which the driver holds; rules
are scored on Spark, each canonical rule once, since a memo keeps what was seen. Rows and coverages stay on
Spark: the cover of each class's front is written when the front changes, and only counts come back.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patternloom.functions.measures import all_measures
from patternloom.model import TableModel
from patternloom.operators.contingency import with_objectives
from patternloom.operators.encode import compact
from patternloom.operators.generate import (
    GENERATION,
    OPERATORS,
    covering_masks,
    init_oriented,
    init_random,
    oriented_masks,
)
from patternloom.operators.profile import build_model
from patternloom.operators.ranking import crowding_distance, nondominated_rank, pareto_front, select_top
from patternloom.operators.rules import dedupe_rules
from patternloom.operators.selection import better_set, measure_filter, with_slot
from patternloom.plans.layout import evaluate_rules, matched_rows, prepare
from patternloom.plans.population import UNRANKED, Individual, Scorer, population_frame, reproduce_rules, survivors
from patternloom.session import cut_lineage, small_table
from patternloom.sources import reports

CREDIT_FLOOR = 2


def settled(rules: DataFrame) -> DataFrame:
    """A rule table whose size a parameter bounds (a population, a front, an elite), evaluated once."""
    return rules.sparkSession.createDataFrame(rules.toArrow(), rules.schema)


class FrontCover:
    """Tells whether a new front of a class covers rows that its front before did not."""

    def __init__(self, layout):
        self.layout, self.rules = layout, {c: frozenset() for c in layout.model.classes}
        self.held: dict[str, tuple[frozenset, DataFrame]] = {}  # by class the front that was matched last, and its cover
        self.known: dict[str, list[tuple[frozenset, frozenset, bool]]] = {c: [] for c in self.rules}

    def changed(self, fronts: dict[str, frozenset]) -> set[str]:
        """Classes whose front (canonical masks) now covers a row that their front before did not.

        Only new rules can. What a larger front left uncovered, a smaller one does; so answers given before settle
        many questions. For the others the fronts are matched in one job and their cover is kept, as
        it is the one to compare with next time.
        """
        before, self.rules = self.rules, fronts
        out, asked = set(), []
        for c, front in fronts.items():
            fresh = front - before[c]
            if not fresh:
                continue
            answer = next((new for old, rules, new in self.known[c] if (old >= before[c] and rules <= fresh if new else old <= before[c] and rules >= fresh)), None)
            if answer is None:
                asked.append(c)
            elif answer:
                out.add(c)
        if asked:
            covers = {id(self.held[c][1]) for c in asked if c in self.held and self.held[c][0] == before[c]}
            kept = len(covers) == 1 and all(c in self.held and self.held[c][0] == before[c] for c in asked)
            old = self.held[asked[0]][1] if kept else self._cover(before, asked)
            now = self._cover(fronts, asked).persist()
            added = {r["rule_cls"] for r in self.layout.added(old.where(F.col("rule_cls").isin(asked)), now).collect()}
            self.release(asked)
            for c in asked:
                self.held[c] = fronts[c], now
                self.known[c].append((before[c], fronts[c] - before[c], c in added))
            out |= added & set(asked)
        return out

    def _cover(self, fronts: dict[str, frozenset], classes: list[str]) -> DataFrame:
        listed = [(i, c, list(m)) for i, (c, m) in enumerate((c, m) for c in classes for m in sorted(fronts[c]))]
        table = small_table(self.layout.spark, listed, "rule_id bigint, cls string, masks array<bigint>")
        return self.layout.cover(table, len(listed))

    def release(self, classes) -> None:
        """Forget the covers of these classes; a cover that no class needs any more leaves the memory."""
        gone = [self.held.pop(c)[1] for c in classes if c in self.held]
        for cover in gone:
            if all(cover is not other for _, other in self.held.values()):
                cover.unpersist()


def replace_population(
    pop: DataFrame, offspring: DataFrame, objectives, individuals: int, minimise=()
) -> DataFrame:
    """Best ``individuals`` per class of parents and offspring, by front and crowding."""
    joint = pop.unionByName(offspring)
    ranked = nondominated_rank(joint, objectives, "cls", minimise, group_bound=2 * individuals)
    # Partitioned by class once: the windows over fronts and over classes both accept it.
    return select_top(crowding_distance(ranked.repartition("cls"), objectives), individuals)


@dataclass
class MinedPatterns:
    """Result of a run: the model of the training table and its final scored rules."""

    model: TableModel
    rules: DataFrame
    objectives: tuple[str, ...]
    history: list[dict] = field(default_factory=list)

    def encode_test(self, df: DataFrame) -> DataFrame:
        """Test rows under the training domains and labels."""
        return compact(df, self.model)

    def evaluate(self, df: DataFrame) -> DataFrame:
        """Rules with counts and all listed measures on another table."""
        base = self.rules.select("rule_id", "cls", "masks")
        return all_measures(evaluate_rules(df, base, self.model))

    def match(self, df: DataFrame, keep=None) -> DataFrame:
        """Rows of a table with each rule that covers them."""
        return matched_rows(df, self.rules, self.model, list(keep or df.columns))

    def write(self, folder: str, test: DataFrame | None = None) -> None:
        """Rules, training measures and, for a test table, test measures."""
        reports.write_rules(self.rules, self.model, f"{folder}/rules")
        reports.write_training_measures(self.rules, self.model, self.objectives, f"{folder}/training")
        if test is not None:
            reports.write_test_measures(self.evaluate(test), self.model, f"{folder}/test")


@dataclass
class PatternMiner:
    class_col: str
    numeric: list[str] | None = None
    nominal: list[str] | None = None
    n_labels: int = 3
    individuals: int = 100
    evaluations: int = 25_000
    objectives: tuple[str, ...] = ("WRAccNorm", "SuppDiff")
    minimise: tuple[str, ...] = ()
    filters: tuple[tuple[str, float], ...] = (("Confidence", 0.6),)
    seed: int = 1
    init: str = "oriented"
    layout: str = "auto"
    rid: str | None = None
    max_domain: int = 10_000

    def fit(self, df: DataFrame, model: TableModel | None = None) -> MinedPatterns:
        model = model or build_model(
            df, self.class_col, self.numeric, self.nominal, self.n_labels, self.max_domain
        )
        layout = prepare(df, model, self.layout, self.rid)
        try:
            return self._search(df.sparkSession, model, layout)
        finally:
            layout.release()

    # -- steps -------------------------------------------------------------

    def _columns(self) -> list[str]:
        measures = list(dict.fromkeys([*self.objectives, "WRAccNorm"]))
        return ["rule_id", "cls", "masks", "tp", "fp", "tn", "fn", *measures]

    def _score(self, layout, rules: DataFrame, n: int) -> DataFrame:
        counts = layout.counts(rules.select("rule_id", "cls", "masks"), n)
        return with_objectives(counts, layout.model, self.objectives).select(*self._columns())

    def _unranked(self, scored: DataFrame) -> DataFrame:
        return with_slot(scored).withColumns({"rank": F.lit(UNRANKED), "crowding": F.lit(0.0)})

    def _schema(self) -> str:
        columns = [f"{c} {'bigint' if c in ('tp', 'fp', 'tn', 'fn') else 'double'}" for c in self._columns()[3:]]
        return ", ".join(["rule_id bigint, cls string, masks array<bigint>", *columns, "slot int, rank int, crowding double"])

    def _search(self, spark, model: TableModel, layout) -> MinedPatterns:
        size = self.individuals * len(model.classes)
        start = {"random": init_random, "oriented": init_oriented}[self.init]
        scorer = Scorer(layout, self.objectives, self.minimise, self._columns())
        first = start(spark, model, size, self.seed).select("rule_id", "cls", "masks").orderBy("rule_id").collect()
        pop: dict[str, list[Individual]] = {c: [] for c in model.classes}
        for x in scorer((r["rule_id"], r["cls"], tuple(r["masks"])) for r in first):
            pop[x.cls].append(x)
        probs = {op: 1.0 / len(OPERATORS) for op in OPERATORS}
        elite, gen, used = None, 0, size
        last_change = {c: 0 for c in model.classes}
        patience = int(self.evaluations * 0.25)
        history: list[dict] = []
        cover = FrontCover(layout)

        while used < self.evaluations:
            gen += 1
            pop, credits = self.generation(scorer, pop, model, probs, gen)
            changed = cover.changed({c: frozenset(scorer.canonical(x.masks) for x in mine if x.rank == 0) for c, mine in pop.items()})
            if elite is None:  # the first population is the elite of every class
                elite = population_frame(pop, spark, self._schema()).select(*self._columns())
            restarted = []
            for c in model.classes:
                if c in changed:
                    last_change[c] = used
                elif used + size * len(restarted) - last_change[c] >= patience:
                    restarted.append(c)
            if restarted:
                renewed, elite = self.reinitialise(layout, population_frame(pop, spark, self._schema()), elite, restarted, gen)
                mine = renewed.where(F.col("cls").isin(restarted)).orderBy("cls", "slot").collect()
                for c in restarted:
                    pop[c] = scorer((r["rule_id"], c, tuple(r["masks"])) for r in mine if r["cls"] == c)
                last_change.update(dict.fromkeys(restarted, used))
                used += size * len(restarted)
            used += size
            total = sum(max(credits.get(op, 0), CREDIT_FLOOR) for op in OPERATORS)
            probs = {op: max(credits.get(op, 0), CREDIT_FLOOR) / total for op in OPERATORS}
            history.append({"generation": gen, "evaluations": used, "restarted": restarted, "probs": probs, "scored": len(scorer.memo)})

        cover.release(model.classes)
        rules = cut_lineage(self.finalise(layout, population_frame(pop, spark, self._schema()), elite))
        return MinedPatterns(model, rules, tuple(self.objectives), history)

    def generation(self, scorer: Scorer, pop, model: TableModel, probs: dict[str, float], gen: int):
        """Next population, and how many children each operator made."""
        born = reproduce_rules(pop, model, probs, self.seed, gen)
        scored = scorer((i, c, m) for i, c, m, _, surplus in born if not surplus)
        joint = {c: list(mine) for c, mine in pop.items()}
        for x in scored:
            joint[x.cls].append(x)
        kept = {c: survivors(mine, len(self.objectives), self.individuals) for c, mine in joint.items()}
        return kept, Counter(op for _, _, _, op, _ in born)

    def _competitors(self, layout, front: DataFrame, elite: DataFrame | None, bound: int) -> DataFrame:
        """Front and elite after token competition and dominance."""
        cols = self._columns()
        joint = front.select(*cols) if elite is None else front.select(*cols).unionByName(elite.select(*cols))
        joint = settled(dedupe_rules(joint, cols[3:]))
        kept = settled(layout.token_competition(joint, bound))
        return pareto_front(kept, self.objectives, "cls", self.minimise)

    def reinitialise(self, layout, pop: DataFrame, elite: DataFrame, classes: list[str], gen: int):
        """Renew the populations of some classes; their elite improves if diversity does.

        A class with uncovered rows restarts from the features of the first of them, any
        other class from short random rules.
        """
        cols, n = self._columns(), self.individuals * len(classes)
        mine = F.col("cls").isin(classes)
        chosen = settled(self._competitors(layout, pop.where(mine & (F.col("rank") == 0)), elite.where(mine), 3 * n))
        elite = self.update_elite(elite, chosen, classes)

        number = F.lit(gen).cast("bigint") * GENERATION + GENERATION // 2 + F.col("rule_no")
        position = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("cls")) - 1
        ids = (
            pop.where(mine)
            .withColumn("rule_no", position * self.individuals + F.col("slot"))
            .select(number.alias("rule_id"), "cls")
        )
        pairs = settled(layout.uncovered_pairs(chosen, classes, 3 * n))  # features of one row per class
        still_open = [r["cls"] for r in pairs.select("cls").distinct().collect()]
        fresh = covering_masks(ids, pairs, layout.model, self.seed, gen, 0.5)
        rest = ids.where(~F.col("cls").isin(still_open))
        fresh = settled(fresh.unionByName(oriented_masks(rest, layout.model, self.seed, gen)))
        renewed = self._unranked(self._score(layout, fresh, n))
        others = pop.where(~mine).select(*cols, "slot", "rank", "crowding")
        return settled(others.unionByName(renewed.select(*others.columns))), elite

    def update_elite(self, elite: DataFrame, chosen: DataFrame, classes: list[str]) -> DataFrame:
        cols = self._columns()
        mine = F.col("cls").isin(classes)
        best = better_set(elite.where(mine).select(*cols), chosen.select(*cols))
        return settled(elite.where(~mine).select(*cols).unionByName(best))

    def finalise(self, layout, pop: DataFrame, elite: DataFrame | None) -> DataFrame:
        """Per class the better of elite and competitors, then the measure filter."""
        cols = self._columns()
        ranked = nondominated_rank(
            pop.select(*cols), self.objectives, "cls", self.minimise, group_bound=self.individuals
        )
        chosen = settled(
            self._competitors(layout, ranked.where("rank = 0"), elite, 3 * self.individuals * len(layout.model.classes))
        )
        best = chosen if elite is None else settled(better_set(elite, chosen))
        filtered = measure_filter(dedupe_rules(best.select(*cols), cols[3:]), layout.model, self.filters)
        return filtered.select(*cols)
