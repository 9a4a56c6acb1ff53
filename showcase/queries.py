"""One Spark query per operator, each over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from patternloom.functions.fuzzy import belonging_degree, fuzzy_labels, label_text
from patternloom.functions.hashing import uniform
from patternloom.functions.masks import normalise
from patternloom.functions.measures import MEASURES, measure_violations, with_measures
from patternloom.operators import coverage as cov
from patternloom.operators import generate as gen
from patternloom.operators import profile as prof
from patternloom.operators import ranking, selection
from patternloom.operators.bitmaps import covered_rows_bitmap, newly_covered_bitmap, token_competition_bitmap, wide_lut
from patternloom.operators.contingency import (
    contingency,
    contingency_bitmap,
    mean_diversity,
    score,
)
from patternloom.operators.encode import compact, encode_items, feature_lut, feature_support, items_long
from patternloom.operators.rules import (
    dedupe_rules,
    mask_predicate,
    pair_rules,
    rule_items,
    rule_predicate,
    rule_shape,
    rules_table,
    single_rules,
)
from patternloom.plans.layout import RowLayout, prepare
from patternloom.plans.miner import MinedPatterns, PatternMiner, replace_population
from patternloom.plans.population import Scorer, population_frame
from patternloom.session import cut_lineage, ensure_checkpoint_dir
from patternloom.sources.arff import arff_schema, read_arff
from patternloom.sources.reports import (
    render_rules,
    test_measures,
    training_measures,
    write_rules,
    write_test_measures,
    write_training_measures,
)
from patternloom.sources.row_index import with_row_index
from showcase.bindings import (
    CUSTOMERS,
    DEGENERATE,
    DOCUMENTS,
    EVENTS,
    GAPS,
    LINES,
    ORDERS,
    PLANTED,
    VECTORS,
    Binding,
)

SEED = 7
TRADE_OFF = ("Confidence", "TPR")
THREE_WAY = ("Confidence", "TPR", "TNR")


def _masks(name: str = "masks"):
    return F.array_join(F.transform(F.col(name), lambda m: m.cast("string")), ",").alias("masks")


def _r9(*names):
    return [F.round(F.col(n), 9).alias(n) for n in names]


class Case:
    """A bound table with its model, and rule tables over it."""

    def __init__(self, spark: SparkSession, sf_dir: str, binding: Binding):
        self.spark, self.binding = spark, binding
        self.df = binding.load(spark, sf_dir)
        self.model = binding.model(self.df)
        self.totals = dict(zip(self.model.classes, self.model.class_counts))

    def rows(self, keep=()):
        return encode_items(self.df, self.model, list(keep))

    def compact(self, rid=None):
        return compact(self.df, self.model, rid)

    def rules(self, listed):
        return rules_table(self.spark, self.model, listed), len(listed)

    def scored(self, listed, names=TRADE_OFF):
        rules, n = self.rules(listed)
        return score(self.compact(), rules, self.model, names, n, self.totals), n

    def singles(self):
        return single_rules(self.model)

    def pairs(self):
        return pair_rules(self.model)


# -- sources and profile ------------------------------------------------------


def arff_roundtrip(spark: SparkSession, sf: str):
    df = ORDERS.load(spark, sf).select("o_totalprice", "o_orderpriority", "o_orderstatus")
    folder = f"{ensure_checkpoint_dir(spark)}/arff-{uuid.uuid4().hex}"
    header = ["@relation orders", "@attribute o_totalprice real", "@attribute o_orderpriority string"]
    header += ["@attribute 'o_orderstatus' {F, O, P}", "@data", "% comment", ""]
    spark.createDataFrame([(i, x) for i, x in enumerate(header)], "i int, value string").coalesce(1).sortWithinPartitions(
        "i"
    ).select("value").write.text(folder)
    line = F.concat_ws(",", F.col("o_totalprice").cast("string"), F.format_string("'%s'", "o_orderpriority"), "o_orderstatus")
    df.select(line.alias("value")).write.mode("append").text(folder)
    back = read_arff(spark, folder, schema=arff_schema(spark, folder))
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    return back.groupBy("o_orderpriority", "o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.sum(cents).alias("cents")
    )


def row_index(spark, sf):
    return with_row_index(ORDERS.load(spark, sf).select("o_orderkey"), offset=1, name="row_no")


def profile_numeric(spark, sf):
    return prof.profile_numeric(LINES.load(spark, sf), list(LINES.numeric))


def profile_nominal(spark, sf):
    df = CUSTOMERS.load(spark, sf)
    out = prof.profile_nominal(df, [*CUSTOMERS.nominal, CUSTOMERS.cls])
    return out.select("name", F.array_join("domain", ",").alias("domain"), "n_values")


def feature_count(spark, sf):
    c = Case(spark, sf, CUSTOMERS)
    return prof.feature_count(c.model.attributes_frame(spark), len(c.model.classes))


def row_count(spark, sf):
    return prof.row_count(DOCUMENTS.load(spark, sf))


def class_counts(spark, sf):
    return prof.class_counts(DOCUMENTS.load(spark, sf), DOCUMENTS.cls)


# -- labels and encoding ---------------------------------------------------------


def fuzzy_labels_lines(spark, sf):
    ranges = prof.profile_numeric(LINES.load(spark, sf), list(LINES.numeric))
    where = F.create_map(*[F.lit(x) for p in enumerate(LINES.numeric) for x in (p[1], p[0])])
    attrs = ranges.select(where[F.col("name")].alias("pos"), F.lit("numeric").alias("kind"), "min", "max")
    labels = fuzzy_labels(attrs, 3)
    text = label_text(F.col("shape"), F.col("x0"), F.col("x1"), F.col("x2")).alias("label_text")
    return labels.select("var", "label", "shape", *_r9("x0", "x1", "x2"), text)


def membership(spark, sf):
    c = Case(spark, sf, ORDERS)
    x = prof.numeric_value(c.df, "o_totalprice")
    labels = c.model.attributes[0].labels
    return c.df.selectExpr("o_orderkey", *[f"round({belonging_degree(x, lab)}, 9) as d{lab.label}" for lab in labels])


def assign_labels(spark, sf):
    return Case(spark, sf, ORDERS).rows(["o_orderkey"]).select("o_orderkey", F.col("m0").alias("labels"))


def encode_rows(spark, sf):
    return Case(spark, sf, CUSTOMERS).rows(["c_custkey"]).drop("n")


def encode_long_domain(spark, sf):
    return Case(spark, sf, EVENTS).rows(["event_id"]).drop("n")


def null_wildcard(spark, sf):
    return Case(spark, sf, GAPS).rows(["o_orderkey"]).drop("n")


def degenerate_columns(spark, sf):
    c = Case(spark, sf, DEGENERATE)
    return c.rows().groupBy("cls", *c.model.mask_columns).agg(F.count(F.lit(1)).alias("n_rows"))


def signatures(spark, sf):
    return Case(spark, sf, LINES).compact().withColumnRenamed("n", "n_rows")


def items(spark, sf):
    return items_long(Case(spark, sf, ORDERS).rows(["o_orderkey"]), Case(spark, sf, ORDERS).model, ["o_orderkey", "cls"])


def feature_support_lines(spark, sf):
    c = Case(spark, sf, LINES)
    return feature_support(c.compact(), c.model)


def feature_bitmaps(spark, sf):
    c = Case(spark, sf, ORDERS)
    keyed = c.df.withColumn("row_no", F.col("o_orderkey") + 1)
    lut = feature_lut(encode_items(keyed, c.model, ["row_no"]), c.model, "row_no")
    return lut.select("bucket", "var", "val", F.bitmap_count("bits").alias("n"))


# -- rules and coverage ----------------------------------------------------------


def _edge_rules(model):
    """Rules at the edges of the definition, on the attributes price and priority."""
    a, b = model.attributes[0], model.attributes[1]
    every = list(range(b.n_values))
    c = model.classes
    return [
        (c[0], {}),
        (c[0], {0: list(range(a.n_values)), 1: every}),
        (c[1], {0: [1], 1: every}),
        (c[1], {0: [1]}),
        (c[1], {0: [1]}),
        (c[2], {0: [0, 1], 1: every[:-1]}),
        (c[2], {1: [0, 2]}),
    ]


def rule_shape_edges(spark, sf):
    c = Case(spark, sf, ORDERS)
    rules, _ = c.rules(_edge_rules(c.model) + c.pairs())
    return rule_shape(rules, c.model).select("rule_id", "cls", "empty", "num_vars", "num_active")


def rule_conditions(spark, sf):
    c = Case(spark, sf, ORDERS)
    return rule_items(c.rules(c.pairs())[0], c.model)


def rule_filter(spark, sf):
    c = Case(spark, sf, ORDERS)
    masks = c.model.mask({0: [0, 2], 1: [0, 1]})
    return c.df.where(rule_predicate(c.model, masks, nan_free=True)).select("o_orderkey", "o_orderstatus")


def rule_coverage(spark, sf):
    c = Case(spark, sf, ORDERS)
    rules, n = c.rules(c.pairs())
    return cov.coverage(c.df, rules, c.model, "o_orderkey", n)


def rule_dedupe(spark, sf):
    c = Case(spark, sf, ORDERS)
    rules = gen.init_random(spark, c.model, 600, SEED)
    scored = score(c.compact(), rules, c.model, TRADE_OFF, 600, c.totals)
    kept = dedupe_rules(scored, TRADE_OFF)
    return kept.select("rule_id", "cls", _masks(), "tp", "fp", "tn", "fn")


def _two_sets(c):
    """Row sets covered by two overlapping rules, built without matching tables."""
    rows = c.rows([c.binding.key])
    a = rows.where(mask_predicate(c.model, c.model.mask({0: [0, 1]}))).select(c.binding.key)
    b = rows.where(mask_predicate(c.model, c.model.mask({0: [1, 2], 1: [0, 1, 2]}))).select(c.binding.key)
    return rows.select(c.binding.key), a, b


def cover_union(spark, sf):
    _, a, b = _two_sets(Case(spark, sf, ORDERS))
    return cov.cover_union(a, b)


def cover_intersect(spark, sf):
    _, a, b = _two_sets(Case(spark, sf, ORDERS))
    return cov.cover_intersect(a, b)


def cover_difference(spark, sf):
    _, a, b = _two_sets(Case(spark, sf, ORDERS))
    return cov.newly_covered(a, b)


def cover_symdiff(spark, sf):
    _, a, b = _two_sets(Case(spark, sf, ORDERS))
    return cov.cover_symdiff(a, b)


def cover_complement(spark, sf):
    rows, a, _ = _two_sets(Case(spark, sf, ORDERS))
    return cov.cover_complement(rows, a)


def cover_count(spark, sf):
    c = Case(spark, sf, CUSTOMERS)
    rules, n = c.rules(c.singles())
    pairs = cov.coverage(c.df, rules, c.model, "c_custkey", n)
    return pairs.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))


def covered_rows(spark, sf):
    c = Case(spark, sf, ORDERS)
    rules, n = c.rules(c.pairs())
    return cov.covered_rows(cov.coverage(c.df, rules, c.model, "o_orderkey", n), 5, "o_orderkey")


def _narrow_rules(c):
    """Every class: the middle price label with the first priority, and the lowest price label."""
    return [(k, r) for k in c.model.classes for r in ({0: [1], 1: [0]}, {0: [0]})]


def first_uncovered(spark, sf):
    c = Case(spark, sf, ORDERS)
    rules, n = c.rules(_narrow_rules(c))
    rows = c.compact("o_orderkey")
    out = None
    for k in c.model.classes:
        mine = rules.where(F.col("cls") == k)
        one = cov.first_uncovered(rows, mine, c.model, k, n).select(F.lit(k).alias("cls"), "first_rid")
        out = one if out is None else out.unionByName(one)
    return out


def covering_pairs(spark, sf):
    """The features of the first order of each class that the rules of the class leave uncovered."""
    c = Case(spark, sf, ORDERS)
    rules, n = c.rules(_narrow_rules(c))
    left = cov.uncovered(c.compact("o_orderkey"), rules, c.model, c.model.classes, n)
    masks = c.model.mask_columns
    first = left.groupBy("cls").agg(F.min_by(F.struct(*masks), "first_rid").alias("m")).select("cls", "m.*")
    return cov.covering_pairs(first, c.model, keep=("cls",))


def cover_flags(spark, sf):
    c = Case(spark, sf, LINES)
    (a, _), (b, n) = c.rules(c.singles()), c.rules(c.pairs())
    half = {"first_kind": a.where(F.col("cls") == "A"), "second_kind": b.where(F.col("cls") == "N")}
    flags = cov.cover_flags(c.compact(), half, c.model, max_rules=2 * n)
    return flags.groupBy("cls", "first_kind", "second_kind").agg(F.sum("n").alias("n_rows"))


# -- counts and measures ------------------------------------------------------------

COUNTS = ["tp", "fp", "tn", "fn"]


def contingency_lines(spark, sf):
    c = Case(spark, sf, LINES)
    rules, n = c.rules(c.pairs())
    return contingency(c.compact(), rules, c.model, n).select("rule_id", "cls", *COUNTS)


def contingency_customers(spark, sf):
    c = Case(spark, sf, CUSTOMERS)
    rules, n = c.rules(c.pairs())
    return contingency(c.compact(), rules, c.model, n).select("rule_id", "cls", *COUNTS)


def contingency_gaps(spark, sf):
    c = Case(spark, sf, GAPS)
    rules, n = c.rules(c.pairs())
    return contingency(c.compact(), rules, c.model, n).select("rule_id", "cls", *COUNTS)


def contingency_degenerate(spark, sf):
    c = Case(spark, sf, DEGENERATE)
    rules, n = c.rules(c.pairs())
    return contingency(c.compact(), rules, c.model, n).select("rule_id", "cls", *COUNTS)


def contingency_bitmaps(spark, sf):
    c = Case(spark, sf, VECTORS)
    keyed = c.df.withColumn("row_no", F.col("vec_id") + 1)
    lut = wide_lut(keyed, c.model, "row_no")
    rules, n = c.rules(c.singles())
    return contingency_bitmap(lut, rules, c.model, n, class_totals=c.totals).select("rule_id", "cls", *COUNTS)


def objectives_penalised(spark, sf):
    c = Case(spark, sf, ORDERS)
    scored, _ = c.scored(_edge_rules(c.model), ("WRAccNorm", "SuppDiff"))
    finite = [F.when(F.col(m) > float("-inf"), F.round(m, 9)).alias(m) for m in ("WRAccNorm", "SuppDiff")]
    return scored.select("rule_id", "cls", (F.col("WRAccNorm") == float("-inf")).alias("worst"), *finite)


def measures_all(spark, sf):
    c = Case(spark, sf, LINES)
    rules, n = c.rules(c.pairs())
    full = with_measures(contingency(c.compact(), rules, c.model, n), MEASURES)
    plain = [m for m in MEASURES if m != "GrowthRate"]
    gr = F.when(F.col("GrowthRate") < float("inf"), F.round("GrowthRate", 9)).alias("GrowthRate")
    return full.select("rule_id", "cls", *COUNTS, *_r9(*plain), gr)


def measures_edges(spark, sf):
    """Measures of pure, empty and full rules: the planted class and an all-row class."""
    c = Case(spark, sf, PLANTED)
    rules, n = c.rules(c.pairs())
    full = with_measures(contingency(c.compact(), rules, c.model, n), MEASURES)
    plain = [m for m in MEASURES if m != "GrowthRate"]
    gr = F.when(F.col("GrowthRate") < float("inf"), F.round("GrowthRate", 9)).alias("GrowthRate")
    return full.select("rule_id", "cls", *_r9(*plain), gr, (F.col("GrowthRate") == float("inf")).alias("pure"))


def measure_violations_lines(spark, sf):
    """Counts damaged on purpose must be reported, whole ones must not."""
    c = Case(spark, sf, LINES)
    rules, n = c.rules(c.pairs())
    counts = contingency(c.compact(), rules, c.model, n)
    damaged = counts.withColumn("tp", F.when(F.col("rule_id") < 20, F.col("tp") - 2 * F.col("tp") - 1).otherwise(F.col("tp")))
    checked = with_measures(damaged.select("rule_id", *COUNTS), ["TPR", "Confidence", "Support"])
    return measure_violations(checked).select("rule_id", "measure", F.round("value", 9).alias("value"))


def mean_diversity_lines(spark, sf):
    c = Case(spark, sf, LINES)
    scored, _ = c.scored(c.pairs())
    return mean_diversity(scored).select("cls", *_r9("mean_diversity"), "n_rules")


# -- reports ------------------------------------------------------------------------


def rules_text(spark, sf):
    c = Case(spark, sf, ORDERS)
    rules, _ = c.rules(_edge_rules(c.model) + c.pairs())
    return render_rules(rules, c.model)


def training_report(spark, sf):
    c = Case(spark, sf, ORDERS)
    scored, _ = c.scored(c.pairs(), ("Confidence", "Support"))
    return training_measures(scored, c.model, ("Confidence", "Support"))


def test_report(spark, sf):
    c = Case(spark, sf, DOCUMENTS)
    rules, n = c.rules(c.singles())
    return test_measures(contingency(c.compact(), rules, c.model, n), c.model)


def _folder(spark, name):
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written_rules(spark, sf):
    """The file of rules, written and read back rule by rule."""
    c, path = Case(spark, sf, ORDERS), _folder(spark, "rules")
    rules, _ = c.rules(_edge_rules(c.model) + c.pairs())
    write_rules(rules, c.model, path)
    parts = F.regexp_extract("value", r"(?s)^Rule (\d+)\n(.*)$", 1).cast("int"), F.regexp_extract("value", r"(?s)^Rule (\d+)\n(.*)$", 2)
    return spark.read.text(path, lineSep="\n\n\n").select(parts[0].alias("rule"), parts[1].alias("rule_text"))


def written_training(spark, sf):
    c, path = Case(spark, sf, ORDERS), _folder(spark, "training")
    scored, _ = c.scored(c.pairs(), ("Confidence", "Support"))
    write_training_measures(scored, c.model, ("Confidence", "Support"), path)
    return spark.read.csv(path, sep="\t", header=True).withColumn("Rule", F.col("Rule").cast("int"))


def written_test(spark, sf):
    c, path = Case(spark, sf, DOCUMENTS), _folder(spark, "test")
    rules, n = c.rules(c.singles())
    write_test_measures(contingency(c.compact(), rules, c.model, n), c.model, path)
    return spark.read.csv(path, sep="\t", header=True)


# -- ranking ------------------------------------------------------------------------


def pareto_front(spark, sf):
    scored, _ = Case(spark, sf, LINES).scored(Case(spark, sf, LINES).pairs())
    return ranking.pareto_front(scored, TRADE_OFF).select("rule_id", "cls", *_r9(*TRADE_OFF))


def pareto_front_three(spark, sf):
    c = Case(spark, sf, LINES)
    scored, _ = c.scored(c.pairs(), THREE_WAY)
    return ranking.pareto_front(scored, THREE_WAY).select("rule_id", "cls", *_r9(*THREE_WAY))


def pareto_front_minimise(spark, sf):
    c = Case(spark, sf, LINES)
    scored, _ = c.scored(c.pairs(), ("TPR", "FPR"))
    return ranking.pareto_front(scored, ("TPR", "FPR"), minimise=("FPR",)).select("rule_id", "cls", *_r9("TPR", "FPR"))


def _ranked(c):
    scored, n = c.scored(c.pairs())
    return ranking.nondominated_rank(scored, TRADE_OFF, group_bound=n), n


def nondominated_rank(spark, sf):
    ranked, _ = _ranked(Case(spark, sf, LINES))
    return ranked.select("rule_id", "cls", "rank")


def _crowded(c):
    ranked, n = _ranked(c)
    return ranking.crowding_distance(ranked, TRADE_OFF), n


def crowding(spark, sf):
    crowded, _ = _crowded(Case(spark, sf, LINES))
    inner = F.when(F.col("crowding") < float("inf"), F.round("crowding", 9)).alias("crowding")
    return crowded.select("rule_id", "cls", "rank", inner)


def select_top(spark, sf):
    crowded, _ = _crowded(Case(spark, sf, LINES))
    exact = crowded.withColumn("crowding", F.round("crowding", 9))
    return ranking.select_top(exact, 30).select("rule_id", "cls", "rank", "slot")


def _population(c, k=30):
    crowded, n = _crowded(c)
    return ranking.select_top(crowded.withColumn("crowding", F.round("crowding", 9)), k)


def tournament(spark, sf):
    pop = _population(Case(spark, sf, LINES))
    draws = pop.select("cls", (F.col("slot") - 1).alias("draw"), F.lit(30).cast("bigint").alias("size"))
    won = selection.tournament_select(pop, draws, SEED, 1, 0, 90)
    return won.select("cls", "draw", F.col("p0_rule_id").alias("rule_id"))


def token_competition(spark, sf):
    c = Case(spark, sf, LINES)
    scored, n = c.scored(c.pairs())
    return selection.token_competition(c.compact(), scored, c.model, n).select("rule_id", "cls", *COUNTS)


def token_competition_bitmaps(spark, sf):
    c = Case(spark, sf, ORDERS)
    scored, n = c.scored(c.pairs())
    keyed = c.df.withColumn("row_no", F.col("o_orderkey") + 1)
    lut = wide_lut(keyed, c.model, "row_no")
    return token_competition_bitmap(lut, scored, c.model, n).select("rule_id", "cls", *COUNTS)


def measure_filter(spark, sf):
    c = Case(spark, sf, LINES)
    scored, _ = c.scored(c.pairs())
    kept = selection.measure_filter(scored, c.model, (("Confidence", 0.336), ("Support", 0.02)))
    return kept.select("rule_id", "cls", *COUNTS)


def measure_filter_fallback(spark, sf):
    c = Case(spark, sf, LINES)
    scored, _ = c.scored(c.pairs())
    return selection.measure_filter(scored, c.model, (("Confidence", 0.99),)).select("rule_id", "cls", *COUNTS)


def better_set(spark, sf):
    c = Case(spark, sf, LINES)
    singles, _ = c.scored(c.singles())
    pairs, _ = c.scored(c.pairs())
    return selection.better_set(singles, pairs).select("rule_id", "cls", *COUNTS)


# -- candidates -----------------------------------------------------------------------


def _counted(c, rules, n):
    return contingency(c.compact(), rules, c.model, n, c.totals).select("rule_id", "cls", _masks(), *COUNTS)


def init_random(spark, sf):
    c = Case(spark, sf, LINES)
    return _counted(c, gen.init_random(spark, c.model, 300, SEED), 300)


def init_oriented(spark, sf):
    c = Case(spark, sf, LINES)
    return _counted(c, gen.init_oriented(spark, c.model, 300, SEED, pct=0.5), 300)


def init_covering(spark, sf):
    """For every class, rules from the features of the first line that none of its narrow rules covers."""
    c = Case(spark, sf, LINES)
    rules, n = c.rules([(k, {0: [0]}) for k in c.model.classes])
    pairs = RowLayout(c.compact(), c.model, {}, merged=True).uncovered_pairs(rules, c.model.classes, n)
    return _counted(c, gen.init_covering(spark, pairs, c.model, 120, SEED), 120 * len(c.model.classes))


def _couples(c):
    """Neighbouring rules of every class as parents, from the scored pairs."""
    rules, n = c.rules(c.pairs())
    k = len(c.model.classes)
    a = rules.select((F.col("rule_id")).alias("pair_id"), "cls", F.col("masks").alias("a_masks"))
    b = rules.select((F.col("rule_id") - 5 * k).alias("pair_id"), F.col("masks").alias("b_masks"))
    return a.join(b, "pair_id"), n


def _children(c, kids, n):
    kids = kids.select((F.col("pair_id") * 2 + F.col("child")).alias("rule_id"), "cls", "masks")
    return _counted(c, kids, 2 * n)


def crossover_npoint(spark, sf):
    c = Case(spark, sf, LINES)
    couples, n = _couples(c)
    return _children(c, gen.crossover_npoint(couples, c.model, SEED, 1), n)


def crossover_hux(spark, sf):
    c = Case(spark, sf, LINES)
    couples, n = _couples(c)
    return _children(c, gen.crossover_hux(couples, c.model, SEED, 1), n)


def mutate(spark, sf):
    c = Case(spark, sf, LINES)
    rules, n = c.rules(c.pairs())
    return _counted(c, gen.mutate_dnf(rules, c.model, SEED, 1, 0.9), n)


SHARES = {"hux": 0.3, "mutation": 0.3, "npoint": 0.4}


def reproduce(spark, sf):
    c = Case(spark, sf, LINES)
    kids = gen.reproduce(_population(c), c.model, SHARES, SEED, 1, 90)
    return kids.where("not surplus").select("rule_id", "cls", "op", _masks())


def nondominated_rank_rows(spark, sf):
    """Orders ranked by price within their status: a group of any size, sorted by ranges."""
    df = ORDERS.load(spark, sf).select("o_orderkey", F.col("o_orderstatus").alias("cls"), F.col("o_totalprice").cast("double").alias("price"))
    return ranking.nondominated_rank(df, ("price",)).select("o_orderkey", "cls", "rank")


def own_labels(spark, sf):
    """Counts of rules over thirty labels of the caller, of which a price may hold two or all."""
    c = Case(spark, sf, ORDERS)
    labels = [(0, j, "Triangular", *(15_000.0 * (j // 2) + d for d in (-30_000.0, 0.0, 30_000.0))) for j in range(30)]
    model = c.model.with_labels(spark.createDataFrame(labels, "var int, label int, shape string, x0 double, x1 double, x2 double"))
    rules = rules_table(spark, model, [(k, {0: [j, 29 - j]}) for j in range(15) for k in model.classes])
    return contingency(compact(c.df, model), rules, model).select("rule_id", "cls", *COUNTS)


def generation(spark, sf):
    """One whole generation of the search: children of the population, their scores, and who survives."""
    c = Case(spark, sf, LINES)
    layout = prepare(c.df, c.model)
    miner = _miner(LINES, individuals=30, seed=SEED)
    scorer = Scorer(layout, TRADE_OFF, (), miner._columns())
    pop = {k: [] for k in c.model.classes}
    parents = _population(c).orderBy("cls", "slot").select("rule_id", "cls", "masks", "rank", "crowding").collect()
    for x, r in zip(scorer((r["rule_id"], r["cls"], tuple(r["masks"])) for r in parents), parents):
        x.rank, x.crowding = r["rank"], r["crowding"]
        pop[x.cls].append(x)
    kept, _ = miner.generation(scorer, pop, c.model, SHARES, 1)
    layout.release()
    columns = ["rule_id", "cls", "rank", "slot", F.array_join(normalise("masks", c.model).cast("array<string>"), ",").alias("masks"), *COUNTS]
    return population_frame(kept, spark, miner._schema()).select(*columns)


def _credits(spark, sf):
    """How many children each operator made in one generation over lines."""
    c = Case(spark, sf, LINES)
    kids = gen.reproduce(_population(c), c.model, SHARES, SEED, 1, 90)
    return kids.groupBy("op").agg(F.count(F.lit(1)).alias("credit"))


def operator_probs(spark, sf):
    return gen.operator_probs(_credits(spark, sf)).select("op", "credit", F.round("prob", 12).alias("prob"))


def choose_operator(spark, sf):
    """The operator of each order's draw under the shares of that generation."""
    probs = cut_lineage(gen.operator_probs(_credits(spark, sf)))
    draws = ORDERS.load(spark, sf).select("o_orderkey", F.expr(uniform(SEED, 1, "'operator'", "o_orderkey")).alias("u"))
    return gen.choose_operator(draws, probs).select("o_orderkey", "op")


def replace(spark, sf):
    c = Case(spark, sf, LINES)
    kids = gen.init_oriented(spark, c.model, 90, SEED)
    kids = kids.withColumn("rule_id", F.col("rule_id") + 100_000)
    cols = ["rule_id", "cls", "masks", *TRADE_OFF]
    scored = score(c.compact(), kids, c.model, TRADE_OFF, 90, c.totals).select(*cols)
    parents = _population(c).select(*cols)
    joint = replace_population(
        parents.withColumns({m: F.round(m, 9) for m in TRADE_OFF}),
        scored.withColumns({m: F.round(m, 9) for m in TRADE_OFF}),
        TRADE_OFF,
        30,
    )
    return joint.select("cls", "rank", "slot", *TRADE_OFF)


def stagnation_rows(spark, sf):
    c = Case(spark, sf, LINES)
    before, _ = c.rules(c.pairs())
    now, n = c.rules(c.singles())
    old = before.where(F.col("rule_id") < 20)
    return RowLayout(c.compact(), c.model, c.totals).newly_covered(old, now.where(F.col("rule_id") >= 20), 2 * n + 200)


def stagnation_bitmaps(spark, sf):
    c = Case(spark, sf, ORDERS)
    keyed = c.df.withColumn("row_no", F.col("o_orderkey") + 1)
    lut = wide_lut(keyed, c.model, "row_no")
    before, n = c.rules(c.pairs())
    now, m = c.rules(c.singles())
    return newly_covered_bitmap(lut, before.where(F.col("rule_id") < 20), now, c.model, n + m)


# -- whole jobs -------------------------------------------------------------------------


def _mined(binding, spark, sf):
    """All mined rules of a search with the default budget and objectives, written canonically."""
    df = binding.load(spark, sf)
    mined = PatternMiner(binding.cls, list(binding.numeric), list(binding.nominal)).fit(df)
    return mined.rules.select("cls", F.array_join(normalise("masks", mined.model).cast("array<string>"), ",").alias("masks"), *COUNTS)


def fit_orders(spark, sf):
    """The search over orders, whose best rules are a close race: it may end beside the best of all (a test says how near)."""
    return _mined(ORDERS, spark, sf)


def fit_planted(spark, sf):
    """The search for the plant, and for what best describes the rest; SQL tries all rules there are."""
    return _mined(PLANTED, spark, sf)


def match_bitmap(spark, sf):
    """Vectors with the rules that cover them, from bitmaps as for tables of any width."""
    df = VECTORS.load(spark, sf)
    model = VECTORS.model(df)
    rules = rules_table(spark, model, [(k, {0: [2], 40: [0, 1]}) for k in model.classes] + [(model.classes[0], {63: [2]})])
    rows = with_row_index(df, 1, "row_no")
    cover = cov.coverage_bitmaps(wide_lut(rows, model, "row_no"), rules, model, None, ("cls",))
    hits = covered_rows_bitmap(cover).withColumnRenamed("row", "row_no")
    return rows.select("row_no", "vec_id").join(hits, "row_no").select("vec_id", "rule_id", F.col("cls").alias("rule_cls"))


def _halves(df):
    """Train on the orders up to 1998, test on the later ones, of which low ones have a priority unseen in training."""
    early = F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp")
    unseen = F.when(F.col("o_orderpriority") == "5-LOW", "6-NEW").otherwise(F.col("o_orderpriority"))
    return df.where(early), df.where(~early).withColumn("o_orderpriority", unseen)


def _miner(binding, **kw):
    return PatternMiner(binding.cls, list(binding.numeric), list(binding.nominal), objectives=TRADE_OFF, **kw)


def _elite(c):
    """The one-feature rules as an elite, numbered apart from the pairs."""
    scored, n = c.scored(c.singles())
    return cut_lineage(scored.withColumn("rule_id", F.col("rule_id") + 100_000)), n


def update_elite(spark, sf):
    c = Case(spark, sf, LINES)
    pairs, _ = c.scored(c.pairs())
    kept = _miner(LINES).update_elite(_elite(c)[0], pairs.where(F.col("cls").isin("A", "N")), ["A", "N"])
    return kept.select("rule_id", "cls", *COUNTS)


def finalise(spark, sf):
    c = Case(spark, sf, LINES)
    layout = prepare(c.df, c.model)
    miner = _miner(LINES, individuals=30, filters=(("Confidence", 0.334),))
    out = cut_lineage(miner.finalise(layout, cut_lineage(_population(c)), _elite(c)[0]).select("rule_id", "cls", *COUNTS))
    layout.release()
    return out


def reinitialise(spark, sf):
    """Two of the three classes restart from their first uncovered order; the third keeps its rules."""
    c = Case(spark, sf, ORDERS)
    layout = prepare(c.df, c.model, "rows", "o_orderkey")
    scored, _ = c.scored(c.pairs())
    pop, _ = _miner(ORDERS, individuals=10, seed=SEED).reinitialise(
        layout, cut_lineage(_population(c, 10)), cut_lineage(scored.where(F.col("rule_id") < 30)), ["F", "P"], 1
    )
    layout.release()
    return pop.select("rule_id", "cls", _masks(), *COUNTS)


def evaluate_holdout(spark, sf):
    train, test = _halves(ORDERS.load(spark, sf))
    model = ORDERS.model(train)
    listed = pair_rules(model)
    mined = MinedPatterns(model, rules_table(spark, model, listed), TRADE_OFF)
    out = mined.evaluate(test)
    return out.select("rule_id", "cls", *COUNTS, *_r9("AUC", "Confidence", "WRAccNorm"))


def match_rows(spark, sf):
    train, test = _halves(ORDERS.load(spark, sf))
    model = ORDERS.model(train)
    mined = MinedPatterns(model, rules_table(spark, model, pair_rules(model)), TRADE_OFF)
    return mined.match(test, keep=["o_orderkey"])


def single_patterns(spark, sf):
    """Every one-feature pattern of the orders with counts, confidence and growth rate."""
    c = Case(spark, sf, ORDERS)
    rules, n = c.rules(c.singles())
    scored = with_measures(contingency(c.compact(), rules, c.model, n), ["Confidence", "GrowthRate", "WRAccNorm"])
    return scored.select("rule_id", "cls", *COUNTS, *_r9("Confidence", "GrowthRate", "WRAccNorm"))


QUERIES = {
    "single_patterns": single_patterns,
    "arff_roundtrip": arff_roundtrip,
    "row_index": row_index,
    "profile_numeric": profile_numeric,
    "profile_nominal": profile_nominal,
    "feature_count": feature_count,
    "row_count": row_count,
    "class_counts": class_counts,
    "fuzzy_labels": fuzzy_labels_lines,
    "membership": membership,
    "assign_labels": assign_labels,
    "encode_rows": encode_rows,
    "encode_long_domain": encode_long_domain,
    "null_wildcard": null_wildcard,
    "degenerate_columns": degenerate_columns,
    "signatures": signatures,
    "items_long": items,
    "feature_support": feature_support_lines,
    "feature_bitmaps": feature_bitmaps,
    "rule_shape": rule_shape_edges,
    "rule_items": rule_conditions,
    "rule_filter": rule_filter,
    "rule_coverage": rule_coverage,
    "rule_dedupe": rule_dedupe,
    "cover_union": cover_union,
    "cover_intersect": cover_intersect,
    "cover_difference": cover_difference,
    "cover_symdiff": cover_symdiff,
    "cover_complement": cover_complement,
    "cover_count": cover_count,
    "covered_rows": covered_rows,
    "first_uncovered": first_uncovered,
    "covering_pairs": covering_pairs,
    "cover_flags": cover_flags,
    "contingency": contingency_lines,
    "contingency_joined": contingency_customers,
    "contingency_nulls": contingency_gaps,
    "contingency_degenerate": contingency_degenerate,
    "contingency_bitmap": contingency_bitmaps,
    "objectives_penalised": objectives_penalised,
    "measures_all": measures_all,
    "measures_edges": measures_edges,
    "measure_violations": measure_violations_lines,
    "mean_diversity": mean_diversity_lines,
    "rules_text": rules_text,
    "training_report": training_report,
    "test_report": test_report,
    "written_rules": written_rules,
    "written_training": written_training,
    "written_test": written_test,
    "pareto_front": pareto_front,
    "pareto_front_three": pareto_front_three,
    "pareto_front_minimise": pareto_front_minimise,
    "nondominated_rank": nondominated_rank,
    "crowding": crowding,
    "select_top": select_top,
    "tournament": tournament,
    "token_competition": token_competition,
    "token_competition_bitmap": token_competition_bitmaps,
    "measure_filter": measure_filter,
    "measure_filter_fallback": measure_filter_fallback,
    "better_set": better_set,
    "init_random": init_random,
    "init_oriented": init_oriented,
    "init_covering": init_covering,
    "crossover_npoint": crossover_npoint,
    "crossover_hux": crossover_hux,
    "mutate": mutate,
    "generation": generation,
    "own_labels": own_labels,
    "nondominated_rank_rows": nondominated_rank_rows,
    "match_bitmap": match_bitmap,
    "operator_probs": operator_probs,
    "choose_operator": choose_operator,
    "reproduce": reproduce,
    "replace": replace,
    "stagnation": stagnation_rows,
    "stagnation_bitmap": stagnation_bitmaps,
    "fit_orders": fit_orders,
    "fit_planted": fit_planted,
    "reinitialise": reinitialise,
    "update_elite": update_elite,
    "finalise": finalise,
    "evaluate_holdout": evaluate_holdout,
    "match_rows": match_rows,
}
