"""Where the encoded rows live during a search, behind one interface.

``rows``     encoded rows merged into weighted signatures;
``bitmaps``  one bitmap per feature and bucket of rows, for very many attributes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patternloom.model import TableModel
from patternloom.operators import bitmaps
from patternloom.operators.contingency import contingency, contingency_bitmap, covered_counts, covered_counts_bitmap
from patternloom.operators.coverage import match_rules, uncovered
from patternloom.operators.encode import compact, encode_items, items_long, signatures
from patternloom.operators.profile import quoted
from patternloom.operators.selection import token_competition
from patternloom.session import cut_lineage
from patternloom.sources.row_index import with_row_index

# Above this many mask words one projection per row gets too wide to compile.
WIDE_WORDS = 256
# Up to so many possible signatures rows are merged without an estimate.
FEW_SIGNATURES = 1 << 20
# Merging has to shrink the table at least this many times to be preferred to bitmaps.
MERGE_FACTOR = 16


@dataclass
class RowLayout:
    """``encoded`` may hold equal rows several times unless ``merged``.

    ``parts`` tells into how many files merged rows were written; covers of them are kept in as many for each class.
    """

    encoded: DataFrame
    model: TableModel
    class_totals: dict[str, int]
    merged: bool = False
    parts: int | None = None

    def counts(self, rules, max_rules=None):
        return contingency(self.encoded, rules, self.model, max_rules, self.class_totals, self.merged)

    def covered(self, rules, max_rules=None) -> DataFrame:
        """``rule_id, rule_cls, covered, tp`` of the rules that cover some row."""
        return covered_counts(self.encoded, rules, self.model, max_rules, self.merged)

    def token_competition(self, scored, max_rules=None):
        return token_competition(self.encoded, scored, self.model, max_rules)

    @property
    def spark(self):
        return self.encoded.sparkSession

    def cover(self, rules, max_rules=None) -> DataFrame:
        """The rows that some rule of a class covers: signatures with their weight, once per ``rule_cls``."""
        keys = ["cls", *self.model.mask_columns]
        rows = self.encoded if self.merged else signatures(self.encoded, self.model)
        # Signatures are unique by class and masks, so their weight is the same on every hit.
        cover = match_rules(rows, rules, self.model, ["n", *keys], (), max_rules).groupBy("rule_cls", *keys).agg(F.max("n").alias("n"))
        return cover.coalesce(self.parts * len(self.model.classes)) if self.parts else cover

    def added(self, before: DataFrame, now: DataFrame) -> DataFrame:
        """``rule_cls, n``: rows of one cover that another one lacks."""
        keys = ["rule_cls", "cls", *self.model.mask_columns]
        both = before.select(*keys, "n", F.lit(1).alias("_old")).unionByName(now.select(*keys, "n", F.lit(0).alias("_old")))
        first = both.groupBy(*keys).agg(F.max("_old").alias("_old"), F.max("n").alias("n"))
        return first.where("_old = 0").groupBy("rule_cls").agg(F.sum("n").alias("n"))

    def newly_covered(self, previous, now, max_rules=None) -> DataFrame:
        """``rule_cls, n``: rows a class's rules cover now and did not before."""
        return self.added(self.cover(previous, max_rules), self.cover(now, max_rules))

    def uncovered_pairs(self, rules, classes, max_rules=None) -> DataFrame:
        """``cls, var, val``: features of the first row of each class its rules leave uncovered.

        Without a row number the row with the smallest masks is the first.
        """
        left = uncovered(self.encoded, rules, self.model, classes, max_rules)
        masks = self.model.mask_columns
        order = F.col("first_rid") if "first_rid" in left.columns else F.struct(*masks)
        first = left.groupBy("cls").agg(F.min_by(F.struct(*masks), order).alias("_m")).select("cls", "_m.*")
        return items_long(first, self.model, ("cls",))

    def release(self):
        self.encoded.unpersist()


@dataclass
class BitmapLayout:
    lut: DataFrame
    model: TableModel
    class_totals: dict[str, int]

    def counts(self, rules, max_rules=None):
        return contingency_bitmap(self.lut, rules, self.model, max_rules, class_totals=self.class_totals)

    def covered(self, rules, max_rules=None):
        return covered_counts_bitmap(self.lut, rules, self.model, max_rules)

    def token_competition(self, scored, max_rules=None):
        return bitmaps.token_competition_bitmap(self.lut, scored, self.model, max_rules)

    @property
    def spark(self):
        return self.lut.sparkSession

    def cover(self, rules, max_rules=None):
        """One bitmap per class and bucket."""
        return bitmaps.cover_bitmap(self.lut, rules, self.model, max_rules)

    def added(self, before, now):
        return bitmaps.added_bitmap(before, now)

    def newly_covered(self, previous, now, max_rules=None):
        return self.added(self.cover(previous, max_rules), self.cover(now, max_rules))

    def uncovered_pairs(self, rules, classes, max_rules=None):
        return bitmaps.uncovered_pairs_bitmap(self.lut, rules, self.model, classes, max_rules)

    def release(self):
        self.lut.unpersist()


def content_order(model: TableModel, name: str = "_order"):
    """A hash of what a row holds: an order of the rows that no layout or partitioning changes."""
    return F.xxhash64(*[F.col(quoted(a.name)) for a in model.attributes], F.col(quoted(model.class_col))).alias(name)


def prepare(df: DataFrame, model: TableModel, layout: str = "auto", rid: str | None = None):
    """Encode the table once and persist it in the layout that suits it.

    ``auto`` merges rows if few signatures are possible or an approximate distinct count
    shows that merging pays; otherwise bitmaps serve, as they test 64 rows at a time. Both give the
    same results: rows are ordered by ``rid`` or else by a hash of their content. Bitmaps need
    numbers without gaps; rows are numbered in that order, once, and written before they are sliced.
    Merged rows are written too: a persisted shuffle has as many partitions as the session gives to one, however few its rows,
    and every job of a search would start a task for each; the files follow the size of what was merged.
    """
    totals = dict(zip(model.classes, model.class_counts))
    level = StorageLevel.MEMORY_AND_DISK
    order = rid or "_order"
    if rid is None:
        df = df.select("*", content_order(model))
    if layout == "auto" and model.n_words <= WIDE_WORDS:
        few = model.signature_bound <= FEW_SIGNATURES
        if not few:
            seen = encode_items(df, model).agg(F.approx_count_distinct(F.xxhash64("cls", *model.mask_columns))).head()[0]
            few = seen * MERGE_FACTOR <= model.n_rows
        layout = "rows" if few else "bitmaps"
    if layout == "rows":
        merged = cut_lineage(signatures(encode_items(df, model, keep=[order]), model, order))
        return RowLayout(merged.persist(level), model, totals, merged=True, parts=max(1, len(merged.inputFiles())))
    return BitmapLayout(bitmaps.wide_lut(numbered_rows(df, model, order), model, "_row").persist(level), model, totals)


def numbered_rows(df: DataFrame, model: TableModel, order: str) -> DataFrame:
    """The columns of the model with ``_row`` from 1 in the order of a column, written once."""
    names = dict.fromkeys([*[a.name for a in model.attributes], model.class_col])
    wanted = df.select(*[F.col(quoted(n)) for n in names], F.col(quoted(order)).alias("_at"))
    return cut_lineage(with_row_index(wanted.repartitionByRange("_at").sortWithinPartitions("_at"), 1, "_row").drop("_at"))


def evaluate_rules(df: DataFrame, rules: DataFrame, model: TableModel) -> DataFrame:
    """Confusion counts of rules on another table of the same structure, which is read once.

    Up to ``WIDE_WORDS`` mask words equal rows are merged and written; wider tables are counted by bitmaps.
    """
    if model.n_words <= WIDE_WORDS:
        return contingency(cut_lineage(compact(df, model)), rules, model, merged=True)
    rows = numbered_rows(df.select("*", content_order(model)), model, "_order")
    # Rows without class count as rows, under a name that no class has.
    cls = F.coalesce(F.col(quoted(model.class_col)).cast("string"), F.lit("\0"))
    totals = {r["cls"]: r["count"] for r in rows.groupBy(cls.alias("cls")).count().collect()}
    return contingency_bitmap(cut_lineage(bitmaps.wide_lut(rows, model, "_row")), rules, model, class_totals=totals)


def matched_rows(df: DataFrame, rules: DataFrame, model: TableModel, keep) -> DataFrame:
    """``keep..., rule_id, rule_cls`` for every row of a table and rule that covers it.

    Up to ``WIDE_WORDS`` mask words a row looks its rules up. The rows of a wider table are numbered and written;
    rules become bitmaps bucket by bucket, and their bits the numbers by which the rows are joined, so
    no projection is as wide as the table.
    """
    if model.n_words <= WIDE_WORDS:
        return match_rules(encode_items(df, model, list(keep)), rules, model, keep=[quoted(k) for k in keep])
    names = dict.fromkeys([*keep, *[a.name for a in model.attributes], model.class_col])
    rows = cut_lineage(with_row_index(df.select(*[F.col(quoted(n)) for n in names]), 1, "_row"))
    lut = cut_lineage(bitmaps.wide_lut(rows, model, "_row"))
    cover = bitmaps.coverage_bitmaps(lut, rules.select("rule_id", "cls", "masks"), model, None, ("cls",))
    hits = bitmaps.covered_rows_bitmap(cover).select("rule_id", F.col("cls").alias("rule_cls"), F.col("row").alias("_row"))
    return rows.select("_row", *[F.col(quoted(k)) for k in keep]).join(hits, "_row").drop("_row").select(*[F.col(quoted(k)) for k in keep], "rule_id", "rule_cls")
