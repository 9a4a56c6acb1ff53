"""Expressions over the mask array of a rule.

A variable takes part in a rule iff some but not all of its values are selected;
all-zero and all-one masks both mean "any value". ``masks`` is the name of the array
column (or any SQL text for it). Each function is one SQL expression, so building a
plan stays cheap; constants per variable travel as one folded array literal.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from patternloom.model import TableModel


def ints(values, kind: str = "int") -> str:
    """SQL text of a constant integer array, folded to one literal however long it is."""
    return f"cast(split('{','.join(str(v) for v in values)}', ',') as array<{kind}>)"


def n_values(model: TableModel) -> str:
    return ints(a.n_values for a in model.attributes)


def word_owners(model: TableModel) -> str:
    """Variable of every word."""
    return ints(w.var for w in model.words)


def full_masks(model: TableModel) -> str:
    return ints((w.full for w in model.words), "bigint")


def popcounts_sql(masks: str, model: TableModel) -> str:
    per_word = f"transform({masks}, _m -> bit_count(_m))"
    if model.n_words == model.n_vars:
        return per_word
    starts = ints(model.var_words[a.pos][0] + 1 for a in model.attributes)
    sizes = ints(len(model.var_words[a.pos]) for a in model.attributes)
    return f"zip_with({starts}, {sizes}, (_s, _k) -> aggregate(slice({per_word}, _s, _k), 0, (_t, _c) -> _t + _c))"


def participation_sql(masks: str, model: TableModel) -> str:
    return f"zip_with({popcounts_sql(masks, model)}, {n_values(model)}, (_c, _n) -> _c > 0 and _c < _n)"


def normalise_sql(masks: str, model: TableModel) -> str:
    flags = participation_sql(masks, model)
    if model.n_words != model.n_vars:
        flags = f"transform({word_owners(model)}, _v -> element_at({flags}, _v + 1))"
    return f"zip_with({masks}, {flags}, (_w, _p) -> if(_p, _w, 0L))"


def popcounts(masks: str, model: TableModel) -> Column:
    """Selected values per variable."""
    return F.expr(popcounts_sql(masks, model))


def participation(masks: str, model: TableModel) -> Column:
    """Array of flags, one per variable."""
    return F.expr(participation_sql(masks, model))


def participates(masks: str, model: TableModel, var: int) -> Column:
    return F.expr(f"element_at({participation_sql(masks, model)}, {var + 1})")


def is_empty(masks: str, model: TableModel) -> Column:
    return F.expr(f"not exists({participation_sql(masks, model)}, _p -> _p)")


def num_vars(masks: str, model: TableModel) -> Column:
    return F.expr(f"size(filter({participation_sql(masks, model)}, _p -> _p))")


def num_active(masks: str, model: TableModel) -> Column:
    """Selected values over participating variables."""
    used = f"zip_with({popcounts_sql(masks, model)}, {n_values(model)}, (_c, _n) -> if(_c > 0 and _c < _n, _c, 0))"
    return F.expr(f"aggregate({used}, 0, (_t, _x) -> _t + _x)")


def normalise(masks: str, model: TableModel) -> Column:
    """Set the words of non-participating variables to zero."""
    return F.expr(normalise_sql(masks, model))
