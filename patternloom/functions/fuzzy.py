"""Fuzzy labels: cut points, membership degrees and hard assignment.

A label is a dict or Row with ``shape`` and the points ``x0, x1, x2``; shoulder
shapes use only ``x0`` and ``x1``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# They decide which cut points are snapped and which labels tie.
SNAP_TOLERANCE = 1e-4
TIE_TOLERANCE = 1e-11

DECREASING = "DecreasingLine"
TRIANGULAR = "Triangular"
INCREASING = "IncreasingLine"
ALWAYS = "Always"


def snap(v: Column, top: Column) -> Column:
    """Move a cut point lying next to zero or next to the maximum onto it."""
    eps = F.lit(SNAP_TOLERANCE)
    near_zero = (v > -eps) & (v < eps)
    near_top = (v > top - eps) & (v < top + eps)
    return F.when(near_zero, F.lit(0.0)).when(near_top, top).otherwise(v)


def fuzzy_labels(attributes: DataFrame, n_labels: int = 3) -> DataFrame:
    """Uniform fuzzy partition of every numeric attribute.

    ``attributes`` has ``pos, kind, min, max``; the result has
    ``var, label, shape, x0, x1, x2``. All-null attributes get no label.
    """
    if n_labels < 1:
        raise ValueError("n_labels must be at least 1")
    width = (F.col("max") - F.col("min")) / F.lit(float(max(n_labels - 1, 1)))

    def point(j):
        return snap(F.col("min") + width * j.cast("double"), F.col("max"))

    label, last = F.col("label"), n_labels - 1
    if n_labels == 1:
        shape, first = F.lit(ALWAYS), label
        inner = F.lit(False)
    else:
        shape = (
            F.when(label == 0, F.lit(DECREASING))
            .when(label == last, F.lit(INCREASING))
            .otherwise(F.lit(TRIANGULAR))
        )
        first = F.when(label == 0, F.lit(0)).otherwise(label - 1)
        inner = (label > 0) & (label < last)
    return (
        attributes.where((F.col("kind") == "numeric") & F.col("min").isNotNull())
        .select("pos", "min", "max", F.explode(F.sequence(F.lit(0), F.lit(last))).alias("label"))
        .select(
            F.col("pos").alias("var"),
            "label",
            shape.alias("shape"),
            point(first).alias("x0"),
            point(first + 1).alias("x1"),
            F.when(inner, point(label + 1)).alias("x2"),
        )
    )


def _sql(v) -> str:
    """Number as a double literal; text is taken as it is."""
    return v if isinstance(v, str) else f"{float(v)!r}D"


def _slope(hi, lo) -> str:
    if isinstance(hi, str) or isinstance(lo, str):
        return f"(1D / nullif({_sql(hi)} - {_sql(lo)}, 0D))"
    return _sql(1.0 / (hi - lo) if hi != lo else 0.0)


def membership_decreasing(x: str, x0, x1) -> str:
    """Left shoulder: 1 up to ``x0``, falling to 0 at ``x1``.

    Degrees are SQL text over column names and numbers: a wide table has many of them,
    and one parsed expression is far cheaper to build than a tree of Column calls.
    """
    a, b = _sql(x0), _sql(x1)
    return f"case when {x} <= {a} then 1D when {x} >= {b} then 0D else ({b} - {x}) * {_slope(x1, x0)} end"


def membership_triangular(x: str, x0, x1, x2) -> str:
    """Triangle over ``[x0, x2]`` with its peak at ``x1``."""
    a, b, c = _sql(x0), _sql(x1), _sql(x2)
    return (
        f"case when {x} <= {a} or {x} >= {c} then 0D when {x} < {b} then ({x} - {a}) * {_slope(x1, x0)} "
        f"when {x} > {b} then ({c} - {x}) * {_slope(x2, x1)} else 1D end"
    )


def membership_increasing(x: str, x0, x1) -> str:
    """Right shoulder: 0 up to ``x0``, rising to 1 at ``x1``."""
    a, b = _sql(x0), _sql(x1)
    return f"case when {x} <= {a} then 0D when {x} >= {b} then 1D else ({x} - {a}) * {_slope(x1, x0)} end"


def belonging_degree(x: str, label) -> str:
    """Degree of a non-null value for one label."""
    shape = label["shape"]
    if shape == DECREASING:
        return membership_decreasing(x, label["x0"], label["x1"])
    if shape == INCREASING:
        return membership_increasing(x, label["x0"], label["x1"])
    if shape == TRIANGULAR:
        return membership_triangular(x, label["x0"], label["x1"], label["x2"])
    return "1D"


def max_degree(degrees: list[str]) -> str:
    """Best degree, lowered by the tie tolerance."""
    best = f"greatest({', '.join(degrees)})" if len(degrees) > 1 else degrees[0]
    return f"({best} - {TIE_TOLERANCE!r}D)"


def assign_labels(degrees: list[str]) -> str:
    """Bit mask of the labels whose degree ties with the best one."""
    top = max_degree(degrees)
    return "(" + " | ".join(f"if({d} >= {top}, {1 << j}L, 0L)" for j, d in enumerate(degrees)) + ")"


def label_text(shape: Column, x0: Column, x1: Column, x2: Column) -> Column:
    """``Triangular(a, b, c)`` and the like, six decimals."""
    two = F.format_string("%s(%.6f, %.6f)", shape, x0, x1)
    three = F.format_string("%s(%.6f, %.6f, %.6f)", shape, x0, x1, x2)
    return F.when(x2.isNotNull(), three).otherwise(two)
