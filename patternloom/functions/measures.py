"""Quality measures of a confusion table, as guarded Column expressions.

Each function takes the bigint columns tp, fp, tn, fn and never divides by zero,
so ANSI mode stays on.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTS = ("tp", "fp", "tn", "fn")
RANGE_TOLERANCE = 1e-13


def _ratio(num: Column, den: Column, zero: float = 0.0) -> Column:
    return F.when(den != 0, num.cast("double") / den.cast("double")).otherwise(F.lit(zero))


def tpr(tp, fp, tn, fn):
    return _ratio(tp, tp + fn)


def fpr(tp, fp, tn, fn):
    return _ratio(fp, fp + tn, zero=1.0)


def tnr(tp, fp, tn, fn):
    return _ratio(tn, fp + tn)


def inverse_fpr(tp, fp, tn, fn):
    return F.lit(1.0) - fpr(tp, fp, tn, fn)


def confidence(tp, fp, tn, fn):
    return _ratio(tp, tp + fp)


def coverage(tp, fp, tn, fn):
    return _ratio(tp + fp, tp + fp + tn + fn)


def support(tp, fp, tn, fn):
    return _ratio(tp, tp + fp + tn + fn)


def accuracy(tp, fp, tn, fn):
    return _ratio(tp + tn, tp + fp + tn + fn)


def auc(tp, fp, tn, fn):
    return (F.lit(1.0) + tpr(tp, fp, tn, fn) - fpr(tp, fp, tn, fn)) / F.lit(2.0)


def gmean(tp, fp, tn, fn):
    return F.sqrt(tpr(tp, fp, tn, fn) * tnr(tp, fp, tn, fn))


def jaccard(tp, fp, tn, fn):
    return _ratio(tp, tp + fn + fp)


def supp_diff(tp, fp, tn, fn):
    return tpr(tp, fp, tn, fn) - fpr(tp, fp, tn, fn)


def growth_rate(tp, fp, tn, fn):
    t, f = tpr(tp, fp, tn, fn), fpr(tp, fp, tn, fn)
    return F.when(f != 0, t / f).when(t == 0, F.lit(0.0)).otherwise(F.lit(float("inf")))


def is_growth_rate(tp, fp, tn, fn):
    return F.when(growth_rate(tp, fp, tn, fn) > 1.0, F.lit(1.0)).otherwise(F.lit(0.0))


def _class_share(tp, fp, tn, fn):
    return _ratio(tp + fn, tp + fp + tn + fn)


def wracc(tp, fp, tn, fn):
    return coverage(tp, fp, tn, fn) * (confidence(tp, fp, tn, fn) - _class_share(tp, fp, tn, fn))


def wracc_norm(tp, fp, tn, fn):
    share = _class_share(tp, fp, tn, fn)
    lo = (F.lit(1.0) - share) * (F.lit(0.0) - share)
    hi = share * (F.lit(1.0) - share)
    return F.when(hi - lo != 0, (wracc(tp, fp, tn, fn) - lo) / (hi - lo)).otherwise(F.lit(0.0))


Measure = Callable[[Column, Column, Column, Column], Column]

MEASURES: dict[str, Measure] = {
    "AUC": auc,
    "Accuracy": accuracy,
    "Confidence": confidence,
    "Coverage": coverage,
    "FPR": fpr,
    "GMean": gmean,
    "GrowthRate": growth_rate,
    "InverseFPR": inverse_fpr,
    "IsGrowthRate": is_growth_rate,
    "Jaccard": jaccard,
    "SuppDiff": supp_diff,
    "Support": support,
    "TNR": tnr,
    "TPR": tpr,
    "WRAcc": wracc,
    "WRAccNorm": wracc_norm,
}

# Headings used in the written reports.
SHORT_NAMES = {
    "AUC": "AUC",
    "Accuracy": "Acc",
    "Confidence": "CONF",
    "Coverage": "Cov",
    "FPR": "FPR",
    "GMean": "G-Mean",
    "GrowthRate": "GR",
    "InverseFPR": "Inv_FPR",
    "IsGrowthRate": "GR_Pct",
    "Jaccard": "Jacc",
    "SuppDiff": "SuppDiff",
    "Support": "Supp",
    "TNR": "TNR",
    "TPR": "TPR",
    "WRAcc": "WRAcc",
    "WRAccNorm": "WRAcc_Norm",
}

# Admissible range of each measure.
RANGES = {
    "GrowthRate": (0.0, float("inf")),
    "InverseFPR": (0.0, float("inf")),
    "SuppDiff": (-1.0, 1.0),
    "WRAcc": (float("-inf"), float("inf")),
}

LISTED_MEASURES = [m for m in MEASURES if m != "InverseFPR"]


def register_measure(name: str, fn: Measure, short_name: str | None = None, lo: float = 0.0, hi: float = 1.0) -> None:
    """Make a user-defined measure available by name everywhere."""
    MEASURES[name] = fn
    SHORT_NAMES[name] = short_name or name
    RANGES[name] = (lo, hi)


def measure(name: str) -> Column:
    """The named measure over the columns tp, fp, tn, fn."""
    if name not in MEASURES:
        raise KeyError(f"unknown measure {name!r}; known: {sorted(MEASURES)}")
    return MEASURES[name](*(F.col(c) for c in COUNTS))


def with_measures(counts: DataFrame, names) -> DataFrame:
    """Add one double column per named measure."""
    return counts.withColumns({n: measure(n) for n in names})


def objective_measures(counts: DataFrame, names=("WRAccNorm", "SuppDiff")) -> DataFrame:
    return with_measures(counts, names)


def all_measures(counts: DataFrame) -> DataFrame:
    return with_measures(counts, LISTED_MEASURES)


def measure_violations(measures: DataFrame, names=None) -> DataFrame:
    """Rows with a negative count, or one row per measure that is NaN or out of range."""
    names = [n for n in (names or MEASURES) if n in measures.columns]
    negative = reduce(lambda a, b: a | b, [F.col(c) < 0 for c in COUNTS])

    def bad(n):
        lo, hi = RANGES.get(n, (0.0, 1.0))
        v = F.col(n)
        return F.isnan(v) | v.isNull() | (v < lo - RANGE_TOLERANCE) | (v > hi)

    found = F.filter(
        F.array(
            F.when(negative, F.struct(F.lit("counts").alias("measure"), F.lit(None).cast("double").alias("value"))),
            *[
                F.when(bad(n), F.struct(F.lit(n).alias("measure"), F.col(n).cast("double").alias("value")))
                for n in names
            ],
        ),
        lambda v: v.isNotNull(),
    )
    keep = [c for c in measures.columns if c not in names]
    return measures.select(*keep, F.explode(found).alias("v")).select(*keep, "v.measure", "v.value")
