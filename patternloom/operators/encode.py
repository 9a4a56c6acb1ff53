"""Rows to bit masks: one projection per row, then optional compaction.

An encoded table has ``cls``, the mask words ``m0, m1, ...`` and the weight
``n``; rows with equal masks are indistinguishable to every rule, so they may be
merged into weighted signatures.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patternloom.functions.fuzzy import assign_labels, belonging_degree
from patternloom.model import Attribute, TableModel
from patternloom.operators.profile import numeric_value, quoted

SMALL_DOMAIN = 60
LUT_CHUNK = 240


def text(value: str) -> str:
    """String literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def encode_numeric(df: DataFrame, attribute: Attribute) -> tuple[dict[str, str], str]:
    """Helper columns of one attribute, its value and degrees, and the mask over them."""
    a = attribute
    if not a.labels:
        return {}, "0L"
    x = numeric_value(df, a.name)
    degrees = {f"_d{a.pos}_{lab.label}": belonging_degree(f"({x})", lab) for lab in a.labels}
    full = (1 << a.n_values) - 1
    return {f"_x{a.pos}": x, **degrees}, f"if(_x{a.pos} is null, {full}L, {assign_labels(list(degrees))})"


def encode_nominal(value: str, domain) -> str:
    """Mask bit of a value of a domain of at most 60 values; unseen values give 0."""
    if not domain:
        return "0L"
    arms = " ".join(f"when {text(item)} then {1 << j}L" for j, item in enumerate(domain))
    return f"case when {value} is null then {(1 << len(domain)) - 1}L else case cast({value} as string) {arms} else 0L end end"


def _join_long_domains(df: DataFrame, model: TableModel) -> tuple[DataFrame, dict[int, str]]:
    """Look up values of domains over 60 values in a broadcast table.

    Its size is proven: ``max_domain`` was checked when the model was built.
    """
    words: dict[int, str] = {}
    for a in model.attributes:
        if a.numeric or a.n_values <= SMALL_DOMAIN:
            continue
        table = df.sparkSession.createDataFrame(list(enumerate(a.domain)), f"_p{a.pos} int, _v{a.pos} string")
        name = quoted(a.name)
        df = df.join(F.broadcast(table), F.expr(f"cast({name} as string) = _v{a.pos}"), "left")
        for i in model.var_words[a.pos]:
            w = model.words[i]
            at = f"_p{a.pos} - {w.first}"
            inside = f"_p{a.pos} between {w.first} and {w.first + w.bits - 1}"
            words[i] = f"case when {name} is null then {w.full}L when {inside} then shiftleft(1L, {at}) else 0L end"
    return df, words


def encode_items(df: DataFrame, model: TableModel, keep=()) -> DataFrame:
    """``keep`` columns, ``cls``, mask words and ``n = 1``: one select, no shuffle."""
    df, looked_up = _join_long_domains(df, model)
    stage: dict[str, str] = {}
    masks: list[str] = []
    for a in model.attributes:
        words = model.var_words[a.pos]
        if a.numeric:
            columns, mask = encode_numeric(df, a)
            stage.update(columns)
            masks.append(f"{mask} as m{words[0]}")
        elif a.n_values <= SMALL_DOMAIN:
            masks.append(f"{encode_nominal(quoted(a.name), a.domain)} as m{words[0]}")
        else:
            masks += [f"{looked_up[i]} as m{i}" for i in words]
    kept = [quoted(k) for k in keep]
    nominal = [quoted(a.name) for a in model.attributes if not a.numeric and a.name not in keep]
    helpers = [f"_p{a.pos}" for a in model.attributes if not a.numeric and a.n_values > SMALL_DOMAIN]
    # Degrees get their own projection so that each is computed once.
    first = df.selectExpr(
        *kept,
        *nominal,
        *helpers,
        f"cast({quoted(model.class_col)} as string) as cls",
        *[f"{v} as {k}" for k, v in stage.items()],
    )
    return first.selectExpr(*kept, "cls", *masks, "1L as n")


def signatures(encoded: DataFrame, model: TableModel, rid: str | None = None) -> DataFrame:
    """Merge equal encoded rows into weighted ones; keeps the smallest ``rid`` if asked."""
    aggs = [F.sum("n").alias("n")]
    if rid:
        aggs.append(F.min(rid).alias("first_rid"))
    return encoded.groupBy("cls", *model.mask_columns).agg(*aggs)


def compact(df: DataFrame, model: TableModel, rid: str | None = None) -> DataFrame:
    """Encode, and merge equal rows; partial sums are made before the shuffle."""
    return signatures(encode_items(df, model, keep=[rid] if rid else []), model, rid)


def items_long(encoded: DataFrame, model: TableModel, keep=("cls", "n")) -> DataFrame:
    """``keep..., var, val``: one row per feature a row has."""
    words = ", ".join(
        f"struct({w.var} as var, {w.first} as first, {w.bits} as bits, m{i} as mask)" for i, w in enumerate(model.words)
    )
    long = encoded.selectExpr(*keep, f"explode(array({words})) as w").select(*keep, "w.*").where("mask <> 0")
    bits = F.explode(F.expr("sequence(0, bits - 1)")).alias("bit")
    return (
        long.select(*keep, "var", "first", "mask", bits)
        .where("(shiftright(mask, bit) & 1) = 1")
        .select(*keep, "var", (F.col("first") + F.col("bit")).alias("val"))
    )


def feature_support(encoded: DataFrame, model: TableModel) -> DataFrame:
    """Rows per (variable, value, class); small partial aggregates only are shuffled."""
    return items_long(encoded, model).groupBy("var", "val", "cls").agg(F.sum("n").alias("n"))


def feature_lut(encoded: DataFrame, model: TableModel, rid: str) -> DataFrame:
    """Row bitmaps per feature and bucket of 32768 row numbers.

    ``rid`` counts from 1. The class appears as variable -1, its values numbered as in
    ``model.classes``. Output is hash partitioned by ``bucket`` so that later steps
    grouped by bucket need no further exchange.
    """
    feats = []
    for i, w in enumerate(model.words):
        feats += [(w.var, w.first + b, f"(shiftright(m{i}, {b}) & 1) = 1") for b in range(w.bits)]
    for j, c in enumerate(model.classes):
        feats.append((-1, j, f"cls = {text(c)}"))
    base = encoded.selectExpr("*", f"bitmap_bucket_number({rid}) as bucket", f"bitmap_bit_position({rid}) as _at")
    out = None
    for start in range(0, len(feats), LUT_CHUNK):
        part = feats[start : start + LUT_CHUNK]
        # A null position is ignored by the aggregate, which leaves that bit unset.
        aggs = [F.expr(f"bitmap_construct_agg(if({c}, _at, null)) as f{k}") for k, (_, _, c) in enumerate(part)]
        rows = ", ".join(f"struct({v} as var, {j} as val, f{k} as bits)" for k, (v, j, _) in enumerate(part))
        wide = base.groupBy("bucket").agg(*aggs)
        long = wide.selectExpr("bucket", f"explode(array({rows})) as f").select("bucket", "f.*")
        out = long if out is None else out.unionByName(long)
    return out.where(F.bitmap_count("bits") > 0)
