"""Profile of a labelled table: ranges, nominal domains, class counts, model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patternloom.functions.fuzzy import fuzzy_labels
from patternloom.model import WORD_BITS, Attribute, Label, TableModel

AGGREGATE_CHUNK = 200


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def numeric_value(df: DataFrame, name: str) -> str:
    """SQL text of a column as double with NaN turned into null."""
    col = quoted(name)
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return f"cast(if(isnan({col}), null, {col}) as double)"
    return f"cast({col} as double)"


def split_columns(df: DataFrame, class_col: str, exclude=()) -> tuple[list[str], list[str]]:
    """Numeric and nominal attribute columns by type."""
    numeric, nominal = [], []
    for f in df.schema.fields:
        if f.name == class_col or f.name in exclude:
            continue
        if isinstance(f.dataType, T.NumericType):
            numeric.append(f.name)
        elif isinstance(f.dataType, (T.StringType, T.BooleanType)):
            nominal.append(f.name)
    return numeric, nominal


def _long(df: DataFrame, cols: list[str], value) -> DataFrame:
    pairs = [F.struct(F.lit(c).alias("name"), value(c).alias("value")) for c in cols]
    return df.select(F.explode(F.array(*pairs)).alias("p")).select("p.name", "p.value")


def profile_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    """``name, min, max`` of every numeric column.

    Columns are taken in slices, each of which scans its own columns once, so neither a plan's expressions nor its rows
    grow with the width of the table.
    """
    if len(cols) > AGGREGATE_CHUNK:
        parts = [profile_numeric(df, cols[i : i + AGGREGATE_CHUNK]) for i in range(0, len(cols), AGGREGATE_CHUNK)]
        return reduce(lambda a, b: a.unionByName(b), parts)
    aggs = []
    for i, c in enumerate(cols):
        v = numeric_value(df, c)
        aggs += [F.expr(f"min({v}) as lo{i}"), F.expr(f"max({v}) as hi{i}")]
    rows = [
        F.struct(F.lit(c).alias("name"), F.col(f"lo{i}").alias("min"), F.col(f"hi{i}").alias("max"))
        for i, c in enumerate(cols)
    ]
    return df.agg(*aggs).select(F.explode(F.array(*rows)).alias("p")).select("p.*")


def nominal_values(df: DataFrame, cols: list[str]) -> DataFrame:
    """Distinct non-null values with their row counts, all columns in one job."""
    return _long(df, cols, lambda c: F.col(c).cast("string")).where("value is not null").groupBy("name", "value").agg(
        F.count(F.lit(1)).alias("n")
    )


def check_domain_size(df: DataFrame, cols: list[str], max_domain: int) -> None:
    """Refuse key-like nominal columns before their domain is gathered; the exact limit is tested afterwards."""
    if not cols:
        return
    sizes = df.agg(*[F.approx_count_distinct(F.col(c).cast("string")).alias(c) for c in cols]).head()
    wide = [c for c in cols if sizes[c] > 1.2 * max_domain]
    if wide:
        raise ValueError(f"nominal columns with more than {max_domain} values: {wide}")


def profile_nominal(df: DataFrame, cols: list[str], max_domain: int = 10_000) -> DataFrame:
    """``name, domain, n_values`` with the sorted domain of every nominal column."""
    check_domain_size(df, cols, max_domain)
    refused = F.raise_error(F.concat(F.lit(f"nominal column with more than {max_domain} values: "), F.col("name")))
    return (
        nominal_values(df, cols)
        .groupBy("name")
        .agg(F.array_sort(F.collect_list("value")).alias("domain"))
        .withColumn("n_values", F.when(F.size("domain") <= max_domain, F.size("domain")).otherwise(refused.cast("int")))
    )


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"))


def class_counts(df: DataFrame, class_col: str) -> DataFrame:
    return df.groupBy(F.col(class_col).cast("string").alias("cls")).agg(F.count(F.lit(1)).alias("n"))


def feature_count(attributes: DataFrame, n_classes: int) -> DataFrame:
    """Features over all attributes plus the values of the class attribute."""
    total = F.coalesce(F.sum("n_values"), F.lit(0)) + F.lit(n_classes)
    return attributes.agg(total.cast("bigint").alias("n_features"))


def build_model(
    df: DataFrame,
    class_col: str,
    numeric: list[str] | None = None,
    nominal: list[str] | None = None,
    n_labels: int = 3,
    max_domain: int = 10_000,
) -> TableModel:
    """Profile the table and fix its labels: three jobs whatever the number of columns.

    Ranges and distinct counts are apart: in one aggregate the counts would keep the ranges out of the generated code.
    """
    if n_labels > WORD_BITS:
        raise ValueError(f"at most {WORD_BITS} labels per attribute")
    if numeric is None and nominal is None:
        numeric, nominal = split_columns(df, class_col)
        order = [c for c in df.columns if c in {*numeric, *nominal}]
    else:
        order = [*(numeric or []), *(nominal or [])]
    numeric, nominal = list(numeric or []), list(nominal or [])
    used = df.select(*numeric, *nominal, class_col)

    approx = [F.approx_count_distinct(F.col(c).cast("string")).alias(f"d_{c}") for c in [*nominal, class_col]]
    if len(numeric) <= AGGREGATE_CHUNK:
        aggs = []
        for i, c in enumerate(numeric):
            v = numeric_value(used, c)
            aggs += [F.expr(f"min({v}) as lo{i}"), F.expr(f"max({v}) as hi{i}")]
        span = used.agg(*aggs).head() if aggs else None
        ranges = {c: (span[f"lo{i}"], span[f"hi{i}"]) for i, c in enumerate(numeric)}
    else:
        ranges = {r["name"]: (r["min"], r["max"]) for r in profile_numeric(used, numeric).collect()}
    head = used.agg(*approx).head()
    wide = [c for c in [*nominal, class_col] if head[f"d_{c}"] > 1.2 * max_domain]
    if wide:
        raise ValueError(f"nominal columns with more than {max_domain} values: {wide}")

    domains: dict[str, list] = {c: [] for c in [*nominal, class_col]}
    for r in nominal_values(used, [*nominal, class_col]).collect():
        domains[r["name"]].append((r["value"], r["n"]))
    wide = [c for c in domains if len(domains[c]) > max_domain]
    if wide:
        raise ValueError(f"nominal columns with more than {max_domain} values: {wide}")
    for c in domains:
        domains[c].sort(key=lambda vn: vn[0])

    spark = df.sparkSession
    ranged = [(i, "numeric", *ranges[c]) for i, c in enumerate(order) if c in ranges]
    labels: dict[int, list[Label]] = {i: [] for i, *_ in ranged}
    if ranged:
        frame = spark.createDataFrame(ranged, "pos int, kind string, min double, max double")
        for r in fuzzy_labels(frame, n_labels).collect():
            labels[r["var"]].append(Label(r["label"], r["shape"], r["x0"], r["x1"], r["x2"]))
    attrs = []
    for i, c in enumerate(order):
        if c in ranges:
            mine = tuple(sorted(labels[i], key=lambda x: x.label))
            attrs.append(Attribute(i, c, "numeric", *ranges[c], (), mine))
        else:
            attrs.append(Attribute(i, c, "nominal", None, None, tuple(v for v, _ in domains[c])))
    return TableModel(
        class_col,
        tuple(attrs),
        tuple(v for v, _ in domains[class_col]),
        tuple(n for _, n in domains[class_col]),
    )
