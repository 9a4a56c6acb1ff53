"""How the given tables become labelled tables, for Spark and as SQL text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patternloom.model import TableModel
from patternloom.operators.profile import build_model


@dataclass(frozen=True)
class Binding:
    tables: tuple[str, ...]
    sql: str
    cls: str
    numeric: tuple[str, ...]
    nominal: tuple[str, ...]
    key: str | None = None
    n_labels: int = 3

    def load(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in self.tables}
        return LOADERS[self](frames)

    def model(self, df: DataFrame) -> TableModel:
        return build_model(df, self.cls, list(self.numeric), list(self.nominal), self.n_labels)


ORDERS = Binding(
    ("orders",),
    "SELECT o_orderkey, o_totalprice, o_orderpriority, o_orderstatus FROM orders",
    "o_orderstatus",
    ("o_totalprice",),
    ("o_orderpriority",),
    "o_orderkey",
)
LINES = Binding(
    ("lineitem",),
    "SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_linestatus, l_returnflag FROM lineitem",
    "l_returnflag",
    ("l_quantity", "l_extendedprice", "l_discount", "l_tax"),
    ("l_linestatus",),
)
PLANTED = Binding(
    ("lineitem",),
    "SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_linestatus, "
    "CASE WHEN l_discount > 0.075 AND l_quantity > 37.75 THEN 'hot' ELSE 'cold' END AS kind FROM lineitem",
    "kind",
    ("l_quantity", "l_extendedprice", "l_discount", "l_tax"),
    ("l_linestatus",),
)
CUSTOMERS = Binding(
    ("customer", "nation", "region"),
    "SELECT c_custkey, c_acctbal, r_name, n_name, c_mktsegment FROM customer "
    "JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "c_mktsegment",
    ("c_acctbal",),
    ("r_name", "n_name"),
    "c_custkey",
)
EVENTS = Binding(
    ("events",),
    "SELECT event_id, value, CAST(hour(ts) AS INTEGER) AS hour, props, event_type FROM events",
    "event_type",
    ("value", "hour"),
    ("props",),
    "event_id",
)
DOCUMENTS = Binding(
    ("documents", "labels"),
    "SELECT doc_id, n_chars, lang, source, CAST(quality AS VARCHAR) AS quality "
    "FROM documents JOIN labels USING (doc_id)",
    "quality",
    ("n_chars",),
    ("lang", "source"),
    "doc_id",
)
VECTOR_SIZE = 64
VECTORS = Binding(
    ("embeddings",),
    "SELECT vec_id, "
    + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS e{i}" for i in range(VECTOR_SIZE))
    + ", CAST(label AS VARCHAR) AS label FROM embeddings",
    "label",
    tuple(f"e{i}" for i in range(VECTOR_SIZE)),
    (),
    "vec_id",
)
# One numeric and one nominal value in ten missing, as given tables hold no nulls.
GAPS = Binding(
    ("orders",),
    "SELECT o_orderkey, CASE WHEN o_custkey % 10 <> 0 THEN o_totalprice END AS price, "
    "CASE WHEN o_custkey % 10 <> 1 THEN o_orderpriority END AS priority, o_orderstatus FROM orders",
    "o_orderstatus",
    ("price",),
    ("priority",),
    "o_orderkey",
)
DEGENERATE = Binding(
    ("orders",),
    "SELECT o_orderkey, o_totalprice, CAST(7.0 AS DOUBLE) AS constant, CAST(NULL AS DOUBLE) AS missing, "
    "o_orderpriority, o_orderstatus FROM orders",
    "o_orderstatus",
    ("o_totalprice", "constant", "missing"),
    ("o_orderpriority",),
    "o_orderkey",
)


def _planted(f):
    hot = (F.col("l_discount") > 0.075) & (F.col("l_quantity") > 37.75)
    return f["lineitem"].withColumn("kind", F.when(hot, F.lit("hot")).otherwise(F.lit("cold")))


def _customers(f):
    # Dimension tables join on their keys; the planner broadcasts them by their file size.
    return (
        f["customer"]
        .join(f["nation"], F.col("c_nationkey") == F.col("n_nationkey"))
        .join(f["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    )


def _documents(f):
    joined = f["documents"].select("doc_id", "n_chars", "lang", "source").join(f["labels"], "doc_id")
    return joined.withColumn("quality", F.col("quality").cast("string"))


def _vectors(f):
    # Another width is an error, not a prefix.
    vector = F.when(F.size("embedding") == VECTOR_SIZE, F.col("embedding")).otherwise(F.raise_error(F.lit("vector of another size")))
    parts = [vector[i].cast("double").alias(f"e{i}") for i in range(VECTOR_SIZE)]
    return f["embeddings"].select("vec_id", *parts, F.col("label").cast("string").alias("label"))


def _gaps(f):
    return f["orders"].select(
        "o_orderkey",
        F.when(F.col("o_custkey") % 10 != 0, F.col("o_totalprice")).alias("price"),
        F.when(F.col("o_custkey") % 10 != 1, F.col("o_orderpriority")).alias("priority"),
        "o_orderstatus",
    )


def _degenerate(f):
    return f["orders"].withColumns({"constant": F.lit(7.0), "missing": F.lit(None).cast("double")})


LOADERS = {
    ORDERS: lambda f: f["orders"],
    LINES: lambda f: f["lineitem"],
    PLANTED: _planted,
    CUSTOMERS: _customers,
    EVENTS: lambda f: f["events"].withColumn("hour", F.hour("ts")),
    DOCUMENTS: _documents,
    VECTORS: _vectors,
    GAPS: _gaps,
    DEGENERATE: _degenerate,
}
