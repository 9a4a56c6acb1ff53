"""ARFF / KEEL text tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Header keywords that are not attributes, and the numeric type names.
OTHER_KEYWORDS = ("@relation", "@data", "@inputs", "@outputs")
NUMERIC_TYPES = ("numeric", "real", "integer")

_ATTRIBUTE = re.compile(r"""^@\w+\s+(?:'([^']*)'|"([^"]*)"|([^\s{\[,]+))\s*[\s{\[,]\s*([^\s{}\[\],]*)""")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``value, file, at`` of every line; ``at`` grows within a file."""
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), at.alias("at"))


def _header_ends(lines: DataFrame) -> DataFrame:
    """``file, end``: where the header of each file with an ``@data`` line ends, one row per file."""
    marks = lines.where(F.lower(F.ltrim("value")).startswith("@data"))
    return marks.groupBy("file").agg(F.min("at").alias("end"))


def _field(line: str) -> tuple[str, bool]:
    found = _ATTRIBUTE.match(line)
    if not found:
        raise ValueError(f"cannot read header line: {line!r}")
    return next(g for g in found.groups()[:3] if g is not None), found.group(4).lower() in NUMERIC_TYPES


def arff_schema(spark: SparkSession, path: str) -> T.StructType:
    """Column names and types from the header lines, those before ``@data``.

    A folder may hold several files; files without header lines are data only, and headers that declare other
    columns than the rest are refused. Of equal headers one reaches the driver.
    """
    lines = _lines(spark, path)
    marked = lines.where(F.col("value").startswith("@")).join(F.broadcast(_header_ends(lines)), "file", "left")
    header = marked.where("end is null or at < end")
    for word in OTHER_KEYWORDS:
        header = header.where(~F.lower("value").startswith(word))
    per_file = header.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("h"))
    texts = per_file.select(F.transform("h", lambda x: x["value"]).alias("h")).distinct().limit(1000).collect()
    declared = {tuple(_field(line) for line in r["h"]) for r in texts}
    if not declared:
        raise ValueError(f"no attributes declared in {path}")
    if len(declared) > 1:
        raise ValueError(f"files of {path} declare different attributes")
    return T.StructType([T.StructField(n, T.DoubleType() if numeric else T.StringType(), True) for n, numeric in declared.pop()])


def read_arff(spark: SparkSession, path: str, null_value: str = "?", schema: T.StructType | None = None) -> DataFrame:
    """Data lines as typed columns; a malformed line fails the job.

    Lines up to ``@data`` are skipped in every file that has it, in others those that begin with ``@``; so are
    ``%`` comments and blank lines. Text is split and parsed in the JVM, so files stay splittable.
    """
    schema = schema or arff_schema(spark, path)
    lines = _lines(spark, path).where(~F.col("value").rlike(r"^\s*(%|$)"))
    body = lines.join(F.broadcast(_header_ends(_lines(spark, path))), "file", "left")
    is_data = (F.col("end").isNull() & ~F.col("value").startswith("@")) | (F.col("at") > F.col("end"))
    body = body.where(is_data)
    options = {
        "mode": "FAILFAST",
        "nullValue": null_value,
        "quote": "'",
        "ignoreLeadingWhiteSpace": "true",
        "ignoreTrailingWhiteSpace": "true",
    }
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    # Only data reaches the parser, wherever a later filter on its columns is moved to.
    parsed = body.select(F.from_csv(F.when(is_data, F.col("value")), ddl, options).alias("r"))
    return parsed.select("r.*")
