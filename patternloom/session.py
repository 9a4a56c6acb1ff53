"""Session helpers: where lineage is cut, and a builder for local runs."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

_shipped: set[str] = set()


def local_session(cores: int | str = "*", app: str = "patternloom", **conf) -> SparkSession:
    """Small local session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared folder the cluster names; fall back only in local mode."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        named = tempfile.mkdtemp(prefix="patternloom-checkpoint-")
    sc.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and read them back.

    The result survives the loss of executors, and unlike a checkpointed plan it carries
    real sizes, so the planner's estimates do not compound over the rounds of a loop.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/patternloom/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows that the driver holds, of a number that a parameter bounds, as a table.

    By way of Arrow they become a part of the plan, whose size the planner knows; a list of tuples would be dealt out to the
    cluster, and each use of it would be a job of as many tasks as there are cores.
    """
    fields = StructType.fromDDL(schema).fields
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    kinds = to_arrow_schema(StructType(fields))
    return spark.createDataFrame(pa.table([pa.array(c, k.type) for c, k in zip(columns, kinds)], schema=kinds), StructType(fields))


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Functions that run in workers refer to the package; installed clusters have it, others get a zip.
    Rows may be whole texts: unless the session says otherwise, 1,000 of them go to a worker at a time.
    """
    sc = spark.sparkContext
    if BATCH_ROWS not in spark.conf.getAll:
        spark.conf.set(BATCH_ROWS, "1000")
    if sc.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    target = Path(SparkFiles.getRootDirectory()) / "built" / "patternloom.zip"
    target.parent.mkdir(exist_ok=True)
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)
