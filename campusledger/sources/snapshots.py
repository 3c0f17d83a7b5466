"""Versioned table writes.

A batch change produces whole new tables. Each is written to a **new** folder
``<root>/<table>/<version>``, and only after every write of the batch succeeded
one row per table is appended to the log table ``<root>/_published``. Readers
take, per table, the version of the latest logged batch, so they never see a
half-written version and never read a folder that is being overwritten. Two
batches that publish at the same time both stay in the log; of a table that
both wrote, the later one counts. Everything goes through Spark's own readers
and writers, so any storage Spark can use will do.
"""

from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "_published"
LOG_SCHEMA = "batch string, name string, version string"
_ONE = "_table"


def _new_version() -> str:
    return f"v{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"


def current_manifest(spark: SparkSession, root: str) -> dict[str, str]:
    """Table name -> folder below ``root`` of its latest published version."""
    try:
        log = spark.read.schema(LOG_SCHEMA).parquet(f"{root}/{LOG}")
        rows = log.groupBy("name").agg(F.max_by("version", "batch").alias("version")).collect()
    except AnalysisException:       # nothing published yet
        return {}
    return {r["name"]: f"{r['name']}/{r['version']}" for r in rows}


def write_batch(outputs: dict[str, DataFrame], root: str, partition_by: list[str] | None = None,
                max_records_per_file: int | None = None) -> dict[str, str]:
    """Write every output of one batch (new tables, derived rows) as a new
    version, then publish them together. Returns the new manifest.

    Tables not in ``outputs`` keep their version. A failure before the log entry
    leaves every table at its previous version.
    """
    spark = next(iter(outputs.values())).sparkSession
    written = []
    for name, df in outputs.items():
        version = _new_version()
        writer = df.write.mode("errorifexists")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        if max_records_per_file:
            writer = writer.option("maxRecordsPerFile", str(max_records_per_file))
        writer.parquet(f"{root}/{name}/{version}")
        written.append((name, version))
    batch = _new_version()
    entries = spark.createDataFrame([(batch, n, v) for n, v in written], LOG_SCHEMA)
    entries.coalesce(1).write.mode("append").parquet(f"{root}/{LOG}")
    return current_manifest(spark, root)


def read_batch_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    folder = current_manifest(spark, root).get(name)
    if folder is None:
        raise FileNotFoundError(f"table {name} not published under {root}")
    return spark.read.parquet(f"{root}/{folder}")


# ---- one table ----------------------------------------------------------------------

def current_version(spark: SparkSession, root: str) -> str | None:
    folder = current_manifest(spark, root).get(_ONE)
    return folder.split("/")[-1] if folder else None


def read_snapshot(spark: SparkSession, root: str) -> DataFrame:
    return read_batch_table(spark, root, _ONE)


def write_snapshot(df: DataFrame, root: str, partition_by: list[str] | None = None,
                   max_records_per_file: int | None = None) -> str:
    """Write ``df`` as a new version of the one table under ``root``."""
    return write_batch({_ONE: df}, root, partition_by, max_records_per_file)[_ONE].split("/")[-1]
