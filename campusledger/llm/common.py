"""Shared helpers: reading tables, writing intermediate tables, Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from campusledger.session import checkpoint_dir

# Rows per Arrow batch handed to Python. Texts can be long, so batches are cut
# small: a batch of ordinary documents is then well under a few megabytes.
ARROW_ROWS = 256
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back.

    This cuts the lineage: a lost executor then costs a re-read, not a re-run.
    The folder is the one the cluster names in ``spark.checkpoint.dir``. Once
    the table is written the step's shuffle files are of no use, so Spark is
    asked to delete them when the write ends, and the disk a chain of steps
    needs is that of its largest step.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table._stored_at = path
    return table


def release(*tables: DataFrame) -> None:
    """Delete tables that :func:`stored` wrote, once nothing reads them any more.

    Only for tables whose dependants are all written themselves: a lost executor then
    has nothing to recompute from them. Other DataFrames are left alone.
    """
    for table in tables:
        path = getattr(table, "_stored_at", None)
        if path:
            spark = table.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
            table._stored_at = None


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Keep the batches that Python workers get small (memory, long texts)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def keyed_rows(docs: DataFrame) -> DataFrame:
    """``docs`` as ``row`` (a struct of all its columns) and ``key``, one long per distinct (doc_id, text).

    The key is the ``doc_id``, but where rows repeat a ``doc_id`` with other texts the
    others get keys of their own (hashes, above 2**62, so that plain ids come first).
    Rows equal in both share a key; without a ``doc_id`` the key is null.
    """
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    rows = rows.select("row", F.col("row.doc_id").cast("long").alias("id"), F.xxhash64("row.text").alias("text_hash"))
    seen = rows.where(F.col("id").isNotNull()).select("id", "text_hash").distinct()
    several = seen.groupBy("id").agg(F.min("text_hash").alias("first"), F.max("text_hash").alias("last")).where("first != last")
    own = F.xxhash64("id", "text_hash").bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    others = stored(seen.join(several, "id").where("text_hash != first").select("id", "text_hash", own.alias("own")), "keys")
    return (rows.join(others, ["id", "text_hash"], "left")
            .select("row", F.coalesce("own", "id").alias("key")))


def crc32_bucket(key: str, buckets: int):
    """``crc32(key as text) mod buckets`` as a Column."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(buckets))


def record_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema)],
        schema=schema)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; a null text reads as the empty text."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def each_batch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            yield b
