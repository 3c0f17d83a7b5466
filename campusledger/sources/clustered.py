"""Tables laid out for small changes and point look-ups.

A clustered table is a Parquet folder partitioned by ``_part``, a range of numeric
record ids or a hash of a lower-cased text key. Rows are dealt by range of (part, key,
sort columns), so a key that holds a third of all rows still spreads over several
tasks and files, and they are sorted inside the files. Lower-cased copies of the key
and look-up columns (``_k_<column>``) carry Parquet bloom filters, each as large as the
values of its file need (a fixed size would be a megabyte for a part of a few rows).
:func:`fitted` widens the ranges of a large table, so that it has a bounded number of parts.

* A look-up of one key reads one part; in its files, and for other look-up columns in
  all files, sorting and bloom filters let the reader skip row groups.
* A change reads and rewrites the touched parts only, by Spark's dynamic partition
  overwrite; inserts add files. All other files stay as they are.

* JSON lists are parsed when a row is written: ``_f_<column>`` holds the typed list
  beside the text, and ``_l_<column>`` whether the text is a list. Screens that read
  files (O31, O41-O43) then read a few nested fields and no text.

A part that loses all its rows keeps one row marked dead (``_live`` false), as
dynamic overwrite replaces no part that it has no row for; readers leave it out.
A change is staged in the shared folder first. The swap of the parts is Spark's
commit of one write: readers of several parts may see it half done, and two changes
of one part at a time are the caller's to avoid.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from campusledger.functions.jsoncols import ATTACHMENTS, listed
from campusledger.operators.changes import Written
from campusledger.session import written


class Layout(NamedTuple):
    """``size``: ids per part for a numeric key, number of parts for a text key."""

    key: str
    size: int
    text: bool = False
    lookups: tuple[str, ...] = ()       # further columns to look rows up by, ignoring case
    sort: tuple[str, ...] = ()          # order of rows with one key
    files: str | None = None            # attachment list, stored parsed as well


IDS_PER_PART, TEXT_PARTS = 1_000_000, 4096
LAYOUTS = {
    "tbl_case_records": Layout("cr_case_id", IDS_PER_PART, lookups=("cr_student_id",)),
    "tbl_counseling_records": Layout("cor_record_id", IDS_PER_PART, lookups=("cor_student_id_number",)),
    "tbl_medical_records": Layout("mr_medical_id", IDS_PER_PART, lookups=("mr_student_id",), files="mr_attachments"),
    "tbl_notifications": Layout("n_id", IDS_PER_PART, lookups=("n_receiver",)),
    "tbl_student_data": Layout("sd_id_number", TEXT_PARTS, True, sort=("sd_school_year_semesterr",)),
    "users": Layout("u_email", TEXT_PARTS, True, ("u_username",)),
}
# The record tables once more by student, for the lists of one student.
BY_STUDENT = {
    "tbl_case_records": Layout("cr_student_id", TEXT_PARTS, True, sort=("cr_case_id",)),
    "tbl_counseling_records": Layout("cor_student_id_number", TEXT_PARTS, True, sort=("cor_record_id",)),
    "tbl_medical_records": Layout("mr_student_id", TEXT_PARTS, True, sort=("mr_medical_id",)),
}
_NO_KEY = -1
PARTS = 512                 # ranges of ids that a fitted layout makes at most
BLOOM_SIZES = 12            # sizes of a bloom filter to choose from, from 1 MB down by halves


def fitted(table: DataFrame, layout: Layout) -> Layout:
    """The layout with ranges wide enough for at most ``PARTS`` of them over the table's ids."""
    if layout.text:
        return layout
    span = F.col("b").cast("decimal(20,0)") - F.col("a").cast("decimal(20,0)") + 1      # may pass 64 bits
    row = table.agg(F.min(layout.key).alias("a"), F.max(layout.key).alias("b")).select(
        F.ceil(span / PARTS).cast("decimal(20,0)").alias("size")).first()       # one number
    return layout._replace(size=max(layout.size, int(row[0] or 0)))


def part_of(layout: Layout, key: Column) -> Column:
    """The part a key belongs to; rows without a key share one."""
    if layout.text:
        part = F.pmod(F.crc32(F.lower(key).cast("binary")), F.lit(layout.size))
    else:
        part = F.floor(key.cast("decimal(20,0)") / F.lit(layout.size))      # exact for every long
    return F.coalesce(part, F.lit(_NO_KEY)).cast("bigint")


def _copies(layout: Layout) -> list[str]:
    return [*([layout.key] if layout.text else []), *layout.lookups]


def _arranged(df: DataFrame, layout: Layout) -> DataFrame:
    keys = {f"_k_{c}": F.lower(F.col(c)) for c in _copies(layout)}
    if layout.files:
        keys |= {f"_f_{layout.files}": F.from_json(layout.files, ATTACHMENTS), f"_l_{layout.files}": listed(F.col(layout.files))}
    df = df.withColumns({**keys, "_live": F.lit(True), "_part": part_of(layout, F.col(layout.key))})
    order = ["_part", f"_k_{layout.key}" if layout.text else layout.key, *layout.sort]
    return df.repartitionByRange(*order).sortWithinPartitions(*order)


def _save(df: DataFrame, path: str, layout: Layout, mode: str) -> None:
    writer = df.write.mode(mode).partitionBy("_part").option("partitionOverwriteMode", "dynamic")
    writer = writer.option("parquet.bloom.filter.adaptive.enabled", "true") \
        .option("parquet.bloom.filter.candidates.number", str(BLOOM_SIZES))
    for c in _copies(layout):
        writer = writer.option(f"parquet.bloom.filter.enabled#_k_{c}", "true")
    writer.parquet(path)


def write_clustered(df: DataFrame, path: str, layout: Layout) -> None:
    """Write a new clustered table (``path`` must not exist)."""
    _save(_arranged(df, layout), path, layout, "errorifexists")


def _live(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).where("_live")


def _plain(df: DataFrame) -> DataFrame:
    return df.drop(*(c for c in df.columns if c in ("_part", "_live") or c[:3] in ("_k_", "_f_", "_l_")))


def read_clustered(spark: SparkSession, path: str, parsed: bool = False) -> DataFrame:
    """All rows, without the columns of the layout; with ``parsed`` the parsed lists stay."""
    rows = _live(spark, path)
    return rows.drop(*(c for c in rows.columns if c in ("_part", "_live") or c.startswith("_k_"))) if parsed else _plain(rows)


def rows_of(spark: SparkSession, path: str, layout: Layout, column: str, value) -> DataFrame:
    """The rows whose ``column`` equals ``value`` (ignoring case): only the key's part, or the row groups
    that sorting and bloom filters leave."""
    rows = _live(spark, path)
    if column == layout.key:
        key = F.lit(value)
        part = spark.range(1).select(part_of(layout, key)).first()[0]       # one number
        rows = rows.where(F.col("_part") == part)
    if column in _copies(layout):
        return _plain(rows.where(F.col(f"_k_{column}") == str(value).lower()))
    return _plain(rows.where(F.col(column) == value))


def rows_of_prefix(spark: SparkSession, path: str, column: str, prefix: str) -> DataFrame:
    """The rows whose ``column`` starts with ``prefix`` (ignoring case), by the sorted copy of the column."""
    return _plain(_live(spark, path).where(F.col(f"_k_{column}").startswith(prefix.lower())))


def insert_rows(rows: DataFrame, path: str, layout: Layout) -> None:
    """Add rows as new files."""
    _save(_arranged(rows, layout), path, layout, "append")


def change_parts(spark: SparkSession, path: str, layout: Layout, requests: DataFrame, key: str,
                 operator: Callable[[DataFrame, DataFrame], Written]) -> Written:
    """Apply ``operator(table, requests)`` to the parts that the requests' ``key`` column points to.

    For updates and deletions, which touch rows of the requested keys only (O49, O50,
    O57a). Returns the operator's outputs; ``table`` is the whole table afterwards.
    """
    return rewrite_parts(spark, path, layout, requests.select(part_of(layout, F.col(key)).alias("_part")),
                         lambda table: operator(table, requests))


def rewrite_parts(spark: SparkSession, path: str, layout: Layout, touched: DataFrame,
                  operator: Callable[[DataFrame], Written]) -> Written:
    """Apply ``operator`` to the parts listed in ``touched`` (column ``_part``) and rewrite those that exist."""
    parts = [r[0] for r in touched.distinct().collect()]        # at most the number of parts
    here = _live(spark, path).where(F.col("_part").isin(parts))
    present = [r[0] for r in here.select("_part").distinct().collect()]
    done = operator(_plain(here))
    table, rows, status = (written(df, "changes") for df in (done.table, done.rows, done.status))
    notes = None if done.notifications is None else written(done.notifications, "changes")
    new = _arranged(table, layout)
    left = {r[0] for r in new.select("_part").distinct().collect()}
    emptied = [(p,) for p in present if p not in left]
    if emptied:
        dead = spark.createDataFrame(emptied, "_part bigint").withColumn("_live", F.lit(False))
        new = new.unionByName(dead, allowMissingColumns=True)
    _save(new, path, layout, "overwrite")
    return Written(read_clustered(spark, path), rows, status, notes)
